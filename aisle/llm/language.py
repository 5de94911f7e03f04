"""Language identification by interpolated Kneser-Ney character trigram models.

One model per language is estimated from n-gram counts that Spark sums over all
training texts. Letters are folded to 128 symbols, so a model has at most 2²¹
trigrams whatever the corpus; it is held as one sorted array of packed trigrams with
the log-probability in each language beside it. A text is scored by its cross-entropy
in bits per symbol, and the lowest wins. Two calibrations come from all training
texts: the temperature that turns cross-entropies into probabilities (lowest log
loss), and per language the middle and the spread of the cross-entropy. Both are
medians, so texts of another kind among the training texts do not move them much, and
the spread is of a letter, so a short text may deviate more than a long one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm import letters
from aisle.llm.batches import chunks
from aisle.llm.shared import written

MAX_LANGUAGES = 256
TEMPERATURES = [0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0]
"""Multipliers of the cross-entropy that calibration chooses from."""
UNKNOWN = "und"
BITS = letters.SYMBOL_BITS
CHUNK = 1 << 19
"""Bytes of text worked on at once; a longer single text is one chunk of its own."""
BLOCK = 1 << 18
"""Symbols scored at once, in all languages; bounds a task's memory whatever the text."""


class Model(NamedTuple):
    languages: list[str]
    trigrams: np.ndarray
    """Sorted packed trigrams seen in any language."""
    log_p: np.ndarray
    """log₂ probability of each trigram's last symbol, per language."""
    contexts: np.ndarray
    """Sorted packed histories of two symbols."""
    log_backoff: np.ndarray
    """log₂ weight left to the lower order after each history, per language."""
    log_bigram: np.ndarray
    """log₂ probability of every symbol after every other, per language."""


def _tally(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams and how often each occurs."""
    if len(grams) < 1 << 17:
        return np.unique(grams, return_counts=True)
    n = np.bincount(grams, minlength=1 << 3 * BITS)
    seen = np.flatnonzero(n)
    return seen, n[seen]


def _gram_counts(training: DataFrame) -> DataFrame:
    """(lang, gram, n) over the whole texts of (text, lang)."""
    def count(batches):
        for batch in batches:
            labels = batch.column("lang").dictionary_encode()
            names = labels.dictionary.to_pylist()
            label = np.asarray(labels.indices)
            for row, data, offsets in chunks(batch.column("text"), CHUNK):
                symbols, bounds, _ = letters.sequences(data, offsets)
                packed, ends = letters.histories(symbols, bounds, 3)
                text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                for k in range(len(names)):
                    seen, n = _tally(packed[label[row + text] == k])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[k]] * len(seen), pa.string()), pa.array(seen, pa.int64()), pa.array(n, pa.int64())],
                        ["lang", "gram", "n"])

    return training.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once else 0.5


def _estimate(gram: np.ndarray, n: np.ndarray, all_grams: np.ndarray, all_contexts: np.ndarray):
    """Kneser-Ney tables of one language: (log_p of all_grams, log_backoff of all_contexts, log_bigram)."""
    size = 1 << BITS
    low = size * size - 1
    # order 1: in how many bigram types a symbol ends; order 2: in how many trigram types a bigram ends
    follow = np.bincount(gram & low, minlength=size * size).reshape(size, size).astype(float)
    types = follow > 0
    ends = types.sum(0).astype(float)
    d1 = _discount(ends[ends > 0])
    unigram = (np.maximum(ends - d1, 0) + d1 * (ends > 0).sum() / size) / max(ends.sum(), 1) if ends.sum() else np.full(size, 1 / size)
    d2 = _discount(follow[types])
    row = follow.sum(1, keepdims=True)
    bigram = np.where(row > 0, (np.maximum(follow - d2, 0) + d2 * types.sum(1, keepdims=True) * unigram) / np.maximum(row, 1), unigram)
    d3 = _discount(n)
    total = np.bincount(gram >> BITS, weights=n, minlength=size * size)
    kinds = np.bincount(gram >> BITS, minlength=size * size)
    left = np.where(total > 0, d3 * kinds / np.maximum(total, 1), 1.0)
    at = np.searchsorted(gram, all_grams)
    mine = np.where(gram[np.minimum(at, len(gram) - 1)] == all_grams, n[np.minimum(at, len(gram) - 1)], 0) if len(gram) else np.zeros(len(all_grams))
    context, last = all_grams >> BITS, all_grams & (size - 1)
    lower = bigram[context & (size - 1), last]
    p = np.maximum(mine - d3, 0) / np.maximum(total[context], 1) + left[context] * lower
    return np.log2(p), np.log2(left[all_contexts]), np.log2(bigram)


def train(training: DataFrame) -> Model:
    """The model of every language in (text, lang); texts of a null lang are ignored."""
    found = _gram_counts(training.where("lang IS NOT NULL")).toArrow()  # at most 2^21 rows a language
    languages = sorted(found.column("lang").unique().to_pylist())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"{len(languages)} values of lang; at most {MAX_LANGUAGES} are languages")
    lang, gram, n = np.asarray(found.column("lang")), np.asarray(found.column("gram")), np.asarray(found.column("n"))
    all_grams = np.unique(gram)
    contexts = np.unique(all_grams >> BITS)
    tables = []
    for name in languages:
        mine = lang == name
        order = np.argsort(gram[mine])
        tables.append(_estimate(gram[mine][order], n[mine][order].astype(float), all_grams, contexts))
    stack = lambda k: np.stack([t[k] for t in tables], -1).astype(np.float32) if tables else np.zeros((0, 0), np.float32)
    return Model(languages, all_grams, stack(0), contexts, stack(1), stack(2))


def _log_p(model: Model, packed: np.ndarray) -> np.ndarray:
    """log₂ probability of the last symbol of each packed trigram, per language."""
    at = np.minimum(np.searchsorted(model.trigrams, packed), max(len(model.trigrams) - 1, 0))
    known = model.trigrams[at] == packed
    rows = np.empty((len(packed), len(model.languages)), np.float32)
    rows[known] = model.log_p[at[known]]
    new = packed[~known]
    context = new >> BITS
    where = np.minimum(np.searchsorted(model.contexts, context), max(len(model.contexts) - 1, 0))
    left = np.where((model.contexts[where] == context)[:, None], model.log_backoff[where], 0)
    rows[~known] = left + model.log_bigram[context & ((1 << BITS) - 1), new & ((1 << BITS) - 1)]
    return rows


def cross_entropies(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits per symbol of each text in each language."""
    packed, ends = letters.histories(symbols, bounds, 3)
    bits = np.zeros((len(ends) - 1, len(model.languages)))
    for a in range(0, len(packed), BLOCK):
        b = min(a + BLOCK, len(packed))
        total = np.zeros((b - a + 1, len(model.languages)))
        np.cumsum(_log_p(model, packed[a:b]), axis=0, dtype=np.float64, out=total[1:])
        inside = np.clip(ends, a, b) - a  # a text over several blocks is summed block by block
        bits -= total[inside[1:]] - total[inside[:-1]]
    return bits / np.maximum(np.diff(ends), 1)[:, None]


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with n_letters and cross_entropy array<float>, in the order of ``model.languages``."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text"), CHUNK):
                symbols, bounds, count = letters.sequences(data, offsets)
                values = cross_entropies(held.value, symbols, bounds).astype(np.float32)
                part = batch.slice(row, len(count))
                flat = pa.ListArray.from_arrays(np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)[: len(count) + 1], pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in part.schema.names if c != "text"] + [pa.array(count, pa.int64()), flat],
                    [c for c in part.schema.names if c != "text"] + ["n_letters", "cross_entropy"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != "text")
    return documents.mapInArrow(run, f"{kept}, n_letters long, cross_entropy array<float>")


def identify(
    documents: DataFrame, training: Column, deviations: float = 8.0, slack_bits: float = 0.5, row_key: Column | None = None,
) -> DataFrame:
    """The language of every text of (doc_id, text, lang).

    ``training`` says which rows may be learned from; those with a null lang are not.
    ``row_key``, if given, is returned as row_key beside doc_id, to find rows by their text.
    Returns per row doc_id, is_training, lang_pred, score (calibrated probability, 0 to
    1), cross_entropy of lang_pred and accepted. A text that is null or has no letter
    has lang_pred ``und``, score 0 and is not accepted. A text is not accepted either
    if its cross-entropy is over the calibrated bound of its language: the median of the
    training texts of that lang predicted so, plus ``slack_bits``, plus ``deviations`` times their
    spread over the square root of the text's number of letters. The spread is 1.4826 times the median
    of |cross-entropy - median| * sqrt(letters).
    Equal scores go to the first language by name. Without training rows all are ``und``.
    """
    key = [] if row_key is None else [row_key.alias("row_key")]
    names_kept = ["doc_id", "is_training", *(["row_key"] if key else [])]
    rows = documents.select("doc_id", "text", "lang", F.coalesce(training, F.lit(False)).alias("is_training"), *key)
    model = train(rows.where("is_training"))
    if not model.languages:
        return rows.select(*names_kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("accepted"))
    scored = written(score(rows, model), "language")
    names = F.array(*map(F.lit, model.languages))
    best = F.array_min("cross_entropy")
    at = F.array_position("cross_entropy", best).cast("int")
    chosen = F.when(F.col("n_letters") > 0, F.element_at(names, at)).otherwise(F.lit(UNKNOWN))
    scored = scored.withColumns({"best": best.cast("double"), "lang_pred": chosen})

    def probability(t, of):
        """Share of ``of``'s weight 2^(-t * cross-entropy) in all languages' weights."""
        total = F.aggregate("cross_entropy", F.lit(0.0), lambda s, x: s + F.pow(F.lit(2.0), t * (of - x)))
        return F.lit(1.0) / total

    position = F.array_position(names, F.col("lang")).cast("int")
    truth = F.element_at("cross_entropy", position).cast("double")
    used = scored.where("is_training AND n_letters > 0 AND lang IS NOT NULL")
    losses = used.agg(*[F.avg(-F.log(F.greatest(probability(F.lit(t), truth), F.lit(1e-12)))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]).first()
    loss = [losses[i] if losses[i] is not None else 0.0 for i in range(len(TEMPERATURES))]
    t = TEMPERATURES[int(np.argmin(loss))]
    right = used.where("lang_pred = lang")
    middles = {r["lang"]: r["m"] for r in right.groupBy("lang").agg(F.percentile_approx("best", 0.5, 10_000).alias("m")).collect()}

    def by_language(values: dict[str, float]) -> Column:  # one value per language
        pairs = F.create_map(*[F.lit(v) for pair in values.items() for v in pair]) if values else F.create_map(F.lit(""), F.lit(0.0))
        return F.try_element_at(pairs, F.col("lang_pred"))

    off = F.abs(F.col("best") - by_language(middles)) * F.sqrt("n_letters")
    spreads = {r["lang"]: 1.4826 * r["s"] for r in right.groupBy("lang").agg(F.percentile_approx(off, 0.5, 10_000).alias("s")).collect()}
    limit = by_language(middles) + slack_bits + deviations * by_language(spreads) / F.sqrt("n_letters")
    accepted = (F.col("n_letters") > 0) & F.coalesce(F.col("best") <= limit, F.lit(False))
    return scored.select(
        *names_kept, "lang_pred",
        F.when(F.col("n_letters") > 0, probability(F.lit(t), F.col("best"))).otherwise(F.lit(0.0)).alias("score"),
        F.when(F.col("n_letters") > 0, F.col("best")).alias("cross_entropy"), accepted.alias("accepted"),
    )
