"""Phrase collocations by Toivonen's mining: a sample proposes, full passes decide.

A share of the texts proposes which phrases are frequent, at a lowered threshold. A full
pass then counts, exactly and in all texts, every phrase whose first and last parts (all
words but the last, all but the first) are proposed: these are the proposed phrases and
their negative border. A phrase of the border that turns out frequent is a failure: it
joins the proposed ones, and another full pass counts the border that this adds. When no
failure is left, no uncounted phrase can be frequent, since it would have a part that
is infrequent; so the result does not depend on the sample.

Texts are worked on in chunks, as arrays of 64-bit word hashes. The proposed phrases are
held by the tasks as a bitmap of a fixed size: two phrases that share a bit only make a
pass count more than it must, never less. The first full pass, whose border is large,
counts names of 64 bits, in narrow rows; the words of the frequent names come from the
sample, and from a further pass for names that it does not hold. Rows that are shuffled are distinct phrases of many chunks, not occurrences.
Words are named by 64-bit hashes, phrases by their words' names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.llm.batches import _SALT, Words, chunks, mix
from aisle.llm.shared import written

MOST_WORDS = 4
SAMPLE = 0.125
"""Share of the texts that proposes phrases; the result does not depend on it."""
LEAST_BITS, MOST_BITS = 16, 27
"""The tasks hold proposed phrases as eight bits or more for each word of the sample, from 2^16 to 2^27 (16 MB)."""
CHUNK = 1 << 18
"""Bytes of text worked on at once; a longer single text is one chunk of its own."""
HELD = 1 << 22
"""Occurrences that a task holds until it counts them (of phrases by their words: a quarter)."""
ROWS = 1 << 16
"""Rows of a batch that a task returns."""
UNKNOWN = "und"

_PART = np.zeros(256, bool)
_PART[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = True
_BLANK = _PART.copy()
_BLANK[[0x20, 0x09]] = True
WORDS = [f"w{i + 1}" for i in range(MOST_WORDS)]


class _Pieces(Words):
    """The words of a chunk of texts; ``doc`` numbers pieces, ``text`` the texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        super().__init__(data, offsets, ~_BLANK[data])
        self.text = self.doc
        breaks = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_PART[data], out=breaks[1:])
        self.doc = self.text + breaks[self.start]


def _grams(
    words: _Pieces, hashes: np.ndarray, label: np.ndarray, size: int, at: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(first word, 64-bit name within the language) of all phrases of ``size`` words, or of those that begin ``at``."""
    at, names = words.windows(hashes, size, at)
    return at, mix(names ^ label[words.text[at]])


def _bits(names: np.ndarray, width: int) -> np.ndarray:
    return (names >> np.uint64(64 - width)).astype(np.int64)


def _held(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    bits = _bits(names, len(bitmap).bit_length() + 2)
    return (bitmap[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases (lang, w1 … w4, k) with the names that :func:`_grams` gives them."""
    for batch in batches:
        labels = batch.column("lang").dictionary_encode()
        label = _labels(labels.dictionary.to_pylist())[np.asarray(labels.indices)]
        total = np.asarray(batch.column("k")).astype(np.uint64)
        for salt, word in zip(_SALT, WORDS):  # words that a phrase has not are 0
            total += np.asarray(batch.column(word)).view(np.uint64) * salt
        name = mix(mix(total) ^ label).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("lang", *WORDS, "k")), pa.array(name)], ["lang", *WORDS, "k", "name"])


def named(phrases: DataFrame) -> DataFrame:
    """Phrases (lang, w1 … w4, k) with their 64-bit ``name``."""
    return phrases.select("lang", *WORDS, "k").mapInArrow(_named, SCHEMA.replace(", n long", ", name long"))


def _labels(names: list[str]) -> np.ndarray:
    """A 64-bit number for each language."""
    return np.array([xxhash.xxh64_intdigest(n) for n in names], np.uint64)


SCHEMA = "lang string, " + ", ".join(f"{w} long" for w in WORDS) + ", k int, n long"


def _runs(names: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin in sorted ``names``."""
    return np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))


def _batches(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    yield from pa.table(columns).to_batches(max_chunksize=ROWS)


def _count_rows(lang: str, words: list[np.ndarray], size: int, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    words = [w.view(np.int64) for w in words] + [np.zeros(len(n), np.int64)] * (MOST_WORDS - len(words))
    yield from _batches({
        "lang": pa.array([lang]).take(pa.array(np.zeros(len(n), np.int8))), **dict(zip(WORDS, words, strict=True)),
        "k": np.full(len(n), size, np.int32), "n": n.astype(np.int64)})


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))


def _chunked(batches: Iterator[pa.RecordBatch]):
    """(language, words, word names, label of each text) of one language's texts at a time."""
    for batch in batches:
        labels = batch.column("lang").dictionary_encode()
        names = labels.dictionary.to_pylist()
        index = np.asarray(labels.indices)
        numbers = _labels(names)
        for k, name in enumerate(names):
            mine = batch.column("text").filter(pa.array(index == k))
            for _, data, offsets in chunks(mine, CHUNK):
                words = _Pieces(data, offsets)
                yield name, words, words.hashes(lower=True), np.full(len(offsets) - 1, numbers[k])


def _border(
    words: _Pieces, hashes: np.ndarray, label: np.ndarray, sizes: tuple[int, ...], new: np.ndarray | None, old: np.ndarray | None,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, first words, names) of the phrases of a chunk that a pass counts: see :func:`names`."""
    if new is None:
        for size in sizes:
            yield size, *_grams(words, hashes, label, size)
        return
    held = known = None  # by first word: whether the phrase that is a word shorter, and all it holds, are in a bitmap
    for size in range(max(1, min(sizes) - 1), max(sizes) + 1):
        at = None if held is None else np.flatnonzero(held[:-1] & held[1:])
        at, found = _grams(words, hashes, label, size, at)
        before = None if known is None else known[at] & known[at + 1]
        if size in sizes:
            yield (size, at, found) if before is None else (size, at[~before], found[~before])
        if size < max(sizes):  # longer phrases hold proposed ones only
            held = np.zeros(len(hashes) + 1, bool)
            held[at] = _held(new, found)
            if old is not None:
                known = np.zeros(len(hashes) + 1, bool)
                known[at] = _held(old, found) if before is None else before & _held(old, found)


def names(documents: DataFrame, sizes: tuple[int, ...], proposed: np.ndarray | None = None, known: np.ndarray | None = None) -> DataFrame:
    """(name, n): occurrences in all texts of (text, lang) of the phrases of ``sizes`` words, by their 64-bit names.

    With ``proposed`` only phrases whose parts, down to single words, are all in that bitmap, and
    with ``known`` those of them that have a part outside that one (the others are counted).
    """
    maps = documents.sparkSession.sparkContext.broadcast((proposed, known))

    def tally(held):
        found = np.concatenate(held)
        found.sort()
        first = _runs(found)
        yield from _batches({"name": found[first].view(np.int64), "n": np.diff(first, append=len(found)).astype(np.int32)})

    def run(batches):
        held, count = [], 0
        for _, words, hashes, label in _chunked(batches):
            for _, _, found in _border(words, hashes, label, sizes, *maps.value):
                held.append(found)
                count += len(found)
            if count >= HELD:
                yield from tally(held)
                held, count = [], 0
        if count:
            yield from tally(held)

    rows = _texts(documents).mapInArrow(run, "name long, n int").repartition("name")  # few names would meet before it
    return rows.groupBy("name").agg(F.sum("n").alias("n"))


def counts(
    documents: DataFrame, sizes: tuple[int, ...], proposed: np.ndarray, known: np.ndarray | None = None, wanted: np.ndarray | None = None,
) -> DataFrame:
    """(lang, w1 … w4, k, n): occurrences of the phrases of :func:`names`, with ``wanted`` only of those with a name in that bitmap."""
    maps = documents.sparkSession.sparkContext.broadcast((proposed, known, wanted))

    def tally(held):
        for lang, (hashes, by_size, _) in held.items():
            hashes = np.concatenate(hashes)
            for size, parts in by_size.items():
                found, first = (np.concatenate(p) for p in zip(*parts, strict=True))
                order = np.argsort(found)
                begin = _runs(found[order])
                one = first[order[begin]]
                yield from _count_rows(lang, [hashes[one + i] for i in range(size)], size, np.diff(begin, append=len(found)))

    def run(batches):
        new, old, wanted = maps.value
        held, count = {}, 0
        for lang, words, hashes, label in _chunked(batches):
            seen, by_size, total = held.get(lang, ([], {}, 0))
            for size, at, found in _border(words, hashes, label, sizes, new, old):
                if wanted is not None:
                    mine = _held(wanted, found)
                    at, found = at[mine], found[mine]
                if len(at):
                    by_size.setdefault(size, []).append((found, at + total))
                    count += len(at)
            seen.append(hashes)
            held[lang] = seen, by_size, total + len(hashes)
            count += len(hashes)
            if count >= HELD >> 2:
                yield from tally(held)
                held, count = {}, 0
        yield from tally(held)

    return _texts(documents).mapInArrow(run, SCHEMA).groupBy("lang", *WORDS, "k").agg(F.sum("n").alias("n"))


def totals(documents: DataFrame) -> DataFrame:
    """(lang, total): all words of each language of (text, lang)."""
    def run(batches):
        for batch in batches:
            langs = pc.unique(batch.column("lang"))
            texts = [batch.column("text").filter(pc.equal(batch.column("lang"), lang)) for lang in langs]
            words = [sum(len(_Pieces(data, offsets).start) for _, data, offsets in chunks(text, CHUNK)) for text in texts]
            yield pa.RecordBatch.from_arrays([langs, pa.array(words, pa.int64())], ["lang", "total"])

    return _texts(documents).mapInArrow(run, "lang string, total long").groupBy("lang").agg(F.sum("total").alias("total"))


def bitmap(names: DataFrame, width: int) -> np.ndarray:
    """The column ``name`` as a bitmap of 2^``width`` bits, OR-ed by Spark in words of 64."""
    bit = f"shiftrightunsigned(name, {64 - width})"
    rows = names.selectExpr(f"shiftrightunsigned({bit}, 6) AS word", f"shiftleft(1L, cast({bit} & 63 AS int)) AS flags")
    found = rows.groupBy("word").agg(F.bit_or("flags").alias("flags")).toArrow()  # at most 2^21 rows
    whole = np.zeros(1 << width - 6, np.uint64)
    whole[np.asarray(found.column("word"))] = np.asarray(found.column("flags")).view(np.uint64)
    return whole.view(np.uint8)


def frequent(documents: DataFrame, least: int = 30, share: float = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """((lang, w1 … w4, k, n) with n >= ``least``, (lang, n of all its words)), exact over all texts.

    ``share`` of the texts, picked by a hash of the text, proposes the phrases found
    three quarters of ``least`` * ``share`` times in it (twice at least).
    """
    picked = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = written(_texts(documents).where(picked), "sample")
    lowered = F.col("n") >= max(2, math.ceil(least * share * 3 / 4))
    often = F.col("n") >= least
    words = written(names(sample, (1,)), "names")
    width = min(max((words.agg(F.sum("n")).first()[0] or 0).bit_length() + 3, LEAST_BITS), MOST_BITS)
    proposed = bitmap(words.where(lowered), width)
    for size in range(2, MOST_WORDS + 1):  # within the sample, size by size
        proposed = proposed | bitmap(names(sample, (size,), proposed).where(lowered), width)
    sizes = tuple(range(1, MOST_WORDS + 1))
    counted = written(names(documents, sizes, proposed).where(often), "names")
    grown = bitmap(counted, width)
    parts = proposed & grown  # all parts of a frequent phrase of the border are in both
    found = written(named(counts(sample, sizes, parts, wanted=grown)).join(counted, "name"), "counts")
    missing = written(counted.join(found, "name", "left_anti"), "names")
    if not missing.isEmpty():
        rest = named(counts(documents, sizes, parts, wanted=bitmap(missing, width)))
        found = found.unionByName(written(rest.join(missing, "name"), "counts"))
    found, known = found.drop("name"), proposed
    grown = known | grown
    while not np.array_equal(grown, known):  # each pass settles one more size at least, so there are at most MOST_WORDS - 1
        added = written(counts(documents, sizes[1:], grown, known).where(often), "counts")
        found = found.unionByName(added)
        known, grown = grown, grown | bitmap(named(added), width)
    return written(found, "frequent"), written(totals(documents), "totals")


def _key(names: list[Column | str]) -> list[Column]:
    """Words padded with 0 to the width of a key."""
    columns = [F.col(n) if isinstance(n, str) else n for n in names]
    return [*columns, *[F.lit(0).cast("long")] * (MOST_WORDS - len(columns))]


def _parts(rows: DataFrame, spans: list[tuple[int, int, int]], *more: str) -> DataFrame:
    """For phrases of size words and each span (size, first, stop): the part as p1 … p4, with ``more``."""
    def part(first, stop, tag):
        return F.struct(*[c.alias(f"p{i + 1}") for i, c in enumerate(_key(WORDS[first:stop]))], F.lit(tag).alias("cut"))

    by_size = F.lit(None)
    for size in sorted({s for s, _, _ in spans}, reverse=True):
        here = F.array(*[part(first, stop, stop if first == 0 else first) for s, first, stop in spans if s == size])
        by_size = F.when(F.col("k") == size, here).otherwise(by_size)
    return rows.select("lang", *more, F.explode(by_size).alias("x")).select("lang", *more, "x.*")


def scored(found: DataFrame, longest: int = MOST_WORDS, scale: int = 2_000_000) -> DataFrame:
    """Phrases of two words or more with the counts l and r of the parts of their lowest-scoring cut, and that score.

    The score of a cut is floor(scale * n / (l + r)); equal scores go to the earlier cut.
    """
    phrases = found.where("k >= 2")
    cuts = [(s, c) for s in range(2, longest + 1) for c in range(1, s)]
    count = found.select("lang", *[F.col(w).alias(f"p{i + 1}") for i, w in enumerate(WORDS)], F.col("n").alias("part_n"))
    on = ["lang", "p1", "p2", "p3", "p4"]
    left = _parts(phrases, [(s, 0, c) for s, c in cuts], *WORDS, "k", "n").join(count.withColumnRenamed("part_n", "l"), on).drop(*on[1:])
    sides = left.withColumn("right_words", F.expr(
        f"slice(array({', '.join(WORDS)}, 0, 0, 0, 0), cut + 1, {MOST_WORDS})")).select(
        "lang", *WORDS, "k", "n", "cut", "l", *[F.element_at("right_words", i + 1).cast("long").alias(f"p{i + 1}") for i in range(MOST_WORDS)])
    both = sides.join(count.withColumnRenamed("part_n", "r"), on).drop(*on[1:])
    score = F.expr(f"cast({scale} as decimal(19, 0)) * cast(n as decimal(19, 0)) div cast(l + r as decimal(19, 0))")
    best = both.withColumn("score", score.cast("long")).groupBy("lang", *WORDS, "k", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", *WORDS, "k", "n", "best.l", "best.r", "best.score")


def maximal(found: DataFrame, phrases: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``phrases`` that no longer frequent phrase holds with ``den`` * its count >= ``num`` * their own."""
    spans = [(s, first, first + size) for s in range(3, MOST_WORDS + 1) for size in range(2, s) for first in range(s - size + 1)]
    on = ["lang", "p1", "p2", "p3", "p4"]
    inside = _parts(found.where("k >= 3").withColumnRenamed("n", "longer"), spans, "longer").groupBy(*on).agg(F.max("longer").alias("longer"))
    inside = inside.select("lang", *[F.col(f"p{i + 1}").alias(w) for i, w in enumerate(WORDS)], "longer")
    held = F.expr(f"cast(longer as decimal(19, 0)) * {den} >= cast(n as decimal(19, 0)) * {num}")
    return phrases.join(inside, ["lang", *WORDS], "left").where(F.col("longer").isNull() | ~held).drop("longer")


def words_of(documents: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, word, word_text): the text of every word of the phrases (lang, w1 … w4)."""
    wanted = phrases.select("lang", F.explode(F.array(*WORDS)).alias("w1")).where("w1 <> 0").select(
        "lang", "w1", *[F.lit(0).cast("long").alias(w) for w in WORDS[1:]], F.lit(1).alias("k")).distinct()
    wanted = written(wanted, "words")
    held = documents.sparkSession.sparkContext.broadcast(bitmap(named(wanted), 22))

    def run(batches):
        seen: dict[str, np.ndarray] = {}
        for lang, words, hashes, label in _chunked(batches):
            at, names = _grams(words, hashes, label, 1)
            at = at[_held(held.value, names)]
            done = seen.get(lang, np.zeros(0, np.uint64))
            name, first = np.unique(hashes[at], return_index=True)
            fresh = ~np.isin(name, done)
            name, first = name[fresh], at[first[fresh]]
            if len(done) < 1 << 20:
                seen[lang] = np.concatenate([done, name])
            texts = [words.data[words.start[i] : words.end[i]].tobytes().lower().decode() for i in first]
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(texts), pa.string()), pa.array(name.view(np.int64)), pa.array(texts, pa.large_string()).cast(pa.string())],
                    ["lang", "word", "word_text"])

    rows = _texts(documents).mapInArrow(run, "lang string, word long, word_text string").distinct()
    return rows.join(wanted.select("lang", F.col("w1").alias("word")), ["lang", "word"], "left_semi")


def mine(documents: DataFrame, top: int = 2000, least: int = 30, share: float = SAMPLE) -> DataFrame:
    """The ``top`` phrases of each language of (text, lang): lang, rank, phrase, a, l, r, n, score.

    Words are lower-cased (A-Z) and lie within pieces; a null text is empty, a null lang is
    ``und``. a is the phrase's count (``least`` at least), l and r those of the parts of
    its lowest-scoring cut, n all words of the language. Order: score, then a, both
    descending, then the phrase by its bytes. Rows are counted as often as they occur; a
    table without a phrase found ``least`` times gives no rows.
    """
    found, totals = frequent(documents, least, share)
    kept = written(maximal(found, scored(found)), "phrases")
    best = Window.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("n"))
    salted = kept.withColumn("salt", F.pmod(F.xxhash64(*WORDS), F.lit(32)))
    first = salted.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("salt", "place")
    over = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"))
    first = written(first.withColumn("place", F.rank().over(over)).where(F.col("place") <= top).drop("place"), "first")
    texts = words_of(documents, first)
    spelled = first.select("*", F.posexplode(F.expr(f"filter(array({', '.join(WORDS)}), w -> w <> 0)")).alias("i", "word")).join(
        texts, ["lang", "word"]).groupBy("lang", *WORDS, F.col("n").alias("a"), "l", "r", "score").agg(
        F.array_sort(F.collect_list(F.struct("i", "word_text"))).alias("parts"))
    spelled = spelled.withColumn("phrase", F.expr("array_join(transform(parts, p -> p.word_text), ' ')"))
    final = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return spelled.withColumn("rank", F.row_number().over(final).cast("long")).where(F.col("rank") <= top).join(
        totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
