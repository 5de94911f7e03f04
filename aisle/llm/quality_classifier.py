"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network.

A word or mark (a run of letters, of digits or of other visible characters) has a slot
by its hash and a fixed sparse random index vector. A slot's context vector is the sum
of the index vectors of its neighbours (two on each side) over the whole corpus: that
is random indexing, and Spark sums it as one SLOTS x WIDTH table of integers, whatever
the corpus. A text is the mean and the spread of its words' normalised vectors. A
network with one hidden layer is fitted in NumPy on at most ``TRAIN_ROWS`` labelled
texts; a part of them kept aside sets the temperature of its probabilities.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm.batches import SPACE, chunks, mix, span_hashes
from aisle.llm.shared import written

SLOT_BITS, WIDTH, NONZERO, REACH = 14, 32, 4, 2
SLOTS = 1 << SLOT_BITS
TRAIN_ROWS = 20_000
HIDDEN = 24
TEMPERATURES = [0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0, 5.0]

_KIND = np.full(256, 3, np.uint8)  # marks
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_KIND[SPACE] = 0


def index_places() -> tuple[np.ndarray, np.ndarray]:
    """The random index vector of every slot: NONZERO places and their signs."""
    bits = mix(np.arange(SLOTS * NONZERO, dtype=np.uint64)).reshape(SLOTS, NONZERO)
    return (bits % np.uint64(WIDTH)).astype(np.int64), 1 - 2 * ((bits >> np.uint64(32)) & np.uint64(1)).astype(np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, bounds) of the words and marks of the texts of a chunk."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    cut = np.append(True, kind[1:] != kind[:-1])
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data))
    visible = kind[start] > 0
    start, end = start[visible], end[visible]
    return (span_hashes(data, start, end) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.searchsorted(start, offsets)


def context_vectors(documents: DataFrame) -> np.ndarray:
    """The SLOTS x WIDTH table of context vectors of all words of all texts, normalised."""
    def gather(batches):
        place, sign = index_places()
        total = np.zeros(SLOTS * WIDTH, np.int64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text")):
                slot, bounds = tokens(data, offsets)
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
                for apart in range(1, REACH + 1):
                    near = np.flatnonzero(text[apart:] == text[:-apart]) if len(text) > apart else np.zeros(0, np.int64)
                    a, b = slot[near], slot[near + apart]
                    # count each pair of slots once, then add its index vectors
                    pair, n = np.unique(a << SLOT_BITS | b, return_counts=True)
                    a, b = pair >> SLOT_BITS, pair & (SLOTS - 1)
                    for k in range(NONZERO):
                        total += np.bincount(np.append(a * WIDTH + place[b, k], b * WIDTH + place[a, k]),
                                             np.append(sign[b, k] * n, sign[a, k] * n), SLOTS * WIDTH).astype(np.int64)
        table = total.reshape(SLOTS, WIDTH)
        used = np.flatnonzero(table.any(1))
        values = pa.ListArray.from_arrays(np.arange(0, len(used) * WIDTH + 1, WIDTH, dtype=np.int32), pa.array(table[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), values], ["slot", "vector"])

    def add(batches):
        table = np.zeros((SLOTS, WIDTH), np.int64)
        for batch in batches:
            np.add.at(table, np.asarray(batch.column("slot")), np.asarray(batch.column("vector").flatten()).reshape(-1, WIDTH))
        used = np.flatnonzero(table.any(1))
        values = pa.ListArray.from_arrays(np.arange(0, len(used) * WIDTH + 1, WIDTH, dtype=np.int32), pa.array(table[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), values], ["slot", "vector"])

    schema = "slot long, vector array<long>"
    parts = documents.select("text").mapInArrow(gather, schema).repartition("slot").mapInArrow(add, schema)
    found = parts.toArrow()  # at most SLOTS rows
    table = np.zeros((SLOTS, WIDTH))
    if found.num_rows:
        table[np.asarray(found.column("slot"))] = np.asarray(found.column("vector").combine_chunks().flatten()).reshape(-1, WIDTH)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text: mean and spread of its words' vectors, log of its number of words, share of repeats of the word before."""
    slot, bounds = tokens(data, offsets)
    rows, counts = len(offsets) - 1, np.diff(bounds)
    out = np.zeros((rows, 2 * WIDTH + 2), np.float32)
    full = np.flatnonzero(counts)
    if len(full):
        mine, n = vectors[slot], counts[full][:, None]
        mean = np.add.reduceat(mine, bounds[:-1][full], 0) / n
        out[full, :WIDTH] = mean
        out[full, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(np.add.reduceat(mine * mine, bounds[:-1][full], 0) / n - mean * mean, 0))
        out[full, -2] = np.log1p(counts[full]) / 10
        again = np.append(False, slot[1:] == slot[:-1])
        again[bounds[:-1][full]] = False
        out[full, -1] = np.add.reduceat(again, bounds[:-1][full], dtype=np.float32) / counts[full]
    return out


class Network(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.first + self.first_bias) @ self.second + self.second_bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -700, 700)))


def fit(x: np.ndarray, label: np.ndarray, steps: int = 1500, seed: int = 1) -> Network:
    """The network of pooled texts and labels; every fifth row sets the temperature."""
    x = x.astype(np.float64)
    centre, scale = x.mean(0), x.std(0) + 1e-6
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    p = [rng.normal(0, width ** -0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    if len(set(label.tolist())) < 2:
        sure = 8.0 if len(label) and label[0] else -8.0
        return Network(centre, scale, p[0] * 0, p[1], p[2] * 0, sure, 1.0)
    aside = np.arange(len(label)) % 5 == 4
    z, y = ((x - centre) / scale)[~aside], label[~aside]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(y), min(512, len(y)))
        hidden = np.tanh(z[rows] @ p[0] + p[1])
        error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - y[rows]) / len(rows)
        back = error[:, None] * p[2] * (1 - hidden * hidden)
        grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]
        rate = 0.01 * (1 - step / (steps + 1))
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if aside.any():
        logit, y = net.logits(x[aside]), label[aside]
        loss = [np.mean(np.logaddexp(0, -(2 * y - 1) * logit / t)) for t in TEMPERATURES]
        net = net._replace(temperature=TEMPERATURES[int(np.argmin(loss))])
    return net


def classify(
    documents: DataFrame, labels: DataFrame, training: Column, label: str = "quality", threshold: float = 0.3,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """Quality of every text of (doc_id, text): doc_id, is_training, score, predicted.

    ``labels`` has doc_id and ``label`` (1, 0 or null: not labelled); a doc_id labelled
    twice counts as 1 if any of its labels is. ``training`` says which rows of
    ``documents`` may be learned from. Empty and null texts are scored as texts without
    words. With labels of one kind only, all texts get nearly 1 or nearly 0. Null
    doc_ids are scored, never trained on.
    """
    rows = documents.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("is_training"))
    spark = documents.sparkSession
    vectors = spark.sparkContext.broadcast(context_vectors(rows))

    def pool(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                x = pooled(vectors.value, data, offsets)
                part = batch.slice(row, len(x))
                values = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("is_training"), values], ["doc_id", "is_training", "x"])

    texts = written(rows.mapInArrow(pool, "doc_id long, is_training boolean, x array<float>"), "pooled")
    known = labels.groupBy("doc_id").agg(F.max(label).cast("double").alias("label")).where("label IN (0, 1)")
    usable = texts.where("is_training").join(known, "doc_id")
    share = min(1.0, train_rows / max(usable.count(), 1))
    if share < 1:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = usable.select("x", "label").toArrow()  # train_rows texts
    x = np.asarray(found.column("x").combine_chunks().flatten()).reshape(-1, 2 * WIDTH + 2) if found.num_rows else np.zeros((1, 2 * WIDTH + 2))
    net = spark.sparkContext.broadcast(fit(x, np.asarray(found.column("label")) if found.num_rows else np.zeros(1)))

    def score(batches):
        for batch in batches:
            lists = batch.column("x")
            values = np.asarray(lists.flatten()).reshape(-1, 2 * WIDTH + 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("is_training"), pa.array(net.value.probabilities(values))], ["doc_id", "is_training", "score"])

    scored = texts.mapInArrow(score, "doc_id long, is_training boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
