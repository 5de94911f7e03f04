"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct n-grams (4 to 6 letter symbols, word boundaries
included) that it contains, hashed to 2²⁰ slots. Each slot is scaled by its log-count
ratio r = log P(gram | toxic) / P(gram | clean), estimated over all labelled training
texts; slots with too few texts or a weak ratio are left out. Weights are then fitted by
logistic regression on at most ``TRAIN_ROWS`` different labelled rows, those of the
smallest hashes of (doc_id, text), in that order.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm import letters
from aisle.llm.batches import chunks, mix
from aisle.llm.shared import labelled, written

SLOT_BITS = 20
SIZES = (4, 5, 6)
TRAIN_ROWS = 20_000
LEAST_TEXTS, LEAST_RATIO = 4, 1.0


class Model(NamedTuple):
    feature: np.ndarray
    """Feature number of each slot, -1 if it has none."""
    weight: np.ndarray
    bias: float


def _slots(data: np.ndarray, offsets: np.ndarray):
    """(slot, bounds) of the n-grams of the texts of a chunk, one size after the other."""
    symbols, bounds, _ = letters.sequences(data, offsets)
    for size in SIZES:
        packed, ends = letters.histories(symbols, bounds, size)
        yield (mix(packed.view(np.uint64) + (np.uint64(size) << np.uint64(56))) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), ends


def features(data: np.ndarray, offsets: np.ndarray, feature: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of a chunk, ascending; without ``feature``, slots."""
    pairs = []
    for slot, ends in _slots(data, offsets):
        text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        if feature is not None:
            slot = feature[slot]
            text, slot = text[slot >= 0], slot[slot >= 0]
        pairs.append(text << SLOT_BITS | slot)
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> SLOT_BITS, pairs & ((1 << SLOT_BITS) - 1)


def _ratios(training: DataFrame) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Per slot: number of training texts, log-count ratio; texts per label. All labelled texts count."""
    def count(batches):
        total, rows = np.zeros((2, 1 << SLOT_BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = np.asarray(batch.column("label"))
            for row, data, offsets in chunks(batch.column("text")):
                text, slot = features(data, offsets)
                mine = label[row : row + len(offsets) - 1]
                for k in (0, 1):
                    total[k] += np.bincount(slot[mine[text] == k], minlength=1 << SLOT_BITS)
                    rows[k] += int((mine == k).sum())
        seen = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_pydict({
            "slot": np.append(seen, -1), "n0": np.append(total[0][seen], rows[0]), "n1": np.append(total[1][seen], rows[1])})

    counted = training.mapInArrow(count, "slot long, n0 long, n1 long").groupBy("slot").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()  # at most 2^20 + 1 rows
    total = np.zeros((2, (1 << SLOT_BITS) + 1))
    slot = np.asarray(counted.column("slot"))
    for k in (0, 1):
        total[k][slot] = np.asarray(counted.column(f"n{k}"))  # slot -1 is the last place
    rows = (int(total[0][-1]), int(total[1][-1]))
    n0, n1 = total[0][:-1], total[1][:-1]
    ratio = np.log((n1 + 0.5) / (rows[1] + 1)) - np.log((n0 + 0.5) / (rows[0] + 1))
    return n0 + n1, ratio, rows


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, label: np.ndarray, width: int,
             steps: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse rows, by Adam on the whole set."""
    weight, bias = np.zeros(width), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    n = max(len(label), 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(rows, weights=values * weight[columns], minlength=len(label))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / n
        g = np.bincount(columns, weights=values * error[rows], minlength=width) + decay * weight
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * min(1.0, 2 * (1 - step / (steps + 1)))
        weight -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9 ** step)) / (np.sqrt(vb / (1 - 0.99 ** step)) + 1e-9)
    return weight, float(bias)


def train(training: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The classifier of (row_key, text, label); rows without a label of 0 or 1 are ignored.

    ``row_key`` is a hash that names a row's content: rows that share it are fitted once.
    """
    training = training.where("label IN (0, 1)").select("row_key", "text", F.col("label").cast("long").alias("label"))
    texts, ratio, rows = _ratios(training)
    used = np.flatnonzero((texts >= LEAST_TEXTS) & (np.abs(ratio) >= LEAST_RATIO))
    feature = np.full(1 << SLOT_BITS, -1, np.int32)
    feature[used] = np.arange(len(used))
    if not min(rows):
        sure = 1.0 if rows[1] else 0.0
        return Model(np.full(1 << SLOT_BITS, -1, np.int32), np.zeros(1), 8.0 * (2 * sure - 1))
    held = training.sparkSession.sparkContext.broadcast(feature)
    chosen = written(training.select("row_key").distinct().orderBy("row_key").limit(train_rows), "chosen")  # a bounded table
    sample = training.join(F.broadcast(chosen), "row_key", "left_semi")

    def sparse(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                text, column = features(data, offsets, held.value)
                bounds = np.searchsorted(text, np.arange(len(offsets)))
                part = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_key"), part.column("label"),
                     pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(column.astype(np.int32)))], ["row_key", "label", "columns"])

    # train_rows rows at most; a row that is repeated is one, so the order by its key is the only one
    found = sample.mapInArrow(sparse, "row_key long, label long, columns array<int>").groupBy("row_key").agg(
        F.max("label").alias("label"), F.max("columns").alias("columns")).orderBy("row_key").toArrow()
    label = np.asarray(found.column("label")).astype(float)
    lists = found.column("columns").combine_chunks()
    columns = np.asarray(lists.flatten())
    sizes = np.asarray(lists.value_lengths())
    scale = ratio[used]
    weight, bias = logistic(np.repeat(np.arange(len(label)), sizes), columns, scale[columns], label, len(used))
    return Model(feature, weight * scale, bias)


def score(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the score, 0 to 1, of every row; a null text counts as empty."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                text, column = features(data, offsets, held.value.feature)
                z = held.value.bias + np.bincount(text, weights=held.value.weight[column], minlength=len(offsets) - 1)
                part = batch.slice(row, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in keep] + [pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], [*keep, "score"])

    types = dict(documents.dtypes)
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "score double"]))


def classify(documents: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """Toxicity of every text of (doc_id, text): doc_id, is_training, score, predicted.

    ``labels`` has doc_id and ``label`` (1, 0 or null: not labelled); a doc_id labelled
    twice counts as 1 if any of its labels is. ``training`` says which rows of
    ``documents`` may be learned from. Empty and null texts get the score of a text
    without any feature. Without labels of both kinds all texts get the same score:
    nearly 1 if all labels are 1, else nearly 0. Null doc_ids are scored, never trained on.
    """
    rows = documents.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("is_training"))
    known = written(labels.groupBy("doc_id").agg(F.max(label).alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)"), "known")
    usable = labelled(rows.where("is_training"), known)
    model = train(usable.select(F.xxhash64("doc_id", "text").alias("row_key"), "text", "label"))
    return score(rows, model, ["doc_id", "is_training"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
