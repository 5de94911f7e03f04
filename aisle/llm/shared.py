"""Written intermediate tables, whole groups of sorted partitions, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.plans.jobs import shared_folder


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once to the cluster's shared folder and read back.

    This cuts the lineage: a lost executor costs the tasks it ran, not the job.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


BROADCAST_ROWS = 1_000_000
HELD_BYTES = 24 << 20


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``gone(key)``, a written table of one number a row.

    Up to BROADCAST_ROWS numbers (counted) are broadcast, so the rows stay where they
    are; more are joined by a shuffle.
    """
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, key, "left_anti")


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``frame`` is called so."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def labelled(rows: DataFrame, known: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with the columns of ``known``, a written table of one narrow row a ``key``; other rows are left out.

    As in :func:`without`, a counted number of labels is broadcast, so texts stay where they are.
    """
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(known) if few else known, key)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``key``; at least ``rows`` rows or HELD_BYTES but for the last."""
    held: list[pa.RecordBatch] = []
    count = size = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        size += batch.nbytes
        if count < rows and size < HELD_BYTES:
            continue
        table = pa.Table.from_batches(held)
        keys = np.asarray(table.column(key))
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            count = table.num_rows - cut
            size = sum(b.nbytes for b in held)
    if count:
        yield pa.Table.from_batches(held)
    held.clear()
    pa.default_memory_pool().release_unused()  # the worker goes on to other stages


class Union:
    """Disjoint sets of 0 … n-1; the root of a set is its smallest member."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node of ``edges(a, b)``, as (node, component).

    Alternates the two star contractions of Kiveris et al. (2014) until nothing
    changes: each node is pointed at its smallest neighbour. Every round aggregates
    before it shuffles, and its result is a written table, so neither the driver nor
    a task holds a component.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs = written(pairs, "edges")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.expr(
            "filter(array(named_struct('a', b, 'b', m), named_struct('a', a, 'b', m)), x -> x.a <> x.b)")).alias("x"))
        after = written(small.select("x.a", "x.b").distinct(), "edges")
        if after.exceptAll(pairs).isEmpty() and after.count() == pairs.count():
            break
        pairs = after
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
