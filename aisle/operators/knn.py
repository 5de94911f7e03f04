"""Nearest neighbours for a table of queries.

Scoring every candidate is the operator's job, but the pairs never exist as
rows. Each task holds a block of targets as a matrix, multiplies it with the
query matrix and emits at most ``k`` rows per query; a shuffle then merges
those short lists.

A query table below ``BLOCK_ROWS`` is broadcast, so targets are scanned in
place. A larger one is written once and broadcast in blocks: each task holds a
chunk of its targets and takes the blocks one after the other, so neither side
is copied or shuffled. Queries that probe keys and are too many to broadcast
meet the targets in co-grouped chunks of both sides.

Vectors that are null or hold a number that is null or not finite take no part.
They are found by NumPy in the task that reads them: as a Spark filter the test
would be pushed below, and repeat, whatever made the vector.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisle.functions import fixed_values as fv
from aisle.functions.vectors import SCORE_DIGITS, confidence
from aisle.sources.folders import shared_folder

#: A broadcast query block has at most this many rows, and so does a group's query side.
BLOCK_ROWS = 20_000
#: A broadcast probe list (query x cell or query x taxonomy node) has at most this many rows.
PROBE_ROWS = 2_000_000
#: Targets per co-grouped chunk, and targets that a task holds while query blocks pass.
CHUNK_ROWS = 50_000
#: Query blocks of one scan hold at most about this many bytes of vectors; more queries take more scans.
STREAMED_BYTES = 256 << 20
#: A task keeps at most about this many (query, rank) places for the query blocks of one scan.
STREAMED_PLACES = 4_000_000
#: A task holds results for at most this many (query, rank) places at a time.
HELD_ROWS = 500_000
#: Partial results are merged by this many reducers per query before the last merge.
MERGE_FAN_IN = 32
#: Up to this many probed keys are pushed into the targets' scan.
PUSHED_KEYS = 2_000
#: Results up to this many rows are marked for broadcast in follow-up joins.
BROADCAST_ROWS = 1_000_000

_SCALE = 10 ** SCORE_DIGITS


@dataclass(frozen=True)
class QueryBlock:
    """A query table that was checked to fit into one broadcast."""

    ids: list
    matrix: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, start: int, stop: int) -> QueryBlock:
        return QueryBlock(self.ids[start:stop], self.matrix[start:stop])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype not in (np.float32, np.float64):
        flat = flat.astype(np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _usable(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose vector is made of finite numbers only, those vectors as a matrix)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.arange(len(column))
    if column.null_count:
        rows = rows[np.asarray(column.is_valid())]
        column = column.drop_null()
    matrix = _matrix(column)  # a null number becomes NaN
    fine = np.isfinite(matrix).all(axis=1)
    return (rows, matrix) if fine.all() else (rows[fine], matrix[fine])


def query_block(queries: DataFrame, vector: str = "embedding", limit: int | None = None) -> QueryBlock | None:
    """The (query_id, vector) rows as a block, or None when there are too many."""
    limit = BLOCK_ROWS if limit is None else limit
    table = queries.select("query_id", vector).limit(limit + 1).toArrow()
    return None if table.num_rows > limit else _as_block(table)


def _as_block(table: pa.Table) -> QueryBlock:
    rows, matrix = _usable(table.column(1))
    return QueryBlock(table.column(0).take(pa.array(rows)).to_pylist(), matrix)


def probe_list(probes: DataFrame, limit: int | None = None) -> pd.DataFrame | None:
    """The (query_id, key, offset) rows on the driver, or None when there are too many."""
    limit = PROBE_ROWS if limit is None else limit
    table = probes.select("query_id", "key", "offset").limit(limit + 1).toArrow()
    return None if table.num_rows > limit else table.to_pandas()


def _literal(value: object) -> str:
    """A key as SQL text: one short predicate instead of a column call per key."""
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return str(value)


def _similarity(queries: np.ndarray, targets: np.ndarray, metric: str) -> np.ndarray:
    queries = queries.astype(np.float64, copy=False)
    products = queries @ targets.T
    if metric == "dot":
        return products
    q, t = (queries ** 2).sum(axis=1), (targets ** 2).sum(axis=1)
    if metric == "l2":
        return -(q[:, None] + t[None, :] - 2.0 * products)
    sizes = np.sqrt(q)[:, None] * np.sqrt(t)[None, :]
    cosine = np.divide(products, sizes, out=np.zeros_like(products), where=sizes > 0)
    return np.maximum(cosine, 0.0)


def _best(
    queries: np.ndarray, targets: np.ndarray, offsets: np.ndarray, k: int, metric: str,
    step: int = 256,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query the k best target positions; equal scores go to the lower position.

    Scores are compared in whole units of the comparison precision, as floating
    numbers: no size of vector overflows them.
    """
    n = targets.shape[0]
    targets = targets.astype(np.float64, copy=False)
    positions = np.arange(n, dtype=np.int64)
    for start in range(0, queries.shape[0], step):
        block = slice(start, start + step)
        scores = _similarity(queries[block], targets, metric) + offsets[block, None]
        units = np.rint(scores * _SCALE)
        if n > k:
            keep = np.argpartition(-units, k - 1, axis=1)[:, :k]
            last = np.take_along_axis(units, keep, axis=1).min(axis=1, keepdims=True)
            for row in np.flatnonzero((units >= last).sum(axis=1) > k):  # ties at the last place
                above, equal = np.flatnonzero(units[row] > last[row]), np.flatnonzero(units[row] == last[row])
                keep[row] = np.append(above, equal[: k - len(above)])
        else:
            keep = np.broadcast_to(positions, units.shape)
        rows = np.repeat(np.arange(start, start + units.shape[0]), keep.shape[1])
        yield rows, keep.ravel(), np.take_along_axis(units, keep, axis=1).ravel()


def _trim(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["q", "units", "id"], ascending=[True, False, True])
    return found[found.groupby("q", sort=False).cumcount() < k]


def _scan_keys(batches: Iterator[pa.RecordBatch], shared, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """Best k targets per (query, probed key), batch by batch of one task; an unusable vector counts as the zero vector."""
    block, probes = shared.value
    for batch in batches:
        names = ["query_id", "target_id", "score", "key"]
        ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_pandas()
        at, usable = _usable(batch.column(1))
        vectors = np.zeros((batch.num_rows, block.matrix.shape[1] if len(block) else 0))
        if len(at) and vectors.shape[1]:
            vectors[at] = usable
        asked, found, units, held = [], [], [], 0

        def table() -> pa.RecordBatch:
            rows = pa.array(np.concatenate(found))
            return pa.RecordBatch.from_arrays(
                [pa.array([block.ids[i] for i in np.concatenate(asked)]), batch.column(0).take(rows),
                 pa.array(np.concatenate(units) / _SCALE), batch.column(2).take(rows)], names=names)

        for key, rows in keys.groupby(keys, sort=False).indices.items():
            if key not in probes:
                continue
            queries, offsets = probes[key]
            rows = rows[np.argsort(ids[rows], kind="stable")]
            for q, position, best in _best(block.matrix[queries], vectors[rows], offsets, k, metric):
                asked.append(queries[q])
                found.append(rows[position])
                units.append(best)
                held += len(q)
            if held > HELD_ROWS:
                yield table()
                asked, found, units, held = [], [], [], 0
        if held:
            yield table()


def _scan(batches: Iterator[pa.RecordBatch], shared, k: int, metric: str, keyed: bool):
    """Best k targets per query over the batches of one task."""
    block, probes = shared.value
    pending: list[pd.DataFrame] = []
    held = 0
    id_type = None

    def offer(ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, offsets: np.ndarray) -> int:
        order = np.argsort(ids, kind="stable")
        count = 0
        for q, position, units in _best(block.matrix[rows], vectors[order], offsets, k, metric):
            pending.append(pd.DataFrame({"q": rows[q], "units": units, "id": ids[order][position]}))
            count += len(q)
        return count

    every = np.arange(len(block))
    zero = np.zeros(len(block))
    budget = 4 * k * max(len(block), 1) + 100_000
    for batch in batches:
        if not batch.num_rows or not len(block):
            continue
        id_type = batch.schema.field(0).type
        at, vectors = _usable(batch.column(1))
        if len(at) < batch.num_rows:
            batch = batch.take(pa.array(at))
            if not len(at):
                continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        if not keyed:
            held += offer(ids, vectors, every, zero)
        else:
            keys = batch.column(2).to_pandas()
            for key, rows in keys.groupby(keys, sort=False).indices.items():
                if key in probes:
                    queries, offsets = probes[key]
                    held += offer(ids[rows], vectors[rows], queries, offsets)
        if held > budget:
            pending = [_trim(pd.concat(pending, ignore_index=True), k)]
            held = len(pending[0])
    if pending:
        best = _trim(pd.concat(pending, ignore_index=True), k)
        names = pa.array([block.ids[i] for i in best["q"]])
        yield pa.RecordBatch.from_arrays(
            [names, pa.array(best["id"], type=id_type), pa.array(best["units"].to_numpy() / _SCALE)],
            names=["query_id", "target_id", "score"],
        )


def _chunks_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[pa.DataType, np.ndarray, np.ndarray]]:
    """(type of ids, ids, vectors) of at least ``rows`` usable targets at a time, ids ascending."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count, id_type = 0, None

    def joined():
        ids = np.concatenate([x for x, _ in held])
        order = np.argsort(ids, kind="stable")
        return id_type, ids[order], np.concatenate([x for _, x in held])[order]

    for batch in batches:
        id_type = batch.schema.field(0).type
        at, vectors = _usable(batch.column(1))
        if len(at):
            held.append((batch.column(0).take(pa.array(at)).to_numpy(zero_copy_only=False), vectors))
            count += len(at)
        if count >= rows:
            yield joined()
            held, count = [], 0
    if count:
        yield joined()


def _reachable(block: QueryBlock, vectors: np.ndarray, worst: np.ndarray | None, metric: str) -> np.ndarray:
    """Rows of the block that some of the targets can still serve, by the lengths of the vectors.

    No target is nearer to a query than their lengths differ, and no dot product exceeds
    that of the lengths; ``worst`` is each query's last score so far, in units.
    """
    every = np.arange(len(block))
    if worst is None or metric == "cosine":
        return every
    asked = np.sqrt((block.matrix.astype(np.float64) ** 2).sum(axis=1))
    found = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    if metric == "dot":
        bound = asked * found.max()
    else:
        bound = -np.maximum(0.0, np.maximum(asked - found.max(), found.min() - asked)) ** 2
    slack = 1e-9 * (asked + found.max()) ** 2  # rounding of either side
    return every[~(np.rint((bound + slack) * _SCALE) < worst)]


def _scan_blocks(
    batches: Iterator[pa.RecordBatch], shared: list, k: int, metric: str, block_rows: int,
) -> Iterator[pa.RecordBatch]:
    """Best k targets per query of many blocks: targets are read once, blocks pass by chunks of them.

    Each of the broadcast query tables ``shared`` is taken in blocks of ``block_rows``.
    """
    blocks = [block.value.part(i, i + block_rows) for block in shared for i in range(0, len(block.value), block_rows)]
    best: list[pd.DataFrame | None] = [None] * len(blocks)
    id_type = None
    for id_type, ids, vectors in _chunks_of(batches, CHUNK_ROWS):
        for n, block in enumerate(blocks):
            worst = None
            if best[n] is not None:
                last = best[n].groupby("q")["units"].agg(["size", "min"])
                worst = np.full(len(block), -np.inf)
                full = last[last["size"] >= k]
                worst[full.index] = full["min"]
            rows = _reachable(block, vectors, worst, metric)
            parts = [] if best[n] is None else [best[n]]
            for q, position, units in _best(block.matrix[rows], vectors, np.zeros(len(rows)), k, metric):
                parts.append(pd.DataFrame({"q": rows[q], "units": units, "id": ids[position]}))
            if parts:
                best[n] = _trim(pd.concat(parts, ignore_index=True), k)
    for n, found in enumerate(best):
        if found is not None and len(found):
            names = blocks[n].ids
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in found["q"]]), pa.array(found["id"], type=id_type), pa.array(found["units"].to_numpy() / _SCALE)],
                names=["query_id", "target_id", "score"],
            )


def _nearest_streamed(queries, targets, k, target_id, metric, vector, block_rows: int | None = None) -> DataFrame:
    """Many queries without probes: written once, broadcast in blocks, one target scan for many blocks.

    The driver holds ``BLOCK_ROWS`` queries at a time, which tasks score in blocks of
    ``block_rows``: small blocks are no jobs, files or broadcasts of their own. A scan takes
    as many blocks as its tasks may hold (``STREAMED_BYTES`` of vectors, ``STREAMED_PLACES``
    results); more queries take more scans, never larger tasks.
    """
    block_rows = block_rows or BLOCK_ROWS
    spark = queries.sparkSession
    asked = queries.select("query_id", F.col(vector).alias("_qv"))
    path = f"{shared_folder(spark)}/knn/queries-{uuid.uuid4().hex}"
    asked.write.parquet(path)
    asked = spark.read.schema(asked.schema).parquet(path)
    n = max(1, -(-asked.count() // BLOCK_ROWS))
    parts = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n)))
    arranged = f"{path}-blocks"
    parts.write.partitionBy("_block").parquet(arranged)
    parts = spark.read.schema(parts.schema).parquet(arranged)
    schema = _hit_schema(queries, targets, target_id)
    narrow = targets.select(target_id, vector)
    hits, blocks, size, places = None, [], 0, 0

    def scan_of(blocks):
        return narrow.mapInArrow(lambda batches: _scan_blocks(batches, blocks, k, metric, block_rows), schema)

    for i in range(n):
        block = _as_block(parts.where(F.col("_block") == i).select("query_id", "_qv").toArrow())
        if not len(block):
            continue
        if blocks and (size + block.matrix.nbytes > STREAMED_BYTES or places + len(block) * k > STREAMED_PLACES):
            hits = scan_of(blocks) if hits is None else hits.unionByName(scan_of(blocks))
            blocks, size, places = [], 0, 0
        blocks.append(spark.sparkContext.broadcast(block))
        size, places = size + block.matrix.nbytes, places + len(block) * k
    last = scan_of(blocks)  # without usable queries a scan that finds nothing
    return last if hits is None else hits.unionByName(last)


def _hit_schema(queries: DataFrame, targets: DataFrame, target_id: str, key: str | None = None) -> T.StructType:
    """Of hits; with ``key`` they also tell the key by which they were found."""
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("target_id", targets.schema[target_id].dataType),
        T.StructField("score", T.DoubleType()),
        *([] if key is None else [T.StructField("key", targets.schema[key].dataType)]),
    ])


def merge_top_k(hits: DataFrame, k: int, fan_in: int | None = None, per: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Global top k per query (or per ``per``) out of per-task lists, with a rank.

    The first round splits each query's rows by target, so no reducer sees the
    lists of all tasks; both rounds prune before they shuffle.
    """
    fan_in = MERGE_FAN_IN if fan_in is None else fan_in
    order = [F.desc("score"), F.asc("target_id")]
    if fan_in > 1:
        salted = hits.withColumn("_salt", F.pmod(F.xxhash64("target_id"), F.lit(fan_in)))
        partial = Window.partitionBy(*per, "_salt").orderBy(*order)
        hits = salted.withColumn("_n", F.row_number().over(partial)).where(F.col("_n") <= k).drop("_n", "_salt")
    final = Window.partitionBy(*per).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)


def nearest(
    queries: DataFrame, targets: DataFrame, k: int, target_id: str, metric: str = "l2",
    vector: str = "embedding", probes: DataFrame | None = None, key: str | None = None,
    block: QueryBlock | None = None, chunk_rows: int | None = None, fan_in: int | None = None,
) -> DataFrame:
    """(query_id, target_id, score, rank): the k best targets of every query.

    ``queries`` has query_id and a vector; score is minus the squared distance,
    the cosine or the dot product. With ``probes`` (query_id, key, offset) a
    query meets only targets whose ``key`` it probes, and the offset is added to
    the score. Ties go to the smaller target id. Targets and queries whose vector is
    null or holds a null, NaN or infinite number have no neighbours and are none.
    """
    block = query_block(queries, vector) if block is None else block
    listed = None if probes is None or block is None else probe_list(probes)
    if block is not None and (probes is None or listed is not None):
        # deep results for many queries: several scans, each with a bounded share of the queries
        step = max(1, HELD_ROWS // k)
        hits = None
        for start in range(0, max(len(block), 1), step):
            part = _nearest_broadcast(
                queries, targets, k, target_id, metric, vector, block.part(start, start + step), listed, key
            )
            hits = part if hits is None else hits.unionByName(part)
    elif probes is None:
        hits = _nearest_streamed(queries, targets, k, target_id, metric, vector)
    else:
        hits = _nearest_grouped(
            queries, targets, k, target_id, metric, vector, probes, key,
            CHUNK_ROWS if chunk_rows is None else chunk_rows,
        )
    return merge_top_k(hits, k, fan_in)


def nearest_per_key(
    queries: DataFrame, targets: DataFrame, k: int, target_id: str, probes: DataFrame, key: str, metric: str = "l2",
    vector: str = "embedding", block: QueryBlock | None = None,
) -> DataFrame:
    """(query_id, target_id, score, key, rank): as :func:`nearest`, but the k best targets of each probed key.

    ``probes`` (query_id, key, offset) is a written table with each pair once. A target without a
    usable vector counts as the zero vector.
    """
    block = query_block(queries, vector) if block is None else block
    listed = None if block is None else probe_list(probes)
    if listed is not None:
        hits = _nearest_broadcast(queries, targets, k, target_id, metric, vector, block, listed, key, per_key=True)
    else:
        first = queries.where(F.col(vector).isNotNull()).select(F.size(vector)).first()
        zero = F.array_repeat(F.lit(0.0).cast("float"), first[0] if first else 0)
        fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        whole = targets.withColumn(vector, F.when(fine, F.col(vector)).otherwise(zero))
        hits = _nearest_grouped(queries, whole, k, target_id, metric, vector, probes, key, CHUNK_ROWS, per_key=True)
    return merge_top_k(hits, k, 1, ("query_id", "key"))


def _nearest_broadcast(queries, targets, k, target_id, metric, vector, block, listed, key, per_key=False) -> DataFrame:
    spark = targets.sparkSession
    keyed = listed is not None
    lookup = None
    if keyed:
        position = {q: i for i, q in enumerate(block.ids)}
        mine = listed[listed["query_id"].isin(position)]
        rows = mine["query_id"].map(position).to_numpy(dtype=np.int64)
        offsets = mine["offset"].to_numpy(dtype=np.float64)
        lookup = {
            value: (rows[at], offsets[at])
            for value, at in mine.groupby("key", sort=False).indices.items()
        }
        targets = _with_keys(targets, key, list(lookup))
    shared = spark.sparkContext.broadcast((block, lookup))
    columns = [target_id, vector] + ([key] if keyed else [])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scan_keys(batches, shared, k, metric) if per_key else _scan(batches, shared, k, metric, keyed)

    return targets.select(*columns).mapInArrow(scan, _hit_schema(queries, targets, target_id, key if per_key else None))


def _with_keys(targets: DataFrame, key: str, keys: list) -> DataFrame:
    """Targets whose key is probed at all, so that the others never leave the scan."""
    if len(keys) <= PUSHED_KEYS:
        wanted = ", ".join(_literal(v) for v in keys) or "NULL"
        return targets.where(f"`{key}` IN ({wanted})")
    table = pa.table({key: pa.array([v.item() if hasattr(v, "item") else v for v in keys])})
    wanted = targets.sparkSession.createDataFrame(table).select(F.col(key).cast(targets.schema[key].dataType))
    return targets.join(F.broadcast(wanted), key, "left_semi")


def _nearest_grouped(queries, targets, k, target_id, metric, vector, probes, key, chunk_rows, per_key=False) -> DataFrame:
    """The same scoring on co-grouped chunks, for probing queries that must not be broadcast.

    Each key's targets are cut into groups of about ``CHUNK_ROWS`` and its
    queries into blocks of about ``BLOCK_ROWS``; a task takes one group and one
    block, so a key that holds a third of all rows is many tasks. Only whole groups
    copy a query: within one, ``chunk_rows`` targets are scored at a time.
    """
    base = targets.select(F.col(target_id).alias("_t"), F.col(vector).alias("_tv"), F.col(key).alias("_key"))
    asked = queries.select("query_id", F.col(vector).alias("_qv"))
    asked = probes.select(
        "query_id", F.col("key").alias("_key"), F.col("offset").cast("double").alias("_offset")
    ).join(asked, "query_id")

    def pieces(frame: DataFrame, size: int, name: str) -> DataFrame:
        n = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.count(F.lit(1)) / size))
        return frame.groupBy("_key").agg(n.alias(name))

    sizes = pieces(base, max(chunk_rows, CHUNK_ROWS), "_chunks").join(pieces(asked, BLOCK_ROWS, "_blocks"), "_key")
    one = F.lit(1).cast("bigint")
    left = (
        asked.join(sizes, "_key")
        .withColumn("_block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")) + 1)
        .withColumn("_chunk", F.explode(F.sequence(one, F.col("_chunks"))))
        .select("_key", "_chunk", "_block", "query_id", "_offset", "_qv")
    )
    right = (
        base.join(sizes, "_key")
        .withColumn("_chunk", F.pmod(F.xxhash64("_t"), F.col("_chunks")) + 1)
        .withColumn("_block", F.explode(F.sequence(one, F.col("_blocks"))))
        .select("_key", "_chunk", "_block", "_t", "_tv")
    )
    schema = _hit_schema(queries, targets, target_id)

    def score(asked: pa.Table, found: pa.Table) -> pa.Table:
        names = ["query_id", "target_id", "score"]
        id_type = found.schema.field("_t").type
        query_type = asked.schema.field("query_id").type
        if not asked.num_rows or not found.num_rows:
            empty = [pa.array([], query_type), pa.array([], id_type), pa.array([], pa.float64())]
            return pa.Table.from_arrays(empty, names=names)
        rows, queried = _usable(asked.column("_qv"))
        at, vectors = _usable(found.column("_tv"))
        asked, found = asked.take(pa.array(rows)), found.take(pa.array(at))
        if not len(rows) or not len(at):
            return score(asked.slice(0, 0), found.slice(0, 0))
        ids = found.column("_t").to_numpy()
        order, offsets = np.argsort(ids, kind="stable"), asked.column("_offset").to_numpy()
        worst, parts, held = np.full(len(queried), -np.inf), [], 0  # each query's last score so far, in units
        for start in range(0, len(order), chunk_rows):
            piece = order[start:start + chunk_rows]
            for q, position, units in _best(queried, vectors[piece], offsets, k, metric):
                fine = units >= worst[q]
                parts.append(pd.DataFrame({"q": q[fine], "units": units[fine], "id": ids[piece][position[fine]]}))
                held += len(parts[-1])
            if held > 2 * k * len(queried) or start + chunk_rows >= len(order):
                parts = [_trim(pd.concat(parts, ignore_index=True), k)]
                held, last = len(parts[0]), parts[0].groupby("q")["units"].agg(["size", "min"])
                full = last[last["size"] >= k]
                worst[full.index] = full["min"]
        best = parts[0]
        return pa.Table.from_arrays([
            asked.column("query_id").combine_chunks().take(pa.array(best["q"].to_numpy())),
            pa.array(best["id"].to_numpy(), type=id_type),
            pa.array(best["units"].to_numpy() / _SCALE),
        ], names=names)

    def score_key(of_group: tuple, asked: pa.Table, found: pa.Table) -> pa.Table:
        hits = score(asked, found)
        return hits.append_column("key", pa.array([of_group[0].as_py()] * hits.num_rows, found.schema.field("_key").type))

    groups = ["_key", "_chunk", "_block"]
    pairs = left.groupBy(*groups).cogroup(right.groupBy(*groups))
    if per_key:
        return pairs.applyInArrow(score_key, _hit_schema(queries, targets, target_id, key))
    return pairs.applyInArrow(score, schema)


def flat(
    queries: DataFrame, targets: DataFrame, k: int, target_id: str = "product_id",
    vector: str = "embedding", block: QueryBlock | None = None,
) -> DataFrame:
    """Exact k nearest by squared L2: (query_id, target_id, distance, confidence, rank)."""
    return with_confidence(nearest(queries, targets, k, target_id, "l2", vector, block=block))


def with_confidence(hits: DataFrame) -> DataFrame:
    distance = F.greatest(F.lit(0.0), -F.col("score"))
    return hits.select(
        "query_id", "target_id", distance.alias("distance"),
        confidence(distance).alias("confidence"), "rank",
    )


@dataclass(frozen=True)
class Cells:
    """Vectors with their k-means cell, and the cells' centroids."""

    vectors: DataFrame
    centroids: DataFrame


def default_cells(n: int) -> int:
    """As many cells as a cell has vectors on average."""
    return max(1, math.isqrt(n))


def build_cells(
    vectors: DataFrame, nlist: int | None = None, target_id: str = "product_id",
    vector: str = "embedding", seed: int = 42, max_iter: int = 10,
) -> Cells:
    """Partition vectors by nearest k-means centroid, trained on all of them."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = vectors.where(F.col(vector).isNotNull() & fine)  # stored vectors: nothing is computed again
    n = vectors.count()
    nlist = default_cells(n) if nlist is None else nlist
    pointed = vectors.withColumn("_point", array_to_vector(vector))
    if nlist < 2:
        centre = vectors.limit(1).select(F.lit(0).alias("cell"), F.col(vector).alias("embedding"))
        return Cells(vectors.withColumn("cell", F.lit(0)), centre)
    model = KMeans(
        k=nlist, seed=seed, maxIter=max_iter, featuresCol="_point", predictionCol="cell",
    ).fit(pointed)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = vectors.sparkSession.createDataFrame(centres, "cell int, embedding array<double>")
    return Cells(model.transform(pointed).drop("_point"), centroids)


def ivf(
    queries: DataFrame, cells: Cells, k: int, nprobe: int = fv.IVF_PROBES,
    target_id: str = "product_id", vector: str = "embedding", block: QueryBlock | None = None,
) -> DataFrame:
    """Approximate k nearest: only the vectors of each query's ``nprobe`` closest cells.

    Probing every cell gives the exact answer.
    """
    block = query_block(queries, vector) if block is None else block
    closest = nearest(
        queries.select("query_id", F.col(vector).alias("embedding")), cells.centroids,
        nprobe, "cell", "l2", block=block, fan_in=1,
    )
    probes = closest.select("query_id", F.col("target_id").alias("key"), F.lit(0.0).alias("offset"))
    return with_confidence(
        nearest(queries, cells.vectors, k, target_id, "l2", vector, probes, "cell", block)
    )
