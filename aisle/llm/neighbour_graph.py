"""Approximate nearest neighbours: a graph built by NN-descent, searched greedily.

Equal vectors are one node. Every node starts with neighbours from a few random cuts of
the space, and then, round by round, with neighbours of its neighbours: a node's
neighbours (and those it is a neighbour of) meet at the node, are compared with each other,
and better ones enter each other's lists. Rounds end when few lists change. What meets at
a node is bounded by a parameter; vectors travel as 16-bit floats there.

A query starts at its own node, or at the nearest of a bounded sample of nodes, and follows
the graph: the nearest nodes that it has not opened yet are opened together, their
neighbours are compared with the query, and the ``beam`` nearest are kept, until all of
these are open. Distances of the search are Euclidean, of the original vectors, in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle.llm.shared import whole_groups, written

DEGREE = 24
"""Neighbours of a node."""
MEETING = 16
"""Neighbours, and nodes that have it as a neighbour, which meet at a node in a round."""
CUTS = 6
"""Random cuts of the space that first neighbours come from."""
CELL = 512
"""Nodes of a cell of such a cut, about; larger cells are dealt out by hash."""
SETTLED = 0.02
"""Rounds end when at most this share of all list places changes."""
BEAM = 160
OPENED = 48
"""Nodes that a query opens at once."""
SEEDS = 1024
"""Nodes that queries without a node of their own start from, at most."""
QUERY_BYTES = 64 << 20
"""Vectors of queries broadcast at once; more queries are searched in several blocks."""


class Graph(NamedTuple):
    points: DataFrame
    """(id, vector, node) of every vector that takes part."""
    nodes: DataFrame
    """(node, vector array<double>), distinct vectors; node is the smallest id of its vector."""
    members: DataFrame
    """(node, id): up to ``held`` smallest ids of each node's vector."""
    links: DataFrame
    """(node, neighbours array<long>)."""


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector array<double>): one row an id, of vectors that take part.

    Null ids take no part, nor do vectors that are null, empty, zero or hold null or
    non-finite numbers, or whose length is not that of most vectors (the shorter of equally
    common ones). Of different vectors under one id the one with the smallest hash is taken.
    """
    values = F.col(vector).cast("array<double>")
    fine = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    good = rows.select(F.col(key).cast("long").alias("id"), F.transform(values, lambda x: x + 0.0).alias("vector"), fine.alias("fine")).where(
        "fine AND id IS NOT NULL").drop("fine")
    usual = good.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").first()
    good = good.where(F.size("vector") == (usual["n"] if usual else 0))
    first = Window.partitionBy("id").orderBy(F.xxhash64("vector"))
    return good.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List rows of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _codes(nodes: DataFrame) -> DataFrame:
    """(node, code binary): vectors by the middle norm of all, as 16-bit floats; only the graph is built of these."""
    norms = nodes.select(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
    middle = norms.agg(F.percentile_approx("norm", 0.5, 1000)).first()[0] or 1.0
    scale = middle if np.isfinite(middle) else 1e300

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                values = np.clip(_matrix(batch.column("vector")) / scale, -100, 100).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array([row.tobytes() for row in values], pa.binary())], ["node", "code"])

    return nodes.mapInArrow(run, "node long, code binary")


def _decoded(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, np.float16).reshape(len(column), -1).astype(np.float32)


def _nearest_lists(ids: np.ndarray, codes: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, neighbour, squared distance) of each row's nearest other rows."""
    n = len(ids)
    k = min(degree, n - 1)
    out = []
    sizes = (codes ** 2).sum(1)
    for a in range(0, n, 512):
        block = codes[a : a + 512]
        d = sizes[a : a + 512, None] + sizes - 2 * block @ codes.T
        d[np.arange(len(block)), np.arange(a, a + len(block))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out.append((np.repeat(ids[a : a + 512], k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel()))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


EDGE = "node long, neighbour long, d float"


def _edge_batch(node: np.ndarray, neighbour: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(node), pa.array(neighbour), pa.array(np.maximum(d, 0).astype(np.float32))], ["node", "neighbour", "d"])


def _first_lists(codes: DataFrame, cut: int, cells: int, degree: int) -> DataFrame:
    """Nearest nodes within the cells of one random cut: hyperplanes, and a hash for cells that hold too many."""
    bits = max(0, int(np.ceil(np.log2(max(cells, 1)))))

    def place(batches):
        planes = None
        for batch in batches:
            if batch.num_rows:
                values = _decoded(batch.column("code"))
                if planes is None:
                    planes = np.random.default_rng(cut).standard_normal((values.shape[1], bits)).astype(np.float32)
                cell = ((values @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(values), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(cell)], ["node", "code", "cell"])

    placed = written(codes.mapInArrow(place, "node long, code binary, cell long"), "cells")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * CELL)).alias("parts"))
    dealt = placed.join(sizes, "cell").withColumn("key", F.xxhash64("cell", F.pmod(F.xxhash64("node", F.lit(cut)), F.col("parts"))))

    def compare(batches):
        for table in whole_groups(batches, "key", 4 * CELL):
            keys = np.asarray(table.column("key"))
            edges = np.flatnonzero(np.diff(keys)) + 1
            ids, values = np.asarray(table.column("node")), _decoded(table.column("code"))
            for a, b in zip([0, *edges], [*edges, len(keys)], strict=True):
                if b - a > 1:
                    yield _edge_batch(*_nearest_lists(ids[a:b], values[a:b], degree))

    return dealt.select("key", "node", "code").repartition("key").sortWithinPartitions("key").mapInArrow(compare, EDGE)


def _shortest(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` nearest neighbours of each node, each once; ``new`` if no row had it before."""
    once = edges.groupBy("node", "neighbour").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    order = Window.partitionBy("node").orderBy("d", "neighbour")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= degree)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs, one of them new, of the nodes that meet at a node, where the distance is below one's worst."""
    for table in whole_groups(batches, "at", 8192):
        at = np.asarray(table.column("at"))
        ids, new, worst = (np.asarray(table.column(c)) for c in ("member", "new", "worst"))
        values = _decoded(table.column("code"))
        edges = np.flatnonzero(np.diff(at)) + 1
        start, stop = np.array([0, *edges]), np.array([*edges, len(at)])
        width = int((stop - start).max())
        step = max(1, (1 << 22) // (width * max(width, values.shape[1])))
        for g in range(0, len(start), step):
            first, size = start[g : g + step], (stop - start)[g : g + step]
            slot = np.minimum(np.arange(width), size[:, None] - 1)
            rows = first[:, None] + slot
            there = np.arange(width) < size[:, None]
            v = values[rows]
            sizes = (v ** 2).sum(2)
            d = sizes[:, :, None] + sizes[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
            fresh = new[rows].astype(bool)
            name = ids[rows]
            ok = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :]) & (name[:, :, None] != name[:, None, :])
            ok &= d < worst[rows][:, :, None]
            group, i, j = np.nonzero(ok)
            if len(group):
                node, neighbour, found = name[group, i], name[group, j], d[group, i, j]
                order = np.lexsort((neighbour, node))
                node, neighbour, found = node[order], neighbour[order], found[order]
                once = np.append(True, (node[1:] != node[:-1]) | (neighbour[1:] != neighbour[:-1]))
                yield _edge_batch(node[once], neighbour[once], found[once])


def build(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", degree: int = DEGREE, held: int = 11) -> Graph:
    """The neighbour graph of (key, vector); what takes part is said at :func:`usable`.

    Repeated rows and equal vectors are one node. An empty table gives an empty graph.
    """
    points = written(usable(rows, key, vector).withColumn("same", F.md5(F.to_json("vector"))), "points")
    lowest = points.groupBy("same").agg(F.min("id").alias("node"))
    points = written(points.join(lowest, "same").drop("same"), "points")
    smallest = Window.partitionBy("node").orderBy("id")
    members = points.select("node", "id").withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= held).drop("place")
    nodes = written(points.where("id = node").select("node", "vector"), "nodes")
    members = written(members, "members")
    n = nodes.count()
    codes = written(_codes(nodes), "codes")

    lists = None
    for cut in range(CUTS if n > 2 * CELL else 1):
        found = _first_lists(codes, cut, n // CELL if n > 2 * CELL else 1, degree)
        lists = found if lists is None else lists.unionByName(found)
    lists = written(_shortest(lists.withColumn("new", F.lit(1)), degree), "lists")
    while n > 2 * CELL:
        forward = lists.select(F.col("node").alias("at"), F.col("neighbour").alias("member"), "new", F.col("place").alias("by"))
        backward = lists.select(F.col("neighbour").alias("at"), F.col("node").alias("member"), "new",
                                F.xxhash64("node", "neighbour").alias("by"))
        some = Window.partitionBy("at").orderBy(F.desc("new"), "by", "member")
        meeting = forward.withColumn("n", F.row_number().over(some)).where(F.col("n") <= MEETING).unionByName(
            backward.withColumn("n", F.row_number().over(some)).where(F.col("n") <= MEETING))
        meeting = meeting.groupBy("at", "member").agg(F.max("new").alias("new"))
        worst = lists.groupBy(F.col("node").alias("member")).agg(F.max("d").alias("worst"), F.count(F.lit(1)).alias("n")).select(
            "member", F.when(F.col("n") < degree, F.lit(float("inf"))).otherwise(F.col("worst")).cast("float").alias("worst"))
        known = codes.select(F.col("node").alias("member"), "code").join(worst, "member")
        brought = meeting.join(known, "member").select("at", "member", "new", "worst", "code")
        pairs = brought.repartition("at").sortWithinPartitions("at").mapInArrow(_met, EDGE)
        both = lists.select("node", "neighbour", "d", F.lit(0).alias("new")).unionByName(pairs.withColumn("new", F.lit(1)))
        lists = written(_shortest(both, degree), "lists")
        if lists.where("new = 1").count() <= SETTLED * n * degree:
            break

    back = Window.partitionBy("neighbour").orderBy("d", "node")
    reverse = lists.withColumn("n", F.row_number().over(back)).where(F.col("n") <= degree).select(
        F.col("neighbour").alias("node"), F.col("node").alias("neighbour"))
    links = lists.select("node", "neighbour").unionByName(reverse).groupBy("node").agg(
        F.collect_set("neighbour").alias("neighbours"))  # twice ``degree`` at most
    return Graph(points, nodes, members, written(links, "links"))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, in double precision; what would overflow or vanish is scaled first."""
    with np.errstate(over="ignore", invalid="ignore"):
        difference = a - b
        d = np.sqrt((difference ** 2).sum(1))
        odd = ~np.isfinite(d) | ((d < 1e-150) & (difference != 0).any(1))
        if odd.any():
            x, y = a[odd] / 2, b[odd] / 2
            most = np.abs(x - y).max(1)
            d[odd] = 2 * most * np.sqrt((((x - y) / most[:, None]) ** 2).sum(1))
    return d


def _starts(graph: Graph, queries: DataFrame, seeds: int) -> DataFrame:
    """(query_id, node) where each query starts: the node of an equal vector, else the sampled nodes nearest to it."""
    own = queries.withColumn("same", F.md5(F.to_json("vector"))).join(
        graph.nodes.select("node", F.md5(F.to_json("vector")).alias("same")), "same", "left")
    own = written(own.select("query_id", "vector", "node"), "starts")
    lost = own.where("node IS NULL")
    found = own.where("node IS NOT NULL").select("query_id", "node")
    if lost.isEmpty():
        return found
    sample = graph.nodes.orderBy(F.xxhash64("node")).limit(seeds).toArrow()  # a bounded sample
    held = queries.sparkSession.sparkContext.broadcast((np.asarray(sample.column("node")), _matrix(sample.column("vector"))))

    def run(batches):
        nodes, vectors = held.value
        for batch in batches:
            if not batch.num_rows or not len(nodes):
                continue
            ids, v = np.asarray(batch.column("query_id")), _matrix(batch.column("vector"))
            near = [nodes[np.argsort(_distances(vectors, row[None, :]), kind="stable")[:16]] for row in v]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, [len(x) for x in near])), pa.array(np.concatenate(near))], ["query_id", "node"])

    return found.unionByName(lost.select("query_id", "vector").mapInArrow(run, "query_id long, node long"))


def _compared(wanted: DataFrame, nodes: DataFrame, block) -> DataFrame:
    """(query_id, node, d) of (query_id, node): the nodes come with their vectors, the queries are broadcast."""
    def run(batches):
        ids, vectors = block.value
        for batch in batches:
            for a in range(0, batch.num_rows, 8192):
                part = batch.slice(a, 8192)
                query = np.searchsorted(ids, np.asarray(part.column("query_id")))
                d = _distances(vectors[query], _matrix(part.column("vector")))
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("node"), pa.array(d)], ["query_id", "node", "d"])

    return wanted.join(nodes, "node").select("query_id", "node", "vector").mapInArrow(run, "query_id long, node long, d double")


def _search_block(graph: Graph, queries: DataFrame, beam: int) -> DataFrame:
    """(query_id, node, d): the ``beam`` nearest nodes that each query of one block finds."""
    spark = queries.sparkSession
    table = queries.select("query_id", "vector").orderBy("query_id").toArrow()  # one block, bounded by QUERY_BYTES
    block = spark.sparkContext.broadcast((np.asarray(table.column("query_id")), _matrix(table.column("vector"))))
    nearest = Window.partitionBy("query_id").orderBy("d", "node")

    def kept(rows):
        once = rows.groupBy("query_id", "node").agg(F.min("d").alias("d"), F.max("open").alias("open"))
        return once.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= beam).drop("place")

    found = written(kept(_compared(_starts(graph, queries, SEEDS), graph.nodes, block).withColumn("open", F.lit(0))), "beam")
    following = Window.partitionBy("query_id").orderBy("d", "node")
    while True:
        # the next to open are the nearest closed ones, and none is left when all of the beam is open
        closed = found.where("open = 0").withColumn("place", F.row_number().over(following)).where(F.col("place") <= OPENED)
        opening = written(closed.select("query_id", "node"), "opening")
        if opening.isEmpty():
            return found
        wanted = opening.join(graph.links, "node").select("query_id", F.explode("neighbours").alias("node")).distinct()
        new = wanted.join(found, ["query_id", "node"], "left_anti")
        reached = _compared(new, graph.nodes, block).withColumn("open", F.lit(0))
        opened = opening.join(found.select("query_id", "node", "d"), ["query_id", "node"]).withColumn("open", F.lit(1))
        found = written(kept(found.unionByName(opened).unionByName(reached)), "beam")


def search(graph: Graph, queries: DataFrame, k: int = 10, beam: int = BEAM, exclude_self: bool = True) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest ids found for each (query_id, vector).

    score is the Euclidean distance; equal ones are in the order of id. With ``exclude_self``
    the id that equals query_id is not a result. Fewer rows come only where there are fewer
    ids. The graph's members hold k + 1 ids of a node at least, so no id is missed.
    """
    width = queries.agg(F.max(F.size("vector"))).first()[0] or 1
    blocks = -(-queries.count() * width * 8 // QUERY_BYTES)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))))
    found = None
    for i in range(max(1, blocks)):
        part = _search_block(graph, queries.where(F.col("block") == i).drop("block"), beam)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("d", "id")
    rows = found.join(graph.members, "node").select("query_id", "id", "d")
    if exclude_self:
        rows = rows.where("id <> query_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", F.col("d").alias("score"))
