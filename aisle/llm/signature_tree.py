"""Similarity join of documents on word n-grams by signature trees.

A document is its set of distinct word shingles. A signature is a bitmap of the
set; a tree's leaf is one set, an inner node holds the OR of its children's bitmaps,
their range of set sizes and their largest count of members that share a bit. Two
nodes can hold a linked pair only if their size ranges allow the wanted similarity
and the bits they have in common, plus what collisions may hide, reach the overlap
that it needs. Traversing two trees at once drops all other pairs of nodes.

How it runs on Spark, none of it on pairs of all documents:

1. Sets are taken from whole texts; equal sets become one class.
2. Sets in order (common shingles last, then by hash) that are similar enough share
   one of their first shingles, so a class is dealt to these. A common shingle is
   found by counting all shingles of all documents in a fixed number of slots.
3. Classes that meet at a shingle are joined there by a tree of bitmaps. What
   survives is a superset of the links; only a spanning forest of it is passed on.
   A meeting too large for a task is passed on whole, as a star (see :func:`_stars`).
4. Its connected components are small, and each has all links of its members:
   there a second tree, checked by exact set overlap, finds the links. A component
   too large for a task is dealt out in blocks (see :func:`_large`).

Hashes are 64 bits wide: among N distinct sets the chance that any two coincide is
about N² / 2⁶⁵.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.llm.batches import Words, chunks, mix
from aisle.llm.shared import BROADCAST_ROWS, Union, components, free_name, whole_groups, without, written

SLOTS = 1 << 18
FAN_OUT = 8
SMALL_GROUP = 32
BLOCK_SHINGLES = 4_000_000
"""Shingles of a block; a component with more is dealt out in several, a meeting with more is not gathered."""
MAP_BITS = 1 << 29
"""Bits of all bitmaps of one exact comparison."""
LIKELY_BITS = 1 << 26


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def _sets(batch: pa.RecordBatch, words: int):
    """(row, ascending shingle hashes, their bounds) of the texts, part by part."""
    for row, data, offsets in chunks(batch.column("text")):
        found = Words(data, offsets)
        yield row, *found.shingles(found.hashes(lower=True), words)


def _set_id(hashes: np.ndarray) -> int:
    weights = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    return int(mix(np.array([mix(hashes ^ mix(weights)).sum(dtype=np.uint64)]))[0].astype(np.int64))


def _bitmap(hashes: np.ndarray, bits: int) -> bytes:
    flags = np.zeros(bits, bool)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _classes_of(n: int, num: int, den: int) -> list[int]:
    """Size classes (powers of two) where a set of ``n`` meets all sets it can be linked with."""
    return sorted({max(n.bit_length(), 6), max((n * den // num).bit_length(), 6)})


class SignatureTree:
    """A tree over sets ordered by size; ``bitmaps`` is one row of bytes per set."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray):
        width = -(-bitmaps.shape[1] // 8) * 8
        if width != bitmaps.shape[1]:
            bitmaps = np.pad(bitmaps, ((0, 0), (0, width - bitmaps.shape[1])))
        rows = np.ascontiguousarray(bitmaps).view(np.uint64)
        hidden = sizes - np.bitwise_count(rows).sum(1, dtype=np.int64)
        self.levels = [(rows, sizes, sizes, hidden)]
        while len(self.levels[-1][0]) > 1:
            rows, low, high, hidden = self.levels[-1]
            starts = np.arange(0, len(rows), FAN_OUT)
            self.levels.append((
                np.bitwise_or.reduceat(rows, starts, 0), np.minimum.reduceat(low, starts),
                np.maximum.reduceat(high, starts), np.maximum.reduceat(hidden, starts),
            ))

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which node pairs may hold a linked pair."""
        rows, low, high, hidden = self.levels[level]
        fits = (high[i] * den >= low[j] * num) & (high[j] * den >= low[i] * num)
        i, j = i[fits], j[fits]
        common = np.bitwise_count(rows[i] & rows[j]).sum(1, dtype=np.int64)
        most = np.minimum(common + np.minimum(hidden[i], hidden[j]), np.minimum(high[i], high[j]))
        fits[fits] = most * (num + den) >= (low[i] + low[j]) * num
        return fits

    def traverse(self, num: int, den: int, settled) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets i < j that survive, in batches.

        ``settled()`` gives a group number per set as known so far; nodes whose sets
        all belong to one group are not compared again.
        """
        step = max(1, (4 << 20) // (8 * self.levels[0][0].shape[1]))
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > step:
                stack.append((level, i[step:], j[step:]))
                i, j = i[:step], j[:step]
            group = settled()
            starts = np.arange(0, len(group), FAN_OUT ** level)
            low, high = np.minimum.reduceat(group, starts), np.maximum.reduceat(group, starts)
            open_ = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
            if not level:
                open_ &= i < j
            i, j = i[open_], j[open_]
            kept = self._possible(level, i, j, num, den)
            i, j = i[kept], j[kept]
            if not len(i):
                continue
            if not level:
                yield i, j
                continue
            nodes = len(self.levels[level - 1][0])
            child = np.arange(FAN_OUT)
            a = (i[:, None, None] * FAN_OUT + child[:, None]).repeat(FAN_OUT, 2).reshape(len(i), -1)
            b = (j[:, None, None] * FAN_OUT + child[None, :]).repeat(FAN_OUT, 1).reshape(len(i), -1)
            real = (a < nodes) & (b < nodes) & (a <= b)
            stack.append((level - 1, a[real], b[real]))


def _common_slots(documents: DataFrame, words: int) -> np.ndarray:
    """How far each slot's count of shingles stands above what chance explains; 0: not at all.

    Every shingle of every document is counted. The result has SLOTS numbers whatever
    the input, and only sets the order of shingles: any order gives the same links.
    """
    def count(batches):
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, hashes, _ in _sets(batch, words):
                total += np.bincount(_slot(hashes), minlength=SLOTS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": used.astype(np.int32), "n": total[used]})

    counted = documents.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counted.toArrow()
    total = np.zeros(SLOTS)
    total[np.asarray(found.column("slot"))] = np.asarray(found.column("n"))
    usual = max(np.median(total), 1.0)
    above = (total - usual) / np.sqrt(usual)
    return np.where(above > 6, np.minimum(above, 30_000), 0).astype(np.int16)


def _described(documents: DataFrame, words: int, num: int, den: int, common) -> DataFrame:
    """(doc_id, mark, n, id, first, classes, bitmaps) of every document."""
    def describe(batches):
        for batch in batches:
            for row, hashes, bounds in _sets(batch, words):
                out: dict[str, list] = {"n": [], "id": [], "first": [], "classes": [], "bitmaps": []}
                order = common.value[_slot(hashes)]
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    mine, n = hashes[a:b], int(b - a)
                    classes = _classes_of(n, num, den) if n else []
                    first = mine[np.argsort(order[a:b], kind="stable")[: n + (-n * num) // den + 1]] if n else mine
                    out["n"].append(n)
                    out["id"].append(_set_id(mine) if n else None)
                    out["first"].append(first.view(np.int64))
                    out["classes"].append(classes)
                    out["bitmaps"].append([_bitmap(mine, 1 << c) for c in classes])
                part = batch.slice(row, len(bounds) - 1)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("mark"), pa.array(out["n"], pa.int64()), pa.array(out["id"], pa.int64()),
                    pa.array(out["first"], pa.list_(pa.int64())), pa.array(out["classes"], pa.list_(pa.int32())),
                    pa.array(out["bitmaps"], pa.list_(pa.binary())),
                ], ["doc_id", "mark", "n", "id", "first", "classes", "bitmaps"])

    return documents.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(
        describe, "doc_id long, mark long, n long, id long, first array<long>, classes array<int>, bitmaps array<binary>")


def _meetings(num: int, den: int):
    """Of (token, id, n, place) sorted by token: (key, id) of the sets that meet there and may be linked.

    Two sets are met at the first shingle they share, so at most what follows in
    either is common. ``key`` is that of the meeting's members: the many shingles at
    which the same copies meet give one meeting.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "token", 200_000):
            token, ids, size, place = (np.asarray(table.column(c)) for c in ("token", "id", "n", "place"))
            begin = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            count = np.diff(np.append(begin, len(token)))
            group = np.repeat(np.arange(len(begin)), count)
            may = (count > SMALL_GROUP)[group]
            for apart in range(1, min(int(count.max(initial=1)), SMALL_GROUP)):
                i = np.flatnonzero((group[:-apart] == group[apart:]) & (count <= SMALL_GROUP)[group[apart:]])
                j = i + apart
                most = np.minimum(size[i] - place[i], size[j] - place[j])
                i = i[(size[i] * den >= size[j] * num) & (size[j] * den >= size[i] * num)
                      & (most * (num + den) >= (size[i] + size[j]) * num)]
                may[i], may[i + apart] = True, True
            group, ids = group[may], ids[may]
            members = np.zeros(len(begin), np.uint64)
            np.add.at(members, group, mix(ids.view(np.uint64)))
            rows = np.unique(np.stack([mix(members)[group].view(np.int64), ids], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], ["token", "id"])
    return run


def _stars(members: DataFrame, num: int, den: int) -> DataFrame:
    """Of (token, id, n): the members of each token and size class linked with the smallest id among them.

    No task gathers a meeting: the smallest ids are aggregated before the shuffle and
    broadcast back if they are few. A class meets at its rare shingles first, so what
    meets at such a common one consists of common ones nearly whole; the exact step decides.
    """
    def classes(batches):
        for batch in batches:
            size = np.asarray(batch.column("n"))
            known = {n: _classes_of(n, num, den) for n in np.unique(size).tolist()}
            found = [known[n] for n in size.tolist()]
            row = np.repeat(np.arange(len(size)), [len(c) for c in found])
            yield pa.RecordBatch.from_arrays([
                batch.column("token").take(pa.array(row)), pa.array([c for many in found for c in many], pa.int32()),
                batch.column("id").take(pa.array(row))], ["token", "class", "id"])

    rows = members.select("token", "id", "n").mapInArrow(classes, "token long, class int, id long")
    ends = written(rows.groupBy("token", "class").agg(F.min("id").alias("b")), "stars")
    few = ends.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ends) if few else ends, ["token", "class"]).where("id <> b").select(
        F.col("id").alias("a"), "b").distinct()


def _possible_links(num: int, den: int):
    """Of (key, id, n, bitmap) sorted by key: a spanning forest of the pairs whose bitmaps allow a link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key"):
            key, size = (np.asarray(table.column(c)) for c in ("key", "n"))
            nodes, node = np.unique(np.asarray(table.column("id")), return_inverse=True)
            maps = table.column("bitmap").combine_chunks().cast(pa.large_binary())
            offsets = np.frombuffer(maps.buffers()[1], np.int64)[maps.offset : maps.offset + len(maps) + 1]
            data = np.frombuffer(maps.buffers()[2], np.uint8)
            width = np.diff(offsets)
            union = Union(len(nodes))
            edges: list[tuple[int, int]] = []
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            count = np.diff(np.append(begin, len(key)))
            group = np.repeat(np.arange(len(begin)), count)

            def connect(i, j):
                for a, b in np.unique(np.stack([node[i], node[j]], 1), axis=0).tolist():
                    if union.join(a, b):
                        edges.append((a, b))

            small = count <= SMALL_GROUP
            for apart in range(1, int(count[small].max(initial=1))):  # all pairs of a small group's rows so far apart
                i = np.flatnonzero((group[:-apart] == group[apart:]) & small[group[apart:]])
                j = i + apart
                fits = (size[i] * den >= size[j] * num) & (size[j] * den >= size[i] * num)
                i, j = i[fits], j[fits]
                for w in np.unique(width[i]):
                    a, b = i[width[i] == w], j[width[i] == w]
                    for at in range(0, len(a), step := max(1, (8 << 20) // int(w))):
                        p, q = a[at : at + step], b[at : at + step]
                        x, y = (data[offsets[r][:, None] + np.arange(w)].view(np.uint64) for r in (p, q))
                        missing = np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
                        extra = np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
                        most = np.minimum(size[p] - missing, size[q] - extra)
                        near = most * (num + den) >= (size[p] + size[q]) * num
                        connect(p[near], q[near])
            for at, n in zip(begin[~small].tolist(), count[~small].tolist(), strict=True):
                rows = at + np.argsort(size[at : at + n], kind="stable")
                w = int(width[at])
                tree = SignatureTree(size[rows], data[offsets[rows][:, None] + np.arange(w)])
                for i, j in tree.traverse(num, den, lambda rows=rows: union.roots()[node[rows]]):
                    connect(rows[i], rows[j])
            ends = nodes[np.array(edges, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])
    return run


def _likely(spark, picked: DataFrame):
    """Drops most rows of (d, mark, text) whose mark is not in ``picked``, before they are shuffled.

    The marks are a bitmap of 16 bits a row, at most LIKELY_BITS; a fuller one lets more rows pass.
    """
    rows = picked.count()
    bits = min(max(1 << (16 * max(rows, 1) - 1).bit_length(), 1 << 16), LIKELY_BITS)
    slots = picked.select(F.pmod("mark", F.lit(bits)).alias("slot")).groupBy(F.expr("slot div 8").alias("byte")).agg(
        F.expr("bit_or(shiftleft(1, cast(slot % 8 as int)))").alias("bits")).toArrow()  # at most LIKELY_BITS / 8 rows
    table = np.zeros(bits // 8, np.uint8)
    table[np.asarray(slots.column("byte"))] = np.asarray(slots.column("bits"))
    held = spark.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            slot = np.asarray(batch.column("mark")) & (bits - 1)
            yield batch.filter(pa.array((held.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
    return run


def _set_rows(words: int):
    """(grp, part, side, id, settled, text) to the same rows with their sets."""
    def run(batches):
        for batch in batches:
            for row, hashes, bounds in _sets(batch, words):
                part = batch.slice(row, len(bounds) - 1)
                sets = pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("grp", "id")] + [sets], ["grp", "id", "hashes"])
    return run


def _exact_links(num: int, den: int):
    """Of (key, id, settled, hashes) sorted by key: a spanning forest of each group's links.

    ``settled`` numbers what is known to be linked already; those pairs are not compared.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", 2_000):
            key = np.asarray(table.column("key"))
            ids, known = np.asarray(table.column("id")), np.asarray(table.column("settled"))
            hashes = table.column("hashes").combine_chunks()
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            links = []
            for a, b in zip(begin, np.append(begin[1:], len(key)), strict=True):
                _, first = np.unique(ids[a:b], return_index=True)
                rows = a + first
                sets = [np.frombuffer(hashes[int(r)].as_py(), np.uint64) for r in rows]
                size = np.array([len(s) for s in sets])
                order = np.argsort(size, kind="stable")
                rows, sets, size = rows[order], [sets[k] for k in order], size[order]
                bits = 1 << max(min(int(size.max()).bit_length() + 1, 16, (MAP_BITS // len(sets)).bit_length() - 1), 6)
                maps = np.stack([np.frombuffer(_bitmap(s, bits), np.uint8) for s in sets])
                union = Union(len(rows))
                start: dict[int, int] = {}
                for k, group in enumerate(known[rows].tolist()):
                    union.join(start.setdefault(group, k), k)
                for i, j in SignatureTree(size, maps).traverse(num, den, union.roots):
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        if union.find(x) == union.find(y):
                            continue
                        overlap = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if overlap * den >= (len(sets[x]) + len(sets[y]) - overlap) * num:
                            union.join(x, y)
                            links.append((ids[rows[x]], ids[rows[y]]))
            ends = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])
    return run


def _links_within(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) within each ``key`` of (key, id, settled, hashes)."""
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_exact_links(num, den), "a long, b long")


def _salted(rows: DataFrame, by: list[str], block: int) -> DataFrame:
    """``rows`` with ``chunk``: each group of ``by`` in as many as hold ``block`` shingles each."""
    chunks_of = written(rows.groupBy(*by).agg(F.expr(f"sum(n) div {block} + 1").alias("chunks")), "chunks")
    few = chunks_of.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(chunks_of) if few else chunks_of, by).withColumn(
        "chunk", F.expr("pmod(xxhash64(id, 1), chunks)")).drop("chunks")


def _large(sets: DataFrame, blocks: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Links of the components dealt out in blocks.

    First links within blocks, then links between two members of every part found
    so far (its smallest and its largest set), parts of about as many sets together.
    Parts of one large group of near copies meet there, so what remains is the sets
    outside the component's most frequent part: they are compared with every block,
    a chunk of them at a time. Nothing is left out, no task holds more than a block
    and a chunk, and a group of near copies is not compared with itself block by block.
    """
    rows = written(sets.join(blocks, ["grp", "id"]).withColumn("n", F.expr("length(hashes) div 8")), "blocks")
    inner = written(_links_within(
        rows.select(F.xxhash64("grp", "block").alias("key"), "id", F.col("id").alias("settled"), "hashes"), num, den), "links")
    part = components(inner)
    rows = rows.join(part.withColumnsRenamed({"node": "id", "component": "part"}), "id", "left").withColumn(
        "part", F.coalesce("part", "id"))
    ends = rows.groupBy("grp", "part").agg(
        F.min_by("id", "n").alias("x"), F.max_by("id", "n").alias("y"), F.expr("cast(log2(count(*)) as int) div 3").alias("many")).select(
        F.explode(F.array_distinct(F.array("x", "y"))).alias("id"), "many").withColumn("many", F.explode(F.expr("array(many, many + 1)")))
    pivots = _salted(rows.join(ends, "id").withColumn("sized", F.expr("cast(log2(n) as int)")), ["grp", "sized", "many"], block)
    across = written(_links_within(pivots.select(
        F.xxhash64("grp", "sized", "many", "chunk").alias("key"), "id", F.col("part").alias("settled"), "hashes"), num, den), "links")
    part = components(inner.unionByName(across))
    rows = written(rows.drop("part").join(part.withColumnsRenamed({"node": "id", "component": "part"}), "id", "left").withColumn(
        "part", F.coalesce("part", "id")), "blocks")
    counts = rows.groupBy("grp", "part").count()
    main = counts.groupBy("grp").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    others = written(_salted(rows.join(main, "grp").where("part <> main"), ["grp"], block), "others")
    places = blocks.select("grp", F.col("block").alias("place")).distinct()
    sent = others.join(places, "grp").where("block <> place").select("grp", F.col("place").alias("block"), "chunk", "id", "part", "hashes")
    met = rows.select("grp", "block", "id", "part", "hashes").join(
        others.select("grp", "chunk").distinct(), "grp").select("grp", "block", "chunk", "id", "part", "hashes")
    last = _links_within(met.unionByName(sent).select(
        F.xxhash64("grp", "block", "chunk").alias("key"), "id", F.col("part").alias("settled"), "hashes"), num, den)
    return inner.unionByName(across).unionByName(last)


def linked(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``num / den`` or more.

    Returns (doc_id, n_shingles, component_id, class_id) per row of ``documents``,
    which has doc_id and text (other columns are ignored). Words are lower-cased in
    A-Z; a text with fewer than ``words`` words is one shingle; an empty or null text
    has no shingle and is a component of its own. ``class_id`` and ``component_id``
    are the smallest doc_id with an equal set and the smallest reachable by links; rows
    with a null doc_id take part but never name a component, unless they are alone
    (then it is null). Repeated rows give repeated rows. An empty table gives none.
    """
    return _labelled(documents, words, num, den, block).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "class_id")


def _labelled(documents: DataFrame, words: int, num: int, den: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """What :func:`linked` returns, with the hash of the text (mark) and the set id that names the component."""
    spark = documents.sparkSession
    documents = documents.select("doc_id", "text")
    common = spark.sparkContext.broadcast(_common_slots(documents, words))
    described = written(_described(documents, words, num, den, common), "sets")
    sets = described.where("n > 0")

    firsts = written(sets.select("id", F.col("n").cast("int").alias("n"), "first").dropDuplicates(["id"]), "firsts").select(
        "id", "n", F.posexplode("first").alias("place", "token"))
    hot = written(firsts.groupBy("token").agg(F.sum("n").alias("total"), F.count("*").alias("members")).where(
        (F.col("total") > block) & (F.col("members") > 1)).select("token"), "hot")
    stars = None if hot.isEmpty() else _stars(firsts.join(hot, "token", "left_semi"), num, den)
    shared = (firsts if stars is None else without(firsts, hot, "token")).repartition("token").sortWithinPartitions("token").mapInArrow(
        _meetings(num, den), "token long, id long").distinct()
    maps = sets.select("id", "n", "classes", "bitmaps").dropDuplicates(["id"])
    dealt = shared.join(maps.hint("shuffle_hash"), "id").select(
        "token", "id", "n", F.explode(F.arrays_zip("classes", "bitmaps")).alias("x")).select(
        F.xxhash64("token", "x.classes").alias("key"), "id", "n", F.col("x.bitmaps").alias("bitmap"))
    possible = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_possible_links(num, den), "a long, b long")
    near = written(components(possible if stars is None else possible.unionByName(stars)), "near")

    # one row per class that may have a link, with its text's set
    picked = sets.groupBy("id").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "mark")).alias("x"), F.min("n").alias("n"))
    picked = picked.join(near.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id")
    picked = written(picked.select("grp", "id", "n", "x.d", F.col("x.mark").alias("mark")), "picked")
    own = documents.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("mark"), "text")
    own = own.mapInArrow(_likely(spark, picked), "d long, mark long, text string")
    # one text a class: rows that repeat a doc_id and a text meet as their first one
    texts = own.groupBy("d", "mark").agg(F.first("text").alias("text"))
    with_sets = texts.join(picked.hint("merge"), ["d", "mark"]).select("grp", "id", "text").mapInArrow(
        _set_rows(words), "grp long, id long, hashes binary")

    total = picked.groupBy("grp").agg(F.sum("n").alias("total"))
    large = written(picked.join(total.where(F.col("total") > block), "grp").select(
        "grp", "id", F.expr(f"pmod(xxhash64(id), total div {block} + 1)").alias("block")), "large")
    if large.isEmpty():
        links = _links_within(with_sets.select(F.col("grp").alias("key"), "id", F.col("id").alias("settled"), "hashes"), num, den)
    else:
        small = with_sets.join(large.select("grp").distinct(), "grp", "left_anti")
        links = _links_within(small.select(F.col("grp").alias("key"), "id", F.col("id").alias("settled"), "hashes"), num, den)
        links = links.unionByName(_large(with_sets, large, num, den, block))
    found = components(links)

    classes = sets.groupBy("id").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    names = classes.groupBy("component").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(names, "component")
    alone = F.when(F.col("n") == 0, F.col("doc_id"))
    return described.select("doc_id", "mark", "n", "id").join(classes, "id", "left").select(
        "doc_id", "mark", "n", "component",
        F.coalesce(alone, "class_id").alias("class_id"), F.coalesce(alone, "component_id").alias("component_id"))


def one_of_each(documents: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``documents`` with one row of each component: that of the smallest doc_id.

    Documents without words stay. Of different texts with that doc_id in one component
    the one of the smallest hash stays, and of rows that repeat it, one. A row with a
    null doc_id stays only where no other row of the component has a doc_id. Rows are
    told apart by doc_id and text, so a doc_id on texts of several components is
    judged in each of them.
    """
    name = free_name(documents, "_row")

    def row(mark, name="_row"):
        return F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), mark).alias(name)

    labels = written(_labelled(documents, words, num, den).where("n > 0").select(
        "component", "doc_id", "mark", row(F.col("mark"))), "labels")
    chosen = labels.groupBy("component").agg(
        F.min(F.struct(F.isnull("doc_id"), "doc_id", "mark", "_row")).getField("_row").alias("chosen"), F.count("*").alias("rows"))
    several = written(labels.select("component", "_row").join(chosen.where("rows > 1"), "component").groupBy("_row").agg(
        F.first("chosen").alias("chosen"), F.count("*").alias("rows")), "several")
    gone = several.where("_row <> chosen").select(F.col("_row").alias(name))
    kept = without(documents.withColumn(name, row(F.xxhash64("text"), name)), gone, name)
    repeated = several.where("_row = chosen AND rows > 1").select(F.col("_row").alias(name))
    if not repeated.isEmpty():
        again = kept.join(repeated, name, "left_semi").dropDuplicates([name])
        kept = kept.join(repeated, name, "left_anti").unionByName(again)
    return kept.select(*[F.col(f"`{c}`") for c in documents.columns])
