"""Prefix trie of conversations by van Emde Boas recursion.

A trie of depth 2^m is cut at half its depth: the cut prefixes are named, the upper half
is one trie, and below every cut prefix hangs a trie of the lower halves. Both kinds are
cut again, all pieces of a level in one Spark pass, until a piece is one turn deep: that
is a node. Pieces that are equal and hang below the same prefix become one before
they are cut, so a shared beginning is cut once. Totals go the other way: what a lower
forest holds is summed, and grafted to the node it hangs from.

Nothing holds a conversation or a group of conversations whole. Turns are rows; a block
of 2^r turns is named from its two halves, so naming costs two rows a turn in all. Every
level is a written table. A name is two 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.llm.shared import written

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


class Trie(NamedTuple):
    nodes: DataFrame
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, n_words (of the last text) and the name (name_a, name_b)."""
    ends: DataFrame
    """conv_id of every conversation and the name (name_a, name_b) of the node where it ends."""


def _hashed(kind: int, *parts: str | Column) -> tuple[Column, Column]:
    """A name of 128 bits; ``kind`` keeps turns, blocks and prefixes apart."""
    return F.xxhash64(F.lit(2 * kind), *parts), F.xxhash64(F.lit(2 * kind + 1), *parts)


TURN, BLOCK, PREFIX = 0, 1, 2
ROOT = (0, 0)
"""The name of the empty prefix."""


def _root() -> tuple[Column, Column]:
    return F.lit(ROOT[0]).cast("long"), F.lit(ROOT[1]).cast("long")


def items(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, words) of (conv_id, turn, role, text): one narrow row per turn.

    A null role or text is empty. Turns without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    a, b = _hashed(TURN, role, text)
    words = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", a.alias("a"), b.alias("b"), words.alias("words"))


def numbered(rows: DataFrame) -> DataFrame:
    """``items`` with pos, the place of a turn in its conversation, from 0.

    Turns are in the order of turn, null first; equal turns in the order of their hashes, so
    repeated rows are repeated turns. A conversation of any length is numbered in pieces: the
    rows are dealt out by range, counted per range, and the counts before are added.
    """
    order = [F.asc_nulls_first("turn"), F.asc("a"), F.asc("b")]
    ranged = written(rows.repartitionByRange(F.asc("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return ranged.withColumn("pos", inside - 1).join(before, ["conv_id", "part"]).select(
        "conv_id", (F.col("pos") + F.col("before")).cast("long").alias("pos"), "a", "b", "words")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another: ((conv_id, pos, a, b, words), (conv_id, n)).

    Conversation c has the first h turns of conversation c - c % ``every`` (all if there are
    fewer, none if it is absent), then its own from the h-th on; h = crc32(c) % ``heads``.
    n is the number of turns that result; a conversation may be left without any.
    """
    own = written(turns, "numbered")
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own_n")).withColumns({
        "base": F.expr(f"conv_id - conv_id % {every}"),
        "h": F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)),
    })
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own_n").alias("base_n"))
    sizes = sizes.join(base, "base", "left").withColumn("head_n", F.least("h", F.coalesce("base_n", F.lit(0))))
    sizes = written(sizes.withColumn("n", F.col("head_n") + F.greatest(F.col("own_n") - F.col("h"), F.lit(0))), "sizes")
    first = own.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "base")
    head = sizes.join(first, "base").where("pos < head_n").select("conv_id", "pos", "a", "b", "words")
    tail = own.join(sizes, "conv_id").where("pos >= h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("head_n")).alias("pos"), "a", "b", "words")
    return head.unionByName(tail), sizes.select("conv_id", "n")


def _blocks(turns: DataFrame, sizes: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Per level r the blocks of 2^r turns: (whole sequences that fit, halves of each block, last blocks).

    A sequence of n turns is named once by the smallest block that holds it. The last
    blocks are those that the binary digits of n stand for: 6 turns are one of 4 and one of 2.
    """
    level = written(turns.join(sizes, "conv_id").select("conv_id", "n", F.col("pos").alias("j"), "a", "b", "words"), "blocks")
    whole, halves, last = [], [], []
    r = 0
    while True:
        ended = F.expr(f"(n >> {r}) & 1 = 1 AND j = (n >> {r}) - 1")
        last.append(level.where(ended).select("conv_id", F.lit(r).alias("r"), "a", "b"))
        whole.append(level.where(F.col("n") <= 1 << r).select("conv_id", "a", "b", "words"))
        rest = level.where(F.col("n") > 1 << r)
        if rest.isEmpty():
            return whole, halves, last
        sides = [F.max(F.when(F.expr(f"j & 1 = {side}"), F.col(c))).alias(f"{name}_{c}")
                 for side, name in enumerate(("left", "right")) for c in ("a", "b", "words")]
        paired = rest.groupBy("conv_id", "n", F.expr("j >> 1").alias("j")).agg(*sides)
        a, b = _hashed(BLOCK, "left_a", "left_b", "right_a", "right_b")
        paired = written(paired.withColumns({"a": a, "b": b}), "blocks")
        halves.append(paired.select("a", "b", *[f"{s}_{c}" for s in ("left", "right") for c in ("a", "b", "words")]).distinct())
        level = paired.select("conv_id", "n", "j", "a", "b", F.lit(0).cast("long").alias("words"))
        r += 1


PIECE = ["root_a", "root_b", "a", "b", "end_a", "end_b", "at", "words"]


def _gathered(pieces: DataFrame) -> DataFrame:
    """Equal pieces below the same prefix as one, with their members counted."""
    return pieces.groupBy(*PIECE).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


def _started(whole: DataFrame) -> DataFrame:
    """Whole sequences as pieces that hang from the root."""
    end_a, end_b = _hashed(PREFIX, *_root(), "a", "b")
    return whole.select(
        _root()[0].alias("root_a"), _root()[1].alias("root_b"), "a", "b", end_a.alias("end_a"), end_b.alias("end_b"),
        F.lit(0).cast("long").alias("at"), "words", F.lit(1).cast("long").alias("n_convs"), "conv_id")


def _cut(pieces: DataFrame, halves: DataFrame) -> DataFrame:
    """Pieces with their halves and the name of the prefix they are cut at."""
    cut_a, cut_b = _hashed(PREFIX, "root_a", "root_b", "left_a", "left_b")
    return pieces.drop("words").join(halves, ["a", "b"]).drop("a", "b").withColumns({"cut_a": cut_a, "cut_b": cut_b})


def _halves(cut: DataFrame, size: int) -> DataFrame:
    """The upper and lower halves of cut pieces, ``size`` turns deep, as pieces."""
    def side(name, root, end, at):
        names = {"root_a": f"{root}_a", "root_b": f"{root}_b", "a": f"{name}_a", "b": f"{name}_b",
                 "end_a": f"{end}_a", "end_b": f"{end}_b"}
        return F.struct(*[F.col(c).alias(n) for n, c in names.items()], at.alias("at"), F.col(f"{name}_words").alias("words"))

    both = F.array(side("left", "root", "cut", F.col("at")), side("right", "cut", "end", F.col("at") + size))
    return cut.select(F.explode(both).alias("x"), "n_convs", "conv_id").where("x.a IS NOT NULL").select("x.*", "n_convs", "conv_id")


def _summed(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def build(turns: DataFrame, sizes: DataFrame) -> Trie:
    """The trie of (conv_id, pos, a, b, words) and (conv_id, n), n = 0 where there are no turns.

    A node is a distinct sequence of first turns; conversations that begin with it are its
    members. n_leaves counts the childless nodes of its subtree, itself included;
    saved_tokens sums (n_convs - 1) * n_words over it. Without conversations there is no node;
    with turnless ones only, the root is the one node and leaf. Rows of equal (conv_id, pos)
    must not occur; :func:`numbered` never makes them.
    """
    sizes = written(sizes, "sizes")
    whole, halves, last = _blocks(turns, sizes)
    levels = len(halves)

    # cut downwards: pieces of 2^r turns become pieces of 2^(r-1), down to one turn
    pieces, cuts = written(_gathered(_started(whole[levels])), "pieces"), {}
    for r in range(levels, 0, -1):
        cuts[r] = written(_cut(pieces, halves[r - 1]), "cut")
        pieces = written(_gathered(_halves(cuts[r], 1 << r - 1).unionByName(_started(whole[r - 1]))), "pieces")
    children = pieces.groupBy("root_a", "root_b").agg(F.count(F.lit(1)).alias("n_children")).select(
        F.col("root_a").alias("end_a"), F.col("root_b").alias("end_b"), "n_children")
    none = F.coalesce("n_children", F.lit(0).cast("long"))
    nodes = written(pieces.drop("a", "b").join(children, ["end_a", "end_b"], "left").withColumns({
        "n_children": none, "leaves": F.when(none == 0, 1).otherwise(0).cast("long"),
        "saved": (F.col("n_convs") - 1) * F.col("words"),
    }), "nodes")

    # sum upwards: totals of the tries of 2^r turns below each prefix
    totals = [written(_summed(nodes, "root_a", "root_b"), "totals")]
    owners = {}
    for r in range(1, levels + 1):
        owners[r] = written(cuts[r].where("right_a IS NOT NULL").select("cut_a", "cut_b", "root_a", "root_b").distinct(), "owners")
        owner = owners[r].select(F.col("cut_a").alias("root_a"), F.col("cut_b").alias("root_b"),
                                 F.col("root_a").alias("up_a"), F.col("root_b").alias("up_b"))
        up = totals[-1].join(owner, ["root_a", "root_b"], "left").select(
            F.coalesce("up_a", "root_a").alias("root_a"), F.coalesce("up_b", "root_b").alias("root_b"), "leaves", "saved")
        totals.append(written(_summed(up, "root_a", "root_b"), "totals"))

    # graft: below a cut prefix is its lower trie, and what hangs from the ends of that
    below = totals[levels].select(F.col("root_a").alias("end_a"), F.col("root_b").alias("end_b"), "leaves", "saved")
    for r in range(levels, 0, -1):
        grafts = cuts[r].where("right_a IS NOT NULL").select("cut_a", "cut_b", "end_a", "end_b").join(
            below, ["end_a", "end_b"]).select("cut_a", "cut_b", "leaves", "saved")
        lower = totals[r - 1].join(owners[r].select(F.col("cut_a").alias("root_a"), F.col("cut_b").alias("root_b")),
                                   ["root_a", "root_b"], "left_semi")
        under = written(_summed(lower.select(F.col("root_a").alias("cut_a"), F.col("root_b").alias("cut_b"), "leaves", "saved")
                                .unionByName(grafts), "cut_a", "cut_b"), "below")
        below = below.unionByName(under.select(F.col("cut_a").alias("end_a"), F.col("cut_b").alias("end_b"), "leaves", "saved"))

    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        _root()[0].alias("end_a"), _root()[1].alias("end_b"), F.lit(None).cast("long").alias("root_a"), F.lit(None).cast("long").alias("root_b"),
        F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("saved"))
    root = root.join(children, ["end_a", "end_b"], "left").withColumn("n_children", none)
    root = root.withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    every = nodes.withColumn("depth", F.col("at") + 1).drop("at").unionByName(root)
    every = every.join(below.withColumnsRenamed({"leaves": "more_leaves", "saved": "more_saved"}), ["end_a", "end_b"], "left")
    parents = every.select(F.col("end_a").alias("root_a"), F.col("end_b").alias("root_b"), F.col("conv_id").alias("parent_conv_id"))
    nodes = every.join(parents, ["root_a", "root_b"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        F.col("words").alias("n_words"), F.col("end_a").alias("name_a"), F.col("end_b").alias("name_b"))

    # the end of a conversation: its last blocks, largest first, name prefix after prefix
    parts = last[0]
    for more in last[1:]:
        parts = parts.unionByName(more)
    steps = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("r")).alias("r"), "a", "b"))).alias("steps"))

    def step(name, x):
        a, b = _hashed(PREFIX, name["a"], name["b"], x["a"], x["b"])
        return F.struct(a.alias("a"), b.alias("b"))

    named = steps.select("conv_id", F.aggregate("steps", F.struct(_root()[0].alias("a"), _root()[1].alias("b")), step).alias("end"))
    ends = sizes.select("conv_id").join(named, "conv_id", "left").select(
        "conv_id", F.coalesce("end.a", _root()[0]).alias("name_a"), F.coalesce("end.b", _root()[1]).alias("name_b"))
    return Trie(nodes, ends)


def digests(ends: DataFrame) -> DataFrame:
    """(name_a, name_b, ends_sha256): SHA-256 of each node's decimal conv_ids, ascending, comma-joined.

    The ids of a node are sorted by Spark, which spills, and run through one digest in order:
    SHA-256 has no partial form, so a node's ids are one task's work, but never held.
    """
    def run(batches):
        name, digest = None, None
        done: list[tuple[int, int, str]] = []
        for batch in batches:
            a, b = np.asarray(batch.column("name_a")), np.asarray(batch.column("name_b"))
            text = pc.cast(batch.column("conv_id"), pa.string())
            edge = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for first, stop in zip([0, *edge], [*edge, len(a)], strict=True):
                if stop == first:
                    continue
                joined = ",".join(text.slice(first, stop - first).to_pylist()).encode()
                if name == (a[first], b[first]):
                    digest.update(b",")
                else:
                    if name is not None:
                        done.append((*name, digest.hexdigest()))
                    name, digest = (a[first], b[first]), hashlib.sha256()
                digest.update(joined)
            if done:
                yield _digest_batch(done)
                done = []
        if name is not None:
            yield _digest_batch([*done, (*name, digest.hexdigest())])

    spread = ends.repartition("name_a", "name_b").sortWithinPartitions("name_a", "name_b", "conv_id")
    return spread.select("name_a", "name_b", "conv_id").mapInArrow(run, "name_a long, name_b long, ends_sha256 string")


def _digest_batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.string())],
                                      ["name_a", "name_b", "ends_sha256"])


def with_digests(trie: Trie) -> DataFrame:
    """Nodes with ends_sha256 of the conversations that end there (of the empty string if none does)."""
    found = trie.nodes.join(digests(trie.ends), ["name_a", "name_b"], "left")
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA256))).drop("name_a", "name_b")


def prefixes(conversations: DataFrame) -> Trie:
    """The trie of (conv_id, turn, role, text) as they are, without rebuilding."""
    turns = written(numbered(items(conversations)), "numbered")
    return build(turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
