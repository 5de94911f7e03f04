"""Chat formatting: logged snapshots of one conversation collapsed into the longest, then rendered.

A chat logged after every turn is stored as many conversations, each a prefix of the
next. The hash of a prefix is the running exclusive or of its turns' hashes, each of
which holds the turn's number, role and text; two independent hashes make 128 bits.
A conversation whose whole hash is the hash of a proper prefix of another is a snapshot
of it and falls to an anti-join; of equal conversations the smallest conv_id stays. All
of it is DataFrame operations; prefix hashes are aggregated to distinct ones before
they are joined, so a first turn that a third of all conversations share is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aisle.llm.shared import written

CHUNK_TURNS = 256
"""Turn numbers hashed or rendered together: what one task holds of a conversation at once."""
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns with a conversation and a number; null role and text count as empty."""
    return conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).dropDuplicates()


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2): hash of the conversation's turns up to each turn number.

    Running hashes are taken within chunks of turn numbers, then over the chunks, so no
    task runs through an unbounded conversation turn by turn.
    """
    hashed = _turns(conversations).select(
        "conv_id", "turn", F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk"),
        F.xxhash64("turn", "role", "text").alias("x1"), F.xxhash64(F.lit("second"), "text", "role", "turn").alias("x2"))
    turns = hashed.groupBy("conv_id", "chunk", "turn").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn")
    turns = turns.select("conv_id", "chunk", "turn", *[F.expr("bit_xor(x%d)" % k).over(inside).alias(f"x{k}") for k in (1, 2)])
    chunks = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0)).alias(f"b{k}") for k in (1, 2)])
    return turns.join(bases, ["conv_id", "chunk"]).select(
        "conv_id", "turn", F.col("x1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("b2")).alias("h2"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_snapshots) of the conversations that no other one continues.

    ``n_snapshots`` counts the equal conversations, itself included.
    """
    every = written(prefixes(conversations), "prefixes")
    last = every.groupBy("conv_id").agg(F.max(F.struct("turn", "h1", "h2")).alias("x")).select("conv_id", "x.*")
    whole = last.groupBy("turn", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_snapshots"))
    proper = every.join(last.select("conv_id", F.col("turn").alias("last")), "conv_id").where("turn < last").select("turn", "h1", "h2").distinct()
    return whole.join(proper, ["turn", "h1", "h2"], "left_anti").select("conv_id", "n_snapshots")


def render(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Maximal conversations as text: (conv_id, part, n_turns, n_snapshots, text).

    ``template`` is applied to each turn in order of turn, role and text, with {role} and
    {text} filled in. A conversation is one row, part 0, unless its turn numbers pass
    CHUNK_TURNS; then each run of CHUNK_TURNS numbers is a part, so that a row and a
    task stay bounded. Rows without conv_id or turn are left out; repeated rows count
    once; turns that share a number stay, in order of role and text; a null role or text
    is empty. Extra columns are ignored; an empty table gives none.
    """
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    turns = _turns(conversations).join(maximal(conversations), "conv_id")
    parts = turns.groupBy("conv_id", F.floor(F.col("turn") / CHUNK_TURNS).alias("part")).agg(
        F.count(F.lit(1)).alias("n_turns"), F.min("n_snapshots").alias("n_snapshots"),
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    line = lambda t: F.concat(F.lit(head), t["role"], F.lit(middle), t["text"], F.lit(tail))
    return parts.select("conv_id", "part", "n_turns", "n_snapshots", F.array_join(F.transform("turns", line), "").alias("text"))
