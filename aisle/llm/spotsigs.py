"""Document fingerprints by spot signatures, in DataFrame operations only.

A signature is a common word (the anchor) with the two content words that follow it,
common words in between left out. A document's fingerprint is the set of its
signatures, written as sorted hexadecimal numbers. Fingerprints are compared by the
Jaccard similarity of the sets; for a join they are partitioned by set length, as sets
whose lengths differ too much cannot be similar, and only the rarest signatures of a
set are looked up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.llm.shared import written

# Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to "
    "was we were what which will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui sa se ses son sont sur un une vous "
    "als am auf aus bei bis da das dass dem den der die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch "
    "oder sich sie sind so über um und von vor war wie wird zu zum zur "
    "al como con del el ella ese esta este fue ha hay las lo los más muy no nos o para pero por sin sobre su sus también tan todo una uno y ya"
).split()
_MARK, _END = "\x01", "\x02"
BUCKET_BITS, LEVEL_BITS = 10, 14


def with_signatures(frame: DataFrame, text: str, into: str) -> DataFrame:
    """``frame`` with the signatures of column ``text``: sorted distinct 32-bit numbers, never empty.

    A text without common words takes every word as an anchor; a text without words,
    also an empty or null one, has the hash of itself as its only signature.
    """
    words, spots = f"_{into}_words", f"_{into}_spots"
    split = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.transform(split, lambda w: F.when(w.isin(ANCHORS), F.concat(F.lit(_MARK), w)).otherwise(w))
    # one entry per content word, with the common words before it; the end counts as one.
    # Possessive repeats: the regex engine neither recurses nor goes back over long runs.
    grouped = F.regexp_extract_all(
        F.concat(F.array_join(marked, " "), F.lit(" " + _END)), F.lit(rf"(?<![^ ])(?:{_MARK}[^ ]++ )*+[^{_MARK} ][^ ]*+"), F.lit(0))

    def content(j):
        return F.substring_index(F.coalesce(F.get(F.col(spots), j), F.lit("")), " ", -1)

    def number(*parts):
        return F.shiftrightunsigned(F.xxhash64(*parts), 32)

    chains = F.filter(F.transform(F.col(spots), lambda s, j: F.when(
        s.startswith(_MARK), number(F.substring_index(s, " ", -2), content(j + 1)))), lambda x: x.isNotNull())
    every = F.transform(F.col(spots), lambda s, j: number(content(j), content(j + 1)))
    frame = frame.withColumn(spots, grouped).withColumn(words, chains)
    found = F.when(F.size(words) > 0, F.col(words)).when(F.size(spots) > 1, every).otherwise(
        F.array(number(F.lower(F.coalesce(F.col(text), F.lit(""))))))
    return frame.withColumn(into, F.array_sort(F.array_distinct(found))).drop(words, spots)


def fingerprint(signatures: Column) -> Column:
    """The set as text."""
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x), 8, "0")), " ")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets; null if their lengths alone keep it under ``least``."""
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    if not least:
        return exact
    return F.when(F.least(F.size(a), F.size(b)) >= least * F.greatest(F.size(a), F.size(b)), exact)


def similar(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of fingerprint classes with a likeness of ``least`` or more.

    ``prints`` has id and signatures. Equal sets are one class, named by its smallest id,
    so copies are not paired; :func:`classes` gives the members. Each set looks up as
    many of its rarest signatures as a similar set cannot all lack, in its own partition
    of set lengths and the next. Null ids are left out; empty tables give none.
    """
    sets = written(prints.where("id IS NOT NULL").groupBy("signatures").agg(F.min("id").alias("id")), "sets").withColumn("n", F.size("signatures"))
    single = sets.select("id", "n", F.explode("signatures").alias("s"))
    rarity = single.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a signature of one set alone is the rarest and meets nothing: it only takes up a place
    kept = single.join(rarity, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("shared"))
    places = F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1 - (F.col("n") - F.size("shared"))
    step = F.lit(math.log(1 / least) if least < 1 else 1e-9)
    looked = kept.where(places > 0).select("id", "n", F.floor(F.log(F.col("n").cast("double")) / step).alias("part"),
                                           F.explode(F.slice("shared", F.lit(1), places.cast("int"))).alias("x"))
    left = looked.select(F.col("id").alias("a"), F.col("n").alias("na"), "part", F.col("x.s").alias("s"))
    right = looked.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("x.s").alias("s"))
    pairs = left.join(right, ["part", "s"]).where("a <> b").where(
        F.least("na", "nb") >= least * F.greatest("na", "nb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one, two = sets.select(F.col("id").alias("a"), F.col("signatures").alias("x")), sets.select(F.col("id").alias("b"), F.col("signatures").alias("y"))
    return pairs.join(one, "a").join(two, "b").withColumn("likeness", likeness(F.col("x"), F.col("y"), least)).where(
        F.col("likeness") >= least).select("a", "b", "likeness")


def classes(prints: DataFrame) -> DataFrame:
    """(id, class_id): the smallest id with an equal fingerprint."""
    smallest = prints.groupBy("signatures").agg(F.min("id").alias("class_id"))
    return prints.join(smallest, "signatures").select("id", "class_id")


def _next_lower(keys: DataFrame, bits: int) -> DataFrame:
    """(k, next) of distinct numbers of ``bits`` bits: the next smaller one, null for the smallest.

    Numbers are looked at in groups with equal leading bits, and the groups likewise,
    until at most 2^LEVEL_BITS groups can be left.
    """
    if bits <= LEVEL_BITS:
        return keys.select("k", F.lead("k").over(Window.orderBy(F.desc("k"))).alias("next"))
    up = keys.withColumn("up", F.shiftright("k", LEVEL_BITS))
    inside = up.withColumn("next", F.lead("k").over(Window.partitionBy("up").orderBy(F.desc("k"))))
    tops = up.groupBy("up").agg(F.max("k").alias("top"))
    order = _next_lower(tops.select(F.col("up").alias("k")), bits - LEVEL_BITS).select(F.col("k").alias("up"), F.col("next").alias("below"))
    first = order.join(tops.select(F.col("up").alias("below"), "top"), "below").select("up", "top")
    return inside.join(first, "up", "left").select("k", F.coalesce("next", "top").alias("next"))


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, signatures, next_text, next_signatures); a null text is empty.

    The next row is that of the next smaller doc_id, after the smallest that of the
    largest; rows of one doc_id follow each other by text. A row without doc_id is its
    own next. Ids are dealt out in ranges of 2^BUCKET_BITS, so texts are shuffled once,
    and only the first row of each range travels to the range before.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("doc_id IS NOT NULL").withColumn("bucket", F.shiftright("doc_id", BUCKET_BITS)).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), "text")
    heads = known.withColumn("place", F.row_number().over(order)).where("place = 1").select("bucket", F.col("text").alias("head_text"))
    heads = with_signatures(heads, "head_text", "head_signatures")
    buckets = rows.where("doc_id IS NOT NULL").select(F.shiftright("doc_id", BUCKET_BITS).alias("k")).distinct()
    links = _next_lower(buckets, 64 - BUCKET_BITS)
    highest = buckets.agg(F.max("k").alias("highest"))
    links = links.join(F.broadcast(highest)).select(F.col("k").alias("from"), F.coalesce("next", "highest").alias("bucket"))
    heads = heads.join(links, "bucket").drop("bucket").withColumnRenamed("from", "bucket")
    inside = with_signatures(known, "text", "signatures").withColumns({
        "next_text": F.lead("text").over(order), "next_signatures": F.lead("signatures").over(order)})
    joined = inside.join(heads.hint("merge"), "bucket", "left").select(
        "doc_id", "text", "signatures", F.coalesce("next_text", "head_text").alias("next_text"),
        F.coalesce("next_signatures", "head_signatures").alias("next_signatures"))
    alone = with_signatures(rows.where("doc_id IS NULL"), "text", "signatures")
    return joined.unionByName(alone.select("doc_id", "text", "signatures", F.col("text").alias("next_text"), F.col("signatures").alias("next_signatures")))


def edited(documents: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its edited text and the next document's.

    The edited text has the last half (rounded down) of the code points replaced by the
    first as many, or all, of the next document. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_signatures.
    """
    rows = with_next(documents).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited_text", F.concat(
        F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_signatures(rows, "edited_text", "edited_signatures")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"), fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"), F.size("signatures").alias("n_signatures"),
    )
