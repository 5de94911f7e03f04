"""Operators on the query table: validation, intent, expansion, word-level normalisation."""

from __future__ import annotations

from collections.abc import Mapping

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv
from aisle.functions import intent, text

#: A dictionary or a rules table of up to this many bytes is broadcast.
HELD_BYTES = 32 << 20


def validate(queries: DataFrame, top_k: int | Column = 5) -> DataFrame:
    """Add ``reason`` (null when valid) and the bounded ``top_k``."""
    q = F.trim(F.coalesce(F.col("query"), F.lit("")))
    k = F.lit(top_k) if isinstance(top_k, int) else top_k
    reason = (
        F.when(q == "", "empty query")
        .when(F.length(q) > fv.MAX_QUERY_CHARS, f"query longer than {fv.MAX_QUERY_CHARS} characters")
    )
    return queries.withColumns({
        "reason": reason, "top_k": F.least(F.greatest(k, F.lit(1)), F.lit(fv.MAX_TOP_K)),
    })


def with_constraints(queries: DataFrame) -> DataFrame:
    """Add gender, wants_tshirt, wants_kids and constrained."""
    df = queries.withColumns(intent.query_constraints(F.col("query")))
    return df.withColumn(
        "constrained", intent.is_constrained(F.col("gender"), F.col("wants_tshirt"))
    )


def expand_text(query: Column, rules: Mapping[str, str] | None = None) -> Column:
    """The query followed by the terms of every trigger it contains, in rule order."""
    table = fv.INTENT_EXPANSIONS if rules is None else rules
    lowered = F.lower(query)
    entries = text.constant(
        [{"trigger": t, "terms": terms} for t, terms in table.items()],
        "array<struct<trigger: string, terms: string>>",
    )
    hits = F.transform(F.filter(entries, lambda r: F.contains(lowered, r["trigger"])), lambda r: r["terms"])
    return F.when(F.size(hits) == 0, query).otherwise(
        F.concat(query, F.lit(" "), F.array_join(hits, " "))
    )


def _expand_by_automaton(queries: DataFrame, rules: DataFrame) -> DataFrame:
    """:func:`expand` with a rules table whose bytes were checked; equal (ord, terms) count once."""
    used = rules.where(F.length("trigger") > 0).select("ord", "trigger", F.coalesce("terms", F.lit("")).alias("terms")).distinct()
    rows = sorted((r["ord"], r["terms"], r["trigger"]) for r in used.collect())
    by_trigger: dict[str, list[int]] = {}
    for i, (_, _, trigger) in enumerate(rows):
        by_trigger.setdefault(trigger, []).append(i)
    held = queries.sparkSession.sparkContext.broadcast((rows, by_trigger))
    built: list = []  # one automaton per Python worker

    @F.arrow_udf("string")
    def hits(lowered: pa.Array) -> pa.Array:
        table, triggers = held.value
        if not built:
            automaton = ahocorasick.Automaton()
            for trigger, places in triggers.items():
                automaton.add_word(trigger, places)
            automaton.make_automaton()
            built.append(automaton)
        found = []
        for query in lowered.to_pylist():
            seen = {i for _, places in built[0].iter(query) for i in places} if query and triggers else ()
            terms = dict.fromkeys(table[i][:2] for i in sorted(seen))
            found.append(" ".join(t for _, t in terms) if terms else None)
        return pa.array(found, pa.string())

    added = hits(F.lower("query"))
    return queries.withColumn("_terms", added).withColumn("expanded", F.when(F.col("_terms").isNull(), F.col("query")).otherwise(
        F.concat("query", F.lit(" "), "_terms"))).drop("_terms")


def expand(
    queries: DataFrame, rules: Mapping[str, str] | DataFrame | None = None, limit: int | None = None,
) -> DataFrame:
    """Add ``expanded``.

    A mapping becomes one array literal, so nothing is joined. A rules table
    (ord, trigger, terms) of up to ``limit`` bytes (checked) becomes an automaton that
    finds all triggers in one pass over a query; a larger one is joined on the first three
    characters of the trigger, which any text containing the trigger contains too.
    """
    if not isinstance(rules, DataFrame):
        return queries.withColumn("expanded", expand_text(F.col("query"), rules))
    if _held_bytes(rules, ["trigger", "terms"]) <= (HELD_BYTES if limit is None else limit):
        return _expand_by_automaton(queries, rules)
    gram = 3
    keyed_rules = rules.where(F.length("trigger") > 0).select(
        "ord", "trigger", "terms", F.substring("trigger", 1, gram).alias("_gram")
    )
    lowered = F.lower("query")
    starts = F.sequence(F.lit(1), F.greatest(F.length(lowered), F.lit(1)))
    grams = F.flatten(F.transform(
        starts, lambda i: F.array(*[F.substring(lowered, i, F.lit(n)) for n in range(1, gram + 1)])
    ))
    grams = queries.select("query_id", lowered.alias("_lowered"), F.explode(F.array_distinct(grams)).alias("_gram"))
    hits = (
        grams.join(keyed_rules, "_gram").where(F.contains("_lowered", "trigger"))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set(F.struct("ord", "terms"))).alias("_hits"))
        .select("query_id", F.array_join(F.transform("_hits", lambda h: h["terms"]), " ").alias("_terms"))
    )
    joined = queries.join(hits, "query_id", "left")
    expanded = F.when(F.col("_terms").isNull(), F.col("query")).otherwise(
        F.concat("query", F.lit(" "), "_terms")
    )
    return joined.withColumn("expanded", expanded).drop("_terms")


def refine(
    queries: DataFrame, rewrites: DataFrame | None = None,
    rules: Mapping[str, str] | DataFrame | None = None,
) -> DataFrame:
    """Add ``refined_query``: a rewrite made elsewhere, else the rule-based expansion.

    ``rewrites`` is (query, refined) with at most one row per query text; rows
    with a null or blank ``refined`` count as failed.
    """
    df = expand(queries, rules)
    if rewrites is None:
        return df.withColumn("refined_query", F.col("expanded")).drop("expanded")
    usable = rewrites.where(F.trim("refined") != "").groupBy("query").agg(
        F.min(F.trim("refined")).alias("_refined")
    )
    joined = df.join(usable, "query", "left")
    return joined.withColumn("refined_query", F.coalesce("_refined", "expanded")).drop("_refined", "expanded")


def _held_bytes(frame: DataFrame, columns: list[str]) -> int:
    """Bytes of the texts in ``columns``, with a fixed share per row."""
    size = F.lit(64)
    for c in columns:
        size = size + F.coalesce(F.octet_length(F.col(c)), F.lit(0))
    return frame.agg(F.sum(size)).first()[0] or 0


def lemmatize_join(
    df: DataFrame, column: str, lexicon: DataFrame, key: str, output: str = "lemmatized", limit: int | None = None,
) -> DataFrame:
    """Tokens replaced by their lemma from ``lexicon(form, lemma)``, order kept.

    A lexicon of up to ``limit`` bytes (checked) is broadcast and looked up in one pass over
    the texts, which stay where they are. A larger one is joined with the tokens of the
    distinct (``key``, text) pairs, whose words meet again by that pair: rows that
    share a key keep their own texts. A form with several lemmas has the smallest.
    """
    forms = lexicon.where("form IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("lemma"))
    limit = HELD_BYTES if limit is None else limit
    words = text.tokens(F.coalesce(F.col(column), F.lit("")))
    if _held_bytes(forms, ["form", "lemma"]) <= limit:
        table = forms.toArrow()  # the bytes were checked
        held = df.sparkSession.sparkContext.broadcast((table.column(0).combine_chunks(), table.column(1).combine_chunks()))

        @F.arrow_udf("array<string>")
        def lemmas(tokens: pa.Array) -> pa.Array:
            known, lemma = held.value
            flat = tokens.flatten().cast(pa.string())
            found = lemma.cast(pa.string()).take(pc.index_in(flat, value_set=known.cast(pa.string())))
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pc.coalesce(found, flat))

        return df.withColumn(output, F.array_join(lemmas(words), " "))
    texts = df.select(F.col(key).alias("_key"), F.coalesce(F.col(column), F.lit("")).alias("_text")).distinct()
    spread = texts.select("_key", "_text", F.posexplode(text.tokens(F.col("_text"))).alias("_pos", "form"))
    mapped = spread.join(forms, "form", "left").select(
        "_key", "_text", F.struct("_pos", F.coalesce("lemma", "form").alias("w")).alias("_word")
    )
    lines = mapped.groupBy("_key", "_text").agg(F.array_sort(F.collect_list("_word")).alias("_words")).select(
        "_key", "_text", F.array_join(F.transform("_words", lambda e: e["w"]), " ").alias("_line")
    )
    same = df[key].eqNullSafe(lines["_key"]) & (F.coalesce(df[column], F.lit("")) == lines["_text"])
    joined = df.join(lines, same, "left").drop("_key", "_text")
    return joined.withColumn(output, F.coalesce(F.col("_line"), F.lit(""))).drop("_line")


def normalize_queries(
    df: DataFrame, column: str = "query", output: str = "normalized",
    words: Mapping[str, str] | None = None, stop: Column | None = None,
    lexicon: DataFrame | None = None, key: str = "query_id",
) -> DataFrame:
    """Lower case → code-mixed words → punctuation → stopwords → lemmas."""
    base = F.trim(F.lower(F.coalesce(F.col(column), F.lit(""))))
    staged = df.withColumn(output, text.map_words(base, words))
    staged = staged.withColumn(output, text.remove_special_chars(F.col(output)))
    staged = staged.withColumn(output, text.remove_stopwords(F.col(output), stop))
    if lexicon is None:
        return staged
    lemmas = lemmatize_join(staged.withColumnRenamed(output, "_plain"), "_plain", lexicon, key, output)
    return lemmas.drop("_plain")
