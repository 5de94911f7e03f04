"""Search over a table of queries: the four models, intent reranking, routing, ensemble."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv
from aisle.functions import intent
from aisle.operators import hierarchy, knn
from aisle.operators.catalog import filter_products
from aisle.operators.encode import encode
from aisle.operators.queries import refine, validate, with_constraints
from aisle.schema import FILTER_COLUMNS, RESULT_COLUMNS
from aisle.sources.folders import shared_folder


@dataclass(frozen=True)
class SearchIndex:
    """The tables a search reads. A model whose tables are None is not loaded."""

    catalog: DataFrame
    flat: DataFrame | None = None
    enhanced: DataFrame | None = None
    nodes: DataFrame | None = None
    leaves: DataFrame | None = None
    flat_cells: knn.Cells | None = None
    enhanced_cells: knn.Cells | None = None
    dim: int = fv.EMBEDDING_DIM
    #: Cells to probe per query; None searches exactly. Only the caller sets it, whatever the size.
    nprobe: int | None = None

    def approximate(self, nprobe: int = fv.IVF_PROBES) -> SearchIndex:
        """This index with flat and enhanced searches limited to the ``nprobe`` nearest cells."""
        if self.flat_cells is None or self.enhanced_cells is None:
            raise ValueError("the index was saved without cells")
        return replace(self, nprobe=nprobe)

    def loaded(self) -> list[str]:
        have = {
            fv.HIERARCHICAL: self.nodes is not None and self.leaves is not None,
            fv.FLAT: self.flat is not None,
            fv.ENHANCED: self.enhanced is not None,
            fv.EXPANDED: self.enhanced is not None,
        }
        return [m for m in fv.MODELS if have[m]]


def top_k(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The k first rows per group with a rank from 1; pruned before the shuffle."""
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def rerank_score(semantic: Column, weights: Mapping[str, float] | None = None) -> Column:
    """Semantic score blended with rating, reviews, price and stock of the joined product."""
    w = fv.RERANK_WEIGHTS if weights is None else weights
    reviews = F.coalesce(F.col("reviews_count"), F.lit(0))
    price = F.coalesce(F.col("price"), F.lit(0.0))
    reviews_score = F.when(
        reviews > 0, F.least(F.log1p(reviews) / F.log1p(F.lit(fv.REVIEWS_FULL_SCORE)), F.lit(1.0))
    ).otherwise(0.0)
    price_score = F.when(
        price > 0, F.least(price / float(fv.PRICE_FULL_SCORE), F.lit(1.0))
    ).otherwise(fv.PRICE_MISSING_SCORE)
    in_stock = F.contains(F.lower(F.coalesce(F.col("stock_status"), F.lit(""))), F.lit("in stock"))
    return (
        semantic * w["semantic_similarity"]
        + F.coalesce(F.col("rating"), F.lit(0.0)) / 5.0 * w["rating_score"]
        + reviews_score * w["reviews_score"]
        + price_score * w["price_relevance"]
        + F.when(in_stock, 1.0).otherwise(fv.OUT_OF_STOCK_SCORE) * w["stock_bonus"]
    )


def bounded_confidence(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "high").when(confidence >= 0.4, "mid").otherwise("low")


def attach_products(hits: DataFrame, catalog: DataFrame, rows: int | None) -> DataFrame:
    """Hits with their product's columns.

    ``rows`` is an upper bound on the hits, known when the queries fitted into a
    block: then the hits are broadcast and the catalogue is not shuffled.
    """
    if rows is not None and rows <= knn.BROADCAST_ROWS:
        hits = F.broadcast(hits)
    return catalog.join(hits, catalog["product_id"] == hits["target_id"]).drop("target_id")


def to_results(ranked: DataFrame, model_id: str, score: Column, extra: Sequence[str] = ()) -> DataFrame:
    """The result contract: bounded confidence, shortened description, fixed columns."""
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("product_name", "department", "category", "brand")]
    return ranked.select(
        "query_id", F.lit(model_id).alias("model_id"), "rank", "product_id", *text,
        F.coalesce("price", F.lit(0.0)).alias("price"),
        F.coalesce("rating", F.lit(0.0)).alias("rating"),
        F.coalesce("reviews_count", F.lit(0)).alias("reviews_count"),
        F.substring(F.coalesce("description", F.lit("")), 1, fv.RESULT_DESCRIPTION_CHARS).alias("description"),
        bounded_confidence(score).alias("confidence_score"),
        *extra,
    )


@dataclass(frozen=True)
class Prepared:
    """Encoded queries with intent columns, ``top_k`` and ``fetch_k``; their block, largest fetch_k and top_k."""

    queries: DataFrame
    block: knn.QueryBlock | None
    fetch: int
    most: int

    @property
    def rows(self) -> int | None:
        return _rows(self.block, self.fetch)


def _written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once to the shared folder and read back."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def prepare(
    queries: DataFrame, top_k: int, text: str = "query", dim: int = fv.EMBEDDING_DIM,
    overfetch: int = 1, block: knn.QueryBlock | None = None,
) -> Prepared:
    """Intent, number of results to fetch, and vectors of a query table.

    Queries that ``validate`` gives a reason against are left out. A column ``top_k``, if
    there is one, is the number of results each query wants (bounded like ``top_k``);
    else all want ``top_k``. A query with gender or t-shirt intent fetches more, because
    intent moves its results afterwards; others fetch ``overfetch`` times the wanted number.
    The result is a written table: a search reads its queries many times, and they may
    come from a large table of their own.
    """
    each = "top_k" in queries.columns
    wanted = F.coalesce(F.col("top_k").cast("int"), F.lit(top_k)) if each else top_k
    df = validate(queries, wanted).where("reason IS NULL").drop("reason")
    most = min((df.agg(F.max("top_k")).first()[0] if each else top_k) or 1, fv.MAX_TOP_K)
    df = with_constraints(df).withColumn("fetch_k", F.when(
        F.col("constrained"), F.least(F.col("top_k") * fv.CONSTRAINED_OVERFETCH, F.lit(fv.MAX_TOP_K))
    ).otherwise(F.col("top_k") * overfetch))
    typed = [c for c, kind in df.dtypes if kind != "void"]  # Parquet has no column without a type
    encoded = _written(encode(df.select(*typed), text, dim=dim), f"queries-{uuid.uuid4().hex}")
    block = knn.query_block(encoded) if block is None else block
    return Prepared(encoded, block, max(min(most * fv.CONSTRAINED_OVERFETCH, fv.MAX_TOP_K), most * overfetch), most)


def _fetch_k(hits: DataFrame, queries: DataFrame, factor: int, rows: int | None) -> DataFrame:
    """Cut each query's hits to ``factor`` times its own fetch_k, where it has one."""
    if "fetch_k" not in queries.columns:
        return hits
    wanted = queries.select("query_id", "fetch_k")
    if rows is not None:
        wanted = F.broadcast(wanted)
    return hits.join(wanted, "query_id").where(F.col("rank") <= F.col("fetch_k") * factor)


def _rows(block: knn.QueryBlock | None, k: int) -> int | None:
    return None if block is None else len(block) * k


def _flat_hits(
    queries: DataFrame, vectors: DataFrame, cells: knn.Cells | None, k: int,
    block: knn.QueryBlock | None, nprobe: int | None,
) -> DataFrame:
    if nprobe is not None:
        return knn.ivf(queries, cells, k, nprobe, block=block)
    return knn.flat(queries, vectors, k, block=block)


def search_flat(
    queries: DataFrame, index: SearchIndex, k: int, block: knn.QueryBlock | None = None, hits: DataFrame | None = None,
) -> DataFrame:
    """Nearest products by combined text. ``queries`` is encoded; fetch_k is optional."""
    block = knn.query_block(queries) if block is None else block
    if hits is None:
        hits = _flat_hits(queries, index.flat, index.flat_cells, k, block, index.nprobe)
    hits = _fetch_k(hits, queries, 1, _rows(block, k))
    found = attach_products(hits, index.catalog, _rows(block, k))
    return to_results(found, fv.FLAT, F.col("confidence"))


def search_enhanced(
    queries: DataFrame, index: SearchIndex, k: int, block: knn.QueryBlock | None = None,
    weights: Mapping[str, float] | None = None, model_id: str = fv.ENHANCED, extra: Sequence[str] = (),
    hits: DataFrame | None = None,
) -> DataFrame:
    """Five times the wanted neighbours by enriched text, reranked by metadata, cut to k."""
    block = knn.query_block(queries) if block is None else block
    fetch = k * fv.OVERFETCH
    if hits is None:
        hits = _flat_hits(queries, index.enhanced, index.enhanced_cells, fetch, block, index.nprobe)
    hits = _fetch_k(hits, queries, fv.OVERFETCH, _rows(block, fetch))
    scored = attach_products(
        hits.withColumnRenamed("rank", "_previous"), index.catalog, _rows(block, fetch)
    ).withColumn("_score", F.round(rerank_score(F.col("confidence"), weights), knn.SCORE_DIGITS))
    ranked = top_k(scored, ["query_id"], [F.desc("_score"), F.col("_previous")], k)
    if "fetch_k" in queries.columns:
        ranked = ranked.where(F.col("rank") <= F.col("fetch_k"))
    return to_results(ranked, model_id, F.col("_score"), extra)


def search_hierarchical(
    queries: DataFrame, index: SearchIndex, k: int, block: knn.QueryBlock | None = None, hits: DataFrame | None = None,
) -> DataFrame:
    """Beam search down the taxonomy, products ranked by decayed path score."""
    block = knn.query_block(queries) if block is None else block
    if hits is None:
        hits = hierarchy.search(queries, index.nodes, index.leaves, k, block=block)
    hits = _fetch_k(hits, queries, 1, _rows(block, k))
    found = attach_products(hits, index.catalog, _rows(block, k))
    return to_results(found, fv.HIERARCHICAL, F.col("score"))


def _refined(queries, index, rewrites, rules) -> tuple[DataFrame, knn.QueryBlock | None]:
    encoded = encode(refine(queries.drop("embedding"), rewrites, rules), "refined_query", dim=index.dim)
    return encoded, knn.query_block(encoded)


@dataclass(frozen=True)
class SharedHits:
    """Each model's neighbours of one prepared query table, as written tables at the deepest need."""

    hits: Mapping[str, DataFrame]
    #: (query_id, refined_query) of the expanded model's queries, and their block.
    refined: DataFrame | None
    refined_block: knn.QueryBlock | None


def shared_hits(
    prepared: Prepared, index: SearchIndex, models: Sequence[str], fetch: int, rewrites: DataFrame | None = None,
    rules: Mapping[str, str] | DataFrame | None = None,
) -> SharedHits:
    """Neighbours for every search of ``models`` up to ``fetch`` results a query, found once.

    Routed searches and the ensemble cut the same tables to what each query needs, so a
    vector table is scanned once per kind of query vector, however many models read it.
    """
    base = f"hits-{uuid.uuid4().hex}"

    def written(frame: DataFrame, name: str) -> DataFrame:
        return _written(frame, f"{base}/{name}")

    found, refined, refined_block = {}, None, None
    for model in models:
        if model == fv.HIERARCHICAL:
            hits = hierarchy.search(prepared.queries, index.nodes, index.leaves, fetch, block=prepared.block)
        elif model == fv.FLAT:
            hits = _flat_hits(prepared.queries, index.flat, index.flat_cells, fetch, prepared.block, index.nprobe)
        else:
            queries, block = prepared.queries, prepared.block
            if model == fv.EXPANDED:
                queries, block = _refined(queries, index, rewrites, rules)
                refined, refined_block = written(queries.select("query_id", "refined_query"), "refined"), block
            hits = _flat_hits(queries, index.enhanced, index.enhanced_cells, fetch * fv.OVERFETCH, block, index.nprobe)
        found[model] = written(hits, model)
    return SharedHits(found, refined, refined_block)


def search_expanded(
    queries: DataFrame, index: SearchIndex, k: int, rewrites: DataFrame | None = None,
    rules: Mapping[str, str] | DataFrame | None = None, shared: SharedHits | None = None,
) -> DataFrame:
    """Queries refined by a rewrite table or by rules, then the enhanced search.

    Adds ``refined_query`` to the results.
    """
    if shared is not None:
        encoded, block, hits = queries.join(shared.refined, "query_id"), shared.refined_block, shared.hits[fv.EXPANDED]
    else:
        encoded, block, hits = *_refined(queries, index, rewrites, rules), None
    results = search_enhanced(encoded, index, k, block, model_id=fv.EXPANDED, hits=hits)
    texts = encoded.select("query_id", "refined_query")
    return results.join(F.broadcast(texts) if block is not None else texts, "query_id")


def search_model(
    model_id: str, queries: DataFrame, index: SearchIndex, k: int, block: knn.QueryBlock | None = None,
    rewrites: DataFrame | None = None, rules: Mapping[str, str] | DataFrame | None = None,
    shared: SharedHits | None = None,
) -> DataFrame:
    """One model's raw results for encoded queries; unknown or absent models are errors."""
    if model_id not in fv.MODELS:
        raise ValueError(f"unknown model {model_id!r}; available: {fv.MODELS}")
    if model_id not in index.loaded():
        raise ValueError(f"model {model_id!r} is not loaded")
    if model_id == fv.EXPANDED:
        return search_expanded(queries, index, k, rewrites, rules, shared).drop("refined_query")
    run = {
        fv.HIERARCHICAL: search_hierarchical, fv.FLAT: search_flat, fv.ENHANCED: search_enhanced,
    }[model_id]
    return run(queries, index, k, block, hits=None if shared is None else shared.hits[model_id])


def _with_adjusted(results: DataFrame, queries: DataFrame, rows: int | None) -> DataFrame:
    """Results with their query's intent columns and ``_adjusted``."""
    own = ["top_k"] if "top_k" in queries.columns else []
    wants = queries.select("query_id", "gender", "wants_tshirt", "wants_kids", "constrained", *own)
    joined = results.join(F.broadcast(wants) if rows is not None else wants, "query_id")
    has = intent.result_flags(
        F.col("product_name"), F.col("department"), F.col("category"), F.col("description")
    )
    adjusted = intent.adjusted_score(
        F.col("confidence_score"),
        {c: F.col(c) for c in ("gender", "wants_tshirt", "wants_kids")}, has,
    )
    return joined.withColumn("_adjusted", F.round(adjusted, knn.SCORE_DIGITS))


def intent_rerank(results: DataFrame, queries: DataFrame, k: int, rows: int | None = None) -> DataFrame:
    """Constrained queries re-ranked by adjusted score; the others keep rank and score."""
    adjusted = _with_adjusted(results, queries, rows).withColumnRenamed("rank", "_previous")
    sort_key = F.when(F.col("constrained"), -F.col("_adjusted")).otherwise(F.lit(0.0))
    ranked = top_k(adjusted, ["query_id"], [sort_key, F.col("_previous")], k)
    if "top_k" in ranked.columns:
        ranked = ranked.where(F.col("rank") <= F.col("top_k"))
    confidence = F.when(F.col("constrained"), F.round("_adjusted", 4)).otherwise(F.col("confidence_score"))
    return ranked.withColumn("confidence_score", confidence).select(RESULT_COLUMNS)


def filtered_index(index: SearchIndex, **filters) -> SearchIndex:
    """The index restricted to matching products, so that top-k stays full.

    Vector tables that carry the filtered columns are filtered where they lie, down to
    their files; older tables without them are joined with the matching ids. An
    approximate index stays approximate: its cells are restricted too.
    """
    catalog = filter_products(index.catalog, **filters)
    ids = catalog.select("product_id")

    def keep(vectors: DataFrame | None) -> DataFrame | None:
        if vectors is None:
            return None
        if set(FILTER_COLUMNS) <= set(vectors.columns):
            return filter_products(vectors, **filters)
        return vectors.join(ids, "product_id", "left_semi")

    def keep_cells(cells: knn.Cells | None) -> knn.Cells | None:
        return None if cells is None else replace(cells, vectors=keep(cells.vectors))

    return replace(
        index, catalog=catalog, flat=keep(index.flat), enhanced=keep(index.enhanced), leaves=keep(index.leaves),
        flat_cells=keep_cells(index.flat_cells), enhanced_cells=keep_cells(index.enhanced_cells),
    )


def _check_k(k: int) -> None:
    if not 1 <= int(k) <= fv.MAX_TOP_K:
        raise ValueError(f"k must be 1 to {fv.MAX_TOP_K}")


def search(
    queries: DataFrame, index: SearchIndex, model_id: str | None = None, k: int = 5,
    filters: Mapping[str, object] | None = None, min_confidence: float | None = None,
    rewrites: DataFrame | None = None, rules: Mapping[str, str] | DataFrame | None = None,
    prepared: Prepared | None = None, shared: SharedHits | None = None,
) -> DataFrame:
    """Route a query table (query_id, query) to one model and apply shopper intent.

    Queries that ``queries.validate`` gives a reason against have no results. A column
    ``top_k`` of the query table is each query's own number of results, 1 to 50; without
    one all have ``k``.
    """
    _check_k(k)
    if filters:
        index = filtered_index(index, **filters)
    p = prepare(queries, k, dim=index.dim) if prepared is None else prepared
    results = search_model(model_id or fv.ENHANCED, p.queries, index, p.fetch, p.block, rewrites, rules, shared)
    ranked = intent_rerank(results, p.queries, p.most, p.rows)
    if min_confidence is not None:
        ranked = ranked.where(F.col("confidence_score") >= min_confidence)
    return ranked


def vote(
    results: DataFrame, queries: DataFrame, k: int, weights: Mapping[str, float] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Weighted vote over the results of several models.

    A product's score is the weighted sum of its intent-adjusted scores; order
    is score, then votes, then first appearance by model and rank. Attributes
    come from the first appearance.
    """
    weights = fv.ENSEMBLE_WEIGHTS if weights is None else weights
    position = {m: i for i, m in enumerate(weights)}
    adjusted = _with_adjusted(results, queries, rows)
    attributes = [c for c in RESULT_COLUMNS if c not in ("query_id", "model_id", "rank", "product_id", "confidence_score")]
    order = F.lit(None).cast("int")
    for model, i in position.items():
        order = F.when(F.col("model_id") == model, i).otherwise(order)
    seen = F.struct(order.alias("model"), F.col("rank"))
    # one sum per model, added in model order: the same total whichever way rows arrive
    parts = [
        F.coalesce(F.sum(F.when(F.col("model_id") == m, F.col("_adjusted") * w)), F.lit(0.0)).alias(f"_w{i}")
        for i, (m, w) in enumerate(weights.items())
    ]
    merged = adjusted.groupBy("query_id", "product_id").agg(
        *parts, F.count(F.lit(1)).alias("votes"), F.min(seen).alias("_seen"),
        F.max(F.col("top_k") if "top_k" in adjusted.columns else F.lit(k)).alias("_wanted"),
        F.min_by(F.struct(*attributes), seen).alias("_product"),
    )
    total = F.lit(0.0)
    for i in range(len(parts)):
        total = total + F.col(f"_w{i}")
    scored = merged.withColumn("_score", F.round(total, knn.SCORE_DIGITS))
    ranked = top_k(
        scored, ["query_id"], [F.desc("_score"), F.desc("votes"), F.col("_seen"), F.col("product_id")], k
    ).where(F.col("rank") <= F.col("_wanted"))
    return ranked.select(
        "query_id", F.lit(fv.ENSEMBLE).alias("model_id"), "rank", "product_id",
        *[F.col(f"_product.{c}").alias(c) for c in attributes],
        F.round(F.least(F.col("_score"), F.lit(1.0)), 4).alias("confidence_score"), "votes",
    ).select(*RESULT_COLUMNS, "votes")


def ensemble(
    queries: DataFrame, index: SearchIndex, k: int = 5, weights: Mapping[str, float] | None = None,
    rewrites: DataFrame | None = None, rules: Mapping[str, str] | DataFrame | None = None,
    block: knn.QueryBlock | None = None, shared: SharedHits | None = None,
) -> DataFrame:
    """All loaded models in one plan, merged by :func:`vote`; queries and ``k`` as in :func:`search`."""
    _check_k(k)
    weights = fv.ENSEMBLE_WEIGHTS if weights is None else weights
    models = [m for m in weights if m in index.loaded()]
    if not models:
        raise ValueError("no models loaded")
    p = prepare(queries, k, dim=index.dim, overfetch=fv.ENSEMBLE_OVERFETCH, block=block)
    results = None
    for model in models:
        found = search_model(model, p.queries, index, p.fetch, p.block, rewrites, rules, shared).select(RESULT_COLUMNS)
        results = found if results is None else results.unionByName(found)
    return vote(results, p.queries, p.most, weights, p.rows)


def compare_models(
    queries: DataFrame, index: SearchIndex, k: int = 5, models: Sequence[str] | None = None,
    prepared: Prepared | None = None, **options,
) -> DataFrame:
    """The routed results of several models side by side, one row per (query, model, rank)."""
    models = index.loaded() if models is None else models
    p = prepare(queries, k, dim=index.dim) if prepared is None else prepared
    table = None
    for model in models:
        found = search(queries, index, model, k, prepared=p, **options)
        table = found if table is None else table.unionByName(found)
    return table
