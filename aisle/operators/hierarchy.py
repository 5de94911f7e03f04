"""The department → category → subcategory → product type → product taxonomy."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv
from aisle.functions import vectors
from aisle.operators import knn
from aisle.operators.encode import encode
from aisle.functions.text import leaf_text
from aisle.schema import FILTER_COLUMNS
from aisle.sources.folders import shared_folder

LEVELS = ["department", "category", "subcategory", "product_type"]
PREFIXES = {1: "dept", 2: "cat", 3: "subcat", 4: "ptype", 5: "prod"}
ROOT = "ROOT"


def with_paths(catalog: DataFrame) -> DataFrame:
    """The four level names with blanks defaulted, and the node id of each level."""
    defaults = fv.TREE_MISSING
    names = {}
    for name, default in zip(LEVELS, defaults):
        trimmed = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        names[name] = F.when(trimmed == "", default).otherwise(trimmed)
    return catalog.withColumns(names).withColumns({
        f"node_{i}": _node_id(i, [F.col(c) for c in LEVELS[:i]]) for i in range(1, 5)
    })


def _node_id(level: int, names: list[Column]) -> Column:
    """The level names joined by ":"; one inside a name is escaped, so two paths never share an id."""
    escaped = [F.replace(F.replace(n, F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:")) for n in names]
    return F.concat_ws(":", F.lit(PREFIXES[level]), *escaped)


def build(catalog: DataFrame) -> DataFrame:
    """Nodes of levels 0–4: node_id, parent_id, level, name, count of products.

    Products are counted once at the deepest level; the upper levels roll up
    those counts instead of the products.
    """
    deepest = with_paths(catalog).groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n"))
    rolled = deepest.rollup(*LEVELS).agg(
        F.sum("n").alias("count"), F.grouping_id().alias("_missing")
    )
    # grouping_id is 15, 7, 3, 1, 0 for 0 to 4 levels kept
    level = F.lit(len(LEVELS)) - F.bit_count("_missing")
    levelled = rolled.withColumn("level", level.cast("int"))

    def by_level(of_level) -> Column:
        chosen = F.when(F.col("level") == 0, of_level(0))
        for i in range(1, 5):
            chosen = chosen.when(F.col("level") == i, of_level(i))
        return chosen

    def node(i: int) -> Column:
        return F.lit(ROOT) if i == 0 else _node_id(i, [F.col(c) for c in LEVELS[:i]])

    no_parent = F.lit(None).cast("string")
    return levelled.select(
        by_level(node).alias("node_id"),
        by_level(lambda i: no_parent if i == 0 else node(i - 1)).alias("parent_id"),
        "level",
        by_level(lambda i: F.lit(ROOT) if i == 0 else F.col(LEVELS[i - 1])).alias("name"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
    )


def leaves(catalog: DataFrame) -> DataFrame:
    """Product leaves: node_id, parent_id, level 5, name, product_id."""
    pathed = with_paths(catalog)
    return pathed.select(
        F.concat(F.lit("prod:"), F.col("product_id")).alias("node_id"),
        F.col("node_4").alias("parent_id"),
        F.lit(5).alias("level"),
        F.coalesce(F.col("product_name"), F.lit("")).alias("name"),
        "product_id",
    )


def edges(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("parent_id").isNotNull()).select("parent_id", F.col("node_id").alias("child_id"))


def stats(catalog: DataFrame) -> DataFrame:
    """Nodes per level and the totals of nodes and edges, in one row."""
    per_level = (
        build(catalog).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
        .unionByName(leaves(catalog).agg(F.countDistinct("node_id").alias("n")).withColumn("level", F.lit(5)))
    )
    names = ["departments", "categories", "subcategories", "product_types", "products"]
    links = leaves(catalog).select("parent_id", "node_id").distinct()
    counted = per_level.agg(
        F.sum("n").alias("total_nodes"),
        F.sum(F.when(F.col("level").between(1, 4), F.col("n")).otherwise(0)).alias("_inner"),
        *[F.sum(F.when(F.col("level") == i, F.col("n")).otherwise(0)).alias(n) for i, n in enumerate(names, 1)],
    )
    leaf_edges = links.agg(F.count(F.lit(1))).scalar()
    return counted.select("total_nodes", (F.col("_inner") + leaf_edges).alias("total_edges"), *names)


def nodes_at_level(nodes: DataFrame, level: int) -> DataFrame:
    return nodes.where(F.col("level") == level)


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Direct children of every parent in ``parents(node_id)``."""
    wanted = parents.select(F.col("node_id").alias("parent_id"))
    return nodes.join(wanted, "parent_id").select("parent_id", "node_id", "level", "name", "count")


def leaf_products(catalog: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(ancestor_id, product_id) for every different node in ``ancestors(node_id)``.

    The depth is fixed, so a product knows its ancestor on each level: one equi-join a
    level with the ancestors of that level, instead of a traversal. The root is no join
    key; every product is below it if it is asked for at all.
    """
    asked = ancestors.select("node_id").distinct()
    pathed = with_paths(catalog)
    root_asked = asked.where(F.col("node_id") == ROOT).agg(F.count(F.lit(1))).scalar()
    below = pathed.where(root_asked > 0).select(F.lit(ROOT).alias("ancestor_id"), "product_id")
    for level in range(1, 5):
        own = asked.where(F.startswith("node_id", F.lit(f"{PREFIXES[level]}:")))
        found = pathed.select(F.col(f"node_{level}").alias("node_id"), "product_id").join(own, "node_id")
        below = below.unionByName(found.select(F.col("node_id").alias("ancestor_id"), "product_id"))
    return below


def subtrees(nodes: DataFrame) -> DataFrame:
    """One JSON text per department: name, level, count, children, products.

    Built bottom-up; at level 4 the children are summarised by their number.
    """
    level_4 = nodes.where(F.col("level") == 4).select(
        "parent_id",
        F.struct("name", "level", "count", F.col("count").alias("products")).alias("tree"),
    )
    below = level_4
    for level in (3, 2, 1):
        listed = below.groupBy("parent_id").agg(
            F.sort_array(F.collect_list("tree")).alias("children")
        ).withColumnRenamed("parent_id", "node_id")
        below = nodes.where(F.col("level") == level).join(listed, "node_id").select(
            "parent_id", F.struct("name", "level", "count", "children").alias("tree"),
        )
    return below.select(F.col("tree.name").alias("department"), F.to_json("tree").alias("json"))


def _path_key(node_id: Column, level: Column) -> Column:
    """The node's escaped path, each name ended by ":". A subtree's keys start with its top's, and only they do."""
    return F.when(level == 0, "").otherwise(F.concat(F.regexp_replace(node_id, "^[a-z]+:", ""), F.lit(":")))


def document_lines(nodes: DataFrame) -> DataFrame:
    """(path, line): the whole tree as one JSON document of a line per node, in order of path.

    Sorted by path, a node stands right before its subtree. What a line closes before it
    opens its node follows from the node alone: the first child of a parent comes right
    after it, any other after the end of a sibling's subtree, which reaches down to level
    4. So no line looks at another one and no task holds a tree. First children are found
    by one aggregation, a minimum per parent. ``nodes`` are those of :func:`build`. The
    last line closes what is open and has a null path; no nodes give no lines.
    """
    keyed = nodes.select("node_id", "parent_id", "level", "name", "count", _path_key(F.col("node_id"), F.col("level")).alias("path"))
    firsts = keyed.where("level > 0").groupBy("parent_id").agg(F.min("path").alias("path"))
    marked = keyed.join(firsts.select("path", F.lit(True).alias("_first")), "path", "left")
    quoted = F.expr("substr(to_json(named_struct('n', coalesce(name, ''))), 6)")  # "name"}
    head = F.concat(
        F.lit('{"name":'), F.rtrim(quoted, F.lit("}")), F.lit(',"level":'), F.col("level").cast("string"),
        F.lit(',"count":'), F.col("count").cast("string"))
    inner = F.concat(head, F.lit(',"children":['))
    leaf = F.concat(head, F.lit(',"products":'), F.col("count").cast("string"), F.lit("}"))
    before = F.when((F.col("level") == 0) | F.col("_first"), "").otherwise(
        F.concat(F.expr("repeat(']}', 4 - level)"), F.lit(",")))
    opened = F.concat(before, F.when(F.col("level") == 4, leaf).otherwise(inner))
    ends = nodes.agg(F.max("level").alias("deepest")).where("deepest IS NOT NULL").select(
        F.lit(None).cast("string").alias("path"), F.expr("repeat(']}', greatest(deepest, 1))").alias("line"))
    return marked.select("path", opened.alias("line")).unionByName(ends)


def export_json(nodes: DataFrame, path: str) -> None:
    """Write the tree as one JSON document: the files under ``path`` in order of name, a line per node.

    The lines are sorted by ranges of path, so any size is the same layout.
    """
    lines = document_lines(nodes).orderBy(F.asc_nulls_last("path"))
    lines.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


# --- search -------------------------------------------------------------------

def node_vectors(nodes: DataFrame, dim: int = fv.EMBEDDING_DIM) -> DataFrame:
    """Nodes of levels 1–4 with the vector of their name."""
    return encode(nodes.where(F.col("level").between(1, 4)), "name", dim=dim)


def leaf_vectors(catalog: DataFrame, dim: int = fv.EMBEDDING_DIM) -> DataFrame:
    """(product_id, node_id of the product type, embedding) and the catalogue's columns that searches filter by."""
    own = [F.col(c).alias(f"_{c}") for c in FILTER_COLUMNS]
    pathed = with_paths(catalog.select("*", *own)).select(
        "product_id", F.col("node_4").alias("node_id"), leaf_text().alias("_text"), *[f"_{c}" for c in FILTER_COLUMNS]
    )
    return encode(pathed, "_text", dim=dim).select(
        "product_id", "node_id", "embedding", *[F.col(f"_{c}").alias(c) for c in FILTER_COLUMNS])


def path_sum(scores: list[Column], decay: float = fv.LEVEL_DECAY) -> Column:
    """Scores of levels 1 to at most 5, each weighted by decay per level above the product."""
    total = F.lit(0.0)
    for level, score in enumerate(scores, 1):
        total = total + score * (decay ** (5 - level))
    return total


def path_score(scores: list[Column], decay: float = fv.LEVEL_DECAY) -> Column:
    """Mean of the decayed scores along one path."""
    return F.round(F.round(path_sum(scores, decay), vectors.SCORE_DIGITS) / 5.0, vectors.SCORE_DIGITS)


def beam(
    queries: DataFrame, nodes: DataFrame, widths: dict[int, int] | None = None,
    decay: float = fv.LEVEL_DECAY, block: knn.QueryBlock | None = None,
) -> DataFrame:
    """(query_id, key, offset): the product types each query descends into.

    The best departments per query, then per kept node its best children, scored in blocks
    where the nodes lie. The offset is what the four levels add to a product's path score.
    Each level's kept nodes are a written table: at most the product of the widths a query.
    """
    widths = widths or fv.BEAM_WIDTHS
    spark = queries.sparkSession
    base = f"{shared_folder(spark)}/beam-{uuid.uuid4().hex}"
    block = knn.query_block(queries) if block is None else block

    def written(kept: DataFrame, level: int) -> DataFrame:
        kept.write.parquet(f"{base}/{level}")
        return spark.read.schema(kept.schema).parquet(f"{base}/{level}")

    top = knn.nearest(
        queries, nodes_at_level(nodes, 1), widths[1], "node_id", "cosine", block=block, fan_in=1
    )
    kept = written(top.select("query_id", F.col("target_id").alias("key"), F.array("score").alias("scores")), 1)
    for level in (2, 3, 4):
        below = nodes_at_level(nodes, level).select("parent_id", "node_id", "embedding")
        asked = kept.select("query_id", "key", F.lit(0.0).alias("offset"))
        found = knn.nearest_per_key(queries, below, widths[level], "node_id", asked, "parent_id", "cosine", block=block)
        kept = written(found.join(kept, ["query_id", "key"]).select(
            "query_id", F.col("target_id").alias("key"), F.concat("scores", F.array("score")).alias("scores")), level)
    levels = [F.get("scores", F.lit(i)) for i in range(4)]
    return kept.select("query_id", "key", path_sum(levels, decay).alias("offset"))


def search(
    queries: DataFrame, nodes: DataFrame, leaf_vectors: DataFrame, k: int,
    widths: dict[int, int] | None = None, decay: float = fv.LEVEL_DECAY,
    block: knn.QueryBlock | None = None,
) -> DataFrame:
    """Beam search: (query_id, target_id, score, rank), best path score first.

    ``nodes`` carry embeddings (:func:`node_vectors`). Products of the kept
    types are scored where they lie; a product id occurs once per catalogue, so
    its one path is its best.
    """
    block = knn.query_block(queries) if block is None else block
    probes = beam(queries, nodes, widths, decay, block)
    hits = knn.nearest(
        queries, leaf_vectors, k, "product_id", "cosine", probes=probes, key="node_id", block=block,
    )
    return hits.withColumn("score", F.round(F.col("score") / 5.0, vectors.SCORE_DIGITS))
