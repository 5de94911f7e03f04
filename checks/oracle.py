"""DuckDB statements that say independently what the registered queries must return.

Statements are put together from named common table expressions; ``sql(name, body)``
adds those that a body refers to, directly or through others.
"""

from __future__ import annotations

import re

from aisle.functions import fixed_values as fv

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
BLANKS = r"[\t\n\x0B\f\r \x1C-\x1F]+"
UNICODE_SPACE = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
DIM = fv.EMBEDDING_DIM


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def mapping(table: dict) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in table.items()) + "}"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def number(x: str) -> str:
    t = strip(f"CAST({x} AS VARCHAR)")
    return f"CASE WHEN regexp_matches({t}, {q(NUMBER)}) THEN TRY_CAST({t} AS DOUBLE) END"


def price(x: str) -> str:
    t = strip(f"replace(replace({x}, ',', ''), '₹', '')")
    return f"CASE WHEN {t} IS NULL OR {t} IN ('', 'nan') THEN 0.0::DOUBLE ELSE coalesce({number(t)}, 0.0::DOUBLE) END"


def rating(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(5.0::DOUBLE, coalesce({number(x)}, 0.0::DOUBLE)))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(BLANKS)}, ' ', 'g'))"


def clean_text(x: str) -> str:
    t = f"coalesce({x}, '')"
    body = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    body = f"regexp_replace({body}, {q('https?://[^' + UNICODE_SPACE + ']+')}, '', 'g')"
    body = f"regexp_replace({body}, {q(r'[^\x00-\x7F]')}, '', 'g')"
    return f"CASE WHEN lower({t}) IN ('', 'nan', 'none', 'null') THEN '' ELSE {squeeze(body)} END"


BOILERPLATE = "(?i)" + "|".join(
    [p.replace("{site}", fv.SHOP_SITE) for p in fv.BOILERPLATE_PATTERNS]
    + [r"\b[a-z0-9]{%d,}\b" % fv.SKU_MIN_LEN]
)


def strip_boilerplate(x: str) -> str:
    t = f"regexp_replace({x}, {q(BOILERPLATE)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(BLANKS)}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(r'\s*([,.;:!?])\s*')}, {q(r'\1 ')}, 'g')"
    return f"trim({t}, ' ,.;:-')"


def labelled(label: str, x: str) -> str:
    return f"CASE WHEN trim({x}) <> '' THEN {q(label + ': ')} || {x} END"


def combined_text() -> str:
    parts = [
        labelled("Product", "product_name"),
        labelled("Category", "(department || ' ' || category || ' ' || subcategory)"),
        labelled("Type", "product_type"),
        labelled("Brand", "brand"),
        labelled("Features", strip_boilerplate("features")),
        labelled("Description", strip_boilerplate("description")),
        labelled("Tags", "tags"),
    ]
    return f"concat_ws(' ', {', '.join(parts)})"


def enhanced_text() -> str:
    rich = (
        "product_name || '. ' || trim(enriched_description) || '. Category: ' || category "
        "|| '. Brand: ' || brand || '. Tags: ' || tags || '.'"
    )
    return f"CASE WHEN length(trim(enriched_description)) > 50 THEN {rich} ELSE {combined_text()} END"


LEAF_TEXT = "product_name || '. ' || category || '. ' || features"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, {q('[' + UNICODE_SPACE + ']+')}), lambda w: w <> '')"


def template(text: str) -> str:
    parts = []
    for piece in re.split(r"(\{\w+\})", text):
        if piece.startswith("{"):
            slot = piece[1:-1]
            parts.append({"rating": "rating_text"}.get(slot, slot))
        elif piece:
            parts.append(q(piece))
    return " || ".join(parts)


def lookup(table: dict) -> str:
    rest = {k: v for k, v in table.items() if k != "default"}
    m = mapping(rest)
    return f"coalesce({m}[category], {m}[department], {q(table['default'])})"


def level_names(tree: str) -> str:
    inner = f"trim({strip(tree)}, '[]\"'' ')"
    parts = f"list_filter(list_transform(string_split({inner}, ' >> '), lambda p: {strip('p')}), lambda p: p <> '')"
    deepest = f"coalesce(({parts})[-1], 'General')"
    return (
        f"CASE WHEN {tree} IS NULL THEN ['Other', 'General', 'General', 'General'] "
        f"ELSE list_concat({parts}, [{deepest}, {deepest}, {deepest}, {deepest}])[1:4] END"
    )


def pairs_of(spec: str) -> str:
    def entry(e: str) -> str:
        return f"{{'key': json_extract_string({e}, '$.key'), 'value': json_extract_string({e}, '$.value')}}"

    return f"""
CASE WHEN json_valid({spec}) THEN
  CASE WHEN json_type({spec}) = 'ARRAY'
       THEN list_transform(json_extract({spec}, '$[*]'), lambda e: {entry('e')})
       WHEN json_extract({spec}, '$.product_specification') IS NOT NULL
       THEN list_transform(json_extract({spec}, '$.product_specification[*]'), lambda e: {entry('e')})
       ELSE list_transform(json_keys({spec}), lambda k: {{'key': k, 'value': json_extract_string({spec}, '$."' || k || '"')}})
  END END"""


def last_of(keys) -> str:
    return f"coalesce((list_filter(pairs, lambda p: p.key IN ({', '.join(map(q, keys))})))[-1].value, '')"


ROUTED = ", ".join(q(k) for k in fv.COLOR_KEYS + fv.MATERIAL_KEYS + fv.SIZE_KEYS)


def unified(raw: str) -> str:
    return f"""
SELECT _ord, coalesce(pid, 'P' || lpad(CAST(_ord + 1 AS VARCHAR), greatest(5, length(CAST(_ord + 1 AS VARCHAR)))::INTEGER, '0')) AS product_id,
  coalesce(product_name, 'Unknown Product') AS product_name,
  levels[1] AS department, levels[2] AS category, levels[3] AS subcategory, levels[4] AS product_type,
  coalesce(description, '') AS description,
  coalesce(array_to_string(list_transform(list_filter(pairs, lambda p: p.key NOT IN ({ROUTED}))[1:10], lambda p: p.value), ', '), '') AS features,
  {last_of(fv.COLOR_KEYS)} AS color, {last_of(fv.MATERIAL_KEYS)} AS material, {last_of(fv.SIZE_KEYS)} AS size_range,
  {price('retail_price')} AS price, coalesce({number('product_rating')}, 0.0::DOUBLE) AS rating,
  CAST(0 AS INTEGER) AS reviews_count, tags, coalesce(brand, 'Unknown') AS brand, 'In Stock' AS stock_status,
  lower(coalesce(product_name, 'Unknown Product')) || ', ' || tags AS keywords
FROM (SELECT *, array_to_string(list_sort(list_distinct(list_filter(
          flatten(list_transform(levels, lambda v: string_split_regex(lower(v), '\\s+'))), lambda w: length(w) > 2))), ', ') AS tags
  FROM (SELECT *, {level_names('product_category_tree')} AS levels,
          list_filter(list_transform({pairs_of('product_specifications')},
             lambda p: {{'key': lower({strip("coalesce(p.key, '')")}), 'value': {strip("coalesce(p.value, '')")}}}),
             lambda p: p.key <> '' AND p.value <> '' AND lower(p.value) <> 'nan') AS pairs
        FROM {raw}))"""


CTES: dict[str, str] = {}

CTES["raw"] = """
SELECT p_partkey AS _ord,
  CASE WHEN p_partkey % 10 = 3 THEN NULL WHEN p_partkey % 10 = 7 THEN CAST(p_partkey - 1 AS VARCHAR)
       ELSE CAST(p_partkey AS VARCHAR) END AS pid,
  CASE WHEN p_partkey % 101 = 1 THEN NULL WHEN p_partkey % 103 = 1 THEN ' ab '
       ELSE p_name || ' ' || lower(replace(p_brand, '#', ' ')) || ' size ' || p_size ||
            CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' for men' WHEN 2 THEN ' womens' WHEN 3 THEN ' kids' ELSE ' t-shirt' END
  END AS product_name,
  CASE p_partkey % 17
    WHEN 1 THEN '["' || p_type || '"]'
    WHEN 2 THEN '["' || p_type || ' >> ' || split_part(p_name, ' ', 2) || ' >> ' || p_brand || ' >> a >> b >> c"]'
    WHEN 3 THEN p_type || '>>' || p_brand
    WHEN 4 THEN ''
    WHEN 5 THEN NULL
    WHEN 6 THEN '["Clothing >> ' || split_part(p_name, ' ', 2) || '"]'
    WHEN 7 THEN '["Electronics >> ' || split_part(p_name, ' ', 2) || ' >> ' || p_brand || '"]'
    ELSE '["' || p_type || ' >> ' || split_part(p_name, ' ', 2) || ' >> ' || p_brand || ' >> size ' || (p_size // 10) || '"]'
  END AS product_category_tree,
  text AS description,
  CASE p_partkey % 6
    WHEN 0 THEN '{"product_specification":[{"key":"Color","value":"' || split_part(p_name, ' ', 1) ||
       '"},{"key":"Fabric","value":"' || lower(p_type) || '"},{"key":"Finish","value":" matte "},' ||
       '{"key":"Colour","value":"deep ' || split_part(p_name, ' ', 1) || '"},{"value":"no key"},' ||
       '{"key":"Size","value":"' || p_size || ' cm"},{"key":"Grade","value":"nan"}]}'
    WHEN 1 THEN '{"shade":"' || split_part(p_name, ' ', 1) || '","Weight":"' || p_size || ' kg","material":"steel"}'
    WHEN 2 THEN '[' || array_to_string(list_transform(range(1, 13),
       lambda i: '{"key":"k' || i || '","value":"feature ' || i || ' of ' || p_size || '"}'), ',') || ']'
    WHEN 3 THEN 'not a specification'
    WHEN 4 THEN NULL
    ELSE '{"product_specification"=>[{"key"=>"Color", "value"=>"' || p_brand || '"}]}'
  END AS product_specifications,
  CASE p_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN 'call us' WHEN 2 THEN CAST(p_size AS VARCHAR)
    ELSE '₹' || format('{:,.1f}', p_retailprice * p_size) END AS retail_price,
  CASE p_partkey % 19 WHEN 0 THEN 'No rating available' WHEN 1 THEN '7' WHEN 2 THEN '-1' WHEN 3 THEN NULL
    ELSE CAST(avg_qty / 10 AS VARCHAR) END AS product_rating,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_brand END AS brand
FROM part LEFT JOIN documents ON doc_id = p_partkey
LEFT JOIN (SELECT l_partkey, floor(avg(l_quantity)) AS avg_qty FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""

CTES["raw_csv"] = """
SELECT * REPLACE (nullif(product_category_tree, '') AS product_category_tree, nullif(retail_price, '') AS retail_price,
  nullif(description, '') AS description) FROM raw"""
CTES["unified"] = unified("raw")
CTES["unified_csv"] = unified("raw_csv")

_CLEANED = ", ".join(
    f"{strip_boilerplate(clean_text(c)) if c in ('description', 'features') else clean_text(c)} AS {c}"
    for c in fv.CLEAN_COLUMNS
)
CTES["texts_cleaned"] = f"SELECT * REPLACE ({_CLEANED}) FROM unified"
CTES["priced"] = f"""
SELECT * REPLACE (CASE WHEN cap > 0 AND price > 3 * cap THEN cap ELSE price END AS price, {rating('rating')} AS rating)
FROM texts_cleaned, (SELECT quantile_cont(price, 0.999) AS cap FROM texts_cleaned)"""
CTES["unique_rows"] = """
SELECT * FROM (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY _ord) = 1)
QUALIFY row_number() OVER (PARTITION BY product_name, category ORDER BY _ord) = 1"""
CTES["named_rows"] = "SELECT * FROM unique_rows WHERE length(trim(product_name)) > 2"
_FILLED = ", ".join(
    f"CASE WHEN {c} IS NULL OR {c} = 'nan'" + (f" OR {c} = ''" if d else "") + f" THEN {q(d)} ELSE {c} END AS {c}"
    for c, d in fv.FILL_DEFAULTS.items()
)
CTES["ready"] = f"SELECT * EXCLUDE (cap) REPLACE ({_FILLED}) FROM named_rows"
CTES["cleaned"] = """
SELECT r.* REPLACE (CAST(coalesce(n, 0) AS INTEGER) AS reviews_count,
  CASE WHEN open = 1 THEN 'In Stock' ELSE 'Out of Stock' END AS stock_status)
FROM ready r LEFT JOIN (SELECT l_partkey, count(*) AS n, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS open
                        FROM lineitem GROUP BY 1) ON l_partkey = _ord"""

T = fv.SLOT_TEXTS


def phrase(x: str, slot: str, missing: str = "") -> str:
    before, after = T[slot].split("%s")
    return f"CASE WHEN {x} <> '' THEN {q(before)} || {x} || {q(after)} ELSE {q(missing)} END"


def slots(source: str) -> str:
    return f"""
SELECT *, {lookup(fv.USE_CASES)} AS use_case, {lookup(fv.OCCASIONS)} AS occasion, {lookup(fv.AUDIENCES)} AS target_audience,
  CASE WHEN features <> '' THEN features ELSE {q(T['features_missing'])} END AS features_text,
  {phrase('color', 'color')} AS color_text, {phrase('material', 'material', T['material_missing'])} AS material_text,
  {phrase('size_range', 'size')} AS size_text, description AS description_text,
  CASE WHEN price <> 0 THEN '₹' || format('{{:,.0f}}', price) ELSE {q(T['price_missing'])} END AS price_text,
  {phrase('tags', 'tags')} AS tags_text, '' AS specs_text, {q(T['value_proposition'])} AS value_proposition,
  CAST(rating AS VARCHAR) AS rating_text
FROM {source}"""


CTES["slots"] = slots("cleaned")
CTES["enriched"] = f"""
SELECT * EXCLUDE (use_case, occasion, target_audience, features_text, color_text, material_text, size_text, description_text,
    price_text, tags_text, specs_text, value_proposition, rating_text, body, padding),
  trim(CASE WHEN len({tokens('body')}) < {fv.MIN_WORDS} THEN body || padding ELSE body END) AS enriched_description
FROM (SELECT *, CASE WHEN contains(lower(department || ' ' || category), 'clothing') THEN {template(fv.TEMPLATES['Clothing'])}
                     WHEN contains(lower(department || ' ' || category), 'electronics') THEN {template(fv.TEMPLATES['Electronics'])}
                     ELSE {template(fv.TEMPLATES['default'])} END AS body,
             {template(fv.PADDING_TEMPLATE)} AS padding FROM slots)"""

# --- queries ---------------------------------------------------------------
CTES["names"] = "SELECT DISTINCT p_name, split_part(p_name, ' ', 2) AS noun FROM part"
CTES["nouns"] = "SELECT DISTINCT noun FROM names"
CTES["queries"] = """
SELECT 'e-' || p_name AS query_id, 'exact' AS query_type, p_name AS query, [p_name] AS relevant_terms FROM names
UNION ALL SELECT 's-' || noun, 'semantic', noun, [noun] FROM nouns
UNION ALL SELECT 'v-' || noun, 'vague', 'something to ' || CASE length(noun) % 4 WHEN 0 THEN 'watch movies' WHEN 1 THEN 'cook food'
   WHEN 2 THEN 'carry laptop' ELSE 'stay warm' END || ' with a ' || noun, [noun] FROM nouns
UNION ALL SELECT 'i-' || p_name, 'intent', CASE length(p_name) % 5 WHEN 0 THEN 'mens ' WHEN 1 THEN 'womens ' WHEN 2 THEN 'boy '
   WHEN 3 THEN '' ELSE 'girl ' END || p_name || CASE length(p_name) % 3 WHEN 0 THEN ' t-shirt' ELSE '' END, [noun, 'zzz'] FROM names"""
CTES["wants"] = f"""
SELECT *, gender IS NOT NULL OR wants_tshirt AS constrained FROM (SELECT *,
  CASE WHEN regexp_matches(lower(trim(query)), {q(fv.QUERY_MEN)}) THEN 'men'
       WHEN regexp_matches(lower(trim(query)), {q(fv.QUERY_WOMEN)}) THEN 'women' END AS gender,
  regexp_matches(lower(trim(query)), {q(fv.QUERY_TSHIRT)}) AS wants_tshirt,
  regexp_matches(lower(trim(query)), {q(fv.KIDS)}) AS wants_kids FROM queries)"""


def expansion(x: str) -> str:
    rules = "[" + ", ".join(f"{{'t': {q(t)}, 'w': {q(w)}}}" for t, w in fv.INTENT_EXPANSIONS.items()) + "]"
    hits = f"list_transform(list_filter({rules}, lambda r: contains(lower({x}), r.t)), lambda r: r.w)"
    return f"CASE WHEN len({hits}) = 0 THEN {x} ELSE {x} || ' ' || array_to_string({hits}, ' ') END"


CTES["expanded"] = f"SELECT *, {expansion('query')} AS refined_query FROM wants"


# --- vectors ---------------------------------------------------------------
def postings(source: str, key: str, text: str) -> str:
    """Non-zero entries (id, b, w) of hashed unit vectors at single precision."""
    return f"""
SELECT id, b, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS w
FROM (SELECT id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {DIM} AS b, CAST(count(*) AS DOUBLE) AS c
      FROM (SELECT {key} AS id, unnest(string_split_regex(lower({text}), '[^a-z0-9]+')) AS t FROM {source})
      WHERE t <> '' GROUP BY 1, 2)"""


CTES["q_vec"] = postings("queries", "query_id", "query")
CTES["x_vec"] = postings("expanded", "query_id", "refined_query")
CTES["flat_vec"] = postings("cleaned", "product_id", combined_text())
CTES["enhanced_vec"] = postings("enriched", "product_id", enhanced_text())
CTES["leaf_vec"] = postings("cleaned", "product_id", LEAF_TEXT)


def neighbours(query_vec: str, target_vec: str, constrained: int, plain: int) -> str:
    """All-pairs squared L2 of sparse vectors, ranked; each query keeps its own number."""
    return f"""
SELECT p.query_id, p.product_id, greatest(0.0::DOUBLE, d2) AS distance,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0 - greatest(0.0::DOUBLE, d2) / 2.0)) AS confidence, rn FROM (
 SELECT query_id, product_id, d2, constrained, row_number() OVER (PARTITION BY query_id ORDER BY d2, product_id) AS rn FROM (
  SELECT w.query_id, w.constrained, c.product_id,
    round(coalesce(qn.n, 0) + coalesce(tn.n, 0) - 2 * coalesce(dot, 0), 9) AS d2
  FROM wants w CROSS JOIN (SELECT product_id FROM cleaned) c
  LEFT JOIN (SELECT id, sum(w * w) AS n FROM {query_vec} GROUP BY 1) qn ON qn.id = w.query_id
  LEFT JOIN (SELECT id, sum(w * w) AS n FROM {target_vec} GROUP BY 1) tn ON tn.id = c.product_id
  LEFT JOIN (SELECT a.id AS qid, t.id AS tid, sum(a.w * t.w) AS dot FROM {query_vec} a JOIN {target_vec} t USING (b) GROUP BY 1, 2) d
    ON qid = w.query_id AND tid = c.product_id)) p
WHERE rn <= CASE WHEN constrained THEN {constrained} ELSE {plain} END"""


RESULT_FIELDS = """product_id, product_name, department, category, brand, price, rating, reviews_count,
  substr(description, 1, 200) AS description"""
RERANK = """
confidence * 0.85 + rating / 5.0 * 0.05
 + CASE WHEN reviews_count > 0 THEN least(ln(1 + reviews_count) / ln(1001), 1.0) ELSE 0.0 END * 0.02
 + CASE WHEN price > 0 THEN least(price / 10000.0, 1.0) ELSE 0.3 END * 0.03
 + CASE WHEN contains(lower(stock_status), 'in stock') THEN 1.0 ELSE 0.2 END * 0.05"""


def conf(x: str) -> str:
    return f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x})), 4)"


def flat_results(hits: str) -> str:
    return f"""
SELECT query_id, {q(fv.FLAT)} AS model_id, CAST(rn AS INTEGER) AS rank, {RESULT_FIELDS}, {conf('confidence')} AS confidence_score
FROM {hits} JOIN cleaned USING (product_id)"""


def enhanced_results(hits: str, model: str, constrained: int, plain: int) -> str:
    return f"""
SELECT query_id, {q(model)} AS model_id, CAST(rank AS INTEGER) AS rank, {RESULT_FIELDS}, {conf('score')} AS confidence_score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rn) AS rank
      FROM (SELECT h.query_id, h.rn, e.*, round({RERANK}, 9) AS score FROM {hits} h JOIN cleaned e USING (product_id)))
JOIN (SELECT query_id, constrained FROM wants) USING (query_id)
WHERE rank <= CASE WHEN constrained THEN {constrained} ELSE {plain} END"""


# --- taxonomy --------------------------------------------------------------
_PATHS = ", ".join(
    f"CASE WHEN trim(coalesce({c}, '')) = '' THEN {q(d)} ELSE trim({c}) END AS l{i}"
    for i, (c, d) in enumerate(zip(["department", "category", "subcategory", "product_type"], fv.TREE_MISSING), 1)
)
CTES["paths"] = f"""
SELECT *, 'dept:' || l1 AS node_1, 'cat:' || l1 || ':' || l2 AS node_2, 'subcat:' || l1 || ':' || l2 || ':' || l3 AS node_3,
  'ptype:' || l1 || ':' || l2 || ':' || l3 || ':' || l4 AS node_4
FROM (SELECT product_id, product_name, features, category AS category_name, {_PATHS} FROM cleaned)"""
CTES["nodes"] = """
SELECT 'ROOT' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS level, 'ROOT' AS name, count(*) AS count FROM paths
UNION ALL SELECT node_1, 'ROOT', 1, l1, count(*) FROM paths GROUP BY ALL
UNION ALL SELECT node_2, node_1, 2, l2, count(*) FROM paths GROUP BY ALL
UNION ALL SELECT node_3, node_2, 3, l3, count(*) FROM paths GROUP BY ALL
UNION ALL SELECT node_4, node_3, 4, l4, count(*) FROM paths GROUP BY ALL"""
CTES["name_vec"] = postings("(SELECT DISTINCT name FROM nodes WHERE level > 0)", "name", "name")
CTES["name_sim"] = """
SELECT a.id AS query_id, t.id AS name, round(greatest(0.0::DOUBLE, sum(a.w * t.w) / (qn * tn)), 9) AS cos
FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS qn FROM q_vec) a
JOIN (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS tn FROM name_vec) t USING (b) GROUP BY 1, 2, qn, tn"""
CTES["beam_1"] = """
SELECT query_id, node_id, coalesce(cos, 0) AS s1 FROM (SELECT w.query_id, n.node_id, n.name FROM wants w CROSS JOIN nodes n WHERE level = 1)
LEFT JOIN name_sim USING (query_id, name)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, node_id) <= 5"""
for _level, _width in ((2, 5), (3, 5), (4, 3)):
    _before = ", ".join(f"s{i}" for i in range(1, _level))
    CTES[f"beam_{_level}"] = f"""
SELECT query_id, node_id, {_before}, s{_level} FROM (
  SELECT p.query_id, n.node_id, n.parent_id, {_before}, coalesce(cos, 0) AS s{_level}
  FROM beam_{_level - 1} p JOIN nodes n ON n.parent_id = p.node_id
  LEFT JOIN name_sim d ON d.query_id = p.query_id AND d.name = n.name)
QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY s{_level} DESC, node_id) <= {_width}"""
CTES["leaf_sim"] = """
SELECT a.id AS query_id, t.id AS product_id, round(sum(a.w * t.w) / (qn * tn), 12) AS cos
FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS qn FROM q_vec) a
JOIN (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS tn FROM leaf_vec) t USING (b) GROUP BY 1, 2, qn, tn"""
CTES["paths_scored"] = """
SELECT k.query_id, p.product_id, round(round(s1 * pow(0.85, 4) + s2 * pow(0.85, 3) + s3 * pow(0.85, 2) + s4 * 0.85
   + coalesce(cos, 0), 9) / 5.0, 9) AS score
FROM beam_4 k JOIN paths p ON p.node_4 = k.node_id
LEFT JOIN leaf_sim l ON l.query_id = k.query_id AND l.product_id = p.product_id"""


def hierarchical_results(constrained: int, plain: int) -> str:
    return f"""
SELECT query_id, {q(fv.HIERARCHICAL)} AS model_id, CAST(rn AS INTEGER) AS rank, {RESULT_FIELDS}, {conf('score')} AS confidence_score
FROM (SELECT s.query_id, s.product_id, score, constrained,
        row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, s.product_id) AS rn
      FROM (SELECT query_id, product_id, max(score) AS score FROM paths_scored GROUP BY 1, 2) s JOIN wants USING (query_id))
JOIN cleaned USING (product_id) WHERE rn <= CASE WHEN constrained THEN {constrained} ELSE {plain} END"""


# hits and results at the depths of a routed top-5 (40 / 5) and of the ensemble (40 / 10)
for _tag, _plain in (("", 5), ("_wide", 10)):
    CTES[f"flat_hits{_tag}"] = neighbours("q_vec", "flat_vec", 40, _plain)
    CTES[f"enhanced_hits{_tag}"] = neighbours("q_vec", "enhanced_vec", 200, _plain * 5)
    CTES[f"expanded_hits{_tag}"] = neighbours("x_vec", "enhanced_vec", 200, _plain * 5)
    CTES[f"r1{_tag}"] = hierarchical_results(40, _plain)
    CTES[f"r2{_tag}"] = flat_results(f"flat_hits{_tag}")
    CTES[f"r3{_tag}"] = enhanced_results(f"enhanced_hits{_tag}", fv.ENHANCED, 40, _plain)
    CTES[f"r4{_tag}"] = enhanced_results(f"expanded_hits{_tag}", fv.EXPANDED, 40, _plain)
    CTES[f"all_results{_tag}"] = " UNION ALL ".join(f"SELECT * FROM r{i}{_tag}" for i in range(1, 5))


# --- intent, ensemble, evaluation -------------------------------------------
def flags(x: str) -> str:
    t = f"lower({x})"
    return ", ".join(f"regexp_matches({t}, {q(p)}) AS {n}" for n, p in {
        "has_men": fv.RESULT_MEN, "has_women": fv.RESULT_WOMEN, "has_kids": fv.KIDS,
        "has_tshirt": fv.RESULT_TSHIRT, "has_bra": fv.RESULT_BRA,
    }.items())


RESULT_TEXT = "product_name || ' ' || department || ' ' || category || ' ' || description"
ADJUST = """
round(greatest(0.0::DOUBLE, least(confidence_score
 * CASE WHEN (gender = 'men' AND has_women AND NOT has_men) OR (gender = 'women' AND has_men AND NOT has_women) THEN 0.35::DOUBLE
        WHEN (gender = 'men' AND has_men) OR (gender = 'women' AND has_women) THEN 1.20::DOUBLE ELSE 1.0::DOUBLE END
 * CASE WHEN gender IS NOT NULL AND has_kids AND NOT wants_kids THEN 0.60::DOUBLE ELSE 1.0::DOUBLE END
 * CASE WHEN wants_tshirt AND has_bra THEN 0.30::DOUBLE ELSE 1.0::DOUBLE END
 * CASE WHEN wants_tshirt AND has_tshirt THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END, 1.0::DOUBLE)), 9)"""


def adjusted(source: str) -> str:
    return f"""
SELECT *, {ADJUST} AS adjusted FROM (SELECT *, {flags(RESULT_TEXT)} FROM {source}
  JOIN (SELECT query_id, gender, wants_tshirt, wants_kids, constrained FROM wants) USING (query_id))"""


RESULT_NAMES = "query_id, model_id, rank, product_id, product_name, department, category, brand, price, rating, reviews_count, description, confidence_score"
CTES["routed"] = f"""
SELECT query_id, model_id, CAST(new_rank AS INTEGER) AS rank, product_id, product_name, department, category, brand, price, rating,
  reviews_count, description, CASE WHEN constrained THEN round(adjusted, 4) ELSE confidence_score END AS confidence_score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, model_id
        ORDER BY CASE WHEN constrained THEN -adjusted ELSE 0 END, rank) AS new_rank FROM ({adjusted('all_results')}))
WHERE new_rank <= 5"""
_WEIGHT = " ".join(f"WHEN {q(m)} THEN {w}::DOUBLE" for m, w in fv.ENSEMBLE_WEIGHTS.items())
_ORDER = " ".join(f"WHEN {q(m)} THEN {i}" for i, m in enumerate(fv.ENSEMBLE_WEIGHTS))
_SUMS = " + ".join(
    f"coalesce(sum(CASE WHEN model_id = {q(m)} THEN adjusted * {w}::DOUBLE END), 0.0::DOUBLE)" for m, w in fv.ENSEMBLE_WEIGHTS.items()
)
_FIRST = ", ".join(
    f"arg_min({c}, CASE model_id {_ORDER} END * 1000 + rank) AS {c}"
    for c in ("product_name", "department", "category", "brand", "price", "rating", "reviews_count", "description")
)
CTES["voted"] = f"""
SELECT query_id, {q(fv.ENSEMBLE)} AS model_id, CAST(row_number() OVER (PARTITION BY query_id
    ORDER BY score DESC, votes DESC, seen, product_id) AS INTEGER) AS rank,
  * EXCLUDE (query_id, score, votes, seen), round(least(score, 1.0), 4) AS confidence_score, votes FROM (
  SELECT query_id, product_id, {_FIRST}, round({_SUMS}, 9) AS score, count(*) AS votes,
    min(CASE model_id {_ORDER} END * 1000 + rank) AS seen
  FROM ({adjusted('all_results_wide')}) GROUP BY 1, 2)
QUALIFY rank <= 5"""
CTES["judged"] = f"""
SELECT r.*, query_type, len(list_filter(relevant_terms,
    lambda t: contains(lower(department || ' ' || category || ' ' || product_name), lower(t)))) > 0 AS flag
FROM (SELECT {RESULT_NAMES} FROM routed UNION ALL SELECT {RESULT_NAMES} FROM voted) r JOIN queries USING (query_id)"""


def metrics(judged: str, asked: str, k: int = 5) -> str:
    """Per (model_id, query_id) metrics of flagged, ranked rows."""
    return f"""
SELECT model_id, query_type, query_id, round(p, 4) AS precision_at_k, round(r, 4) AS recall_at_k, round(r, 4) AS success_at_k,
  round(coalesce(1.0 / first_hit, 0), 4)::DOUBLE AS mrr, round(CASE WHEN hits > 0 THEN dcg / idcg ELSE 0 END, 4)::DOUBLE AS ndcg,
  round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 4)::DOUBLE AS f1_score
FROM (SELECT *, CASE WHEN n > 0 THEN hits::DOUBLE / n ELSE 0.0::DOUBLE END AS p, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r,
        list_sum(list_transform(range(1, hits + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS idcg
      FROM (SELECT a.model_id, a.query_type, a.query_id, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, first_hit, dcg
            FROM {asked} a LEFT JOIN (
              SELECT model_id, query_id, count(*) FILTER (WHERE rank <= {k}) AS n, count(*) FILTER (WHERE flag AND rank <= {k}) AS hits,
                min(rank) FILTER (WHERE flag) AS first_hit, sum(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE flag AND rank <= {k}) AS dcg
              FROM {judged} GROUP BY 1, 2) m USING (model_id, query_id)))"""


CTES["asked"] = f"SELECT query_id, query_type, unnest({words([*fv.MODELS, fv.ENSEMBLE])}) AS model_id FROM queries"
CTES["scored_queries"] = metrics("judged", "asked")
CTES["report"] = """
SELECT model_id, query_type, round(avg(precision_at_k), 4) AS precision_at_k, round(avg(recall_at_k), 4) AS recall_at_k,
  round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg, round(avg(f1_score), 4) AS f1_score FROM scored_queries GROUP BY 1, 2"""

# --- given vectors -----------------------------------------------------------
CTES["emb"] = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
CTES["emb_hits"] = """
SELECT query_id, target_id, greatest(0.0::DOUBLE, d2) AS distance,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0 - greatest(0.0::DOUBLE, d2) / 2.0)) AS confidence, CAST(rn AS INTEGER) AS rank,
  query_label, target_label FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, target_id) AS rn FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS target_id, a.label AS query_label, b.label AS target_label,
    round(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v), 9) AS d2 FROM emb a CROSS JOIN emb b))
WHERE rn <= 10"""


def sql(body: str) -> str:
    """``body`` with every common table expression it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n].strip()})" for n in ordered) + "\n" + body.strip()
