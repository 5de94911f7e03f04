"""DuckDB statements of the queries that SQL can express."""

from __future__ import annotations

# The CRC-32 of a decimal number, one byte and eight shifts at a time (polynomial of ISO 3309).
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)) + bit)))"""

PREFIX_TRIE = f"""
WITH turns AS (
    SELECT conv_id::BIGINT AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, count(*) AS own_n, conv_id - conv_id % 20 AS base, {_CRC32.format("conv_id")} % 4 AS h FROM turns GROUP BY conv_id),
sizes AS (SELECT own.*, least(own.h, coalesce(b.own_n, 0)) AS head_n FROM own LEFT JOIN own b ON b.conv_id = own.base),
rebuilt AS (
    SELECT s.conv_id, t.pos, t.role, t.text FROM sizes s JOIN turns t ON t.conv_id = s.base WHERE t.pos < s.h
    UNION ALL
    SELECT s.conv_id, t.pos - s.h + s.head_n, t.role, t.text FROM sizes s JOIN turns t USING (conv_id) WHERE t.pos >= s.h),
paths AS (
    SELECT conv_id, pos + 1 AS depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
           md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS name
    FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM sizes),
steps AS (SELECT *, lag(name) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
                 depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM paths),
nodes AS (
    SELECT name, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           any_value(words) AS words,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
    FROM steps GROUP BY name),
children AS (SELECT parent AS name, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
own_values AS (SELECT nodes.*, coalesce(n, 0) AS n_children, (n_convs - 1) * words AS saved FROM nodes LEFT JOIN children USING (name)),
below AS (
    SELECT p.name, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum(v.saved) AS saved_tokens
    FROM own_values v JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.name)
SELECT v.conv_id, v.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n_convs, v.n_children, below.n_leaves,
       below.saved_tokens::BIGINT AS saved_tokens, v.words::BIGINT AS n_words, v.ends_sha256
FROM own_values v JOIN below USING (name) LEFT JOIN nodes up ON up.name = v.parent
"""

COLLOCATIONS = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
counted AS MATERIALIZED (
    SELECT lang, k, phrase, count(*) AS n FROM (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
        FROM words, range(1, 5) sizes(k))
    GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, n AS a FROM counted WHERE k >= 2 AND n >= 30),
places AS MATERIALIZED (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
parts AS MATERIALIZED (
    SELECT lang, phrase, a, cut, array_to_string(list_slice(w, 1, cut), ' ') AS first_part,
           array_to_string(list_slice(w, cut + 1, k), ' ') AS rest FROM places),
cuts AS (
    SELECT p.lang, p.phrase, p.a, p.cut, x.n AS l, y.n AS r, ((2000000::HUGEINT * p.a) // (x.n + y.n))::BIGINT AS score
    FROM parts p JOIN counted x ON x.lang = p.lang AND x.phrase = p.first_part
    JOIN counted y ON y.lang = p.lang AND y.phrase = p.rest),
best AS (SELECT lang, phrase, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM cuts GROUP BY ALL),
shorter AS MATERIALIZED (SELECT *, unnest(range(2, k)) AS size FROM candidates),
inside AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(list_slice(w, i, i + size - 1), ' '))) AS phrase
        FROM shorter)
    GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
