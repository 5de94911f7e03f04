"""Prefix trie, collocations and the neighbour graph against brute force and DuckDB."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from aisle.llm import collocations, neighbour_graph, prefix_trie, queries, statements

CONV = "conv_id long, turn int, role string, text string, n long, words string"
VEC = "vec_id long, embedding array<double>, label int, id long, vector string"


# ------------------------------------------------------------------ prefix trie


def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:]) if rebuild else tuple(turns)
    members = defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves = sum(out[c][5] for c in children[p]) or 1
        saved = (len(members[p]) - 1) * words + sum(out[c][6] for c in children[p])
        ends = ",".join(str(c) for c in members[p] if len(full[c]) == len(p))
        out[p] = (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves, saved,
                  hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def trie_rows(spark, rows, rebuild=True):
    frame = spark.createDataFrame(rows, CONV)
    if rebuild:
        trie = prefix_trie.build(*prefix_trie.rebuilt(prefix_trie.numbered(prefix_trie.items(frame))))
    else:
        trie = prefix_trie.prefixes(frame)
    found = prefix_trie.with_digests(trie).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(map(tuple, found.collect()), key=repr)


def conversations(seed, longest):
    """Few texts, so that many conversations share beginnings; copies, null turns, roles and texts."""
    rng = random.Random(seed)
    rows = []
    for c in range(70):
        for turn in range(rng.choice([1, 2, 3, 5, 8, longest])):
            rows.append((c * rng.choice([1, 1, 1, 3]) + 7 if rng.random() < 0.02 else c, turn if rng.random() < 0.97 else None,
                         rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else "user",
                         rng.choice(["a b", "a  b c", "", None, "\t"]) if rng.random() < 0.4 else "same words here", 1, "x"))
    return rows


def no_ties(rows):
    """Turns are numbered so that none is equal within a conversation."""
    seen, kept = set(), []
    for row in rows:
        if (row[0], row[1]) not in seen:
            seen.add((row[0], row[1]))
            kept.append(row)
    return kept


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_matches_brute_force(spark, rebuild):
    rows = no_ties(conversations(4, 13))
    assert trie_rows(spark, rows, rebuild) == brute_trie(rows, rebuild)


def test_trie_of_hard_rows(spark):
    long_text = "word " * 50_000
    rows = [(None, 1, "user", "lost", 1, "x"), (20, None, None, None, 1, "x"), (20, 0, "user", long_text, 1, "x"), (21, 5, "user", "", 1, "x"),
            (22, 5, "user", "", 1, "x"), (9_000_000_000, 1, "user", "far", 1, "x")]
    rows += [(23, t, "user", "same", 1, "x") for t in range(40)]  # much longer than the others
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "a", 1, "x")] * 3
    found = trie_rows(spark, rows, rebuild=False)
    assert [r[1] for r in sorted(found, key=lambda r: r[1])] == [0, 1, 2, 3]  # repeated rows are repeated turns
    assert trie_rows(spark, [], rebuild=False) == []


# ------------------------------------------------------------------ collocations


def brute_phrases(rows, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    out = []
    frequent = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    for (lang, p), a in frequent.items():
        cuts = [(2_000_000 * a // (counts[lang, p[:c]] + counts[lang, p[c:]]), c) for c in range(1, len(p))]
        score, c = min(cuts)
        inside = any(g == lang and len(q) > len(p) and 100 * n >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                     for (g, q), n in frequent.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:c]], counts[lang, p[c:]], totals[lang]))
    rows, rank = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            rows.append((lang, rank[lang], phrase.decode(), -a, left, right, n, -score))
    return rows


def phrase_corpus():
    rng = random.Random(3)
    usual = ["New York City", "state of the art", "a b", "c", "über alles", "x-y", "in the", "of the"]
    rows = []
    for i in range(150):
        words = [rng.choice(usual) if rng.random() < 0.5 else f"w{rng.randrange(40)}" for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([" ", "  ", "\t"]).join(w + rng.choice(["", "", "", ",", ".", "\n"]) for w in words), rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), ("only one", "xx"), ("ha ha ha ha ha", "en")] + [("copies of one text " * 3, "en")] * 20


@pytest.mark.parametrize("share", [0.0, 0.02, 0.5, 1.0])
def test_phrases_do_not_depend_on_the_sample(spark, share):
    rows = phrase_corpus()
    frame = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n long, w1 string")
    found = collocations.mine(frame, top=40, least=6, share=share).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == sorted(brute_phrases(rows, 6, 40))


@pytest.mark.parametrize("width", [7, 10])
def test_phrases_do_not_depend_on_shared_bits(spark, monkeypatch, width):
    monkeypatch.setattr(collocations, "LEAST_BITS", width)
    monkeypatch.setattr(collocations, "MOST_BITS", width)
    rows = phrase_corpus()
    frame = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n long, w1 string")
    found = collocations.mine(frame, top=40, least=6, share=0.1).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == sorted(brute_phrases(rows, 6, 40))


def test_rare_phrases_are_not_written(spark, monkeypatch):
    tables, plain = [], collocations.written
    monkeypatch.setattr(collocations, "written", lambda frame, name: tables.append((name, out := plain(frame, name))) or out)
    frame = spark.createDataFrame(phrase_corpus(), "text string, lang string")
    collocations.frequent(frame, least=6, share=0.5)
    kept = [t for name, t in tables if name == "counts"]
    assert len(kept) > 1 and all(t.where("k > 1 and n < 6").isEmpty() for t in kept)
    assert any(not t.where("k > 1").isEmpty() for t in kept)


def test_rare_phrases_are_not_counted_by_words(spark, monkeypatch):
    wide, plain = [], collocations.counts
    monkeypatch.setattr(collocations, "counts", lambda frame, sizes, *maps, **more: wide.append((sizes, out := plain(frame, sizes, *maps, **more))) or out)
    frame = spark.createDataFrame(phrase_corpus(), "text string, lang string")
    found, _ = collocations.frequent(frame, least=6, share=0.5)
    rows = [out.where("k > 1").count() for sizes, out in wide if len(sizes) == 4]
    assert rows and max(rows) <= 1.2 * found.where("k > 1").count()


@pytest.mark.parametrize("share", [0.02, 0.5])
def test_phrases_that_the_sample_does_not_hold(spark, monkeypatch, share):
    monkeypatch.setattr(collocations, "HELD", 64)  # counted in many parts
    rows = phrase_corpus()
    found = collocations.mine(spark.createDataFrame(rows, "text string, lang string"), top=40, least=6, share=share)
    found = found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == sorted(brute_phrases(rows, 6, 40))


def test_phrases_match_duckdb(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(statements.COLLOCATIONS)
    found = queries.op12_collocations(spark, sf_dir).select(*want.columns).collect()
    assert sorted(map(tuple, found)) == sorted(want.fetchall()) and found


def test_phrases_of_empty_and_long_texts(spark, hard, nothing):
    assert collocations.mine(nothing).collect() == []
    found = collocations.mine(hard, least=2, top=100_000).collect()  # word0 … word29999 twice, in windows of four
    assert any(r.phrase == "word0 word1 word2 word3" and r.a == 2 for r in found)


# ------------------------------------------------------------------ neighbour graph


def brute_neighbours(vectors, query, k):
    d = sorted((float(np.sqrt(((np.array(v) - np.array(vectors[query])) ** 2).sum())), i) for i, v in vectors.items() if i != query)
    return d[:k]


def neighbour_rows(spark, rows, **options):
    graph = neighbour_graph.build(spark.createDataFrame(rows, VEC))
    asked = graph.points.select(F.col("id").alias("query_id"), "vector")
    found = defaultdict(list)
    for r in neighbour_graph.search(graph, asked, **options).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(found[r.query_id]) + 1
        found[r.query_id].append((r.score, r.id))
    return found


def test_small_graphs_are_exact(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.standard_normal(8).round(1).tolist() for i in range(120)}
    vectors |= {1000 + i: [1.0] * 8 for i in range(40)}  # copies: more than are asked for
    vectors |= {7: [1e300] * 8, 8: [-1e300] * 8, 9: [1e-200] * 8}
    found = neighbour_rows(spark, [(i, v, 0, 5, "x") for i, v in vectors.items()] + [(3, vectors[3], 0, 5, "x")])
    for i in vectors:
        if i not in (7, 8):  # their squares overflow in the brute force
            want = brute_neighbours({j: v for j, v in vectors.items() if j not in (7, 8)}, i, 10)
            assert [j for _, j in found[i]] == [j for _, j in want]
            np.testing.assert_allclose([d for d, _ in found[i]], [d for d, _ in want], rtol=1e-12)
    assert max(d for d, _ in found[7]) < float("inf")


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]),
            (8, []), (9, [1.0, 1.0, 1.0]), (None, [2.0, 2.0]), (10, [-0.0, 3.0])]
    found = neighbour_rows(spark, [(i, v, 0, 5, "x") for i, v in rows])
    assert {i: [j for _, j in r] for i, r in found.items()} == {1: [7, 10], 7: [1, 10], 10: [7, 1]}
    assert neighbour_rows(spark, []) == {}
    assert neighbour_rows(spark, [(1, [1.0], 0, 5, "x")]) == {}


def test_recall_of_a_large_graph(spark):
    rng = np.random.default_rng(2)
    points = rng.standard_normal((3000, 24)) + rng.standard_normal((10, 24))[rng.integers(0, 10, 3000)]
    graph = neighbour_graph.build(spark.createDataFrame([(i, v.tolist(), 0, 5, "x") for i, v in enumerate(points)], VEC))
    inside = points[::60]
    outside = rng.standard_normal((30, 24))  # these have no node of their own
    asked = spark.createDataFrame(
        [(i * 60, v.tolist()) for i, v in enumerate(inside)] + [(100_000 + i, v.tolist()) for i, v in enumerate(outside)],
        "query_id long, vector array<double>")
    found = defaultdict(set)
    for r in neighbour_graph.search(graph, asked).collect():
        found[r.query_id].add(r.id)
    hits = []
    for q, v in [(i * 60, v) for i, v in enumerate(inside)] + [(100_000 + i, v) for i, v in enumerate(outside)]:
        d = np.sqrt(((points - v) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        hits.append(len(found[q] & set(order)) / 10)
    assert np.mean(hits) >= 0.9
