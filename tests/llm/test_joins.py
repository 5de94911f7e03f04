"""Signature-tree join, connected components and spot signatures against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from aisle.llm import shared, signature_tree, spotsigs


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(found) < words:
        return frozenset([tuple(found)]) if found else frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def brute(rows, words, num, den):
    sets = {i: shingles(t, words) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    """Random texts, copies, and near copies around the threshold that share common lines."""
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of"] * 40
    rows = []
    for i in range(140):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 4) if i % 7 else 25):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("block", [signature_tree.BLOCK_SHINGLES, 300])
@pytest.mark.parametrize(("words", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components_match_brute_force(spark, corpus, words, num, den, block):
    frame = spark.createDataFrame(corpus, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in signature_tree.linked(frame, words, num, den, block).collect()}
    assert found == brute(corpus, words, num, den)


def test_no_task_gathers_a_large_meeting(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10_000)}" for _ in range(100)]
    rows = [(1, " ".join(base))] + [(i, " ".join([*base[: i % 100], f"new{i}", *base[i % 100 + 1 :]])) for i in range(2, 400)]

    def bounded(make, column, most):
        """``make`` whose groups hold at most ``most`` shingles."""
        def made(num, den):
            inner = make(num, den)

            def run(batches):
                total = {}

                def seen():
                    for batch in batches:
                        for key, n in zip(batch.column("key").to_pylist(), batch.column(column).to_pylist(), strict=True):
                            total[key] = total.get(key, 0) + (n if column == "n" else len(n) // 8)
                        yield batch

                yield from inner(seen())
                assert max(total.values(), default=0) <= most, max(total.values())
            return run
        return made

    monkeypatch.setattr(signature_tree, "_possible_links", bounded(signature_tree._possible_links, "n", 5_000))
    monkeypatch.setattr(signature_tree, "_exact_links", bounded(signature_tree._exact_links, "hashes", 15_000))
    found = signature_tree.linked(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100, 5_000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(rows, 4, 85, 100)


def test_links_of_hard_rows(hard, nothing):
    found = [(r.doc_id, r.n_shingles, r.component_id) for r in signature_tree.linked(hard, 4, 85, 100).collect()]
    by_id = {i: (n, c) for i, n, c in found}
    assert len(found) == 12 and by_id[1][1] == by_id[2][1] == 1
    assert by_id[3] == (0, 3) and by_id[4] == (0, 4) and by_id[5] == (0, 5) and by_id[7] == (1, 7)
    assert by_id[9][1] == 8 and by_id[10][1] == 10 and by_id[None][1] is None
    assert signature_tree.linked(nothing).count() == 0
    kept = signature_tree.one_of_each(hard)
    assert kept.columns == hard.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 10]


def test_one_row_of_each_component_with_null_and_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (1, a), (None, b), (None, c), (None, c), (7, d), (7, b + " end"), (3, d), (5, d), (None, None), (None, "")]
    found = signature_tree.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, found)) == sorted(map(str, spark.createDataFrame(
        [(1, a), (None, c), (7, b + " end"), (3, d), (None, None), (None, "")], "doc_id long, text string").collect()))


def test_tree_finds_every_pair_that_its_bitmaps_allow():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 60))).astype(np.uint64) for _ in range(150)]
    sets.sort(key=len)
    maps = np.stack([np.frombuffer(signature_tree._bitmap(s, 128), np.uint8) for s in sets])
    tree = signature_tree.SignatureTree(np.array([len(s) for s in sets]), maps)
    met = {(a, b) for i, j in tree.traverse(30, 100, lambda: np.arange(150)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    linked = {(a, b) for a in range(150) for b in range(a + 1, 150)
              if 100 * len(np.intersect1d(sets[a], sets[b])) >= 30 * len(np.union1d(sets[a], sets[b]))}
    assert linked <= met


def test_connected_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 510 + i) for i in range(60)]
    found = {r.node: r.component for r in shared.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    union = shared.Union(600)
    for a, b in pairs:
        union.join(a, b)
    assert found == {i: union.find(i) for a, b in pairs if a != b for i in (a, b)}


def test_next_document_and_edit(spark):
    rng = random.Random(2)
    ids = sorted({rng.choice([rng.randrange(5_000), -rng.randrange(3_000), rng.randrange(1 << 45)]) for _ in range(120)}, reverse=True)
    texts = {i: "".join(rng.choice("ab é😀 the der \n") for _ in range(rng.randint(0, 60))) for i in ids}
    found = {r.doc_id: r for r in spotsigs.edited(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[after][:half]
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and found[i].n_chars == len(texts[i])
        assert 0 <= found[i].near_next <= 1 and 0 <= found[i].near_edited <= 1
        assert (found[i].near_edited == 1) >= (edited == texts[i])


def test_fingerprints_of_hard_rows(hard, nothing):
    found = {r.doc_id: r for r in spotsigs.edited(hard).collect()}
    assert spotsigs.edited(hard).count() == 12 and spotsigs.edited(nothing).count() == 0
    assert found[1].fingerprint == found[2].fingerprint and found[3].fingerprint == found[4].fingerprint
    assert found[3].n_chars == 0 and found[4].near_edited == 1.0


def test_similar_fingerprints_match_brute_force(spark, corpus):
    frame = spark.createDataFrame(corpus, "id long, text string")
    prints = spotsigs.with_signatures(frame, "text", "signatures").select("id", "signatures")
    classes = {}
    for r in prints.orderBy("id").collect():
        classes.setdefault(tuple(r.signatures), r.id)
    items = [(i, set(s)) for s, i in classes.items()]
    wanted = {(i, j) for i, a in items for j, b in items if i < j and len(a & b) >= 0.8 * len(a | b)}
    assert {(r.a, r.b) for r in spotsigs.similar(prints, 0.8).collect()} == wanted
    members = {r.id: r.class_id for r in spotsigs.classes(prints).collect()}
    assert members == {r.id: classes[tuple(r.signatures)] for r in prints.collect()}


def test_long_runs_of_common_words(spark):
    frame = spark.createDataFrame([(1, "the " * 30_000 + "end"), (2, "of " * 30_000)], "doc_id long, text string")
    assert spotsigs.with_signatures(frame, "text", "s").where(F.size("s") > 0).count() == 2
