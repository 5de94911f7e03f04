"""Quality rules, language, toxicity and quality classifiers."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from aisle.llm import language, quality_classifier, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(runs)
    covered = {k for i, run in enumerate(runs) if many[run] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def test_measures_match_brute_force(spark, hard):
    extra = ["a b c d e f g h " * 9, "x\ny\nx\n \n \nx", "é ü z # <b> 50%", "a b\n" * 30]
    rows = hard.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    rows = rows.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    found = quality_rules.judge(rows, measures=quality_rules.BASE_MEASURES, keep=["doc_id", "text"]).collect()
    for r in found:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text)
        if r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words:
            assert not r.kept
        assert r.kept == (r.failed_rule is None)


def test_verdict_does_not_depend_on_the_order(hard, nothing):
    verdict = lambda rules: sorted((str(r.doc_id), r.kept) for r in quality_rules.judge(hard, rules).collect())
    assert verdict(quality_rules.RULES) == verdict(quality_rules.RULES[::-1])
    assert quality_rules.judge(nothing).count() == 0
    costs = quality_rules.estimate(hard, quality_rules.RULES, share=1.0)
    assert [c.worth for c in costs] == sorted((c.worth for c in costs), reverse=True)


def test_clean_documents_pass(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.judge(documents).join(labels, "doc_id")
    short = judged.where("quality = 1 AND NOT kept AND failed_rule NOT IN ('few_words', 'repeated_words')").count()
    assert short == 0 and judged.where("quality = 0 AND kept").count() <= 0.1 * judged.where("quality = 0").count()


def test_language_on_held_out_documents(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    found = language.identify(documents, fold != 1).join(documents, "doc_id").where(~F.col("is_training"))
    assert found.where("lang_pred = lang").count() >= 0.98 * found.count()
    assert found.where("NOT accepted").count() <= 0.01 * found.count()


def test_language_of_hard_rows(spark, hard, nothing):
    found = {r.doc_id: r for r in language.identify(hard, F.lit(True)).collect()}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {3, 4, 5, 6}
    assert all(not r.accepted and r.score == 0 for r in found.values() if r.lang_pred == "und")
    assert found[10].lang_pred == "de" and found[1].lang_pred == "en" and 0 <= found[1].score <= 1
    assert language.identify(nothing, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language.identify(hard, F.lit(False)).collect()} == {"und"}


def test_a_text_is_scored_alone(spark):
    texts = ["ein haus", "the house of", "x", "zwei worte ohne sinn", "and so on"]
    frame = spark.createDataFrame([(i, t, "en" if "o" in t else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language.train(frame.select("text", "lang"))
    together = {r.text2: r.cross_entropy for r in language.score(frame.withColumn("text2", F.col("text")).coalesce(1), model).collect()}
    for text in texts:
        alone = language.score(frame.where(F.col("text") == text), model).collect()[0].cross_entropy
        assert together[text] == pytest.approx(alone, abs=1e-5)


def test_kneser_ney_probabilities_sum_to_one(spark):
    frame = spark.createDataFrame([("abracadabra abrakadabra", "x"), ("hokus pokus", "x")], "text string, lang string")
    model = language.train(frame)
    import numpy as np

    assert np.allclose((2.0 ** model.log_bigram[:, :, 0]).sum(1), 1, atol=1e-4)
    for context in model.contexts:
        last = np.arange(128)
        grams = (context << 7) + last
        at = np.minimum(np.searchsorted(model.trigrams, grams), len(model.trigrams) - 1)
        known = model.trigrams[at] == grams
        left = model.log_backoff[np.searchsorted(model.contexts, context), 0]
        p = np.where(known, model.log_p[at, 0], left + model.log_bigram[context & 127, :, 0])
        assert (2.0 ** p).sum() == pytest.approx(1, abs=1e-3)


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.8), (quality_classifier, "quality", 0.9)])
def test_classifiers_on_held_out_documents(spark, module, label, least):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    found = module.classify(documents, labels, fold != 2).where(~F.col("is_training")).join(labels, "doc_id").toPandas()
    rank = found.score.rank()
    ones = found[label] == 1
    auc = (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc > least and (found.predicted == found[label]).mean() > 0.9


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_classifiers_on_hard_rows(hard, nothing, labels, module, label):
    found = module.classify(hard, labels, F.lit(True)).collect()
    assert len(found) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert module.classify(nothing, labels, F.lit(True)).count() == 0
    none = module.classify(hard, labels.where("false"), F.lit(True)).collect()
    assert len(none) == 12 and {r.predicted for r in none} == {0}


def test_toxicity_is_fitted_on_a_bounded_number_of_rows(spark, monkeypatch):
    texts = [(i, f"{'vile hateful scum' if i % 3 == 0 else 'kind gentle words'} number {i % 7}", int(i % 3 == 0)) for i in range(60)]
    rows = [*texts, *([texts[0]] * 500)]
    documents = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    known = spark.createDataFrame([(i, t) for i, _, t in texts], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "logistic", lambda rows, columns, values, label, width, f=toxicity.logistic: seen.append(len(label)) or f(rows, columns, values, label, width))
    training = documents.join(known, "doc_id").select(F.xxhash64("doc_id", "text").alias("row_key"), "text", F.col("toxic").alias("label"))
    first, again = (toxicity.train(frame, 20) for frame in (training, training.repartition(5)))
    assert seen == [20, 20] and (first.weight == again.weight).all() and first.bias == again.bias
    whole = {r.doc_id: r.score for r in toxicity.classify(documents, known, F.lit(True)).collect()}
    assert seen[2] == 60 and all((whole[i] > 0.5) == bool(t) for i, _, t in texts)
    monkeypatch.setattr("aisle.llm.shared.BROADCAST_ROWS", 10)  # labels joined by a shuffle give the same
    assert {r.doc_id: r.score for r in toxicity.classify(documents, known, F.lit(True)).collect()} == pytest.approx(whole)
