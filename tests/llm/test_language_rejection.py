"""Batches of several chunks, and texts that no language's model should accept."""

import random

from pyspark.sql import functions as F

from aisle.llm import language


def test_batches_of_several_chunks_without_one_of_the_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "CHUNK", 1 << 10)
    rows = [(i, "die katze schläft im haus und der hund auch " * 400, "de") for i in range(4)] + [(9, "the cat sleeps", "en"), (10, None, "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    found = {r.doc_id: r.lang_pred for r in language.identify(frame, training=F.lit(True)).collect()}
    assert found == {0: "de", 1: "de", 2: "de", 3: "de", 9: "en", 10: "und"}


def test_garbled_and_foreign_texts_are_rejected_and_clean_ones_stay(spark):
    rng = random.Random(8)
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    garbled = [(100_000 + i, " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(80)), "en")
               for i in range(20)]
    foreign = [(200_000 + i, " ".join("".join(rng.choice("бвгджзклмнпрст") + rng.choice("аеиоуыэюя") for _ in range(rng.randint(1, 4)))
                                      for _ in range(80)), None) for i in range(5)]
    planted = spark.createDataFrame(garbled + foreign, documents.schema)
    found = language.identify(documents.unionByName(planted), training=F.lit(True)).select("doc_id", "accepted", "lang_pred").collect()
    assert not [r.doc_id for r in found if r.doc_id >= 100_000 and r.accepted]
    clean = [r.accepted for r in found if r.doc_id < 100_000 and r.lang_pred != "und"]
    assert sum(clean) >= 0.99 * len(clean)
