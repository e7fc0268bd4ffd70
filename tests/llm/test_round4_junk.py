"""Every length of text that occurs has a bound for junk, and all labelled rows make it."""

import corpus_pipeline
import pytest
from cuewise.llm import language
from pyspark.sql import functions as F

NAMES = {"names": ["de", "en"]}


@pytest.fixture
def plain_model(monkeypatch):
    """A stand-in for the network: texts with ``zq`` are near chance, those with ``k`` a little less sure than others."""
    def predict(docs, model, keep, text_column="text", name="found"):
        text = F.coalesce(text_column, F.lit(""))
        local = F.when(text.contains("zq"), 0.52).when(text.contains("k"), 0.92).otherwise(0.94)
        return docs.select(*keep, F.struct(F.lit("en").alias("lang_pred"), local.alias("score"), local.alias("local"), text.rlike("[a-z]").alias("has_letter")).alias(name))

    monkeypatch.setattr(language, "fit", lambda *args, **more: NAMES)
    monkeypatch.setattr(language, "predict", predict)


def test_junk_goes_whatever_its_length(spark, plain_model):
    clean = [(k, "abk " * (30 + k % 3), "en") for k in range(40)]
    longer, shorter, shortest = [(100, "abc " * 900, None), (101, "abc " * 60, "de")], [(200, "abcdefg hij", None)], [(300, "zq", None)]
    junk = [(1000, "zq " * 900, None), (1001, "zq " * 70, None), (1002, "zq zq zq zq", None), (1003, "zq " * 9000, "en"), (1004, "zq " * 30, None)]
    frame = spark.createDataFrame(clean + longer + shorter + shortest + junk, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, frame, "").collect()}
    assert kept == {r[0] for r in clean + longer + shorter + shortest}


def test_a_class_is_measured_by_all_its_labelled_rows(spark, plain_model):
    rows = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, "abk").otherwise("abc").alias("text"), F.when(F.col("id") % 10 < 9, "en").alias("lang"))
    found = language.predict(rows.withColumn("text", F.repeat("text", F.lit(8))), NAMES, ["text", "lang"])
    mean, dev = found.where("lang IS NOT NULL").agg(F.avg("found.local"), F.stddev_samp("found.local")).first()
    bounds = language.junk_bounds(found, NAMES)
    assert list(bounds) == [4] and abs(bounds[4] - min(mean - 6 * dev, 0.5 + 0.25 * (mean - 0.5))) < 1e-12


def test_pooled_moments():
    parts = [{"n": 2, "mean": 1.0, "var": 1.0}, {"n": 0, "mean": None, "var": None}, {"n": 40, "mean": 3.0, "var": 0.0}, {"n": 9, "mean": 99.0, "var": 0.0}]
    n, mean, dev = language.pooled(parts)
    values = [0.0, 2.0] + [3.0] * 40
    assert n == 42 and abs(mean - sum(values) / 42) < 1e-12 and abs(dev ** 2 - sum((v - mean) ** 2 for v in values) / 41) < 1e-12
