"""Rows of one recording are spread over tasks, and extended parts are made for extended rows alone."""

from pyspark.sql import functions as F

from cuewise.functions import scores
from cuewise.operators import features, ordering


def test_a_large_key_with_close_numbers_is_spread_over_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(40000).select(F.lit("k").alias("k"), F.col("id"))
        ranked = ordering.chunked_row_number(rows, ["k"], "id", "rn")
        assert ranked.where("rn != id + 1").count() == 0
        most = ranked.where("rn >= 1").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert most < 40000


def test_extended_values_stand_only_in_extended_rows(spark):
    text = "Why is this so good? Everyone said it was impossible, but in the end it worked and we won!"
    rows = spark.createDataFrame([(1, "extended", text), (2, "default", text), (3, None, text), (4, " Extended ", text)], "id int, analysis_mode string, transcript string").selectExpr(
        "*", "0.0D AS start_seconds", "12.0D AS end_seconds", "array('humor') AS tags", "'' AS context_before", "'' AS context_after")
    shown = ["extended_hook_score", "extended_ending_score", "opening_clarity_score", "extended_punchline_score", "extended_completeness_score", "extended_story_signals", "extended_reading_likelihood"]
    got = {r["id"]: tuple(r)[1:] for r in features.recompute(rows).select("id", *shown).collect()}
    assert got[2] == got[3] == (-1, -1, -1, -1, -1, [], 0.0)
    assert got[1] == got[4] and min(got[1][:5]) > 0 and got[1][5]


def test_repeats_of_runs(spark):
    rows = [(["a", "b"], 0), ([], 0), (["a", "b", "c"], 1), (["a"] * 6, 4), ("x y z q x y z".split(), 2), ("a b c a b c a b c d".split(), 3)]
    frame = spark.createDataFrame(rows, "words array<string>, n int")
    assert frame.where(scores.max_repeats(F.col("words")) != F.col("n")).count() == 0
