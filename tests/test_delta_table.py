"""The delta table against a dictionary, with late, repeated and deleting batches."""

import random

from pyspark.sql import functions as F

from cuewise.operators import feedback
from cuewise.sources.delta_table import DeltaTable

SCHEMA = "id long, name string, at long"


def table_rows(table):
    return {r["id"]: (r["name"], r["at"]) for r in table.read().collect()}


def test_batches_in_any_order_give_the_newest_rows(spark, tmp_path):
    rng, want = random.Random(8), {k: ("first", 10, False) for k in range(20)}
    table = DeltaTable.create(spark.createDataFrame([(k, "first", 10) for k in want], SCHEMA), str(tmp_path / "t"), ["id"], "at", buckets=4)
    assert table.compact() == [] and table_rows(table) == {k: v[:2] for k, v in want.items()}
    for number in range(5):
        rows = [(rng.randrange(30), f"b{number}-{k}", rng.randrange(40), rng.random() < 0.3) for k in range(12)]
        rows = list({(r[0], r[2]): r for r in rows}.values())  # a key has no two changes of one time in a batch
        frame = spark.createDataFrame(rows, SCHEMA + ", gone boolean")
        for _ in range(2):  # run twice, as after a failure
            table.append(frame.drop("gone").join(frame.select("id", "at", "gone"), ["id", "at"]), number, F.col("gone"))
        for key, name, at, gone in sorted(rows, key=lambda r: r[2]):
            if key not in want or at >= want[key][1]:
                want[key] = name, at, gone
        if number in (1, 3):
            table.compact()
        assert table_rows(table) == {k: v[:2] for k, v in want.items() if not v[2]}
    assert table.compact() and table_rows(table) == {k: v[:2] for k, v in want.items() if not v[2]}


def test_compaction_touches_only_buckets_with_changes(spark, tmp_path):
    table = DeltaTable.create(spark.range(400).select("id", F.lit("x").alias("name"), F.lit(1).cast("long").alias("at")), str(tmp_path / "t"), ["id"], "at", buckets=16)
    table.append(spark.createDataFrame([(5, "new", 2), (6, "late", 0)], SCHEMA), 0)
    touched = table.compact()
    assert 1 <= len(touched) <= 2
    assert len(list((tmp_path / "t" / "base" / "gen=1").glob("bucket=*"))) == len(touched)
    rows = table_rows(table)
    assert len(rows) == 400 and rows[5] == ("new", 2) and rows[6] == ("x", 1)
    # a change that is delivered once more, under another number, changes nothing; a deleted row does not come back
    table.append(spark.createDataFrame([(5, "new", 2)], SCHEMA), 1)
    table.append(spark.createDataFrame([(7, None, 9)], SCHEMA), 2, F.lit(True))
    table.compact()
    table.append(spark.createDataFrame([(7, "late", 8)], SCHEMA), 3)
    rows = table_rows(table)
    assert 7 not in rows and rows[5] == ("new", 2) and len(rows) == 399


def test_late_events_change_neither_review_nor_snapshot(spark):
    reviews = spark.createDataFrame([(1, "accepted", "", "r1", 100)], "segment_id long, rating string, review_reason string, reviewed_revision_id string, updated_at long")
    snapshots = spark.createDataFrame([(1, "general", "accepted", 100)], "segment_id long, profile string, decision string, updated_at long")
    current = spark.createDataFrame([(1, "r1", 1, [1.0], 0.5)], "segment_id long, revision_id string, revision_number int, embedding array<double>, features double")
    for rating in ("rejected", "unrated"):
        late = spark.createDataFrame([(1, 7, 50, "general", rating, "x")], "segment_id long, event_id long, updated_at long, profile string, rating string, review_reason string")
        merged, kept = feedback.apply_reviews(reviews, snapshots, late, current)
        assert [(r["rating"], r["updated_at"]) for r in merged.collect()] == [("accepted", 100)]
        assert [tuple(r) for r in kept.collect()] == [(1, "general", "accepted", 100)]
