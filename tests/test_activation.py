"""Activation of runs over four tables, and its versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cuewise.operators import activation
from cuewise.schemas import project_segments

NOW, OLD = dt.datetime(2024, 5, 1), dt.datetime(2024, 1, 1)


def state(spark):
    rows = spark.createDataFrame(
        [("v", 1, 0.0, 10.0, "to samo zdanie", 2, "current", "r1"), ("v", 2, 100.0, 110.0, "inne zdanie", 1, "current", "r1"),
         ("v", 3, 300.0, 310.0, "powrót po przerwie", 4, "retired", "r0"), ("v", 4, 500.0, 510.0, "bez oceny", 1, "retired", "r0"),
         ("w", 9, 0.0, 5.0, "bez zmian", 1, "current", "q1"), ("x", 12, 0.0, 5.0, "pusty przebieg", 1, "current", "p1")],
        "video_id string, id long, start_seconds double, end_seconds double, transcript string, revision_number int, lifecycle_state string, analysis_run_id string")
    extra = rows.select("video_id", "id", "revision_number", "lifecycle_state", "analysis_run_id", F.lit(None).cast("timestamp").alias("retired_at"), F.lit(OLD).alias("created_at"))
    segments = project_segments(rows).join(extra, ["video_id", "id"])
    revisions = segments.select(
        F.concat(F.lit("old-"), F.col("id").cast("string")).alias("revision_id"), F.col("id").alias("segment_id"), "revision_number", F.lit("analysis").alias("revision_kind"),
        F.lit(True).alias("is_current"), F.col("analysis_run_id").alias("run_id"), F.lit(None).cast("double").alias("match_confidence"), F.lit("").alias("match_reason"),
        activation.machine_digest().alias("payload_digest"), "created_at")
    reviews = spark.createDataFrame([(3, "old-3", "accepted", "", OLD, OLD), (1, "old-1", "rejected", "nudne", OLD, OLD)],
                                    "segment_id long, reviewed_revision_id string, rating string, review_reason string, created_at timestamp, updated_at timestamp")
    runs = spark.createDataFrame(
        [("v", "r1", None, "completed", True, 2, "", OLD), ("v", "r2", "r1", "running", False, 0, "", None), ("v", "r0", None, "failed", False, 0, "earlier fault", OLD),
         ("w", "q1", None, "completed", True, 1, "", OLD), ("x", "p1", None, "completed", True, 1, "", OLD), ("x", "p2", "p1", "running", False, 0, "", None)],
        "video_id string, run_id string, parent_run_id string, state string, is_current boolean, candidate_count long, error_message string, completed_at timestamp")
    return dict(zip(activation.TABLES, (segments, revisions, reviews, runs)))


def records(spark):
    return spark.createDataFrame(
        [("v", 51, 0.5, 10.5, "to samo zdanie", 77), ("v", 52, 300.0, 310.0, "powrót po przerwie", 50), ("v", 53, 700.0, 710.0, "nowe", 40), ("v", 54, 500.0, 510.0, "bez oceny", 30),
         ("w", 60, 0.0, 5.0, "kein Lauf", 1)],
        "video_id string, id long, start_seconds double, end_seconds double, transcript string, quality_score int")


def test_all_tables_change_together(spark):
    staged = spark.createDataFrame([("v", "r2"), ("x", "p2")], "video_id string, run_id string")
    after = activation.activate(state(spark), staged, records(spark), F.lit(NOW))
    got = {r["id"]: (r["revision_number"], r["lifecycle_state"], r["analysis_run_id"], r["quality_score"], r["retired_at"] is not None, r["created_at"] == OLD) for r in after["segments"].collect()}
    assert got == {
        1: (3, "current", "r2", 77, False, True), 2: (1, "retired", "r1", 0, True, True), 3: (5, "current", "r2", 50, False, True), 4: (1, "retired", "r0", 0, False, True),
        53: (1, "current", "r2", 40, False, False), 54: (1, "current", "r2", 30, False, False), 9: (1, "current", "q1", 0, False, True), 12: (1, "current", "p1", 0, False, True)}
    revisions = {(r["segment_id"], r["revision_number"]): (r["revision_kind"], r["is_current"], r["match_reason"]) for r in after["revisions"].collect()}
    assert len(revisions) == 10 and revisions[1, 2] == ("analysis", False, "") and revisions[1, 3][:2] == ("reanalysis", True) and revisions[53, 1] == ("analysis", True, "new moment")
    assert revisions[2, 1][1] and revisions[12, 1][1]
    digests = {r["segment_id"]: r["payload_digest"] for r in after["revisions"].where("is_current").collect()}
    assert digests == {r["id"]: r["d"] for r in after["segments"].select("id", activation.machine_digest().alias("d")).collect()}
    reviews = {r["segment_id"]: (r["rating"], r["reviewed_revision_id"]) for r in after["reviews"].collect()}
    assert reviews == {1: ("rejected", "old-1"), 3: ("accepted", "old-3"), 53: ("unrated", "53:1:r2"), 54: ("unrated", "54:1:r2")}
    runs = {r["run_id"]: (r["state"], r["is_current"], r["candidate_count"], r["error_message"]) for r in after["runs"].collect()}
    assert runs == {"r1": ("completed", False, 2, ""), "r2": ("completed", True, 4, ""), "r0": ("failed", False, 0, "earlier fault"), "q1": ("completed", True, 1, ""),
                    "p1": ("completed", True, 1, ""), "p2": ("failed", False, 0, activation.EMPTY_RERUN)}


def test_runs_that_are_not_running_are_refused(spark):
    for staged in ([("v", "r1")], [("v", "r9")]):
        with pytest.raises(ValueError, match="no longer running"):
            activation.activate(state(spark), spark.createDataFrame(staged, "video_id string, run_id string"), records(spark), F.lit(NOW))


def test_only_committed_versions_are_read(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(ValueError, match="nothing"):
        activation.published(spark, folder)
    before = state(spark)
    assert activation.publish(before, folder, 0) == 1
    # an attempt that wrote a table but did not commit
    before["runs"].limit(1).write.parquet(f"{folder}/runs/version-2")
    assert activation.published(spark, folder)["runs"].count() == 6
    stored = activation.published(spark, folder)
    after = activation.activate(stored, spark.createDataFrame([("v", "r2")], "video_id string, run_id string"), records(spark), F.lit(NOW))
    assert activation.publish(after, folder, 1) == 2
    assert activation.published(spark, folder)["segments"].where("analysis_run_id = 'r2'").count() == 4
    with pytest.raises(ValueError, match="newest"):
        activation.publish(after, folder, 1)
