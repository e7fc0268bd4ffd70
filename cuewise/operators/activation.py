"""Runs become current over all tables at once: segments, revisions, reviews and runs change together or not at all.

``activate`` derives the next state of the four tables from one stored match of old and new moments. ``publish`` writes
them under a new version and then adds the one commit record that makes it visible; ``published`` reads the newest
committed version, so a job that dies halfway leaves the earlier state in force. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from cuewise.operators.history import STRONG_TEXT, has_human_data, match_moments
from cuewise.schemas import MACHINE_COLUMNS, project_segments
from cuewise.session import cut_lineage

EMPTY_RERUN = "The new analysis found no moments; the earlier one stays."
TABLES = ("segments", "revisions", "reviews", "runs")


def machine_digest(columns=tuple(MACHINE_COLUMNS)) -> Column:
    """Fingerprint of the machine part of a row; nulls count."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def _running(runs: DataFrame, staged: DataFrame) -> DataFrame:
    """(video_id, run_id, parent_run_id) of the staged runs; refused unless each is there and running, one for a recording."""
    found = staged.select("video_id", "run_id").join(runs.where("state = 'running'").select("video_id", "run_id", "parent_run_id"), ["video_id", "run_id"], "left")
    counts = staged.groupBy("video_id").count().where("count > 1")
    missing = staged.join(runs.where("state = 'running'"), ["video_id", "run_id"], "left_anti")
    if not missing.isEmpty():
        raise ValueError("a staged run is missing or no longer running")
    if not counts.isEmpty():
        raise ValueError("a recording has several staged runs")
    return found


def _matches(segments: DataFrame, records: DataFrame, evidence: DataFrame) -> DataFrame:
    """(video_id, new_id, previous_id, score, reason): current moments first; what is left may wake a retired moment with
    human evidence, on a high match with strong text."""
    shown = ["video_id", "new_id", "previous_id", "score", "reason"]
    first = cut_lineage(match_moments(segments.where("lifecycle_state = 'current'"), records).select(*shown))
    free = records.join(first.select("video_id", F.col("new_id").alias("id")), ["video_id", "id"], "left_anti")
    asleep = segments.where("lifecycle_state = 'retired'").join(evidence.select(F.col("segment_id").alias("id")).distinct(), "id", "left_semi")
    woken = match_moments(asleep, free).where((F.col("confidence") == "high") & (F.col("text_similarity") >= STRONG_TEXT))
    return cut_lineage(first.unionByName(woken.select(*shown)))


def human_evidence(reviews: DataFrame, revisions: DataFrame, *mentions: DataFrame) -> DataFrame:
    """(segment_id) with a person's review, a revision made by hand, or a mention in any further table."""
    found = reviews.where(has_human_data(reviews)).select("segment_id")
    found = found.unionByName(revisions.where(~F.col("revision_kind").isin("analysis", "reanalysis", "legacy")).select("segment_id"))
    for frame in mentions:
        found = found.unionByName(frame.select("segment_id"))
    return found.distinct()


def activate(tables: dict[str, DataFrame], staged: DataFrame, records: DataFrame, at: Column, mentions: tuple[DataFrame, ...] = ()) -> dict[str, DataFrame]:
    """The four tables after the ``staged`` runs (video_id, run_id) with their ``records`` (video_id, id, machine columns).

    A matched moment keeps its id and review and gets the next revision; an unmatched record is a new moment with an
    unrated review; an unmatched old moment of the recording retires. A rerun without records fails and leaves its
    recording as it was. Records of recordings without a staged run take no part.
    """
    segments, revisions, reviews, runs = (tables[name] for name in TABLES)
    staged = cut_lineage(_running(runs, staged))
    records = project_segments(records.join(staged, "video_id", "left_semi"))
    filled = records.groupBy("video_id").agg(F.count("*").alias("candidates"))
    outcome = cut_lineage(staged.join(filled, "video_id", "left").withColumn(
        "outcome", F.when(F.col("candidates").isNull() & F.col("parent_run_id").isNotNull(), "failed").otherwise("completed")))
    live = outcome.where("outcome = 'completed'").select("video_id", "run_id")
    touched = segments.join(live, "video_id", "left_semi")
    links = _matches(touched, records, human_evidence(reviews, revisions, *mentions))

    known = touched.select("video_id", F.col("id").alias("previous_id"), F.col("revision_number").alias("_revision"), F.col("created_at").alias("_created"))
    linked = records.withColumnRenamed("id", "new_id").join(links, ["video_id", "new_id"], "left").join(known, ["video_id", "previous_id"], "left").join(live, "video_id")
    matched = F.col("previous_id").isNotNull()
    active = cut_lineage(linked.select(
        "video_id", F.coalesce("previous_id", "new_id").alias("id"), *MACHINE_COLUMNS, F.col("run_id").alias("analysis_run_id"),
        F.when(matched, F.greatest(F.lit(1), F.coalesce("_revision", F.lit(1))) + 1).otherwise(1).cast("int").alias("revision_number"),
        F.lit("current").alias("lifecycle_state"), F.lit(None).cast("timestamp").alias("retired_at"), F.coalesce("_created", at).alias("created_at"),
        F.when(matched, F.col("score")).alias("_score"), F.coalesce("reason", F.lit("new moment")).alias("_reason"), matched.alias("_matched")))

    keys = active.select("video_id", "id")
    rest = segments.join(keys, ["video_id", "id"], "left_anti").join(live.select("video_id", F.lit(True).alias("_live")), "video_id", "left")
    retiring = F.col("_live").isNotNull() & (F.col("lifecycle_state") == "current")
    rest = rest.withColumns({"retired_at": F.when(retiring, at).otherwise(F.col("retired_at")),
                             "lifecycle_state": F.when(retiring, "retired").otherwise(F.col("lifecycle_state"))})
    names = segments.columns
    next_segments = rest.select(*names).unionByName(active.select(*names))

    added = active.select(
        F.concat_ws(":", F.col("id").cast("string"), F.col("revision_number").cast("string"), "analysis_run_id").alias("revision_id"), F.col("id").alias("segment_id"), "revision_number",
        F.when(F.col("_matched"), "reanalysis").otherwise("analysis").alias("revision_kind"), F.lit(True).alias("is_current"), F.col("analysis_run_id").alias("run_id"),
        F.col("_score").alias("match_confidence"), F.col("_reason").alias("match_reason"), machine_digest().alias("payload_digest"), at.alias("created_at"))
    marks = keys.select(F.col("id").alias("segment_id"), F.lit(True).alias("_renewed"))
    closed = revisions.join(marks, "segment_id", "left").withColumn("is_current", F.col("is_current") & F.col("_renewed").isNull())
    next_revisions = closed.select(*revisions.columns).unionByName(added.select(*revisions.columns))

    fresh = added.join(reviews, "segment_id", "left_anti").select("segment_id", F.col("revision_id").alias("reviewed_revision_id"))
    unrated = {"rating": F.lit("unrated"), "review_reason": F.lit(""), "created_at": at, "updated_at": at}
    next_reviews = reviews.unionByName(fresh.withColumns({k: v for k, v in unrated.items() if k in reviews.columns}), allowMissingColumns=True)

    told = outcome.select("video_id", F.col("run_id").alias("_staged"), "outcome", "candidates")
    joined = runs.join(told, "video_id", "left")
    own, done = F.col("run_id") == F.col("_staged"), F.col("outcome") == "completed"
    next_runs = joined.withColumns({
        "state": F.when(own, F.col("outcome")).otherwise(F.col("state")),
        "is_current": F.when(own, done).otherwise(F.col("is_current") & F.coalesce(~done, F.lit(True))),
        "candidate_count": F.when(own & done, F.coalesce("candidates", F.lit(0))).otherwise(F.col("candidate_count")),
        "error_message": F.when(own, F.when(done, "").otherwise(EMPTY_RERUN)).otherwise(F.col("error_message")),
        "completed_at": F.when(own, at).otherwise(F.col("completed_at"))}).select(*runs.columns)
    return dict(zip(TABLES, (next_segments, next_revisions, next_reviews, next_runs)))


# ---- versions ----------------------------------------------------------------------------------------------------
def newest_version(spark: SparkSession, folder: str) -> int:
    """Number of the newest committed version; 0 if there is none."""
    try:
        commits = spark.read.schema("version long").json(f"{folder}/commits")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return commits.agg(F.max("version")).first()[0] or 0


def publish(tables: dict[str, DataFrame], folder: str, base: int) -> int:
    """Write all tables as the version after ``base``, then commit it by a single file; refused if ``base`` is no longer the newest."""
    spark = next(iter(tables.values())).sparkSession
    version = base + 1

    def still_newest() -> None:
        if newest_version(spark, folder) != base:
            raise ValueError(f"version {base} is no longer the newest")

    still_newest()
    for name, frame in tables.items():
        # what an uncommitted attempt left under this number is replaced
        frame.write.mode("overwrite").parquet(f"{folder}/{name}/version-{version}")
    still_newest()
    spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").json(f"{folder}/commits")
    return version


def published(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The tables of the newest committed version."""
    version = newest_version(spark, folder)
    if not version:
        raise ValueError("nothing is published yet")
    return {name: spark.read.parquet(f"{folder}/{name}/version-{version}") for name in names}
