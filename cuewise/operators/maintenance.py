"""Table upkeep: recent lists, retention plans, stage reuse, backfills, exportable clips, pattern appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.tags import canonical_tags
from cuewise.operators.ordering import keyed_index, ordered_index


def recent_plus_active(rows: DataFrame, key: str, active: Column, limit: int = 10) -> DataFrame:
    """Active rows and the newest ``limit`` of every key, active ones first.

    The newest are cut with a rank limit before the shuffle. Active rows are added by an anti-join union.
    """
    newest = Window.partitionBy(key).orderBy(F.col("created_at").desc(), F.col("id").desc())
    recent = rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= limit).drop("_rank")
    running = rows.where(active)
    both = recent.unionByName(running).dropDuplicates([key, "id"])
    return keyed_index(both, [key], [F.when(active, 0).otherwise(1), F.col("created_at").desc(), F.col("id").desc()], out="place")


def retention_plan(files: DataFrame, oldest: float, budget: int) -> DataFrame:
    """What to delete: files up to the age limit, then the oldest ones until the rest fits the budget."""
    alive = F.when(F.col("modified") > oldest, F.col("size")).otherwise(0)
    indexed = ordered_index(files, [F.col("modified").desc(), F.col("path").desc()], {"newer_total": alive})
    action = F.when(F.col("modified") <= oldest, "old").when(F.col("newer_total") > budget, "budget").otherwise("keep")
    return indexed.select(*files.columns, action.alias("action"))


def with_stage_key(inputs: DataFrame, stage: str, parameters: str) -> DataFrame:
    """Key of a stage result: digest of source, stage and parameters."""
    parts = F.struct(F.col("source").alias("source"), F.lit(stage).alias("stage"), F.lit(parameters).alias("parameters"))
    return inputs.withColumn("stage_key", F.sha2(F.to_json(parts), 256))


def pending(keyed: DataFrame, stored: DataFrame) -> DataFrame:
    """Inputs whose stage result does not exist yet."""
    return keyed.join(stored.select("stage_key").distinct(), "stage_key", "left_anti")


def needs_backfill(unknown_below_zero: list[str], unknown_zero: list[str]) -> Column:
    """Rows that miss a feature: negative marks are unknown everywhere, 0 only for the second list."""
    result = F.lit(False)
    for name in unknown_below_zero:
        result = result | (F.coalesce(F.col(name), F.lit(-1)) < 0)
    for name in unknown_zero:
        result = result | (F.coalesce(F.col(name), F.lit(0)) <= 0)
    return result


def exportable(segments: DataFrame, reviews: DataFrame, current: DataFrame, shortest: float = 0.5) -> DataFrame:
    """Accepted clips whose review refers to the current revision and that are long enough."""
    accepted = reviews.where("rating = 'accepted'").select("segment_id", F.col("reviewed_revision_id").alias("revision_id"))
    fresh = accepted.join(current.select("segment_id", "revision_id"), ["segment_id", "revision_id"], "left_semi").select(F.col("segment_id").alias("id"))
    return segments.where(F.col("end_seconds") - F.col("start_seconds") >= shortest).join(fresh, "id", "left_semi")


def append_patterns(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Scored items as pattern examples: duration, tags and three scores."""
    def examples(rows: DataFrame) -> DataFrame:
        return rows.select("pattern_set_id", "id", (F.col("end_seconds") - F.col("start_seconds")).alias("duration_seconds"), canonical_tags(F.col("tags")).alias("tags"),
                           "quality_score", "logical_sense_score", "reading_likelihood")
    return examples(stored).unionByName(examples(added))
