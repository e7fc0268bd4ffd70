"""Shareable benchmark records: export from reviewed revisions without private data, and reading them back."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from cuewise.functions import scores
from cuewise.functions.tags import canonical_tags
from cuewise.functions.text import half_even
from cuewise.operators.benchmark import FEATURE_RANGES, PRIVATE_FIELDS, SCHEMA_VERSION, is_metadata, repeated_ids, with_record_errors
from cuewise.session import cut_lineage
from cuewise.operators.json_walk import named_keys

SCHEMA = """type string, schema_version int, sample_id string, group_id string, moment_group_id string, decision string, rejection_code string, \
analysis_mode string, duration_bucket string, profiles array<string>, predicted_score double, expected_reading boolean, tags array<string>, \
tag_feedback map<string,string>, features map<string,double>"""


def anonymous_id(secret: bytes, namespace: str, value: Column) -> Column:
    """Keyed id that cannot be traced back. The secret travels in the function's closure, never in a query plan."""
    @F.pandas_udf(StringType())
    def keyed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: hmac.new(secret, f"{namespace}:{v}".encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()[:24])
    return keyed(value.cast("string"))


def export_records(scored: DataFrame, tag_feedback: DataFrame, profiles: DataFrame, secret: bytes) -> DataFrame:
    """Benchmark records from scored, reviewed rows.

    ``tag_feedback`` (id, tag, verdict) and ``profiles`` (id, profile) refer to the reviewed revision already.
    """
    # both lists are bounded by the tags and profiles of one segment
    marks = tag_feedback.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("tag", "verdict"))).alias("tag_feedback"))
    names = profiles.groupBy("id").agg(F.array_sort(F.collect_set("profile")).alias("profiles"))
    rows = scored.join(marks, "id", "left").join(names, "id", "left")
    code = F.when(F.col("rating") == "rejected", scores.rejection_code(F.col("review_reason"))).otherwise("")
    rows = rows.withColumn("rejection_code", code)
    about_reading = F.map_values(F.map_filter(F.coalesce("tag_feedback", F.create_map().cast("map<string,string>")), lambda tag, _: F.lower(tag).contains("czyt")))
    expected = (F.when(F.array_contains(about_reading, "correct"), True).when(F.array_contains(about_reading, "incorrect"), False)
                .when(F.col("rejection_code") == "reading_game_text", True))
    group = F.coalesce("duplicate_group", F.lit(""))
    moment = F.when(group != "", group).otherwise(F.concat(F.col("video_id").cast("string"), F.lit(":"), half_even(F.col("start_seconds") / 5).cast("string")))
    features = F.map_from_arrays(F.array(*[F.lit(name) for name in FEATURE_RANGES]), F.array(*[
        F.coalesce(F.col("reading_likelihood" if name == "reading_likelihood" else f"{name}_score").cast("double"), F.lit(float(min(0, low) if name not in ("voice_expression",) else 0)))
        for name, (low, _) in FEATURE_RANGES.items()]))
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), anonymous_id(secret, "segment", F.col("id")).alias("sample_id"),
        anonymous_id(secret, "source", F.col("video_id")).alias("group_id"), anonymous_id(secret, "moment", moment).alias("moment_group_id"),
        F.col("rating").alias("decision"), "rejection_code", F.coalesce("analysis_mode", F.lit("default")).alias("analysis_mode"),
        scores.duration_bucket(F.greatest(F.lit(0.0), F.col("end_seconds") - F.col("start_seconds"))).alias("duration_bucket"),
        F.coalesce("profiles", F.array().cast("array<string>")).alias("profiles"), F.col("ranking_score").cast("double").alias("predicted_score"),
        expected.alias("expected_reading"), canonical_tags(F.col("tags")).alias("tags"),
        F.coalesce("tag_feedback", F.create_map().cast("map<string,string>")).alias("tag_feedback"), features.alias("features"))


def write_records(records: DataFrame, path: str) -> None:
    """JSON Lines of the records; refuses private columns."""
    leaked = sorted(set(records.columns) & set(PRIVATE_FIELDS))
    if leaked:
        raise ValueError(f"private fields must not be exported: {leaked}")
    records.write.mode("overwrite").json(path)


def check_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """(line, record, sample_id, errors, is_metadata) of JSON lines, blank ones skipped: every reason why a record must not be used.

    Lines are numbered in the order of the file parts. Field types are judged on the JSON itself, so a number in quotes or a
    boolean does not pass as a number, and private field names are refused at any depth.
    """
    record = F.try_parse_json(F.col(value))
    numbered = cut_lineage(lines.where(F.trim(F.col(value)) != "").select(F.monotonically_increasing_id().alias("line"), record.alias("record")))
    leaked = named_keys(numbered.where(~is_metadata(F.col("record"))), "line", "record", PRIVATE_FIELDS)
    # at most as many names as there are private fields
    private = leaked.groupBy("line").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("_private"))
    judged = with_record_errors(numbered.join(private, "line", "left"), "record", "_private").drop("_private")
    shaped = judged.select("line", "record", F.try_variant_get("record", "$.sample_id", "string").alias("sample_id"), "errors",
                           is_metadata(F.col("record")).alias("is_metadata"))
    counted = shaped.where(~F.col("is_metadata") & F.col("sample_id").isNotNull())
    repeated = repeated_ids(counted).select("sample_id", F.lit(True).alias("_repeated"))
    return shaped.join(repeated, "sample_id", "left").withColumn("errors", F.when(
        F.col("is_metadata"), F.array().cast("array<string>")).when(F.col("_repeated"), F.array_append("errors", F.lit("duplicate sample_id"))).otherwise(F.col("errors"))).drop("_repeated")


def typed(checked: DataFrame) -> DataFrame:
    """Columns of checked records."""
    fields = [field.split(" ", 1) for field in SCHEMA.replace("\n", " ").split(", ")]
    return checked.select(*[F.try_variant_get("record", f"$.{name}", kind).alias(name) for name, kind in fields if name != "type"])


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metadata lines, valid records and refused records (``line``, ``record`` and ``errors``) of a benchmark file."""
    checked = cut_lineage(check_lines(spark.read.text(path)))
    records = checked.where("NOT is_metadata")
    return (checked.where("is_metadata").select("line", "record"), typed(records.where(F.size("errors") == 0)),
            records.where(F.size("errors") > 0).select("line", "sample_id", "record", "errors"))


def load_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metadata and records of a benchmark file that must be in order as a whole: any refused record, a second metadata line or
    a file without records is an error."""
    metadata, records, refused = read_records(spark, path)
    first = refused.orderBy("line").limit(1).collect()
    if first:
        raise ValueError(f"benchmark record {first[0]['sample_id']}: {'; '.join(first[0]['errors'])}")
    if metadata.limit(2).count() > 1:
        raise ValueError("a benchmark may have one metadata line only")
    if records.isEmpty():
        raise ValueError("a benchmark without records")
    return metadata, records
