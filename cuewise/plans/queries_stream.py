"""Live jobs run over the given tables until all input is read; their output is compared with a batch statement."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.operators.candidates import numbered_parts
from cuewise.plans import carriers
from cuewise.plans.carriers import cte
from cuewise.plans.queries_ingest import _NORMAL, _json_items_of
from cuewise.plans.queries_time import CTE  # noqa: F401  (its views are used here)
from cuewise.plans.registry import ORACLES, query
from cuewise.session import cut_lineage, ensure_checkpoint_dir
from cuewise.sources.delta_table import DeltaTable
from cuewise.streaming import jobs

DAY = "2024-01-01 00:00:00"


def _work_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def live_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table read as a file stream, whether it is one file or a folder of files.

    The pattern matches the table's own path alone; without a pattern the stream source refuses a path that is a file.
    """
    schema = carriers.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def run_to_table(stream: DataFrame) -> DataFrame:
    """Run a stream over everything available and read back the table it wrote."""
    spark, folder = stream.sparkSession, _work_folder(stream.sparkSession)
    running = (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
               .outputMode("append").trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def started():
    return F.lit(DAY).cast("timestamp")


def live_messages(spark, sf_dir) -> DataFrame:
    rows = carriers.messages_of(live_table(spark, sf_dir, "events"))
    return rows.withColumn("event_time", jobs.event_time(started(), F.col("seconds")))


@query("stream_chat_ingest", f"SELECT video_id, seconds, author, message FROM ({_NORMAL}) q")
def stream_chat_ingest(spark, sf_dir):
    lines = _json_items_of(live_table(spark, sf_dir, "events")).drop("event_id")
    return run_to_table(jobs.live_messages(lines, started()).select("video_id", "seconds", "author", "message"))


@query("stream_chat_redelivery", f"SELECT video_id, seconds, author, message FROM ({_NORMAL}) q UNION ALL SELECT video_id, seconds, author, message FROM ({_NORMAL}) q WHERE event_id % 16 = 0")
def stream_chat_redelivery(spark, sf_dir):
    """Each recording's log is delivered half, then whole, then whole again; some of its lines stand in it twice."""
    folder = _work_folder(spark)
    lines = _json_items_of(carriers.table(spark, sf_dir, "events"))
    text = F.when(F.col("event_id") % 16 == 0, F.concat("line", F.lit("\n\n"), "line")).otherwise(F.col("line"))
    half = carriers.table(spark, sf_dir, "events").agg(F.max("event_id") / 2).first()[0] or 0
    for k, part in enumerate((lines.where(F.col("event_id") <= half), lines, lines)):
        part.select("video_id", "event_id", text.alias("value")).repartition("video_id").sortWithinPartitions("video_id", "event_id").select(
            "video_id", "value").write.partitionBy("video_id").text(f"{folder}/in/delivery{k}")
    name = F.regexp_extract("_metadata.file_path", "video_id=([^/]+)", 1)
    messages = jobs.delivered_messages(spark, f"{folder}/in/*/*", started(), "3 hours", name, name)
    return run_to_table(messages.select("video_id", "seconds", "author", "message"))


@query("stream_chat_activity", cte("flag") + """, m AS (SELECT *, CAST(round(seconds * 1000000) AS BIGINT) AS us, NOT alert AND (expressive OR joy) AS reactive FROM flag),
  w AS (SELECT m.*, 6 * (CAST(floor(us / 6000000.0) AS BIGINT) - k.k) AS ws FROM m, (SELECT unnest([0, 1, 2]) AS k) k)
  SELECT video_id, ws AS window_start, count(*) AS messages, count(*) FILTER (reactive) AS reactive FROM w WHERE (ws + 18) * 1000000 <= (SELECT max(us) FROM m) - 120000000 GROUP BY 1, 2""")
def stream_chat_activity(spark, sf_dir):
    out = run_to_table(jobs.chat_activity(live_messages(spark, sf_dir)))
    start = (F.unix_seconds("window.start") - F.unix_seconds(started())).alias("window_start")
    return out.select("video_id", start, "messages", "reactive")


@query("stream_chat_reaction", cte("seg", "msg") + """SELECT s.id, count(*) AS messages, count(DISTINCT m.author) AS people FROM (SELECT video_id, doc_id AS id, 20.0 * (doc_id % 50) AS s, 20.0 * (doc_id % 50) + 6 + n_chars % 40 AS e FROM (SELECT source AS video_id, doc_id, n_chars FROM documents) d) s
  JOIN msg m ON m.video_id = s.video_id AND m.seconds BETWEEN s.s + (s.e - s.s) / 2 + 6 AND s.e + 24 GROUP BY 1""")
def stream_chat_reaction(spark, sf_dir):
    i, n = F.col("doc_id"), F.col("n_chars")
    begin = 20.0 * (i % 50)
    end = begin + 6 + n % 40
    segments = live_table(spark, sf_dir, "documents").select(
        F.col("source").alias("video_id"), i.alias("id"), jobs.event_time(started(), (begin + end) / 2).alias("middle_time"), jobs.event_time(started(), end).alias("end_time"))
    pairs = run_to_table(jobs.delayed_reactions(segments, live_messages(spark, sf_dir), 6.0))
    return pairs.groupBy("id").agg(F.count("*").alias("messages"), F.count_distinct("author").alias("people"))


@query("stream_packing", ORACLES["pack_candidates"])
def stream_packing(spark, sf_dir):
    """Parts of all recordings come in any order, in eight deliveries of eight files; a last one lets the watermark pass them all."""
    folder, deliveries, files = _work_folder(spark), 8, 8
    parts = carriers.transcript_parts(spark, sf_dir).select(F.col("video_id").cast("string").alias("video_id"), F.col("turn").alias("position"), "start_seconds", "end_seconds")
    timed = cut_lineage(numbered_parts(parts.withColumnRenamed("position", "turn"), "turn").drop("turn").withColumn("event_time", jobs.event_time(started(), F.col("end_seconds"))))
    span = timed.agg(F.max("end_seconds")).first()[0] or 0.0
    closing = timed.sparkSession.createDataFrame([("", 0, 0.0, 0.0)], "video_id string, position bigint, start_seconds double, end_seconds double").withColumn(
        "event_time", jobs.event_time(started(), F.lit(3.0 * span + 1000)))
    timed.repartition(deliveries * files, "video_id", "position").write.mode("append").parquet(f"{folder}/in")
    closing.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    found = run_to_table(jobs.pack_live(stream, watermark=f"{int(span) + 1} seconds"))
    return found.select(F.col("video_id").cast(dict(carriers.transcript_parts(spark, sf_dir).dtypes)["video_id"]).alias("video_id"), "first", "last", "start_seconds", "end_seconds")


_REVIEW_EVENTS = "SELECT event_id, user_id AS segment_id, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'unrated' ELSE 'rejected' END AS rating, CASE WHEN event_id % 2 = 0 THEN 'general' ELSE 'games' END AS profile FROM events WHERE user_id IN (SELECT doc_id FROM documents)"


def _live_reviews(spark, sf_dir) -> tuple[DeltaTable, DeltaTable]:
    """Review events in six deliveries of eight files, in no order of time and the second one twice, written to tables that are compacted on the way."""
    # every batch reads the revisions, which are therefore made once
    current = cut_lineage(carriers.segments(spark, sf_dir).select(
        F.col("id").alias("segment_id"), F.lit(1).alias("revision_number"), F.concat(F.col("id").cast("string"), F.lit("-1")).alias("revision_id"), "embedding", F.lit(1.0).alias("features")))
    none = current.limit(0)
    reviews = none.select("segment_id", F.lit("").alias("rating"), F.lit("").alias("review_reason"), F.lit("").alias("reviewed_revision_id"), F.lit(0).cast("bigint").alias("updated_at"))
    snapshots = none.select("segment_id", F.lit("").alias("profile"), F.lit("").alias("decision"), F.lit("").alias("review_reason"), "embedding", "features", F.lit(1).alias("reviewed_revision_number"), F.lit(0).cast("bigint").alias("updated_at"))
    kind, folder, deliveries, files = F.col("event_type"), _work_folder(spark), 6, 8
    events = carriers.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("segment_id"), F.col("event_id").alias("updated_at"), F.when(F.col("event_id") % 2 == 0, " General").otherwise("games").alias("profile"),
        F.when(kind == "purchase", "Accepted").when(kind == "error", "unrated").otherwise("rejected").alias("rating"), F.lit("too long").alias("review_reason"))
    for k in [*range(deliveries), 1]:
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(deliveries)) == k).repartition(files).write.mode("append").parquet(f"{folder}/in")
    tables = jobs.review_tables(folder, reviews, snapshots, buckets=8)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    running = (stream.writeStream.foreachBatch(jobs.review_sink(tables, current, compact_every=3)).option("checkpointLocation", f"{folder}/state")
               .trigger(availableNow=True).start())
    running.awaitTermination()
    return tables


@query("stream_review_upsert", f"SELECT segment_id, arg_max(rating, event_id) AS rating FROM ({_REVIEW_EVENTS}) ev GROUP BY 1")
def stream_review_upsert(spark, sf_dir):
    return _live_reviews(spark, sf_dir)[0].read().select("segment_id", "rating")


@query("stream_review_snapshots", f"""SELECT segment_id, profile, arg_max(rating, event_id) AS decision, max(event_id) AS updated_at FROM ({_REVIEW_EVENTS}) ev
  WHERE segment_id IN (SELECT vec_id FROM embeddings) GROUP BY 1, 2 HAVING arg_max(rating, event_id) <> 'unrated'""")
def stream_review_snapshots(spark, sf_dir):
    return _live_reviews(spark, sf_dir)[1].read().select("segment_id", "profile", "decision", "updated_at")
