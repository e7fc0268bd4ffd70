"""Views that let the given tables stand in for recordings, chats, reviews and audio windows.

Every carrier exists twice: as a DataFrame built for scale, and as a named SQL block (``cte``) for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.operators.ordering import chunked_row_number, chunked_running_sum


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def balanced(frame: DataFrame) -> DataFrame:
    """Spread rows before heavy per-row work, only if the files give fewer splits than there are cores."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


CTE: dict[str, str] = {}
NEEDS: dict[str, tuple] = {}


def cte(*names: str) -> str:
    """``WITH`` clause defining the named views and whatever they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for parent in NEEDS.get(name, ()):
            visit(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ", ".join(f"{name} AS ({CTE[name]})" for name in ordered) + " "


# ---- segments ---------------------------------------------------------------------------------------------------
CTE["seg"] = """
SELECT source AS video_id, doc_id AS id, CAST(20.0*(rn-1) AS DOUBLE) AS start_seconds,
  CAST(20.0*(rn-1) + 6 + (n_chars % 40) AS DOUBLE) AS end_seconds, text AS transcript, lang, n_chars, embedding
FROM (SELECT d.*, e.embedding, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS rn
      FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id) q"""


def segments(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Recordings of overlapping segments: one per document, placed every 20 seconds of its source."""
    documents = chunked_row_number(table(spark, sf_dir, "documents"), ["source"], "doc_id", "rn")
    start = 20.0 * (F.col("rn") - 1)
    columns = [
        F.col("source").alias("video_id"), F.col("doc_id").alias("id"), start.cast("double").alias("start_seconds"),
        (start + 6 + F.col("n_chars") % 40).cast("double").alias("end_seconds"), F.col("text").alias("transcript"),
        "lang", "n_chars",
    ]
    if vectors:
        embeddings = table(spark, sf_dir, "embeddings").select(
            F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        documents = documents.join(embeddings, "doc_id", "left")
        columns.append("embedding")
    return documents.select(*columns)


# deterministic stand-ins for measured scores; plain integer arithmetic, valid in both engines
SCORE_COLUMNS = {
    "quality_score": "CAST(1 + (n_chars * 7) % 99 AS INT)",
    "short_potential_score": "CAST((n_chars * 13) % 101 - 1 AS INT)",
    "logical_sense_score": "CAST((n_chars * 5) % 101 - 1 AS INT)",
    "context_score": "CAST((n_chars * 11) % 101 - 1 AS INT)",
    "self_contained_score": "CAST((n_chars * 3) % 101 - 1 AS INT)",
    "extended_completeness_score": "CAST((n_chars * 17) % 101 - 1 AS INT)",
    "opening_clarity_score": "CAST((n_chars * 19) % 101 - 1 AS INT)",
    "extended_punchline_score": "CAST((n_chars * 23) % 101 - 1 AS INT)",
    "chat_question_match_score": "CAST((n_chars * 29) % 101 - 1 AS INT)",
    "audio_event_score": "CAST(n_chars % 21 AS INT)",
    "game_reaction_score": "CAST((n_chars * 3) % 17 AS INT)",
    "voice_expression_score": "CAST((n_chars * 5) % 33 - 16 AS INT)",
    "vision_score": "CAST((n_chars * 7) % 21 AS INT)",
    "chat_reaction_score": "CAST((n_chars * 11) % 21 AS INT)",
    "chat_joy_score": "CAST((n_chars * 13) % 15 AS INT)",
    "moment_reaction_score": "CAST((n_chars * 3) % 31 AS INT)",
    "chat_message_count": "CAST(n_chars % 30 AS INT)",
    "chat_unique_authors": "CAST(n_chars % 7 AS INT)",
    "reading_likelihood": "CAST((n_chars * 31) % 100 AS DOUBLE) / 100.0",
    "moment_reaction_stage": "CASE WHEN n_chars % 3 = 0 THEN 'game -> voice' WHEN n_chars % 3 = 1 THEN 'game -> voice -> chat' ELSE '' END",
    "duplicate_group": "CASE WHEN id % 4 = 0 THEN '' ELSE concat('repeat-', CAST(id % 7 AS VARCHAR(20))) END",
    "tag_a": "CASE WHEN n_chars % 4 = 0 THEN 'humor' WHEN n_chars % 4 = 1 THEN 'Forma:  Opinia' WHEN n_chars % 4 = 2 THEN 'reading' ELSE 'forma: puenta' END",
    "tag_b": "CASE WHEN id % 5 = 0 THEN 'gniew' WHEN id % 5 = 1 THEN 'reakcja: gra' WHEN id % 5 = 2 THEN 'Humor' WHEN id % 5 = 3 THEN 'forma: pytanie' ELSE 'custom ' || CAST(id % 3 AS VARCHAR(20)) END",
}
CTE["scored"] = "SELECT seg.*, " + ", ".join(f"{expr} AS {name}" for name, expr in SCORE_COLUMNS.items()) + " FROM seg"
NEEDS["scored"] = ("seg",)


def scored(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Segments with stand-in scores and two raw tags."""
    return segments(spark, sf_dir, vectors).selectExpr(
        "*", *[f"{expr} AS {name}" for name, expr in SCORE_COLUMNS.items()])


# canonical form of the two raw tags, spelled out for the checking engine
_CANON = """CASE {c} WHEN 'Forma:  Opinia' THEN 'forma: opinia' WHEN 'reading' THEN 'format: czytanie'
 WHEN 'reakcja: gra' THEN 'reakcja na grę' WHEN 'Humor' THEN 'humor' WHEN 'forma: pytanie' THEN NULL ELSE {c} END"""
CTE["tagged"] = f"""SELECT q.*, CASE WHEN tb IS NULL OR tb = ta THEN [ta] ELSE [ta, tb] END AS tags
FROM (SELECT scored.*, {_CANON.format(c='tag_a')} AS ta, {_CANON.format(c='tag_b')} AS tb FROM scored) q"""
NEEDS["tagged"] = ("scored",)


def tagged(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """Scored segments with their raw tag list."""
    return scored(spark, sf_dir, vectors).withColumn("tags", F.array("tag_a", "tag_b"))


# ---- chat -------------------------------------------------------------------------------------------------------
CTE["msg"] = """
SELECT concat('src', CAST(event_id % 20 AS VARCHAR)) AS video_id,
  CAST(60.0*floor(t/60.0) + (t-60.0*floor(t/60.0))*(t-60.0*floor(t/60.0))/60.0 AS DOUBLE) AS seconds,
  CAST(user_id AS VARCHAR) AS author, event_id,
  CASE event_type WHEN 'purchase' THEN 'haha!!' WHEN 'signup' THEN 'omg' WHEN 'click' THEN 'lol' WHEN 'error' THEN '!cmd'
    ELSE CASE WHEN event_id % 3 = 0 THEN 'is this ok?' ELSE 'ok' END END AS message
FROM (SELECT *, 2.0*floor(event_id/20.0) AS t FROM events) q"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat rows squeezed towards the start of every minute, so that bursts exist."""
    return messages_of(table(spark, sf_dir, "events"))


def messages_of(events: DataFrame) -> DataFrame:
    t = 2.0 * F.floor(F.col("event_id") / 20.0)
    inside = t - 60.0 * F.floor(t / 60.0)
    kind = F.col("event_type")
    text = (F.when(kind == "purchase", "haha!!").when(kind == "signup", "omg").when(kind == "click", "lol")
            .when(kind == "error", "!cmd").when(F.col("event_id") % 3 == 0, "is this ok?").otherwise("ok"))
    return events.select(
        F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("video_id"),
        (60.0 * F.floor(t / 60.0) + inside * inside / 60.0).cast("double").alias("seconds"),
        F.col("user_id").cast("string").alias("author"), "event_id", text.alias("message"))


# ---- reviews ----------------------------------------------------------------------------------------------------
CTE["rev"] = """
SELECT l.doc_id AS segment_id, CASE WHEN l.quality=1 THEN 'accepted' ELSE 'rejected' END AS rating,
  CASE WHEN l.quality=1 THEN '' WHEN l.toxic=1 THEN 'needs context' ELSE 'not interesting' END AS review_reason,
  d.lang AS profile, l.doc_id AS updated_at, d.n_chars
FROM labels l JOIN documents d ON d.doc_id=l.doc_id"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return labels.join(documents, "doc_id").select(
        F.col("doc_id").alias("segment_id"),
        F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("rating"),
        F.when(F.col("quality") == 1, "").when(F.col("toxic") == 1, "needs context").otherwise("not interesting").alias("review_reason"),
        F.col("lang").alias("profile"), F.col("doc_id").alias("updated_at"), "n_chars")


CTE["bench"] = """
SELECT lpad(CAST(l.doc_id AS VARCHAR), 10, '0') AS sample_id, d.source AS group_id,
  CAST(floor(l.doc_id/3.0) AS BIGINT) AS moment_group_id,
  CASE WHEN l.quality=1 THEN 'accepted' ELSE 'rejected' END AS decision,
  CASE WHEN l.quality=1 THEN '' WHEN l.toxic=1 THEN 'needs_context' ELSE 'not_interesting' END AS rejection_code,
  CAST(1 + d.n_chars % 99 AS DOUBLE) AS predicted_score, l.toxic=1 AS expected_reading,
  (d.n_chars % 100)/CAST(100 AS DOUBLE) AS reading_likelihood, l.doc_id
FROM labels l JOIN documents d ON d.doc_id=l.doc_id"""


def bench_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, documents = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    accepted = F.col("quality") == 1
    return labels.join(documents, "doc_id").select(
        F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("sample_id"), F.col("source").alias("group_id"),
        F.floor(F.col("doc_id") / 3.0).alias("moment_group_id"),
        F.when(accepted, "accepted").otherwise("rejected").alias("decision"),
        F.when(accepted, "").when(F.col("toxic") == 1, "needs_context").otherwise("not_interesting").alias("rejection_code"),
        (1 + F.col("n_chars") % 99).cast("double").alias("predicted_score"), (F.col("toxic") == 1).alias("expected_reading"),
        ((F.col("n_chars") % 100) / 100.0).alias("reading_likelihood"), "doc_id")


# ---- transcript parts, audio windows, jobs, files ------------------------------------------------------------------
CTE["parts"] = """
SELECT video_id, turn, text, cum-len AS start_seconds, cum AS end_seconds FROM (
  SELECT conv_id AS video_id, turn, text, floor(greatest(1.0, length(text)/15.0)) AS len,
    sum(floor(greatest(1.0, length(text)/15.0))) OVER (PARTITION BY conv_id ORDER BY turn) AS cum FROM conversations) q"""


def transcript_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations read as recordings: every turn is a part whose length follows its text."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), "turn", "text",
        F.floor(F.greatest(F.lit(1.0), F.length("text") / 15.0)).cast("double").alias("len"))
    timed = chunked_running_sum(rows, ["video_id"], "turn", "len", "cum", width=4096)
    return timed.select("video_id", "turn", "text", (F.col("cum") - F.col("len")).alias("start_seconds"),
                        F.col("cum").alias("end_seconds"))


CTE["energy"] = """
SELECT concat('src', CAST(event_id % 20 AS VARCHAR)) AS video_id, CAST(floor(event_id/20.0) AS BIGINT) AS idx,
  value AS game, coalesce(lead(value) OVER (PARTITION BY event_id % 20 ORDER BY event_id), 0.0) AS mic FROM events"""


def audio_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-second windows of two tracks; the microphone track is the game track one window later."""
    events = table(spark, sf_dir, "events").select("event_id", "value")
    following = events.select((F.col("event_id") - 20).alias("event_id"), F.col("value").alias("mic"))
    return events.join(following, "event_id", "left").select(
        F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("video_id"),
        F.floor(F.col("event_id") / 20.0).alias("idx"), F.col("value").alias("game"),
        F.coalesce("mic", F.lit(0.0)).alias("mic"))


CTE["jobs"] = "SELECT o_custkey AS video_id, o_orderdate AS created_at, o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("video_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
