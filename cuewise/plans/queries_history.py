"""Queries over history, feedback, collections and table upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from cuewise.operators import activation, feedback, history, maintenance
from cuewise.plans import carriers
from cuewise.plans.carriers import CTE, NEEDS, cte
from cuewise.plans.registry import query
from cuewise.schemas import project_segments
from cuewise.sources import file_samples

# ---- matching ---------------------------------------------------------------------------------------------------------
CTE["seg_new"] = "SELECT video_id, id + 1000000000 AS id, start_seconds + id % 5 AS start_seconds, end_seconds + id % 5 AS end_seconds, transcript FROM seg WHERE id % 7 <> 3"
NEEDS["seg_new"] = ("seg",)
CTE["near"] = r"""
SELECT o.video_id, o.id AS previous_id, n.id AS new_id, o.start_seconds AS s1, o.end_seconds AS e1, n.start_seconds AS s2, n.end_seconds AS e2, o.transcript AS t1, n.transcript AS t2,
  abs((o.start_seconds + o.end_seconds) / 2 - (n.start_seconds + n.end_seconds) / 2) AS apart FROM seg o JOIN seg_new n ON n.video_id = o.video_id
  AND abs((o.start_seconds + o.end_seconds) / 2 - (n.start_seconds + n.end_seconds) / 2) <= 8"""
NEEDS["near"] = ("seg", "seg_new")
CTE["sig"] = """
SELECT *, iov / uni AS iou, least(1.0::DOUBLE, iov / greatest(0.25::DOUBLE, e1 - s1)) AS c1, least(1.0::DOUBLE, iov / greatest(0.25::DOUBLE, e2 - s2)) AS c2, least(e1 - s1, e2 - s2) / greatest(e1 - s1, e2 - s2) AS ratio,
  greatest(0.0::DOUBLE, 1 - apart / least(8.0::DOUBLE, greatest(3.0::DOUBLE, greatest(e1 - s1, e2 - s2) * 0.45::DOUBLE))) AS prox
FROM (SELECT *, greatest(0.0::DOUBLE, least(e1, e2) - greatest(s1, s2)) AS iov, greatest(e1, e2) - least(s1, s2) AS uni FROM near) q"""
NEEDS["sig"] = ("near",)
_FORM = r"list_distinct(list_filter(string_split(trim(regexp_replace(replace(strip_accents(lower({t})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> ''))"
CTE["jac"] = f"SELECT previous_id, new_id, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0::DOUBLE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) END AS jaccard FROM (SELECT previous_id, new_id, {_FORM.format(t='t1')} AS a, {_FORM.format(t='t2')} AS b FROM near) q"
NEEDS["jac"] = ("near",)


def rerun(spark, sf_dir) -> DataFrame:
    """A second analysis of the same recordings: shifted, with some moments missing."""
    return carriers.segments(spark, sf_dir, False).where("id % 7 <> 3").select(
        "video_id", (F.col("id") + 1000000000).alias("id"), (F.col("start_seconds") + F.col("id") % 5).alias("start_seconds"),
        (F.col("end_seconds") + F.col("id") % 5).alias("end_seconds"), "transcript")


@query("moment_candidates", cte("near") + "SELECT previous_id, new_id, apart AS midpoint_distance FROM near")
def moment_candidates(spark, sf_dir):
    pairs = history.midpoint_pairs(carriers.segments(spark, sf_dir, False), rerun(spark, sf_dir))
    apart = F.abs((F.col("previous_start") + F.col("previous_end")) / 2 - (F.col("new_start") + F.col("new_end")) / 2)
    return pairs.select("previous_id", "new_id", apart.alias("midpoint_distance"))


@query("interval_signals", cte("sig") + "SELECT previous_id, new_id, iov AS overlap_seconds, round(iou, 9) AS iou, round(c1, 9) AS previous_coverage, round(c2, 9) AS new_coverage, round(ratio, 9) AS duration_ratio, round(prox, 9) AS midpoint_proximity FROM sig")
def interval_signals(spark, sf_dir):
    rows = history.time_signals(carriers.segments(spark, sf_dir, False), rerun(spark, sf_dir))
    return rows.select("previous_id", "new_id", "overlap_seconds", *[F.round(name, 9).alias(name) for name in ("iou", "previous_coverage", "new_coverage", "duration_ratio", "midpoint_proximity")])


@query("token_jaccard", cte("jac") + "SELECT previous_id, new_id, round(jaccard, 9) AS token_jaccard FROM jac")
def token_jaccard(spark, sf_dir):
    rows = history.time_signals(carriers.segments(spark, sf_dir, False), rerun(spark, sf_dir))
    return rows.select("previous_id", "new_id", F.round("token_jaccard", 9).alias("token_jaccard"))


_SAME = """, same AS (SELECT *, round_even(iou * 0.20::DOUBLE + c1 * 0.11::DOUBLE + c2 * 0.11::DOUBLE + ratio * 0.10::DOUBLE + prox * 0.10::DOUBLE + 0.25::DOUBLE + 0.13::DOUBLE, 6) AS score, least(c1, c2) AS cov FROM sig WHERE new_id = previous_id + 1000000000),
  fit AS (SELECT * FROM same WHERE (iou >= 0.24 OR cov >= 0.42) AND (score >= 0.64 OR cov >= 0.30))"""


@query("match_scores", cte("sig") + _SAME + "SELECT previous_id, new_id, round(score, 5) AS score FROM fit")
def match_scores(spark, sf_dir):
    pairs = history.accepted_matches(carriers.segments(spark, sf_dir, False), rerun(spark, sf_dir))
    return pairs.where(F.col("new_id") == F.col("previous_id") + 1000000000).select("previous_id", "new_id", F.round("score", 5).alias("score"))


@query("match_classes", cte("sig") + _SAME + """SELECT previous_id, new_id, CASE WHEN score >= 0.76 THEN 'high' ELSE 'medium' END AS confidence,
  CASE WHEN score >= 0.76 THEN 'high: strong temporal and transcript agreement' WHEN score >= 0.64 THEN 'medium: boundary drift with supporting transcript' ELSE 'medium: strong transcript with partial overlap' END AS reason FROM fit""")
def match_classes(spark, sf_dir):
    pairs = history.accepted_matches(carriers.segments(spark, sf_dir, False), rerun(spark, sf_dir))
    return pairs.where(F.col("new_id") == F.col("previous_id") + 1000000000).select("previous_id", "new_id", "confidence", "reason")


@query("match_moments")
def match_moments(spark, sf_dir):
    matches = history.match_moments(carriers.segments(spark, sf_dir, False), rerun(spark, sf_dir))
    return matches.select("video_id", "previous_id", "new_id", "score", "confidence", "reason")


@query("persist_run")
def persist_run(spark, sf_dir):
    rows = carriers.segments(spark, sf_dir, False).withColumns({
        "revision_number": (1 + F.col("id") % 3).cast("int"), "lifecycle_state": F.when(F.col("id") % 9 == 4, "retired").otherwise("current"), "analysis_run_id": F.lit("run-1")})
    evidence = carriers.reviews(spark, sf_dir).select(F.col("segment_id").alias("id"))
    active = history.activate_run(rows.where("lifecycle_state = 'current'"), rows.where("lifecycle_state = 'retired'"), rerun(spark, sf_dir), "run-2", evidence)
    return active.select("video_id", "id", "revision_number", "lifecycle_state", "analysis_run_id", "change")


@query("activation_commit")
def activation_commit(spark, sf_dir):
    """Every recording is analysed anew, but about a third of the runs find nothing: all four tables afterwards, one row per key."""
    at = F.timestamp_seconds(F.lit(1700000000))
    rows = carriers.segments(spark, sf_dir, False)
    state = {"revision_number": (1 + F.col("id") % 3).cast("int"), "lifecycle_state": F.when(F.col("id") % 9 == 4, "retired").otherwise("current"),
             "analysis_run_id": F.concat_ws("-", "video_id", F.lit("run-1")), "retired_at": F.lit(None).cast("timestamp"), "created_at": at}
    segments = project_segments(rows).withColumns(state)
    revisions = segments.select(
        F.concat_ws(":", F.col("id").cast("string"), F.col("revision_number").cast("string")).alias("revision_id"), F.col("id").alias("segment_id"), "revision_number",
        F.lit("analysis").alias("revision_kind"), F.lit(True).alias("is_current"), F.col("analysis_run_id").alias("run_id"), F.lit(None).cast("double").alias("match_confidence"),
        F.lit("").alias("match_reason"), activation.machine_digest().alias("payload_digest"), "created_at")
    reviews = carriers.reviews(spark, sf_dir).select("segment_id", F.lit(None).cast("string").alias("reviewed_revision_id"), "rating", F.lit("").alias("review_reason"),
                                                     at.alias("created_at"), at.alias("updated_at"))
    ended = rows.select("video_id").distinct()
    parent = F.concat_ws("-", "video_id", F.lit("run-1"))
    runs = ended.select("video_id", parent.alias("run_id"), F.lit(None).cast("string").alias("parent_run_id"), F.lit("completed").alias("state"), F.lit(True).alias("is_current"),
                        F.lit(0).cast("long").alias("candidate_count"), F.lit("").alias("error_message"), at.alias("completed_at"))
    staged = ended.select("video_id", F.concat_ws("-", "video_id", F.lit("run-2")).alias("run_id"))
    runs = runs.unionByName(staged.select("video_id", "run_id", parent.alias("parent_run_id"), F.lit("running").alias("state"), F.lit(False).alias("is_current"),
                                          F.lit(0).cast("long").alias("candidate_count"), F.lit("").alias("error_message"), F.lit(None).cast("timestamp").alias("completed_at")))
    records = rerun(spark, sf_dir).where(F.crc32(F.col("video_id").cast("binary")) % 3 != 0)
    after = activation.activate(dict(zip(activation.TABLES, (segments, revisions, reviews, runs))), staged, records, at)
    shown = [
        after["segments"].select(F.lit("segments").alias("table_name"), F.col("id").cast("string").alias("key"), F.col("revision_number").cast("long").alias("number"), F.col("lifecycle_state").alias("state")),
        after["revisions"].select(F.lit("revisions"), F.concat_ws("/", F.col("segment_id").cast("string"), "revision_id"), F.col("revision_number").cast("long"), F.concat_ws(":", "revision_kind", F.col("is_current").cast("string"))),
        after["reviews"].select(F.lit("reviews"), F.col("segment_id").cast("string"), F.lit(None).cast("long"), "rating"),
        after["runs"].select(F.lit("runs"), "run_id", "candidate_count", "state")]
    result = shown[0]
    for part in shown[1:]:
        result = result.union(part)
    return result


# ---- revisions: orders of a customer stand in for the revisions of a segment --------------------------------------------
CTE["hist"] = "SELECT o_custkey AS segment_id, o_orderkey AS event_id, o_orderdate AS created_at, o_totalprice AS quality_score, o_orderstatus AS revision_kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision_number, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current FROM orders"


def revisions(spark, sf_dir) -> DataFrame:
    events = carriers.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("segment_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("quality_score"), F.col("o_orderstatus").alias("revision_kind"))
    return history.revision_history(events)


@query("revision_history", cte("hist") + "SELECT segment_id, event_id, revision_number, is_current FROM hist")
def revision_history(spark, sf_dir):
    return revisions(spark, sf_dir).select("segment_id", "event_id", F.col("revision_number").cast("bigint").alias("revision_number"), "is_current")


@query("revision_sync", cte("hist") + """, u AS (SELECT segment_id, CASE WHEN segment_id % 4 = 0 THEN revision_number - 1 ELSE revision_number END AS revision_number FROM hist WHERE is_current AND segment_id % 2 = 0)
  SELECT h.segment_id, h.revision_number, CASE WHEN h.is_current AND u.revision_number = h.revision_number THEN -1.0::DOUBLE ELSE h.quality_score END AS quality_score, false AS rejected FROM hist h LEFT JOIN u ON u.segment_id = h.segment_id
  UNION ALL SELECT segment_id, revision_number, -1.0::DOUBLE, true FROM u WHERE segment_id % 4 = 0""")
def revision_sync(spark, sf_dir):
    rows = revisions(spark, sf_dir).withColumn("revision_number", F.col("revision_number").cast("bigint"))
    updates = rows.where("is_current AND segment_id % 2 = 0").select("segment_id", (F.col("revision_number") - F.when(F.col("segment_id") % 4 == 0, 1).otherwise(0)).alias("revision_number"), F.lit(-1.0).alias("quality_score"))
    synced, rejected = history.sync_revisions(rows, updates, ["quality_score"])
    shown = ["segment_id", "revision_number", "quality_score"]
    return synced.select(*shown, F.lit(False).alias("rejected")).unionByName(rejected.select(*shown, F.lit(True).alias("rejected")))


@query("manual_edit", cte("hist") + """SELECT segment_id, revision_number, revision_kind, quality_score, is_current AND segment_id % 5 <> 2 AS is_current FROM hist
  UNION ALL SELECT segment_id, revision_number + 1, 'manual_text', segment_id::DOUBLE, true FROM hist WHERE is_current AND segment_id % 5 = 2""")
def manual_edit(spark, sf_dir):
    rows = revisions(spark, sf_dir).withColumn("revision_number", F.col("revision_number").cast("bigint"))
    edits = rows.where("is_current AND segment_id % 5 = 2").select("segment_id", F.lit("manual_text").alias("kind"), F.col("segment_id").cast("double").alias("quality_score"))
    return history.manual_edits(rows, edits, ["quality_score"]).select("segment_id", "revision_number", "revision_kind", "quality_score", "is_current")


CTE["runs0"] = "SELECT o_custkey AS video_id, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS is_current FROM orders"


def _runs(spark, sf_dir) -> DataFrame:
    events = carriers.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("segment_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderkey").alias("created_at"), "o_orderstatus")
    return history.revision_history(events).select(F.col("segment_id").alias("video_id"), F.col("event_id").alias("run_id"), F.col("revision_number").alias("sequence"), "o_orderstatus", "is_current")


@query("next_run_sequence", cte("runs0") + "SELECT c_custkey AS video_id, CAST(coalesce(max(sequence), 0) + 1 AS BIGINT) AS sequence, max(run_id) FILTER (is_current) AS parent_run_id FROM customer LEFT JOIN runs0 ON video_id = c_custkey GROUP BY 1")
def next_run_sequence(spark, sf_dir):
    requests = carriers.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"))
    return history.next_run_sequence(requests, _runs(spark, sf_dir)).select("video_id", F.col("sequence").cast("bigint").alias("sequence"), "parent_run_id")


@query("run_state_update", cte("runs0") + """SELECT run_id, CASE WHEN o_orderstatus = 'P' AND run_id % 3 = 0 THEN 'failed' WHEN o_orderstatus = 'P' THEN 'running' ELSE 'completed' END AS state,
  CASE WHEN o_orderstatus = 'P' AND run_id % 3 = 0 THEN 'stopped' WHEN run_id % 7 = 0 THEN 'earlier' ELSE '' END AS error_message, is_current AND NOT (o_orderstatus = 'P' AND run_id % 3 = 0) AS is_current FROM runs0""")
def run_state_update(spark, sf_dir):
    runs = _runs(spark, sf_dir).withColumns({"state": F.when(F.col("o_orderstatus") == "P", "running").otherwise("completed"),
                                             "error_message": F.when(F.col("run_id") % 7 == 0, "earlier").otherwise("")})
    failures = carriers.table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("run_id"), F.lit("stopped").alias("message"))
    return history.update_run_state(runs, failures).select("run_id", "state", "error_message", "is_current")


# ---- evidence -----------------------------------------------------------------------------------------------------------
@query("human_data_flag", cte("rev") + "SELECT segment_id, rating = 'accepted' OR review_reason = 'needs context' OR n_chars % 10 = 0 AS human FROM rev")
def human_data_flag(spark, sf_dir):
    rows = carriers.reviews(spark, sf_dir).withColumns({
        "rating": F.when(F.col("rating") == "rejected", "Unrated ").otherwise(F.col("rating")), "review_reason": F.when(F.col("review_reason") == "needs context", "x").otherwise(" "),
        "caption_edited": F.col("n_chars") % 10 == 0})
    return rows.select("segment_id", history.has_human_data(rows).alias("human"))


@query("evidence_flags", cte("seg") + """SELECT id, id IN (SELECT doc_id FROM labels) AS has_tag_review, id IN (SELECT vec_id FROM embeddings WHERE label % 3 = 0) AS has_collection_example,
  id IN (SELECT user_id FROM events) AS has_preference_feedback, id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS has_manual_revision FROM seg""")
def evidence_flags(spark, sf_dir):
    read = lambda name: carriers.table(spark, sf_dir, name)
    sources = {
        "has_tag_review": read("labels").select(F.col("doc_id").alias("segment_id")),
        "has_collection_example": read("embeddings").where("label % 3 = 0").select(F.col("vec_id").alias("segment_id")),
        "has_preference_feedback": read("events").select(F.col("user_id").alias("segment_id")),
        "has_manual_revision": read("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("segment_id")),
    }
    return history.evidence_flags(carriers.segments(spark, sf_dir, False).select("id"), sources)


@query("segments_with_evidence", cte("tagged", "rev") + """SELECT id FROM tagged WHERE quality_score > 95 OR id IN (SELECT segment_id FROM rev WHERE rating = 'rejected') OR id IN (SELECT vec_id FROM embeddings WHERE label = 1)""")
def segments_with_evidence(spark, sf_dir):
    rejected = carriers.reviews(spark, sf_dir).where("rating = 'rejected'").select("segment_id")
    examples = carriers.table(spark, sf_dir, "embeddings").where("label = 1").select(F.col("vec_id").alias("segment_id"))
    return history.segments_with_evidence(carriers.scored(spark, sf_dir, False), F.col("quality_score") > 95, [rejected, examples]).select("id")


@query("evidence_revision_pick", cte("hist") + """SELECT segment_id, priority, revision_id FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY priority, recency DESC, revision_id) AS rn FROM (
  SELECT segment_id, CASE revision_kind WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS priority, revision_number AS recency, event_id AS revision_id FROM hist) q) z WHERE rn = 1""")
def evidence_revision_pick(spark, sf_dir):
    kind = F.col("revision_kind")
    candidates = revisions(spark, sf_dir).select("segment_id", F.when(kind == "F", 1).when(kind == "O", 2).otherwise(3).alias("priority"), F.col("revision_number").alias("recency"), F.col("event_id").alias("revision_id"))
    return history.pick_revision(candidates)


CTE["stale"] = """SELECT r.segment_id AS id, r.segment_id % 3 <> 0 AND (r.rating <> 'unrated') AS review_stale, r.rating FROM (SELECT segment_id, CASE WHEN segment_id % 5 = 0 THEN 'unrated' ELSE rating END AS rating FROM rev) r"""
NEEDS["stale"] = ("rev",)


def _bound_reviews(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Reviews bound to revision 1, and current revisions of which every third is still revision 1."""
    i = F.col("segment_id")
    rows = carriers.reviews(spark, sf_dir).select(
        "segment_id", F.when(i % 5 == 0, "unrated").otherwise(F.col("rating")).alias("rating"), "review_reason",
        F.concat(i.cast("string"), F.lit("-1")).alias("reviewed_revision_id"), F.lit(False).alias("censor_profanity"), F.lit(False).alias("remove_pauses"), F.lit("").alias("archive_audio_path"))
    current = carriers.reviews(spark, sf_dir).select("segment_id", F.concat(i.cast("string"), F.when(i % 3 == 0, "-1").otherwise("-2")).alias("revision_id"))
    return rows, current


@query("stale_reviews", cte("stale") + "SELECT id, review_stale FROM stale")
def stale_reviews(spark, sf_dir):
    rows, current = _bound_reviews(spark, sf_dir)
    joined = rows.join(current.withColumnRenamed("revision_id", "current_revision_id"), "segment_id")
    return joined.select(F.col("segment_id").alias("id"), history.stale_review().alias("review_stale"))


@query("serialize_segments", cte("seg", "stale") + """SELECT s.id, coalesce(r.rating, '') AS rating, coalesce(r.review_stale, false) AS review_stale, CASE WHEN r.id IS NULL THEN '' WHEN s.id % 2 = 0 THEN 'format: czytanie=correct' ELSE 'humor=incorrect' END AS tag_feedback FROM seg s LEFT JOIN stale r ON r.id = s.id""")
def serialize_segments(spark, sf_dir):
    rows, current = _bound_reviews(spark, sf_dir)
    even = F.col("segment_id") % 2 == 0
    verdicts = rows.select("segment_id", F.when(even, "Reading").otherwise("HUMOR").alias("tag"), F.when(even, "correct").otherwise("incorrect").alias("verdict"))
    served = history.serialize_segments(carriers.segments(spark, sf_dir), rows, verdicts, current)
    shown = F.array_join(F.transform(F.map_entries("tag_feedback"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return served.select("id", F.coalesce("rating", F.lit("")).alias("rating"), "review_stale", F.coalesce(shown, F.lit("")).alias("tag_feedback"))


@query("exportable_segments", cte("seg", "rev") + "SELECT id FROM seg JOIN rev ON segment_id = id WHERE rating = 'accepted' AND id % 3 = 0 AND id % 5 <> 0 AND end_seconds - start_seconds >= 0.5")
def exportable_segments(spark, sf_dir):
    rows, current = _bound_reviews(spark, sf_dir)
    return maintenance.exportable(carriers.segments(spark, sf_dir, False), rows, current).select("id")


@query("current_tag_verdicts", """SELECT user_id AS segment_id, event_type AS tag, arg_max(CASE WHEN value > 20 THEN 'correct' ELSE 'incorrect' END, event_id) AS verdict FROM events WHERE event_id % 3 = user_id % 3 GROUP BY 1, 2""")
def current_tag_verdicts(spark, sf_dir):
    events = carriers.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("segment_id"), F.col("event_type").alias("tag"), (F.col("event_id") % 3).alias("reviewed_revision_id"),
        F.when(F.col("value") > 20, "correct").otherwise("incorrect").alias("verdict"), F.col("event_id").alias("updated_at"))
    current = events.select("segment_id").distinct().withColumn("revision_id", F.col("segment_id") % 3)
    return history.current_tag_verdicts(events, current)


@query("latest_per_key", cte("jobs") + "SELECT c_custkey AS video_id, id, status FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS rn FROM jobs) j ON j.video_id = c_custkey AND rn = 1")
def latest_per_key(spark, sf_dir):
    videos = carriers.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("video_id"))
    return history.latest_per_key(videos, carriers.jobs(spark, sf_dir), "video_id").select("video_id", "id", "status")


@query("orphan_quarantine", """SELECT sha256('chat_messages:' || p) AS id, 'chat_messages' AS source_table, p AS payload_json FROM (
  SELECT '{"author":"' || event_type || '","seconds":' || event_id || ',"user_id":' || user_id || '}' AS p FROM events WHERE user_id NOT IN (SELECT doc_id FROM labels)) q""")
def orphan_quarantine(spark, sf_dir):
    rows = carriers.table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seconds"), F.col("event_type").alias("author"))
    parents = carriers.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"))
    return history.quarantine_orphans(rows, parents, "user_id", "chat_messages")[1]


# ---- keyed updates --------------------------------------------------------------------------------------------------------
def _events(spark, sf_dir, condition: str) -> DataFrame:
    return carriers.table(spark, sf_dir, "events").where(condition).select(F.col("user_id").alias("segment_id"), "event_id", F.col("event_type").alias("rating"), "value")


def _latest(spark, sf_dir, condition: str) -> DataFrame:
    return _events(spark, sf_dir, condition).groupBy("segment_id").agg(F.max_by(F.struct("event_id", "rating"), "event_id").alias("r")).select("segment_id", "r.*")


@query("review_upsert", "SELECT user_id AS segment_id, max(event_id) AS event_id FROM events GROUP BY 1")
def review_upsert(spark, sf_dir):
    # odd ids are stored and even ones arrive, so about half of the changes come late
    return feedback.upsert(_latest(spark, sf_dir, "event_id % 2 = 1"), _events(spark, sf_dir, "event_id % 2 = 0").select("segment_id", "event_id", "rating"), ["segment_id"], "event_id").select("segment_id", "event_id")


@query("source_fingerprints")
def source_fingerprints(spark, sf_dir):
    """Samples of the given files themselves; their times of change have no SQL form."""
    found = file_samples.fingerprints(spark, sf_dir, glob="*.parquet")
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "size", "fingerprint")


@query("insert_ignore", "SELECT user_id AS segment_id, coalesce(max(event_id) FILTER (event_id % 2 = 1), min(event_id) FILTER (event_id % 2 = 0)) AS event_id FROM events GROUP BY 1")
def insert_ignore(spark, sf_dir):
    # odd ids are stored and even ones arrive
    return feedback.insert_ignore(_latest(spark, sf_dir, "event_id % 2 = 1"), _events(spark, sf_dir, "event_id % 2 = 0").select("segment_id", "event_id", "rating"), ["segment_id"], "event_id").select("segment_id", "event_id")


@query("keyed_delete", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def keyed_delete(spark, sf_dir):
    return feedback.delete_keys(_events(spark, sf_dir, "true"), _events(spark, sf_dir, "event_type = 'error' AND value > 100"), ["segment_id"]).select("event_id")


@query("external_examples_upsert", "SELECT collection_id, source, arg_max(value, event_id) AS value FROM (SELECT user_id AS collection_id, event_type AS source, value, event_id FROM events) q GROUP BY 1, 2")
def external_examples_upsert(spark, sf_dir):
    rows = carriers.table(spark, sf_dir, "events").select(F.col("user_id").alias("collection_id"), F.col("event_type").alias("source"), "value", "event_id")
    stored = rows.where("event_id % 2 = 0").groupBy("collection_id", "source").agg(F.max_by(F.struct("value", "event_id"), "event_id").alias("r")).select("collection_id", "source", "r.*")
    # a batch of imports may be older or newer than what is stored: the time decides
    merged = feedback.upsert(stored, rows.where("event_id % 2 = 1").select(*stored.columns), ["collection_id", "source"], "event_id")
    return merged.select("collection_id", "source", "value")


CTE["cur"] = "SELECT id AS segment_id, 1 + id % 2 AS revision_number, embedding IS NOT NULL AS has_vector FROM seg"
NEEDS["cur"] = ("seg",)
_EVENTS_SQL = """ev AS (SELECT event_id, user_id AS segment_id, CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'unrated' WHEN 'click' THEN 'rejected' WHEN 'view' THEN 'strange' ELSE 'accepted' END AS rating,
  CASE WHEN event_type = 'click' THEN 'too long' ELSE '' END AS review_reason, CASE WHEN event_id % 2 = 0 THEN 'general' ELSE 'horror' END AS profile FROM events)"""


def _review_state(spark, sf_dir):
    current = carriers.segments(spark, sf_dir).select(
        F.col("id").alias("segment_id"), (1 + F.col("id") % 2).alias("revision_number"), F.concat(F.col("id").cast("string"), F.lit("-r")).alias("revision_id"), "embedding", F.lit(1.0).alias("features"))
    kind, i = F.col("event_type"), F.col("event_id")
    events = carriers.table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("segment_id"), i.alias("updated_at"),
        F.when(kind == "purchase", " Accepted").when(kind == "error", "unrated").when(kind == "click", "rejected").when(kind == "view", "strange").otherwise("accepted").alias("rating"),
        F.when(kind == "click", "too   long").otherwise("ignored").alias("review_reason"), F.when(i % 2 == 0, "General").otherwise("horror").alias("profile"))
    reviews = current.where("segment_id % 3 = 0").select("segment_id", F.lit("unrated").alias("rating"), F.lit("").alias("review_reason"), F.lit("old").alias("reviewed_revision_id"), F.lit(-1).cast("bigint").alias("updated_at"))
    snapshots = current.where("segment_id % 3 = 0").select("segment_id", F.lit("general").alias("profile"), F.lit("accepted").alias("decision"), F.lit("").alias("review_reason"), "embedding", "features", F.lit(9).cast("bigint").alias("reviewed_revision_number"), F.lit(-1).cast("bigint").alias("updated_at"))
    return feedback.apply_reviews(reviews, snapshots, events, current)


@query("apply_reviews", cte("cur") + f""", {_EVENTS_SQL}, ok AS (SELECT ev.*, c.revision_number, c.has_vector FROM ev JOIN cur c ON c.segment_id = ev.segment_id WHERE rating <> 'strange'),
  l AS (SELECT segment_id, arg_max(rating, event_id) AS rating, arg_max(review_reason, event_id) AS review_reason FROM ok GROUP BY 1),
  p AS (SELECT segment_id, profile, arg_max(rating, event_id) AS rating, max(revision_number) AS revision_number, bool_or(has_vector) AS has_vector FROM ok GROUP BY 1, 2)
  SELECT 'review' AS kind, coalesce(l.segment_id, c.segment_id) AS segment_id, '' AS profile, coalesce(l.rating, 'unrated') AS decision, coalesce(l.review_reason, '') AS detail FROM (SELECT * FROM cur WHERE segment_id % 3 = 0) c FULL JOIN l ON l.segment_id = c.segment_id
  UNION ALL SELECT 'snapshot', segment_id, profile, rating, CAST(revision_number AS VARCHAR) FROM p WHERE rating <> 'unrated' AND has_vector
  UNION ALL SELECT 'snapshot', segment_id, 'general', 'accepted', '9' FROM cur WHERE segment_id % 3 = 0 AND segment_id NOT IN (SELECT segment_id FROM p WHERE profile = 'general')""")
def apply_reviews(spark, sf_dir):
    reviews, snapshots = _review_state(spark, sf_dir)
    left = reviews.select(F.lit("review").alias("kind"), "segment_id", F.lit("").alias("profile"), F.col("rating").alias("decision"), F.col("review_reason").alias("detail"))
    return left.unionByName(snapshots.select(F.lit("snapshot").alias("kind"), "segment_id", "profile", "decision", F.col("reviewed_revision_number").cast("string").alias("detail")))


@query("refresh_snapshots", cte("rev") + "SELECT segment_id, CASE WHEN segment_id % 3 = 0 AND segment_id IN (SELECT vec_id FROM embeddings) THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS features FROM rev")
def refresh_snapshots(spark, sf_dir):
    i = F.col("segment_id")
    reviews = carriers.reviews(spark, sf_dir).select("segment_id", "rating", F.lit(1).alias("reviewed_revision_id"))
    snapshots = carriers.reviews(spark, sf_dir).select("segment_id", F.array(F.lit(0.0)).alias("embedding"), F.lit(1.0).alias("features"), F.lit(1).alias("reviewed_revision_number"))
    current = carriers.segments(spark, sf_dir).select(F.col("id").alias("segment_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("revision_id"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("revision_number"), "embedding", F.lit(2.0).alias("features"))
    return feedback.refresh_snapshots(snapshots, reviews, current).select("segment_id", "features")


@query("apply_tag_verdicts", cte("tagged") + """, ev AS (SELECT user_id AS segment_id, event_id, CASE event_type WHEN 'click' THEN 'humor' WHEN 'view' THEN 'format: czytanie' WHEN 'purchase' THEN 'gniew' ELSE 'forma: puenta' END AS tag, CASE WHEN event_id % 3 = 0 THEN 'correct' WHEN event_id % 3 = 1 THEN 'incorrect' ELSE 'unmarked' END AS verdict FROM events),
  j AS (SELECT ev.*, t.id FROM ev LEFT JOIN tagged t ON t.id = ev.segment_id AND list_contains(t.tags, ev.tag))
  SELECT segment_id, tag, arg_max(verdict, event_id) AS verdict, 0 AS refused FROM j WHERE id IS NOT NULL GROUP BY 1, 2 HAVING arg_max(verdict, event_id) <> 'unmarked' UNION ALL SELECT -1, '', '', count(*) FROM j WHERE id IS NULL""")
def apply_tag_verdicts(spark, sf_dir):
    kind, i = F.col("event_type"), F.col("event_id")
    events = carriers.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("segment_id"), "event_id", i.alias("updated_at"), F.when(kind == "click", "HUMOR").when(kind == "view", "reading").when(kind == "purchase", "gniew").otherwise("forma:  puenta").alias("tag"),
        F.when(i % 3 == 0, "correct").when(i % 3 == 1, "Incorrect").otherwise("unmarked").alias("verdict"))
    current = carriers.tagged(spark, sf_dir, False).select(F.col("id").alias("segment_id"), F.lit("r1").alias("revision_id"), "tags")
    none = events.limit(0).select("segment_id", F.lit("r1").alias("reviewed_revision_id"), "tag", "verdict", "updated_at")
    verdicts, refused = feedback.apply_tag_verdicts(none, events, current)
    return verdicts.select("segment_id", "tag", "verdict", F.lit(0).cast("bigint").alias("refused")).unionByName(
        refused.agg(F.lit(-1).cast("bigint").alias("segment_id"), F.lit("").alias("tag"), F.lit("").alias("verdict"), F.count("*").alias("refused")))


@query("add_examples", cte("seg") + """SELECT collection_id, segment_id, min(created_at) AS created_at, any_value(start_seconds) AS snapshot_start_seconds FROM (
  SELECT user_id % 50 AS collection_id, user_id AS segment_id, event_id AS created_at, s.start_seconds FROM events JOIN seg s ON s.id = user_id) q GROUP BY 1, 2""")
def add_examples(spark, sf_dir):
    segments = carriers.segments(spark, sf_dir).withColumn("revision_number", F.lit(1))
    requests = carriers.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("collection_id"), F.col("user_id").alias("segment_id"), F.col("event_id").alias("created_at"))
    none = requests.join(segments, F.lit(False)).select(
        "collection_id", "segment_id", "revision_number", F.col("video_id").alias("snapshot_video_id"), F.col("start_seconds").alias("snapshot_start_seconds"), F.col("end_seconds").alias("snapshot_end_seconds"),
        F.col("transcript").alias("snapshot_transcript"), F.col("embedding").alias("snapshot_embedding"), "created_at")
    return feedback.add_examples(none, requests, segments).select("collection_id", "segment_id", "created_at", "snapshot_start_seconds")


CTE["own"] = """SELECT s.id % 9 AS collection_id, s.id, s.transcript, s.embedding FROM seg s WHERE s.embedding IS NOT NULL AND s.id % 2 = 0"""
NEEDS["own"] = ("seg",)


def _collection(spark, sf_dir) -> DataFrame:
    segments = carriers.segments(spark, sf_dir)
    chosen = segments.where("id % 2 = 0")
    examples = chosen.select((F.col("id") % 9).alias("collection_id"), F.col("id").alias("segment_id"), F.when(F.col("id") % 4 == 0, F.col("transcript")).otherwise("").alias("snapshot_transcript"),
                             F.when(F.col("id") % 6 == 0, F.col("embedding")).alias("snapshot_embedding"))
    external = carriers.table(spark, sf_dir, "embeddings").where("label = 2").select((F.col("vec_id") % 9).alias("collection_id"), F.lit("external text").alias("transcript"), F.col("embedding").cast("array<double>").alias("embedding"))
    return feedback.collection_vectors(examples, segments, external)


@query("collection_vectors", cte("own") + """SELECT collection_id, count(*) AS n, round(sum(v), 6) AS checksum FROM (SELECT collection_id, embedding[1]::DOUBLE AS v FROM own UNION ALL SELECT vec_id % 9, embedding[1]::DOUBLE FROM embeddings WHERE label = 2) q GROUP BY 1""")
def collection_vectors(spark, sf_dir):
    return _collection(spark, sf_dir).groupBy("collection_id").agg(F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0))), 6).alias("checksum"))


@query("collection_texts", cte("own") + """SELECT collection_id, count(*) AS n, sum(length(t)) AS characters FROM (SELECT collection_id, transcript AS t FROM own UNION ALL SELECT vec_id % 9, 'external text' FROM embeddings WHERE label = 2) q GROUP BY 1""")
def collection_texts(spark, sf_dir):
    return _collection(spark, sf_dir).groupBy("collection_id").agg(F.count("*").alias("n"), F.sum(F.length("transcript")).alias("characters"))


# ---- upkeep ---------------------------------------------------------------------------------------------------------------
@query("recent_plus_active", cte("jobs") + """SELECT video_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN status = 'P' THEN 0 ELSE 1 END, created_at DESC, id DESC) AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY created_at DESC, id DESC) AS rn FROM jobs) q WHERE rn <= 5 OR status = 'P') z""")
def recent_plus_active(spark, sf_dir):
    rows = maintenance.recent_plus_active(carriers.jobs(spark, sf_dir), "video_id", F.col("status") == "P", 5)
    return rows.select("video_id", "id", F.col("place").cast("bigint").alias("place"))


@query("retention_plan", """SELECT p_partkey AS path, CASE WHEN p_partkey <= 500 THEN 'old' WHEN newer > 20000 THEN 'budget' ELSE 'keep' END AS action FROM (
  SELECT p_partkey, sum(CASE WHEN p_partkey > 500 THEN p_size ELSE 0 END) OVER (ORDER BY p_partkey DESC) AS newer FROM part) q""")
def retention_plan(spark, sf_dir):
    files = carriers.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("bigint").alias("size"), F.col("p_partkey").alias("modified"))
    return maintenance.retention_plan(files, 500, 20000).select("path", "action")


@query("stage_reuse", """SELECT doc_id AS id, sha256('{"source":"' || sha256(text) || '","stage":"tags","parameters":"v3"}') AS stage_key, sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 <> 0) AS pending FROM documents""")
def stage_reuse(spark, sf_dir):
    inputs = carriers.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("source"))
    keyed = maintenance.with_stage_key(inputs, "tags", "v3")
    # results exist for every source but each third one
    stored = keyed.where("id % 3 <> 0").select("stage_key")
    open_keys = maintenance.pending(keyed, stored).select("id").withColumn("pending", F.lit(True))
    return keyed.join(open_keys, "id", "left").select("id", "stage_key", F.coalesce("pending", F.lit(False)).alias("pending"))


@query("backfill_features", cte("scored") + "SELECT id, logical_sense_score < 0 OR context_score <= 0 OR self_contained_score < 0 AS missing FROM scored")
def backfill_features(spark, sf_dir):
    rows = carriers.scored(spark, sf_dir, False)
    return rows.select("id", maintenance.needs_backfill(["logical_sense_score", "self_contained_score"], ["context_score"]).alias("missing"))


@query("scan_segments", "SELECT doc_id AS id, source AS video_id FROM documents WHERE lang = 'en' AND n_chars > 500")
def scan_segments(spark, sf_dir):
    from cuewise.sources.tables import scan

    return scan(spark, f"{sf_dir}/documents.parquet", "lang = 'en' AND n_chars > 500", ["doc_id AS id", "source AS video_id"])


@query("pattern_append", cte("tagged") + "SELECT 'set-' || CAST(id % 3 AS VARCHAR) AS pattern_set_id, count(*) AS examples, sum(end_seconds - start_seconds) AS seconds, CAST(sum(quality_score) AS BIGINT) AS quality FROM tagged GROUP BY 1")
def pattern_append(spark, sf_dir):
    rows = carriers.tagged(spark, sf_dir, False).withColumn("pattern_set_id", F.concat(F.lit("set-"), (F.col("id") % 3).cast("string")))
    stored = maintenance.append_patterns(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))
    return stored.groupBy("pattern_set_id").agg(F.count("*").alias("examples"), F.sum("duration_seconds").alias("seconds"), F.sum("quality_score").alias("quality"))


