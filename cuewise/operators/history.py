"""Revision-bound history: matching old and new moments, activating runs, revisions and evidence."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cuewise.functions.text import blank_null, match_form, token_jaccard
from cuewise.operators.intervals import range_join
from cuewise.operators.ordering import keyed_index
from cuewise.session import cut_lineage

# --- fixed values: matching limits
MAX_MIDPOINT = 8.0
MIN_TEXT, STRONG_TEXT = 0.34, 0.78
SCORE_HIGH, SCORE_MEDIUM = 0.76, 0.64
MIN_IOU, MIN_COVERAGE = 0.24, 0.42
MACHINE_KINDS = ("analysis", "reanalysis", "legacy")


@F.pandas_udf(DoubleType())
def _block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Share of text in matching blocks; Spark has no built-in for this measure."""
    return pd.Series([1.0 if not a and not b else 0.0 if not a or not b else SequenceMatcher(None, a, b, autojunk=False).ratio()
                      for a, b in zip(left, right)], dtype="float64")


def sequence_similarity(pairs: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Similarity of two comparison forms. Equal and empty texts are settled without leaving the JVM; the costly
    measure runs once per distinct pair of different texts."""
    same, empty = F.col(left) == F.col(right), (F.col(left) == "") | (F.col(right) == "")
    costly = pairs.where(~same & ~empty).select(left, right).distinct().withColumn(out, _block_ratio(F.col(left), F.col(right)))
    joined = pairs.join(costly, [left, right], "left")
    return joined.withColumn(out, F.when(same, 1.0).when(empty, 0.0).otherwise(F.col(out)))


def interval_signals(s1: Column, e1: Column, s2: Column, e2: Column) -> dict[str, Column]:
    """Overlap, coverage and midpoint measures of two intervals."""
    first, second = F.greatest(F.lit(0.25), e1 - s1), F.greatest(F.lit(0.25), e2 - s2)
    overlap = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    union = F.greatest(e1, e2) - F.least(s1, s2)
    apart = F.abs((s1 + e1) / 2 - (s2 + e2) / 2)
    reach = F.least(F.lit(MAX_MIDPOINT), F.greatest(F.lit(3.0), F.greatest(first, second) * 0.45))
    return {
        "overlap_seconds": overlap, "iou": F.when(union > 0, overlap / union).otherwise(1.0),
        "previous_coverage": F.least(F.lit(1.0), overlap / first), "new_coverage": F.least(F.lit(1.0), overlap / second),
        "duration_ratio": F.least(first, second) / F.greatest(first, second), "midpoint_distance": apart,
        "midpoint_proximity": F.greatest(F.lit(0.0), 1.0 - apart / reach),
    }


def match_score() -> Column:
    weights = {"iou": 0.20, "previous_coverage": 0.11, "new_coverage": 0.11, "duration_ratio": 0.10, "midpoint_proximity": 0.10,
               "sequence_similarity": 0.25, "token_jaccard": 0.13}
    total = None
    for name, weight in weights.items():
        total = F.col(name) * weight if total is None else total + F.col(name) * weight
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)


def match_class() -> dict[str, Column]:
    """Confidence (null for a rejected pair) and the reason, from the signals and ``score``."""
    text, coverage, score = F.col("text_similarity"), F.col("both_coverage"), F.col("score")
    close = F.col("midpoint_distance") <= MAX_MIDPOINT
    ratio = F.col("duration_ratio")
    rules = [
        ((F.col("overlap_seconds") <= 0) & ~((text >= 0.94) & close), None, "rejected: no temporal overlap"),
        (~close, None, "rejected: midpoint is too far away"),
        ((text < MIN_TEXT) & ~((coverage >= 0.88) & (ratio >= 0.72) & (F.col("midpoint_distance") <= 2.0)), None, "rejected: transcript differs"),
        (~((F.col("iou") >= MIN_IOU) | (coverage >= MIN_COVERAGE)), None, "rejected: insufficient temporal overlap"),
        ((score >= SCORE_HIGH) & (text >= STRONG_TEXT), "high", "high: strong temporal and transcript agreement"),
        ((score >= SCORE_HIGH) & ((text >= MIN_TEXT) | ((coverage >= 0.92) & (ratio >= 0.82))), "high", "high: near-identical temporal boundaries"),
        ((score >= SCORE_MEDIUM) & (text >= MIN_TEXT), "medium", "medium: boundary drift with supporting transcript"),
        ((text >= 0.90) & (coverage >= 0.30), "medium", "medium: strong transcript with partial overlap"),
    ]
    confidence, reason = F, F
    for condition, level, label in rules:
        confidence, reason = confidence.when(condition, F.lit(level)), reason.when(condition, F.lit(label))
    return {"confidence": confidence.otherwise(F.lit(None)), "reason": reason.otherwise(F.lit("rejected: combined confidence below threshold"))}


def midpoint_pairs(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows of one recording whose midpoints are at most eight seconds apart."""
    def side(frame: DataFrame, tag: str) -> DataFrame:
        low, high = F.least("start_seconds", "end_seconds"), F.greatest("start_seconds", "end_seconds")
        return frame.select("video_id", F.col("id").alias(f"{tag}_id"), low.alias(f"{tag}_start"), high.alias(f"{tag}_end"),
                            match_form(F.col("transcript")).alias(f"{tag}_text"))

    old = side(previous, "previous").withColumn("_middle", (F.col("previous_start") + F.col("previous_end")) / 2).withColumn(
        "_low", F.col("_middle") - MAX_MIDPOINT).withColumn("_high", F.col("_middle") + MAX_MIDPOINT).drop("_middle")
    fresh = side(new, "new").withColumn("_at", (F.col("new_start") + F.col("new_end")) / 2)
    return range_join(old, fresh, "video_id", "_low", "_high", "_at", 32.0).drop("_low", "_high", "_at")


def candidate_matches(previous: DataFrame, new: DataFrame) -> DataFrame:
    """All signals, the score and the class of every close pair."""
    measured = time_signals(previous, new)
    compared = sequence_similarity(measured, "previous_text", "new_text", "sequence_similarity")
    return _classified(compared).drop("previous_text", "new_text")


def time_signals(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Close pairs with their interval measures and word overlap."""
    pairs = midpoint_pairs(previous, new)
    measured = pairs.withColumns(interval_signals(*[F.col(name) for name in ("previous_start", "previous_end", "new_start", "new_end")]))
    return measured.withColumn("token_jaccard", token_jaccard(F.col("previous_text"), F.col("new_text")))


def _classified(frame: DataFrame) -> DataFrame:
    combined = frame.withColumns({
        "text_similarity": F.col("sequence_similarity") * 0.65 + F.col("token_jaccard") * 0.35,
        "both_coverage": F.least("previous_coverage", "new_coverage")})
    return combined.withColumn("score", match_score()).withColumns(match_class())


def accepted_matches(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs that are good enough to match.

    The shared text of two strings is at most their shorter length, which bounds the sequence measure from above, and a
    better text never turns an accepted pair into a rejected one. So pairs that fail with the bound are dropped before
    the costly measure; the result is the same.
    The word overlap is measured once a pair and only between different texts of pairs that pass if it were full; then texts
    stay only with the pairs that still need them, and the rest goes on as numbers.
    """
    pairs = midpoint_pairs(previous, new).withColumns(interval_signals(*[F.col(name) for name in ("previous_start", "previous_end", "new_start", "new_end")]))
    same, a, b = F.col("previous_text") == F.col("new_text"), F.length("previous_text"), F.length("new_text")
    bound = F.when(same, 1.0).when((a == 0) | (b == 0), 0.0).otherwise(2.0 * F.least(a, b) / (a + b))
    timed = pairs.withColumns({"sequence_similarity": bound, "token_jaccard": F.lit(1.0), "_same": same})
    hopeful = _passing(timed)
    measured = hopeful.withColumns({
        "token_jaccard": F.when(F.col("_same"), 1.0).otherwise(token_jaccard(F.col("previous_text"), F.col("new_text"))),
        "previous_text": F.when(F.col("_same"), "").otherwise(F.col("previous_text")),
        "new_text": F.when(F.col("_same"), "").otherwise(F.col("new_text"))})
    settled = _passing(cut_lineage(measured))
    # two texts of a settled pair are both empty, so that it costs nothing; an empty text beside another one is not measured either
    compared = settled.where("_same").withColumn("sequence_similarity", F.lit(1.0)).unionByName(
        sequence_similarity(settled.where("NOT _same").drop("sequence_similarity"), "previous_text", "new_text", "sequence_similarity").select(*settled.columns))
    return _classified(compared).where(F.col("confidence").isNotNull()).drop("previous_text", "new_text", "_same")


def _passing(pairs: DataFrame) -> DataFrame:
    """Pairs that are accepted with the similarities they have."""
    return _classified(pairs).where(F.col("confidence").isNotNull()).select(*pairs.columns)


def match_moments(previous: DataFrame, new: DataFrame) -> DataFrame:
    """One-to-one matches, the same as taking pairs greedily from the best to the worst.

    The order of pairs is total, so a pair that is the best one for both of its ends is certain. Every round takes all
    such pairs at once and removes the pairs they block; the ends are found with map-side aggregates.
    """
    level = F.when(F.col("confidence") == "high", 2).otherwise(1)
    order = F.struct((-level).alias("a"), (-F.col("score")).alias("b"), (-F.col("text_similarity")).alias("c"),
                     (-F.col("both_coverage")).alias("d"), F.col("previous_id").alias("e"), F.col("new_id").alias("f"))
    open_pairs = accepted_matches(previous, new).withColumn("_order", order)
    open_pairs = cut_lineage(open_pairs)
    chosen = None
    while True:  # each round settles at least the best open pair
        best_old = open_pairs.groupBy("video_id", "previous_id").agg(F.min("_order").alias("_old"))
        best_new = open_pairs.groupBy("video_id", "new_id").agg(F.min("_order").alias("_new"))
        ranked = open_pairs.join(best_old, ["video_id", "previous_id"]).join(best_new, ["video_id", "new_id"])
        sure = cut_lineage(ranked.where((F.col("_order") == F.col("_old")) & (F.col("_order") == F.col("_new"))).drop("_old", "_new"))
        chosen = sure if chosen is None else chosen.unionByName(sure)
        left = open_pairs.join(sure.select("video_id", "previous_id"), ["video_id", "previous_id"], "left_anti").join(
            sure.select("video_id", "new_id"), ["video_id", "new_id"], "left_anti")
        open_pairs = cut_lineage(left)
        if open_pairs.isEmpty():
            return chosen.drop("_order")


def activate_run(current: DataFrame, retired: DataFrame, records: DataFrame, run_id: str, evidence: DataFrame | None = None) -> DataFrame:
    """Rows of all recordings after a run becomes current.

    Matched rows keep their id and get the next revision; other records are new; unmatched old rows retire. A retired
    row with human evidence may come back for a record that is still unmatched, on a high match with strong text. A run
    without records leaves its recording untouched.
    """
    rerun = records.select("video_id").distinct()
    previous = current.join(rerun, "video_id", "left_semi")
    untouched = current.join(rerun, "video_id", "left_anti").withColumn("change", F.lit("kept"))
    matches = match_moments(previous, records).select("video_id", "previous_id", "new_id", "score", "reason")
    if evidence is not None:
        free = records.join(matches.select("video_id", F.col("new_id").alias("id")), ["video_id", "id"], "left_anti")
        proven = retired.join(evidence, "id", "left_semi")
        back = match_moments(proven, free).where((F.col("confidence") == "high") & (F.col("text_similarity") >= STRONG_TEXT))
        restored = back.select("video_id", "previous_id", "new_id", "score", "reason")
        matches = matches.unionByName(restored)
    known = current.unionByName(retired).select("video_id", F.col("id").alias("previous_id"), F.col("revision_number").alias("_revision"))
    linked = records.withColumnRenamed("id", "new_id").join(matches, ["video_id", "new_id"], "left").join(known, ["video_id", "previous_id"], "left")
    active = linked.select(
        "video_id", F.coalesce("previous_id", "new_id").alias("id"), "start_seconds", "end_seconds", "transcript",
        F.when(F.col("previous_id").isNull(), 1).otherwise(F.greatest(F.lit(1), F.col("_revision")) + 1).cast("int").alias("revision_number"),
        F.lit("current").alias("lifecycle_state"), F.lit(run_id).alias("analysis_run_id"),
        F.when(F.col("previous_id").isNull(), "new").otherwise("matched").alias("change"))
    taken = matches.select("video_id", F.col("previous_id").alias("id"))
    retiring = previous.join(taken, ["video_id", "id"], "left_anti").withColumns({"lifecycle_state": F.lit("retired"), "change": F.lit("retired")})
    asleep = retired.join(taken, ["video_id", "id"], "left_anti").withColumn("change", F.lit("kept"))
    result = active
    for part in (retiring, untouched, asleep):
        result = result.unionByName(part.select(*active.columns))
    return result


def revision_history(events: DataFrame) -> DataFrame:
    """Number the revisions of every segment and mark the newest one as current."""
    numbered = keyed_index(events, ["segment_id"], [F.col("created_at"), F.col("event_id")], out="revision_number")
    newest = numbered.groupBy("segment_id").agg(F.max("revision_number").alias("_newest"))
    return numbered.join(newest, "segment_id").withColumn("is_current", F.col("revision_number") == F.col("_newest")).drop("_newest")


def next_run_sequence(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Sequence number of a new run and the current run it descends from."""
    state = runs.groupBy("video_id").agg(F.max("sequence").alias("_last"), F.max(F.when(F.col("is_current"), F.col("run_id"))).alias("parent_run_id"))
    return requests.join(state, "video_id", "left").withColumn("sequence", F.coalesce("_last", F.lit(0)) + 1).drop("_last")


def update_run_state(runs: DataFrame, failures: DataFrame) -> DataFrame:
    """Running runs named in ``failures`` become failed and keep the message; nothing else changes."""
    joined = runs.join(failures.select("run_id", "message"), "run_id", "left")
    failed = F.col("message").isNotNull() & (F.col("state") == "running")
    return joined.withColumns({"state": F.when(failed, "failed").otherwise(F.col("state")),
                               "error_message": F.when(failed, F.col("message")).otherwise(F.col("error_message")),
                               "is_current": F.col("is_current") & ~failed}).drop("message")


def sync_revisions(revisions: DataFrame, updates: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Mirror derived updates into the current revision; updates for another revision come back as rejected."""
    renamed = updates.select("segment_id", F.col("revision_number").alias("_expected"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = revisions.join(renamed, "segment_id", "left")
    fits = F.col("is_current") & F.col("_expected").isNotNull() & (F.col("_expected") == F.col("revision_number"))
    synced = joined.withColumns({c: F.when(fits, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_expected", *[f"_{c}" for c in columns])
    current = revisions.where("is_current").select("segment_id", "revision_number")
    rejected = updates.join(current, ["segment_id", "revision_number"], "left_anti")
    return synced, rejected


def manual_edits(revisions: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """Add one new revision per edited segment; the review keeps pointing to the old one and so turns stale."""
    current = revisions.where("is_current").join(edits.select("segment_id", "kind", *[F.col(c).alias(f"_{c}") for c in columns]), "segment_id")
    added = current.withColumns({
        **{c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in columns}, "revision_number": F.col("revision_number") + 1,
        "revision_kind": F.col("kind"), "is_current": F.lit(True)}).select(*revisions.columns)
    edited = edits.select("segment_id").distinct().withColumn("_edited", F.lit(True))
    closed = revisions.join(edited, "segment_id", "left").withColumn("is_current", F.col("is_current") & F.col("_edited").isNull()).select(*revisions.columns)
    return closed.unionByName(added)


# ---- evidence ----------------------------------------------------------------------------------------------------
def has_human_data(rows: DataFrame) -> Column:
    """Whether a row carries a person's decision or edit and must be kept."""
    result = ~F.lower(F.trim(blank_null(F.col("rating")))).isin("", "unrated", "not reviewed", "none", "null")
    result = result | (F.trim(blank_null(F.col("review_reason"))) != "")
    for name in ("censor_profanity", "remove_pauses", "caption_edited", "range_edited"):
        if name in rows.columns:
            result = result | F.coalesce(F.col(name).cast("boolean"), F.lit(False))
    for name in ("archive_audio_path", "human_caption_text", "reviewed_at", "review_id", "moment_review_id"):
        if name in rows.columns:
            result = result | (F.trim(blank_null(F.col(name).cast("string"))) != "")
    return result


def evidence_flags(segments: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """One boolean per source: does it mention the segment? Sources are reduced to distinct ids before the join."""
    result = segments
    for name, frame in sources.items():
        ids = frame.select(F.col("segment_id").alias("id")).distinct().withColumn(name, F.lit(True))
        result = result.join(ids, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return result


def segments_with_evidence(segments: DataFrame, reviewed: Column, sources: list[DataFrame]) -> DataFrame:
    """Segments decided by a person or mentioned by any source."""
    ids = segments.where(reviewed).select("id")
    for frame in sources:
        ids = ids.unionByName(frame.select(F.col("segment_id").alias("id")))
    return segments.join(ids.distinct(), "id", "left_semi")


def pick_revision(candidates: DataFrame) -> DataFrame:
    """First available revision per segment from (segment_id, priority, recency, revision_id)."""
    return candidates.groupBy("segment_id").agg(F.min_by(
        F.struct("priority", "revision_id"), F.struct(F.col("priority"), (-F.col("recency")).alias("r"), F.col("revision_id"))).alias("_pick")).select(
        "segment_id", "_pick.*")


def stale_review() -> Column:
    """A review with content that refers to another revision than the current one."""
    content = (F.coalesce("rating", F.lit("unrated")) != "unrated") | F.coalesce("censor_profanity", F.lit(False)) | F.coalesce("remove_pauses", F.lit(False)) | (
        F.coalesce("archive_audio_path", F.lit("")) != "")
    return content & F.col("reviewed_revision_id").isNotNull() & ~F.col("reviewed_revision_id").eqNullSafe(F.col("current_revision_id"))


def current_tag_verdicts(verdicts: DataFrame, current: DataFrame) -> DataFrame:
    """Latest verdict per segment and tag, only for the current revision."""
    valid = verdicts.join(current.select("segment_id", F.col("revision_id").alias("reviewed_revision_id")), ["segment_id", "reviewed_revision_id"])
    return valid.groupBy("segment_id", "tag").agg(F.max_by("verdict", F.struct("updated_at", "verdict")).alias("verdict"))


def latest_per_key(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Every parent with its newest child, ties by id; the newest is found with a map-side aggregate."""
    columns = [name for name in children.columns if name != key]
    newest = children.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("created_at", "id")).alias("_newest"))
    return parents.join(newest, key, "left").select(*parents.columns, "_newest.*")


def quarantine_orphans(children: DataFrame, parents: DataFrame, key: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a parent, and the rest as JSON with a repeatable id."""
    kept = children.join(parents.select(key).distinct(), key, "left_semi")
    lost = children.join(parents.select(key).distinct(), key, "left_anti")
    payload = F.to_json(F.struct(*[F.col(name) for name in sorted(children.columns)]))
    return kept, lost.select(F.sha2(F.concat(F.lit(f"{source}:"), payload), 256).alias("id"), F.lit(source).alias("source_table"), payload.alias("payload_json"))


def serialize_segments(segments: DataFrame, reviews: DataFrame, verdicts: DataFrame, current: DataFrame) -> DataFrame:
    """Segments with review, verdict map and staleness, without the vector."""
    from cuewise.functions.tags import canonical_tag

    named = verdicts.withColumn("tag", canonical_tag(F.col("tag"))).where(F.col("tag").isNotNull())
    # a map holds the verdicts of one segment, at most one per tag
    maps = named.groupBy("segment_id", "tag").agg(F.max("verdict").alias("verdict")).groupBy("segment_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "verdict")))).alias("tag_feedback"))
    joined = (segments.drop("embedding").join(reviews.withColumnRenamed("segment_id", "id"), "id", "left")
              .join(maps.withColumnRenamed("segment_id", "id"), "id", "left")
              .join(current.select(F.col("segment_id").alias("id"), F.col("revision_id").alias("current_revision_id")), "id", "left"))
    return joined.withColumn("review_stale", F.coalesce(stale_review(), F.lit(False)))
