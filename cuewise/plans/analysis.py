"""The write path over many recordings at once: from transcript parts to scored, grouped segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.tags import lexical_tags
from cuewise.functions.text import keywords
from cuewise.functions.vocab import BROAD_MARKERS, DEFAULT_VOCABULARY, DETAILED_MARKERS, Vocabulary
from cuewise.operators import candidates, chat, features, intervals, similarity, stats
from cuewise.operators.feedback import upsert
from cuewise.operators.maintenance import needs_backfill
from cuewise.session import cut_lineage
from cuewise.sources.chat_files import replace_messages


def analyse(parts: DataFrame, order: str, durations: DataFrame, boundaries: DataFrame | None = None, evidence: DataFrame | None = None,
            vectors: DataFrame | None = None, mode: str = "default", vocab: Vocabulary = DEFAULT_VOCABULARY,
            detailed: dict = DETAILED_MARKERS, broad: dict = BROAD_MARKERS) -> DataFrame:
    """Segments of every recording with context, tags, scores and, if vectors are given, duplicate groups.

    ``evidence`` (video_id, id, audio and vision scores) and ``vectors`` (video_id, id, embedding) are produced elsewhere
    and joined by the stable segment id. A recording without parts gets fixed windows without text.
    """
    packed = candidates.pack_candidates(parts, order)
    aligned = candidates.sentence_bounds(packed, parts, order, durations, vocab)
    texted = candidates.with_text(aligned, parts, order)
    start, end = intervals.pad_interval(F.col("start_seconds"), F.col("end_seconds"), F.col("duration_seconds"))
    padded = texted.join(durations, "video_id").withColumns({"_s": start, "_e": end}).drop("start_seconds", "end_seconds", "duration_seconds").withColumnsRenamed(
        {"_s": "start_seconds", "_e": "end_seconds"})
    # candidates aligned to the same range stay apart, as alternatives
    turn = F.row_number().over(Window.partitionBy("video_id", "first", "last").orderBy("boundary_signals"))
    again = F.when(F.col("_turn") > 1, F.col("_turn").cast("string"))  # concat_ws leaves out nulls
    named = padded.withColumn("_turn", turn).withColumn("id", F.sha2(F.concat_ws(":", "video_id", "first", "last", again), 256)).drop("first", "last", "_turn")
    if boundaries is not None:
        snapped = intervals.snap_to_boundaries(named, boundaries, durations)
        free = F.size("boundary_signals") == 0
        named = snapped.withColumns({"start_seconds": F.when(free, F.col("snapped_start")).otherwise(F.col("start_seconds")),
                                     "end_seconds": F.when(free, F.col("snapped_end")).otherwise(F.col("end_seconds"))}).drop("snapped_start", "snapped_end", "duration_seconds")
    silent = candidates.fixed_windows(durations.join(parts.select("video_id").distinct(), "video_id", "left_anti")).withColumns({
        "id": F.sha2(F.concat_ws(":", "video_id", F.lit("window"), "start_seconds"), 256), "transcript": F.lit(""), "boundary_signals": F.array().cast("array<string>")})
    named = named.unionByName(silent)
    named = cut_lineage(named)  # candidates are a stage of their own; the joins below read them several times
    window = 20.0 if mode == "extended" else 12.0
    around = intervals.attach_neighbour_text(named, parts, window, 700, item_id=order)
    tagged = around.withColumns({"tags": lexical_tags(F.col("transcript"), detailed=detailed, broad=broad), "keywords": keywords(F.col("transcript")), "analysis_mode": F.lit(mode)})
    if evidence is not None:
        tagged = tagged.join(evidence, ["video_id", "id"], "left")
    scored = features.recompute(cut_lineage(tagged), None, vocab)
    if vectors is None:
        return scored
    limits = {"threshold": 0.84, "overlap_ratio": 0.45, "overlap_similarity": 0.64} if mode == "extended" else {}
    return similarity.assign_duplicate_groups(scored.join(vectors, ["video_id", "id"], "left"), **limits)


def rescore_chat(segments: DataFrame, messages: DataFrame, settings: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Chat scores of all segments of the recordings in ``settings`` (video_id, delay_seconds), and what depends on them."""
    mine = segments.join(settings.select("video_id", "delay_seconds"), "video_id")
    moved = mine.withColumns({name: F.col(name) + F.col("delay_seconds") for name in ("start_seconds", "end_seconds")})
    scored = chat.score_chat(moved.select("video_id", "id", "start_seconds", "end_seconds"), messages, F.lit(0.0), vocab)
    names = [name for name in scored.columns if name not in ("video_id", "id")]
    fresh = mine.drop("delay_seconds", *names).join(scored, ["video_id", "id"])
    return features.recompute(fresh, {"source:chat"}, vocab)


def import_chat(stored: DataFrame, settings: DataFrame, imported: DataFrame, new_settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and settings tables after an import."""
    return replace_messages(stored, imported), upsert(settings, new_settings, ["video_id"], "imported_at")


def backfill(segments: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Recompute only rows that miss a feature; the others pass through."""
    missing = needs_backfill(["logical_sense_score", "self_contained_score"], ["context_score"])
    rebuilt = features.recompute(segments.where(missing), None, vocab)
    return rebuilt.unionByName(segments.where(~missing), allowMissingColumns=True)


def statistics(facts: DataFrame, saved_reasons: DataFrame) -> dict[str, DataFrame]:
    """All reports of the statistics page, each a small frame."""
    compared = stats.score_comparison(facts)
    return {
        "overview": stats.overview(facts), "published_performance": stats.published_performance(facts), "rejection_reasons": stats.reason_report(facts, saved_reasons),
        "tags": stats.tag_report(facts), "analysis_modes": stats.mode_report(facts), "score_comparison": compared,
        "calibration": stats.calibration(compared), "reading_flags": stats.reading_flags(facts),
    }
