"""Searches: ranked lists over many recordings, built from the ranking and duplicate operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.tags import canonical_tag
from cuewise.operators import diversity, ranking
from cuewise.operators.similarity import suppress_duplicates


# --- fixed values: limits of searches and picks, the tag of reading aloud
LARGEST_LIMIT, LARGEST_PICKS, READING_TAG = 100, 30, "format: czytanie"


def checked_limit(limit: int, largest: int = LARGEST_LIMIT) -> int:
    """A search returns at most 100 rows; a larger request is refused, not cut."""
    if not 1 <= limit <= largest:
        raise ValueError(f"limit must be between 1 and {largest}, not {limit}")
    return limit


def searchable(segments: DataFrame, recordings: DataFrame | None = None) -> DataFrame:
    """Segments that searches may return: current ones with a vector, of the given recordings (video_id) if there are any.

    A frame without ``lifecycle_state`` has current segments only.
    """
    rows = segments.where(F.col("embedding").isNotNull())
    if "lifecycle_state" in segments.columns:
        rows = rows.where(F.col("lifecycle_state") == "current")
    return rows if recordings is None else rows.join(recordings.select("video_id").distinct(), "video_id", "left_semi")


def not_rejected(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Rows with their review, without rejected ones; a segment without review takes no part."""
    return rows.join(reviews.select("id", "rating"), "id").where(F.col("rating") != "rejected")


def top_ranked(scored: DataFrame, limit: int) -> DataFrame:
    """Best rows after duplicates, then reading-aloud clips are removed. A suppressed group is not re-opened."""
    kept = ranking.filter_reading(suppress_duplicates(scored))
    return kept.orderBy(F.col("ranking_score").desc(), "start_seconds", "id").limit(checked_limit(limit))


def page(rows: DataFrame, mode: str, limit: int) -> DataFrame:
    """First rows of one sort mode with their place; the global order is taken as a top-k, not as a full sort."""
    order = ranking.sort_order(mode)
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def search_segments(segments: DataFrame, reviews: DataFrame, feedback: DataFrame | None, text: str = "", rating: str = "", tag: str = "",
                    hide_reading: bool = False, show_duplicates: bool = False, profile: str = "general", profanity: str = "allow",
                    recordings: DataFrame | None = None, videos: DataFrame | None = None) -> DataFrame:
    """Current segments with a vector, filtered, scored and without weaker duplicates; ``in_order`` sorts them.

    ``videos`` (video_id, source_removed) adds whether the source file is gone; segments of unknown videos go. A search for
    reading aloud, under any name of that tag, keeps such clips.
    """
    rows = searchable(segments, recordings)
    if text.strip():
        pattern = text.strip()
        rows = rows.where(F.col("transcript").ilike(f"%{pattern}%"))
    if hide_reading:
        rows = rows.where(F.col("reading_likelihood") < 0.48)
    if videos is not None:
        rows = rows.join(videos.select("video_id", "source_removed"), "video_id")
    rows = rows.join(reviews, "id")
    if rating in ("unrated", "accepted", "rejected"):
        rows = rows.where(F.col("rating") == rating)
    if tag.strip():
        rows = ranking.filter_tag(rows, tag)
    found = suppress_duplicates(ranking.score_candidates(rows, profile, feedback), show_duplicates)
    if tag.strip():
        found = found.where((canonical_tag(F.lit(tag)) == READING_TAG) | ~ranking.read_aloud())
    else:
        found = ranking.filter_reading(found)
    return ranking.filter_profanity(found, profanity)


def in_order(rows: DataFrame, mode: str = "suggested_desc") -> DataFrame:
    """All rows in one of the sort modes."""
    return rows.orderBy(*ranking.sort_order(mode))


def search_by_references(segments: DataFrame, references: DataFrame | None, feedback: DataFrame | None, limit: int = 20,
                         profile: str = "general", profanity: str = "allow", reviews: DataFrame | None = None, recordings: DataFrame | None = None) -> DataFrame:
    """Segments that resemble reference vectors; one vector is the search by description, none a plain ranking.

    With ``reviews``, rejected segments and those without a review take no part.
    """
    rows = searchable(segments, recordings)
    if reviews is not None:
        rows = not_rejected(rows, reviews)
    scored = ranking.score_candidates(rows, profile, feedback, references)
    kept = ranking.filter_profanity(ranking.filter_reading(suppress_duplicates(scored)), profanity)
    return kept.orderBy(F.col("ranking_score").desc(), "start_seconds", "id").limit(checked_limit(limit))


def top_clips(segments: DataFrame, reviews: DataFrame, feedback: DataFrame | None, limit: int = 10, unrated_only: bool = False,
              profile: str = "general", profanity: str = "allow", recordings: DataFrame | None = None) -> DataFrame:
    """Strong and varied picks of every recording among current clips that were reviewed and not rejected."""
    rated = not_rejected(searchable(segments, recordings), reviews)
    scored = ranking.score_candidates(rated.where(F.col("rating") == "unrated") if unrated_only else rated, profile, feedback)
    kept = ranking.filter_profanity(ranking.filter_reading(scored), profanity)
    return diversity.best_of_stream(kept, checked_limit(limit, LARGEST_PICKS))


def scan_priority(rows: DataFrame, spoken_words: Column, limit: int = 120) -> DataFrame:
    """Candidates of every recording that deserve a visual scan. The rank limit prunes before the shuffle."""
    length = F.greatest(F.lit(0.0), F.col("end_seconds") - F.col("start_seconds"))
    priority = (
        F.col("audio_event_score") * 1.5 + F.col("game_reaction_score") + F.greatest(F.lit(0.0), F.col("voice_expression_score")) * 0.5
        + F.least(F.lit(12.0), spoken_words / 5.0) + F.least(F.lit(4.0), length / 10.0)
    )
    best = Window.partitionBy("video_id").orderBy(F.col("priority").desc(), "start_seconds", "id")
    return rows.withColumn("priority", priority).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= limit).drop("_rank")
