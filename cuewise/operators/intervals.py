"""Joins by time range.

A plain range condition makes Spark compare every pair. Here time is cut into cells; the interval side is repeated for
the few cells it covers, both sides meet by (recording, cell) and the exact condition is checked on the survivors. The
cell is part of the join key, so one long recording spreads over many tasks, and adaptive execution can still split a
crowded cell because nothing downstream depends on the join's partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from cuewise.session import bounded_batches


def cells(low: Column, high: Column, width: float) -> Column:
    """Numbers of the time cells that an interval touches."""
    return F.sequence(F.floor(low / width), F.floor(F.greatest(low, high) / width))


def range_join(spans: DataFrame, points: DataFrame, key: str, low: str, high: str, at: str, width: float,
               salts: int = 1) -> DataFrame:
    """Pairs of a span and a point of the same recording with ``low <= at <= high``; each pair once.

    ``salts`` > 1 splits every cell for sessions that run without adaptive skew handling.
    """
    left = spans.withColumn("_cell", F.explode(cells(F.col(low), F.col(high), width)))
    right = points.withColumn("_cell", F.floor(F.col(at) / width))
    on = [key, "_cell"]
    if salts > 1:
        left = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        right = right.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
        on.append("_salt")
    return left.join(right, on).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_cell", "_salt")


def overlap_semi_join(rows: DataFrame, ranges: DataFrame, key: str, width: float, margin: float, same_id: str) -> DataFrame:
    """Rows whose interval comes within ``margin`` seconds of a range of another row."""
    low, high = F.greatest(F.lit(0.0), F.col("range_start") - margin), F.col("range_end") + margin
    wanted = ranges.select(key, F.col(same_id).alias("_other"), low.alias("_low"), high.alias("_high")).withColumn(
        "_cell", F.explode(cells(F.col("_low"), F.col("_high"), width)))
    spread = rows.withColumn("_cell", F.explode(cells(F.col("start_seconds"), F.col("end_seconds"), width)))
    condition = (
        (spread[key] == wanted[key]) & (spread["_cell"] == wanted["_cell"]) & (spread[same_id] != wanted["_other"])
        & (spread["end_seconds"] >= wanted["_low"]) & (spread["start_seconds"] <= wanted["_high"])
    )
    return spread.join(wanted, condition, "left_semi").drop("_cell").dropDuplicates([key, same_id])


def _edge_text(pairs: DataFrame, keys: Sequence[str], newest_first: bool, chars: int, out: str) -> DataFrame:
    """Ordered text of the items nearest to one edge.

    Every item adds at least one character (its separator), so the nearest ``chars`` + 2 items decide the result and
    the list collected per row stays bounded.
    """
    order = [F.col("_item_start"), F.col("_item_order")]
    near = Window.partitionBy(*keys).orderBy(*([column.desc() for column in order] if newest_first else order))
    kept = pairs.withColumn("_rank", F.row_number().over(near)).where(F.col("_rank") <= chars + 2)
    listed = F.array_sort(F.collect_list(F.struct("_item_start", "_item_order", "_item_text")))
    joined = F.array_join(F.transform(listed, lambda item: item["_item_text"]), " ")
    cut = F.right(joined, F.lit(chars)) if newest_first else F.left(joined, F.lit(chars))
    return kept.groupBy(*keys).agg(cut.alias(out))


def attach_neighbour_text(spans: DataFrame, items: DataFrame, window: float, chars: int, key: str = "video_id",
                          span_id: str = "id", item_id: str = "item_id", text: str = "text",
                          exclude_same: bool = False) -> DataFrame:
    """Add ``context_before`` / ``context_after``: text of items that end or start within ``window`` seconds of a span."""
    keys = [key, span_id]
    slim = spans.select(*keys, F.col("start_seconds").alias("_start"), F.col("end_seconds").alias("_end"))
    pieces = items.where(F.coalesce(F.col(text), F.lit("")) != "").select(
        key, F.col("start_seconds").alias("_item_start"), F.col("end_seconds").alias("_item_end"),
        F.col(item_id).alias("_item_order"), F.trim(text).alias("_item_text"))
    width = max(4.0 * window, 30.0)
    before = range_join(slim.withColumn("_low", F.col("_start") - window).withColumn("_high", F.col("_start")),
                        pieces, key, "_low", "_high", "_item_end", width)
    after = range_join(slim.withColumn("_low", F.col("_end")).withColumn("_high", F.col("_end") + window),
                       pieces, key, "_low", "_high", "_item_start", width)
    if exclude_same:
        before, after = (side.where(F.col(span_id) != F.col("_item_order")) for side in (before, after))
    result = spans.join(_edge_text(before, keys, True, chars, "context_before"), keys, "left").join(
        _edge_text(after, keys, False, chars, "context_after"), keys, "left")
    return result.withColumns({name: F.coalesce(F.col(name), F.lit("")) for name in ("context_before", "context_after")})


def snap_to_boundaries(spans: DataFrame, boundaries: DataFrame, durations: DataFrame | None = None, tolerance: float = 2.5,
                       minimum: float = 3.0, key: str = "video_id", span_id: str = "id") -> DataFrame:
    """Move both edges to the nearest boundary within the tolerance, if at least ``minimum`` seconds remain."""
    edges = spans.select(key, span_id, F.explode(F.array(
        F.struct(F.lit("start").alias("edge"), F.col("start_seconds").alias("place")),
        F.struct(F.lit("end").alias("edge"), F.col("end_seconds").alias("place")))).alias("e")).select(key, span_id, "e.*")
    reach = edges.withColumn("_low", F.col("place") - tolerance).withColumn("_high", F.col("place") + tolerance)
    marks = boundaries.select(key, F.col("boundary"))
    close = range_join(reach, marks, key, "_low", "_high", "boundary", 30.0)
    nearest = close.groupBy(key, span_id).agg(*[
        F.min(F.when(F.col("edge") == edge, F.struct(F.abs(F.col("boundary") - F.col("place")), F.col("boundary")))).alias(f"_{edge}")
        for edge in ("start", "end")])
    joined = spans.join(nearest, [key, span_id], "left")
    start = F.coalesce(F.col("_start.boundary"), F.col("start_seconds"))
    end = F.coalesce(F.col("_end.boundary"), F.col("end_seconds"))
    if durations is not None:
        joined = joined.join(durations.select(key, "duration_seconds"), key, "left")
    limit = F.col("duration_seconds") if durations is not None else F.lit(None).cast("double")
    fits = end - start >= minimum
    return joined.withColumn("snapped_start", F.when(fits, F.greatest(F.lit(0.0), start)).otherwise(F.col("start_seconds"))).withColumn(
        "snapped_end", F.when(fits, F.least(end, F.coalesce(limit, end))).otherwise(F.col("end_seconds"))).drop("_start", "_end")


def pad_interval(start: Column, end: Column, duration: Column, lead: float = 0.6, tail: float = 1.0) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), start - lead), F.least(duration, end + tail)


@F.arrow_udf(ArrayType(IntegerType()))
def _running_totals(lengths: pa.Array) -> pa.Array:
    """Cumulative sums of each row's token lengths. Only these integers leave the JVM.

    A fold over the array would copy its state once per token; exploding the words would shuffle all of them.
    """
    if not len(lengths):
        return pa.array([], pa.list_(pa.int32()))
    offsets = lengths.offsets.to_numpy() - lengths.offsets[0].as_py()
    sums = np.concatenate([[0], np.cumsum(lengths.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
    inside = sums[1:] - np.repeat(sums[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(inside, pa.int32()))


# ---- words inside one segment ------------------------------------------------------------------------------------
def word_times(rows: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """One row per white-space token of the text, timed in proportion to token length."""
    from cuewise.functions.text import white_tokens

    bounded_batches(rows.sparkSession)
    listed = rows.withColumn("_tokens", white_tokens(F.col(text)))
    running = _running_totals(F.transform(F.col("_tokens"), lambda token: F.length(token)))
    timed = listed.withColumn("_ends", running).where(F.size("_tokens") > 0)
    total = F.element_at("_ends", -1)
    exploded = timed.select(*rows.columns, "_ends", total.alias("_total"), F.posexplode("_tokens").alias("position", "word"))
    span, right = F.col(end) - F.col(start), F.get("_ends", F.col("position"))
    left = right - F.length("word")
    return exploded.select(
        *rows.columns, "position", "word", (F.col(start) + span * left / F.col("_total")).alias("word_start"),
        (F.col(start) + span * right / F.col("_total")).alias("word_end"))


def pause_ranges(words: DataFrame, keys: Sequence[str], duration: Column, threshold: float = 0.85, padding: float = 0.12,
                 shortest: float = 0.08, clips: DataFrame | None = None) -> DataFrame:
    """Ranges kept after removing long pauses; word times are relative to the clip.

    A gap is measured against the latest end so far; every long gap opens a new island. A clip without a usable word, or
    whose ranges are all too short, is kept whole. ``clips`` has all clips, one row each, with the columns of ``duration``;
    without it only clips that occur in ``words`` are known.
    """
    by_start = Window.partitionBy(*keys).orderBy("left", "right")
    clean = words.select(*keys, duration.alias("_duration"), F.greatest(F.lit(0.0), F.col("word_start")).alias("left"),
                         F.least(duration, F.col("word_end")).alias("right")).where(F.col("right") > F.col("left"))
    previous = F.max("right").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    marked = clean.withColumn("_previous", previous).withColumn(
        "_break", (F.col("left") - F.col("_previous") >= threshold).cast("int"))
    islands = marked.withColumn("_island", F.sum(F.coalesce("_break", F.lit(0))).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = islands.groupBy(*keys, "_island").agg(
        F.min("left").alias("_first"), F.max("right").alias("_own_last"), F.max("_previous").alias("_seen"),
        F.first("_duration").alias("_duration"))
    in_order = Window.partitionBy(*keys).orderBy("_island")
    # an island ends at the largest end seen up to it
    last = F.max("_own_last").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    final = F.lead("_island").over(in_order).isNull()
    ranged = bounds.withColumn("_last", last).withColumn("_final", final).select(
        *keys, "_duration", "_island",
        F.when(F.col("_island") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("_first") - padding)).alias("range_start"),
        F.when(F.col("_final"), F.col("_duration")).otherwise(F.least(F.col("_duration"), F.col("_last") + padding)).alias("range_end"))
    kept = ranged.where(F.col("range_end") - F.col("range_start") >= shortest).drop("_duration").withColumnRenamed("_island", "island")
    known = words.groupBy(*keys).agg(F.max(duration).alias("range_end")) if clips is None else clips.select(*keys, duration.alias("range_end"))
    whole = known.join(kept.select(*keys).distinct(), list(keys), "left_anti").select(
        *keys, F.lit(0).cast(kept.schema["island"].dataType).alias("island"), F.lit(0.0).alias("range_start"), F.col("range_end").cast("double").alias("range_end"))
    return kept.unionByName(whole)


def kept_offsets(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Position of every kept range on the timeline without pauses."""
    earlier = Window.partitionBy(*keys).orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("offset", F.coalesce(F.sum(F.col("range_end") - F.col("range_start")).over(earlier), F.lit(0.0)))


def remap_words(words: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Word times on the timeline that remains after the pauses are cut out."""
    placed = kept_offsets(ranges, keys)
    joined = words.join(placed.hint("shuffle_hash"), list(keys))  # the ranges are few, so the words need no sort
    left, right = F.greatest("range_start", "word_start"), F.least("range_end", "word_end")
    moved = F.col("offset") - F.col("range_start")
    return joined.where(right > left).select(
        *words.columns, "range_start", (left + moved).alias("new_start"), (right + moved).alias("new_end"))


def hook_reorder(words: DataFrame, start: Column, end: Column, hook_seconds: float) -> DataFrame:
    """Word times after the last ``hook_seconds`` are moved to the front; words crossing the cut are dropped."""
    split = end - start - hook_seconds
    left, right = F.col("word_start") - start, F.col("word_end") - start
    inside = words.where((right > 0) & (left < end - start) & ((left >= split) | (right <= split)))
    shift = F.when(left >= split, -split).otherwise(F.lit(float(hook_seconds)))
    return inside.select(*words.columns, (F.col("word_start") + shift).alias("new_start"), (F.col("word_end") + shift).alias("new_end"))


def censor_ranges(words: DataFrame, duration: Column, stems) -> DataFrame:
    """Second half of every profane word."""
    from cuewise.functions.tags import is_profane

    left = F.greatest(F.lit(0.0), F.col("word_start") + (F.col("word_end") - F.col("word_start")) / 2)
    right = F.least(duration, F.col("word_end"))
    return words.where(is_profane(F.col("word"), stems)).withColumns({"mute_start": left, "mute_end": right}).where(
        F.col("mute_end") > F.col("mute_start"))
