"""Scores from audio windows: energy percentiles, events with a response, vocal delivery, windowed energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.text import clip, half_even
from cuewise.operators.ordering import exact_quantiles

WINDOW_SECONDS = 0.25


def energy_percentiles(windows: DataFrame, columns: list[str], shares: list[float], key: str = "video_id") -> DataFrame:
    """Exact interpolated percentiles per recording, as ``<column>_p<share>``."""
    result = None
    for column in columns:
        part = exact_quantiles(windows, [key], column, shares, [f"{column}_p{round(share * 100)}" for share in shares])
        result = part if result is None else result.join(part, key)
    return result


def _window_index(seconds: Column) -> Column:
    return F.floor(seconds / WINDOW_SECONDS)


def segment_windows(segments: DataFrame, windows: DataFrame, first: Column, last: Column, cell: int = 1024) -> DataFrame:
    """Windows with ``first <= idx < last`` of every segment, joined by blocks of window numbers."""
    framed = segments.withColumns({"_first": first, "_last": last})
    left = framed.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_first") / cell), F.floor(F.greatest("_first", F.col("_last") - 1) / cell))))
    right = windows.withColumn("_cell", F.floor(F.col("idx") / cell))
    return left.join(right, ["video_id", "_cell"]).where((F.col("idx") >= F.col("_first")) & (F.col("idx") < F.col("_last"))).drop("_cell")


def event_response_scores(segments: DataFrame, windows: DataFrame, lead_seconds: float = 2.5, response_seconds: float = 2.0,
                          after_start_seconds: float = 3.0) -> DataFrame:
    """0..16: a loud event near the start of a segment that a stronger microphone response follows.

    Only windows around the start of a segment matter, so each segment meets a short list of windows; the three loudest
    events are examined with array expressions.
    """
    limits = energy_percentiles(windows, ["game"], [0.95, 0.99]).join(energy_percentiles(windows, ["mic"], [0.93, 0.99]), "video_id")
    sizes = windows.groupBy("video_id").agg((F.max("idx") + 1).alias("_length"))
    lead, response, after = (round(s / WINDOW_SECONDS) for s in (lead_seconds, response_seconds, after_start_seconds))
    begin = F.greatest(F.lit(0), _window_index(F.col("start_seconds")))
    framed = segments.select("video_id", "id", "start_seconds", "end_seconds").join(sizes, "video_id").withColumn("_begin", begin).withColumn(
        "_left", F.greatest(F.lit(0), F.col("_begin") - lead)).withColumn(
        "_right", F.least(F.col("_length"), F.greatest(F.col("_left") + 1, F.ceil(F.col("end_seconds") / WINDOW_SECONDS)))).withColumn(
        "_events_end", F.least(F.col("_right"), F.col("_begin") + after))
    near = segment_windows(framed, windows, F.col("_left"), F.least(F.col("_right"), F.col("_begin") + after + response + 1))
    # the list covers lead + start + response, a fixed number of windows
    lists = near.groupBy("video_id", "id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "game", "mic"))).alias("_w"), F.first("_begin").alias("_begin"), F.first("_left").alias("_left"),
        F.first("_right").alias("_right"), F.first("_events_end").alias("_events_end")).join(limits, "video_id")
    game_spread, mic_spread = F.greatest(F.lit(1.0), F.col("game_p99") - F.col("game_p95")), F.greatest(F.lit(1.0), F.col("mic_p99") - F.col("mic_p93"))
    events = F.filter("_w", lambda w: w["idx"] < F.col("_events_end"))
    loudest = F.slice(F.reverse(F.array_sort(F.transform(events, lambda w: F.struct(w["game"].alias("game"), w["idx"].alias("idx"))))), 1, 3)

    def value(event: Column) -> Column:
        start = F.greatest(F.col("_begin"), event["idx"] + 1)
        peak = F.array_max(F.transform(F.filter("_w", lambda w: (w["idx"] >= start) & (w["idx"] < F.least(F.col("_right"), start + response))), lambda w: w["mic"]))
        past = F.sort_array(F.transform(F.filter("_w", lambda w: (w["idx"] >= F.greatest(F.col("_left"), event["idx"] - 4)) & (w["idx"] <= event["idx"])), lambda w: w["mic"]))
        middle = F.size(past) / 2
        before = (F.get(past, F.floor((F.size(past) - 1) / 2).cast("int")) + F.get(past, F.floor(middle).cast("int"))) / 2
        fits = (event["game"] >= F.col("game_p95")) & (peak >= F.col("mic_p93")) & (peak > before * 1.16)
        strength = (F.greatest(F.lit(0.0), (event["game"] - F.col("game_p95")) / game_spread) * 5 + F.greatest(F.lit(0.0), (peak - F.col("mic_p93")) / mic_spread) * 7
                    + F.greatest(F.lit(0.0), (peak - before) / mic_spread) * 6)
        return F.when(fits, strength).otherwise(F.lit(0.0))

    best = F.greatest(F.lit(0.0), F.array_max(F.transform(loudest, value)))
    scored = lists.select("video_id", "id", clip(half_even(best), 0, 16).cast("int").alias("game_reaction_score"))
    return segments.select("video_id", "id").join(scored, ["video_id", "id"], "left").fillna(0, ["game_reaction_score"])


def voice_delivery_scores(segments: DataFrame, windows: DataFrame, tempo: DataFrame) -> DataFrame:
    """-8 for flat, 7..16 for expressive delivery, else 0. ``tempo`` holds (video_id, id, tempo_cv) with null for unknown."""
    floors = energy_percentiles(windows, ["energy"], [0.55]).select("video_id", F.greatest(F.lit(40.0), F.col("energy_p55") * 0.55).alias("_floor"))
    sizes = windows.groupBy("video_id").agg((F.max("idx") + 1).alias("_length"))
    framed = segments.select("video_id", "id", "start_seconds", "end_seconds").join(sizes, "video_id").withColumn("_left", F.greatest(F.lit(0), _window_index(F.col("start_seconds"))))
    last = F.least(F.col("_length"), F.greatest(F.col("_left") + 1, F.ceil(F.col("end_seconds") / WINDOW_SECONDS)))
    section = segment_windows(framed, windows, F.col("_left"), last).join(floors, "video_id")
    voiced = F.col("energy") >= F.col("_floor")
    level, tone = F.when(voiced, F.log1p("energy")), F.when(voiced, F.col("tone"))
    measured = section.groupBy("video_id", "id").agg(
        F.count("*").alias("_windows"), F.count(level).alias("_voiced"), F.percentile(level, F.array(F.lit(0.25), F.lit(0.85))).alias("_p"),
        F.stddev_pop(tone).alias("_sd"), F.avg(tone).alias("_mean"))
    joined = segments.select("video_id", "id", (F.col("end_seconds") - F.col("start_seconds")).alias("_duration")).join(measured, ["video_id", "id"], "left").join(tempo, ["video_id", "id"], "left")
    span = F.get("_p", F.lit(1)) - F.get("_p", F.lit(0))
    cv = F.when(F.col("_mean") > 0, F.col("_sd") / F.greatest(F.lit(0.002), F.col("_mean"))).otherwise(0.0)
    level_change, tone_change = clip((span - 0.28) / 0.72, 0.0, 1.0), clip((cv - 0.13) / 0.22, 0.0, 1.0)
    tempo_change = F.when(F.col("tempo_cv").isNotNull(), clip((F.col("tempo_cv") - 0.24) / 0.46, 0.0, 1.0))
    shown = joined.withColumns({"_level": level_change, "_tone": tone_change, "_tempo": tempo_change})
    changed = sum((F.when(F.col(c) >= 0.48, 1).otherwise(0) for c in ("_level", "_tone", "_tempo")), F.lit(0))
    combined = F.col("_level") * 0.42 + F.col("_tone") * 0.34 + F.coalesce("_tempo", F.lit(0.0)) * 0.24
    enough = (F.coalesce("_windows", F.lit(0)) >= 8) & (F.coalesce("_voiced", F.lit(0)) >= 5)
    score = (F.when(~enough, 0).when((changed >= 3) & (combined >= 0.70), clip(half_even(7 + combined * 9), 7, 16))
             .when((F.col("_duration") >= 15.0) & (F.col("_level") <= 0.30) & (F.col("_tempo") <= 0.20), -8).otherwise(0))
    return shown.select("video_id", "id", score.cast("int").alias("voice_expression_score"))


def tempo_variation(words: DataFrame, keys: list[str]) -> DataFrame:
    """Variation of the speaking rate over three equal parts; null for short or uneven clips. One row per segment."""
    length = F.col("end_seconds") - F.col("start_seconds")
    edges = [F.col("start_seconds") + length * i / 3 for i in (0, 1, 2)] + [F.col("end_seconds")]
    counted = words.groupBy(*keys, "start_seconds", "end_seconds").agg(
        F.count("*").alias("_words"), *[F.count(F.when((F.col("word_start") >= edges[i]) & (F.col("word_start") < edges[i + 1]), 1)).alias(f"_c{i}") for i in range(3)])
    part = F.greatest(F.lit(0.5), length / 3)
    rates = [F.col(f"_c{i}") / part for i in range(3)]
    mean = (rates[0] + rates[1] + rates[2]) / 3
    deviation = F.sqrt(sum(((rate - mean) * (rate - mean) for rate in rates), F.lit(0.0)) / 3)
    known = (F.col("_words") >= 8) & (length >= 5.0) & (F.least("_c0", "_c1", "_c2") > 0)
    return counted.select(*keys, F.when(known, deviation / F.greatest(F.lit(0.1), mean)).alias("tempo_cv"))


def energy_windows(samples: DataFrame, rate: int, window_seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Energy and sign-change rate of fixed windows over a samples table (video_id, sample_idx, x)."""
    frames = max(1, round(rate * window_seconds))
    indexed = samples.withColumn("idx", F.floor(F.col("sample_idx") / frames))
    within = Window.partitionBy("video_id", "idx").orderBy("sample_idx")
    paired = indexed.withColumn("_next", F.lead("x").over(within))
    gates = indexed.groupBy("video_id", "idx").agg(F.greatest(F.lit(80.0), F.percentile(F.abs("x"), F.lit(0.55)) * 0.25).alias("_gate"))
    joined = paired.join(gates, ["video_id", "idx"])
    active = (F.abs("x") >= F.col("_gate")) & (F.abs("_next") >= F.col("_gate"))
    crossing = active & (F.col("x") * F.col("_next") < 0)
    grouped = joined.groupBy("video_id", "idx").agg(
        F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("energy"), F.count(F.when(active, 1)).alias("_active"), F.count(F.when(crossing, 1)).alias("_cross"))
    return grouped.select("video_id", "idx", "energy", F.when(F.col("_active") > 0, F.col("_cross") / F.col("_active")).otherwise(0.0).alias("tone"))
