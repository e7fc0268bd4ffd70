"""Vector expressions on ``array<double>`` columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda total, x: total + x)


def norm(value: Column) -> Column:
    return F.sqrt(F.aggregate(value, F.lit(0.0), lambda total, x: total + x * x))


def cosine(left: Column, right: Column) -> Column:
    """Cosine; 0 if one side has no length."""
    size = norm(left) * norm(right)
    return F.when(size > 0, dot(left, right) / size).otherwise(F.lit(0.0))


def hashed_vectors(frame: DataFrame, key: str, text: str, out: str, dimensions: int = 64) -> DataFrame:
    """Deterministic stand-in vectors for texts: normalised counts of hashed words.

    Words are counted per slot with a map-side aggregate; a text has at most ``dimensions`` slots when they are packed.
    """
    from cuewise.functions.text import tokens

    slot = F.pmod(F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int")
    words = frame.select(key, F.explode(tokens(F.col(text))).alias("word"))
    counts = words.groupBy(key, slot.alias("slot")).agg(F.count("*").cast("double").alias("n"))
    packed = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("_slots"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("_length"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("_slots", i), F.lit(0.0)) / F.col("_length"))
    built = packed.select(key, dense.alias(out))
    empty = F.array_repeat(F.lit(0.0), dimensions)
    return frame.join(built, key, "left").withColumn(out, F.coalesce(F.col(out), empty))


def unit_radius(threshold: float) -> float:
    """Distance between unit vectors whose cosine equals the threshold."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * threshold))
