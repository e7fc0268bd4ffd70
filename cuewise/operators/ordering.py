"""Ranks and running sums that never put a whole key into one task.

A window over one key sorts all rows of that key in a single task. When a key may hold a third of the data, these
helpers cut every key into chunks by a value of the row, work inside the chunks, and add the offset of the earlier
chunks. Only one summary row per chunk is ever ordered per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.session import cut_lineage

CHUNK = 4096  # a window holds the whole rows of a chunk, texts too, and keeps up to so many in memory by itself


def _with_offset(frame: DataFrame, keys: Sequence[str], chunk: str, value: Column) -> DataFrame:
    """Attach ``_before``: the total of ``value`` over all earlier chunks of the same key."""
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = frame.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    offsets = sums.select(*keys, chunk, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return frame.join(offsets, [*keys, chunk])


def chunked_row_number(frame: DataFrame, keys: Sequence[str], order: str, out: str, width: float = CHUNK) -> DataFrame:
    """Row number per key in the order of a unique numeric column; ``width`` values of it make one chunk."""
    cut = frame.withColumn("_chunk", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    return (
        _with_offset(cut, keys, "_chunk", F.lit(1))
        .withColumn(out, (F.col("_before") + F.row_number().over(inside)).cast("bigint"))
        .drop("_chunk", "_before")
    )


def chunked_running_sum(frame: DataFrame, keys: Sequence[str], order: str, value: str, out: str,
                        width: float = CHUNK) -> DataFrame:
    """Running sum per key, inclusive, in the order of a unique numeric column."""
    cut = frame.withColumn("_chunk", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_offset(cut, keys, "_chunk", F.col(value))
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_chunk", "_before")
    )


def ordered_index(frame: DataFrame, order: Sequence[Column], running: dict[str, Column] | None = None,
                  out: str = "rank") -> DataFrame:
    """Rank of every row in one total order over the whole frame, plus running sums in that order.

    The sort is Spark's own range sort, so equal leading values still spread over tasks. Its result is materialised
    once; positions inside each output partition are then shifted by the totals of the partitions before it.
    """
    running = running or {}
    sorted_rows = cut_lineage(frame.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    placed = sorted_rows.withColumn("_part", F.shiftright("_place", 33)).withColumn(
        "_local", F.col("_place") - F.shiftleft(F.col("_part"), 33) + 1)
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(
        F.count("*").alias("_rows"), *[F.sum(value).alias(f"_sum_{name}") for name, value in running.items()])
    # one row per sort partition, so its size is bounded by the number of shuffle partitions
    offsets = totals.select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in running])
    result = placed.join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_before") + F.col("_local")).cast("bigint"))
    for name, value in running.items():
        result = result.withColumn(name, F.col(f"_before_{name}") + F.sum(value).over(inside))
    helpers = ["_place", "_part", "_local", "_before", *[f"_before_{name}" for name in running]]
    return result.drop(*helpers)


def keyed_index(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], running: dict[str, Column] | None = None,
                out: str = "position") -> DataFrame:
    """Rank (from 1) and running sums inside every key, also when one key holds a large part of all rows.

    The frame is range-sorted by key and order, which splits a large key over several tasks, and materialised once.
    Ranks are local to a key's part in one task and shifted by the parts before it. Only keys that cross a task border
    need a shift, at most one per border, so the shifts are fewer than the tasks and safe to broadcast.
    """
    running = {out: F.lit(1)} | (running or {})
    placed = cut_lineage(frame.orderBy(*keys, *order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    totals = placed.groupBy(*keys, "_part").agg(*[F.sum(value).alias(f"_sum_{name}") for name, value in running.items()])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*keys, "_part", *[F.sum(f"_sum_{name}").over(earlier).alias(f"_before_{name}") for name in running])
    shifts = shifts.where(F.col(f"_before_{out}").isNotNull())
    inside = Window.partitionBy(*keys, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(shifts), [*keys, "_part"], "left")
    return joined.withColumns({
        name: (F.coalesce(F.col(f"_before_{name}"), F.lit(0)) + F.sum(value).over(inside)).cast("bigint") for name, value in running.items()
    }).drop("_place", "_part", *[f"_before_{name}" for name in running])


def exact_quantiles(values: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Interpolated quantiles per key. Equal values are counted first; ranks come from ``keyed_index``, so no task needs
    all values of a key."""
    present = values.where(F.col(column).isNotNull())
    counts = present.groupBy(*keys, column).agg(F.count("*").alias("_n"))
    ranked = keyed_index(counts, keys, [F.col(column)], {"_upto": F.col("_n")})
    totals = present.groupBy(*keys).agg(F.count("*").alias("_total"))
    joined = ranked.join(totals, list(keys))
    aggregates = []
    for i, share in enumerate(shares):
        place = (F.col("_total") - 1) * share
        aggregates += [F.min(F.when(F.col("_upto") > F.floor(place), F.col(column))).alias(f"_low{i}"),
                       F.min(F.when(F.col("_upto") > F.ceil(place), F.col(column))).alias(f"_high{i}"), F.first(place - F.floor(place)).alias(f"_rest{i}")]
    found = joined.groupBy(*keys).agg(*aggregates)
    return found.select(*keys, *[(F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_rest{i}")).alias(name) for i, name in enumerate(names)])


def best_per_key(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every key in the given order.

    The order columns must be ascending comparable expressions. ``min_by`` combines on the map side, so a hot key
    sends one row per task instead of all its rows.
    """
    columns = [name for name in frame.columns if name not in keys]
    packed = frame.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_best"))
    return packed.select(*keys, "_best.*")
