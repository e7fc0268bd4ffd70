"""Varied picks per recording: strong moments that are apart in time and not all of one kind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.tags import variety_tags
from cuewise.operators.similarity import suppress_duplicates
from cuewise.session import cut_lineage

APART_SECONDS = 35.0



def _greedy(group: pd.DataFrame, wanted: int, more_outside: bool) -> list[int]:
    """Positions to pick next, in order.

    Rows outside the group score no better than its weakest row did when the group was cut, and scores only fall as
    tags get used. So a pick is certain while its current score is above that bound; the first one always is.
    """
    used = set(group["used"].iloc[0])
    floor = group["value"].min() if more_outside else -1e18
    left = list(range(len(group)))
    rows = group.to_dict("records")
    picked: list[int] = []
    while left and len(picked) < wanted:
        def rate(i: int) -> tuple:
            row = rows[i]
            value = row["ranking_score"] * 0.65 + row["short"] * 0.35 - min(12.0, 3.0 * len(set(row["variety"]) & used))
            return value, row["short"], row["ranking_score"], -row["start_seconds"], -i
        best = max(left, key=rate)
        if picked and rate(best)[0] <= floor:
            break
        picked.append(best)
        used |= set(rows[best]["variety"])
        start, end = rows[best]["start_seconds"], rows[best]["end_seconds"]
        left = [i for i in left if not (rows[i]["start_seconds"] <= end + APART_SECONDS and start <= rows[i]["end_seconds"] + APART_SECONDS)]
    return picked


def best_of_stream(scored: DataFrame, limit: int = 10, window: int = 512) -> DataFrame:
    """Up to ``limit`` picks per recording, with their order in ``pick``.

    Every round takes the ``window`` best remaining rows of each recording (pruned before the shuffle), makes all picks
    that are certain on them, and drops what those picks block. Usually one round is enough; recordings that need more
    rows get further rounds, at least one pick each, so no recording has to fit into one task.
    """
    short = F.greatest(F.lit(0.0), F.coalesce(F.col("short_potential_score"), F.lit(0)).cast("double"))
    pool = suppress_duplicates(scored).select(
        "video_id", "id", "start_seconds", "end_seconds", F.col("ranking_score").cast("double").alias("ranking_score"), short.alias("short"),
        variety_tags(F.col("tags")).alias("variety"))
    pool = cut_lineage(pool)
    types = dict(pool.dtypes)
    schema = f"video_id {types['video_id']}, id {types['id']}, start_seconds double, end_seconds double, variety array<string>, turn int, open boolean"

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start_seconds", "id"]).reset_index(drop=True)
        more = bool(group["total"].iloc[0] > len(group))
        wanted = int(limit - group["done"].iloc[0])
        picks = _greedy(group, wanted, more)
        chosen = group.loc[picks, ["video_id", "id", "start_seconds", "end_seconds", "variety"]].copy()
        chosen["turn"] = range(1, len(chosen) + 1)
        chosen["open"] = more and len(picks) < wanted
        return chosen

    remaining, picks = pool, None
    for _ in range(limit):
        if picks is None:
            state = remaining.withColumns({"used": F.array().cast("array<string>"), "done": F.lit(0)})
        else:
            # at most ``limit`` picks per recording
            seen = picks.groupBy("video_id").agg(
                F.array_distinct(F.flatten(F.collect_list("variety"))).alias("used"), F.count("*").cast("int").alias("done"),
                F.collect_list(F.struct("start_seconds", "end_seconds")).alias("taken"), F.max_by("open", "pick").alias("unfinished"))
            blocked = F.exists("taken", lambda t: (F.col("start_seconds") <= t["end_seconds"] + APART_SECONDS) & (t["start_seconds"] <= F.col("end_seconds") + APART_SECONDS))
            state = remaining.join(seen, "video_id").where(F.col("unfinished") & ~blocked).drop("taken", "unfinished")
        state = state.withColumn("value", F.col("ranking_score") * 0.65 + F.col("short") * 0.35
                                 - F.least(F.lit(12.0), F.size(F.array_intersect("variety", "used")) * 3.0))
        order = Window.partitionBy("video_id").orderBy(F.col("value").desc(), F.col("short").desc(), F.col("ranking_score").desc(), "start_seconds", "id")
        head = state.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= window).drop("_rank")
        sizes = state.groupBy("video_id").agg(F.count("*").alias("total"))
        made = head.join(sizes, "video_id").groupBy("video_id").applyInPandas(choose, schema)
        if picks is not None:
            base = picks.groupBy("video_id").agg(F.max("pick").alias("_base"))
            made = made.join(base, "video_id").withColumn("pick", F.col("_base") + F.col("turn")).drop("_base", "turn")
        else:
            made = made.withColumnRenamed("turn", "pick")
        made = cut_lineage(made)
        picks = made if picks is None else cut_lineage(picks.unionByName(made))
        if made.where("open").isEmpty():
            break
    chosen = picks.select("video_id", "id", "pick")
    note = F.concat_ws("; ", F.nullif("ranking_reason", F.lit("")), F.concat(
        F.lit("Best of stream: distinct moment, short potential "), F.coalesce("short_potential_score", F.lit(0)).cast("string"), F.lit("/99")))
    return scored.join(chosen, ["video_id", "id"]).withColumn("ranking_reason", note)
