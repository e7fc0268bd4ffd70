"""Packing of transcript parts into candidate intervals, per recording and in time order.

Both operators walk through the parts of a recording. To keep a long recording out of a single task, its parts are cut
into chunks of a fixed number of positions; chunks are processed in parallel and only small summaries connect them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.functions.text import ascii_fold, blank_null
from cuewise.functions.vocab import DEFAULT_VOCABULARY, Vocabulary
from cuewise.operators.json_walk import pin
from cuewise.operators.ordering import chunked_row_number
from cuewise.session import cut_lineage

# --- fixed values: candidate limits in seconds
MIN_SECONDS, MAX_SECONDS, EXTRA_SECONDS, TAIL_SECONDS, MAX_GAP = 10.0, 36.0, 15.0, 3.0, 2.5


def numbered_parts(parts: DataFrame, order: str) -> DataFrame:
    """Parts with their position (from 0) in the recording."""
    return chunked_row_number(parts, ["video_id"], order, "position", width=4096).withColumn("position", F.col("position") - 1)


def next_starts(numbered: DataFrame) -> DataFrame:
    """For every part: where the next candidate begins if one begins here.

    A candidate closes at the first part that brings it to the minimum length, or before the first part that would make
    it too long. A part adds at least nothing, so the search looks ahead part by part inside a window of the recording's
    next parts; the window is bounded in time, not in rows.
    """
    width = 4.0 * MAX_SECONDS
    left = numbered.select("video_id", "position", F.col("start_seconds").alias("_from")).withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_from") + MAX_SECONDS) / width))))
    right = numbered.select("video_id", F.col("position").alias("_p"), F.col("start_seconds").alias("_s"), F.col("end_seconds").alias("_e")).withColumn(
        "_cell", F.floor(F.col("_s") / width))
    pairs = left.join(right, ["video_id", "_cell"]).where((F.col("_p") >= F.col("position")) & (F.col("_s") <= F.col("_from") + MAX_SECONDS))
    first_long = F.min(F.when(F.col("_e") - F.col("_from") >= MIN_SECONDS, F.struct(F.col("_p"), F.col("_e"))))
    found = pairs.groupBy("video_id", "position", "_from").agg(first_long.alias("_hit"), F.max("_p").alias("_seen"))
    # the part that reaches the minimum belongs to the candidate unless it makes it too long (and is not the first part)
    too_long = (F.col("_hit._e") - F.col("_from") > MAX_SECONDS) & (F.col("_hit._p") > F.col("position"))
    after = F.when(F.col("_hit").isNull(), F.col("_seen") + 1).when(too_long, F.col("_hit._p")).otherwise(F.col("_hit._p") + 1)
    return found.select("video_id", "position", after.cast("bigint").alias("next"), F.col("_hit").isNull().alias("_open"))


def _reached(jumps: DataFrame, chunk: int) -> DataFrame:
    """Positions visited when jumping from 0 along ``next`` in every recording.

    Inside a chunk the exit of every possible entry is found by one backward pass. The chain of chunk entries is then
    walked on one row per (chunk, entry) level by level, and finally every entered chunk marks its visited positions.
    """
    typed = jumps.withColumn("_chunk", F.floor(F.col("position") / chunk).cast("bigint"))
    kind = dict(jumps.dtypes)["video_id"]

    def exits(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        positions, following = group["position"].to_numpy(), group["next"].to_numpy()
        base, out = positions[0], np.empty(len(group), dtype="int64")
        for i in range(len(group) - 1, -1, -1):
            step = following[i] - base
            out[i] = out[step] if step < len(group) else following[i]
        return pd.DataFrame({"video_id": group["video_id"].iloc[0], "position": positions, "next": out})

    def marks(group: pd.DataFrame) -> pd.DataFrame:
        entries = group.loc[group["entered"], "position"]
        group = group.sort_values("position")
        positions, following = group["position"].to_numpy(), group["next"].to_numpy()
        base, seen = positions[0], []
        if len(entries):
            at = int(entries.iloc[0]) - base
            while at < len(group):
                seen.append(positions[at])
                at = following[at] - base
        return group.loc[group["position"].isin(seen), ["video_id", "position"]]

    # follow the chain of chunk entries: every jump leaves its chunk, and the set of known entries doubles its reach every round
    known, hop, reach = typed.where("position = 0").select("video_id", "position"), None, 1
    chunks = (typed.agg(F.max("_chunk")).first()[0] or 0) + 1
    while reach < chunks:
        if hop is None:
            hop = cut_lineage(typed.groupBy("video_id", "_chunk").applyInPandas(exits, f"video_id {kind}, position bigint, next bigint"))
        else:
            onward = hop.select("video_id", F.col("position").alias("next"), F.col("next").alias("_then"))
            hop = cut_lineage(hop.join(onward, ["video_id", "next"], "left").select("video_id", "position", F.coalesce("_then", "next").alias("next")))
        known = cut_lineage(known.unionByName(known.join(hop, ["video_id", "position"]).select("video_id", F.col("next").alias("position"))).distinct())
        reach *= 2
    flagged = typed.join(known.withColumn("entered", F.lit(True)), ["video_id", "position"], "left").withColumn("entered", F.coalesce("entered", F.lit(False)))
    return flagged.groupBy("video_id", "_chunk").applyInPandas(marks, f"video_id {kind}, position bigint")


def pack_candidates(parts: DataFrame, order: str, chunk: int = 50_000) -> DataFrame:
    """Candidate intervals as (video_id, first, last, start_seconds, end_seconds) in positions of the numbered parts."""
    numbered = cut_lineage(numbered_parts(parts, order))
    jumps = cut_lineage(next_starts(numbered))
    starts = _reached(jumps.select("video_id", "position", "next"), chunk)
    spans = starts.join(jumps, ["video_id", "position"]).select("video_id", F.col("position").alias("first"), (F.col("next") - 1).alias("last"), "_open")
    edges = numbered.select("video_id", "position", "start_seconds", "end_seconds")
    sized = (spans.join(edges.select("video_id", F.col("position").alias("first"), "start_seconds"), ["video_id", "first"])
             .join(edges.select("video_id", F.col("position").alias("last"), "end_seconds"), ["video_id", "last"]))
    final = edges.groupBy("video_id").agg(F.max("position").alias("_end"))
    kept = sized.join(final, "video_id").where(~((F.col("last") == F.col("_end")) & F.col("_open")) | (F.col("end_seconds") - F.col("start_seconds") >= TAIL_SECONDS))
    return kept.select("video_id", "first", "last", "start_seconds", "end_seconds")


def fixed_windows(durations: DataFrame, seconds: int = int(MAX_SECONDS)) -> DataFrame:
    """Windows of the maximum length for recordings without speech."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("duration_seconds").cast("int") - 1), F.lit(seconds)), lambda s: s < F.floor(F.col("duration_seconds")))
    exploded = durations.select("video_id", F.explode(starts).alias("_start"), "duration_seconds")
    return exploded.select("video_id", F.col("_start").cast("double").alias("start_seconds"), F.least(F.col("_start") + F.lit(float(seconds)), F.col("duration_seconds")).alias("end_seconds"))


def _neighbouring(numbered: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Parts with what an alignment has to know of them: whether they end a sentence (``ends``), whether the next part follows
    without a break (``flows``), where that one ends (``next_e``), and whether it opens a punchline."""
    text = F.rtrim(F.regexp_replace(blank_null(F.col("text")), r"(?U)\s+$", ""))
    opener = ascii_fold(F.lower(F.regexp_replace(F.col("text"), r"(?U)^\s+", "")), stroked_l=False)
    slim = numbered.select("video_id", "position", F.col("start_seconds").alias("s"), F.col("end_seconds").alias("e"), F.coalesce(text.rlike(r"[.!?]$"), F.lit(False)).alias("ends"),
                           F.coalesce(opener.rlike("^(?:" + "|".join(vocab.punchline_starts) + ")"), F.lit(False)).alias("_opens"))
    after = slim.select("video_id", (F.col("position") - 1).alias("position"), F.col("s").alias("_next_s"), F.col("e").alias("next_e"), F.col("_opens").alias("punch"))
    return slim.drop("_opens").join(after, ["video_id", "position"], "left").withColumn("flows", F.coalesce(F.col("_next_s") - F.col("e") <= MAX_GAP, F.lit(False))).drop("_next_s")


def sentence_bounds(candidates: DataFrame, parts: DataFrame, order: str, durations: DataFrame | None = None,
                    vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Extend candidates over unfinished sentences, and over one following punchline.

    An extension ends at its nearest obstacle: a sentence end, a break in speech, or a part that would make the candidate
    too long. So the new first part comes right after the last obstacle before the candidate, and the new last part is the
    first obstacle from its end on; the same rule, applied once more, finishes a punchline. A candidate can only grow to
    the maximum length plus a fixed extra, so it meets its obstacles among the parts within that time, which are brought
    together by time cells.
    """
    reach = MAX_SECONDS + EXTRA_SECONDS
    slim = _neighbouring(numbered_parts(parts, order), vocab)
    width = 4.0 * reach
    low, high = F.floor(F.greatest(F.lit(0.0), F.col("start_seconds") - reach) / width), F.floor((F.col("end_seconds") + reach) / width)
    spans = candidates.withColumn("_low", low).withColumn("_cell", F.explode(F.sequence(low, high)))
    # a part may last longer than a cell; a pair counts in the first cell that both have
    near = slim.withColumn("_part_low", F.floor(F.col("s") / width)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.greatest("s", "e") / width))))
    joined = spans.join(near, ["video_id", "_cell"]).where((F.col("_cell") == F.greatest("_low", "_part_low")) & (F.col("e") >= F.col("start_seconds") - reach) & (F.col("s") <= F.col("end_seconds") + reach))
    listed = joined.groupBy("video_id", "first", "last", "start_seconds", "end_seconds").agg(
        F.array_sort(F.collect_list(F.struct("position", "s", "e", "ends", "flows", "next_e", "punch"))).alias("near"))
    limit = listed if durations is None else listed.join(durations, "video_id", "left")
    limit = limit.withColumn("longest", F.lit(reach) if durations is None else F.least(F.lit(reach), F.col("duration_seconds")))

    def places(condition) -> Column:
        return F.transform(F.filter("near", condition), lambda p: p["position"])

    def part(position: str) -> Column:
        return F.get(F.filter("near", lambda p: p["position"] == F.col(position)), F.lit(0))

    def obstacle(p: Column) -> Column:
        """No extension from this part to the next one."""
        return p["ends"] | ~p["flows"] | (p["next_e"] - F.col("_head.s") > F.col("longest"))

    def first_obstacle(since: Column) -> Column:
        return F.coalesce(F.array_min(places(lambda p: (p["position"] >= since) & obstacle(p))), F.element_at("near", -1)["position"])

    given = pin(limit, _from=F.coalesce(F.array_min(places(lambda p: p["e"] >= F.col("start_seconds"))), F.get("near", F.lit(0))["position"]),
                _to=F.array_max(places(lambda p: p["s"] <= F.col("end_seconds"))))
    tailed = pin(given, _tail=part("_to"))
    before = places(lambda p: (p["position"] < F.col("_from")) & (p["ends"] | ~p["flows"] | (F.col("_tail.e") - p["s"] > F.col("longest"))))
    headed = pin(pin(tailed, _begin=F.coalesce(F.array_max(before) + 1, F.get("near", F.lit(0))["position"])), _head=part("_begin"))
    finished = pin(pin(headed, _end=first_obstacle(F.col("_to"))), _last=part("_end"))
    punch = F.coalesce(F.col("_last.ends") & F.col("_last.flows") & F.col("_last.punch") & (F.col("_last.next_e") - F.col("_head.s") <= F.col("longest")), F.lit(False))
    extended = pin(pin(pin(finished, _punch=punch), _stop=F.when(F.col("_punch"), first_obstacle(F.col("_end") + 1)).otherwise(F.col("_end"))), _foot=part("_stop"))
    notes = F.array_compact(F.array(F.when(F.col("_begin") != F.col("_from"), "start aligned to sentence"), F.when(F.col("_end") != F.col("_to"), "end aligned to sentence"),
                                    F.when(F.col("_punch"), "extended to punchline")))
    return extended.select("video_id", F.col("_begin").alias("first"), F.col("_stop").alias("last"), F.col("_head.s").alias("start_seconds"), F.col("_foot.e").alias("end_seconds"),
                           notes.alias("boundary_signals"))


def with_text(spans: DataFrame, parts: DataFrame, order: str) -> DataFrame:
    """Text of every candidate from its parts."""
    numbered = numbered_parts(parts, order).select("video_id", "position", "text")
    wanted = spans.select("video_id", "first", "last").distinct().withColumn("position", F.explode(F.sequence("first", "last")))
    listed = wanted.join(numbered, ["video_id", "position"]).groupBy("video_id", "first", "last").agg(
        F.array_sort(F.collect_list(F.struct("position", "text"))).alias("_parts"))
    text = F.trim(F.array_join(F.transform("_parts", lambda part: part["text"]), " "))
    return spans.join(listed.select("video_id", "first", "last", text.alias("transcript")), ["video_id", "first", "last"])
