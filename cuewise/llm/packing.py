"""Best-fit packing into sequences of several permitted lengths.

Pieces (documents, cut where they exceed the largest length) are placed in falling order of length. A piece goes to the
open bin that it fills best; if none can hold it, a new bin is opened. The size of a new bin is the one whose estimated cost for each
token it will hold is least: a bin of capacity c costs ``overhead + c + c * c / quadratic`` and is expected to be filled
by pieces like the current one and the small pieces still to come. At the end every bin shrinks to the smallest permitted
length that holds its contents.

The table is dealt into batches of at most ``batch`` pieces which are packed on their own, each with an unfinished last
bin at worst; the batches do not depend on any key, so no id or length can crowd a task.

Defined cases: an empty or null text has no tokens and takes no part in a bin (``bin`` null, one row); a text longer than
the largest length gives several pieces; repeated rows are packed as often as they occur; no rows give no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (1024, 2048, 4096, 8192, 16384)
OVERHEAD, QUADRATIC = 64.0, 65536.0


def _cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / QUADRATIC


def choose_capacity(size: int, rest: int, capacities: Sequence[int]) -> int:
    """Permitted length with the least cost per token for a bin that starts with ``size``; ``rest`` tokens are to come."""
    fits = [c for c in capacities if c >= size]
    return min(fits, key=lambda c: (_cost(c) / min(c, size + rest), c))


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of every piece, and the final length of every bin."""
    capacities = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    rest = sum(sizes)
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    used: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for k in order:
        size = sizes[k]
        rest -= size
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            free, chosen = room.pop(at)
        else:
            free, chosen = choose_capacity(size, rest, capacities), len(used)
            used.append(0)
        bins[k], offsets[k] = chosen, used[chosen]
        used[chosen] += size
        if free > size:
            bisect.insort(room, (free - size, chosen))
    return bins, offsets, [next(c for c in capacities if c >= u) for u in used]


def best_fit(docs: DataFrame, length, id_column: str = "doc_id", capacities: Sequence[int] = CAPACITIES, batch: int = 20000) -> DataFrame:
    """(id, piece, tokens, bin, bin_offset, capacity): one row per piece; ``bin`` is unique over the whole result."""
    largest = max(capacities)
    sized = docs.select(F.col(id_column).alias("id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / largest)).cast("int")
    pieces = sized.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.least(
        F.lit(largest), F.col("n") - k.cast("long") * largest))).alias("piece", "tokens"))
    pieces = pieces.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        serial = 0

        def settle(held: list[pd.DataFrame]) -> pd.DataFrame:
            nonlocal serial
            frame = pd.concat(held, ignore_index=True)
            sizes = frame["tokens"].to_numpy()
            full = np.flatnonzero(sizes > 0)
            bins, offsets, lengths = pack(sizes[full].tolist(), capacities)
            place = np.full(len(frame), -1, np.int64)
            place[full] = bins
            names = [None if b < 0 else f"{p}-{serial + b}" for p, b in zip(frame["part"], place.tolist())]
            offset = pd.array([None] * len(frame), dtype="Int64")
            capacity = pd.array([None] * len(frame), dtype="Int64")
            offset[full] = offsets
            capacity[full] = [lengths[b] for b in bins]
            serial += len(lengths)
            return frame[["id", "piece", "tokens"]].assign(bin=names, bin_offset=offset, capacity=capacity)

        held: list[pd.DataFrame] = []
        rows = 0
        for frame in batches:
            for begin in range(0, len(frame), batch):
                piece = frame.iloc[begin:begin + batch]
                if rows + len(piece) > batch:
                    yield settle(held)
                    held, rows = [], 0
                held.append(piece)
                rows += len(piece)
        if held:
            yield settle(held)

    kind = sized.schema["id"].dataType.simpleString()
    return pieces.mapInPandas(run, f"id {kind}, piece int, tokens long, bin string, bin_offset long, capacity long")
