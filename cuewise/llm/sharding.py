"""Shards of near equal bytes over fixed virtual slots.

A record's id and text are hashed into one of a fixed number of virtual slots. Bytes and rows are added up per slot, and a
small versioned map tells which shard owns which slot. Version 1 deals the slots out evenly; ``rebalance`` edits the map
by the measured bytes and saves it as the next version; ``grow`` adds a shard that takes slots from the others and gives
none back. Moving a slot is one changed row of the map, whatever the slot holds.

A slot with more than ``CROWDED`` times its fair share of bytes or rows (one record repeated many times always hashes to
one slot) is owned in parts: its rows are dealt over the parts by the number they have in the stored table. The map hence
has at most ``slots * (1 + 2 / CROWDED)`` entries. It is the only thing the driver reads, and what is broadcast.

Positions inside a shard count through its slots in order: the map gives the first position of every slot, and rows are
numbered inside their slot or part only, so no task sees a whole shard.

Defined cases: a null text has no bytes and the CRC 0; rows without an id and repeated rows are records like any other; a
single text longer than a shard's share makes its shard that much larger, as texts are not split. Other columns are not
read. No rows give no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuewise.llm.common import shared_folder, stored

SLOTS = 4096
CROWDED = 4
MAP_SCHEMA = "version int, shards int, virtual_slot int, part int, parts int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """Owner of every (virtual slot, part). ``parts`` has the slots that are split."""

    version: int
    shards: int
    owners: dict[tuple[int, int], int]
    parts: dict[int, int]

    def rows(self) -> list[tuple[int, int, int, int, int, int]]:
        return [(self.version, self.shards, slot, part, self.parts.get(slot, 1), shard) for (slot, part), shard in sorted(self.owners.items())]


def even_map(shards: int, slots: int = SLOTS, parts: dict[int, int] | None = None) -> SlotMap:
    parts = parts or {}
    units = [(slot, part) for slot in range(slots) for part in range(parts.get(slot, 1))]
    return SlotMap(1, shards, {unit: k % shards for k, unit in enumerate(units)}, parts)


def rebalance(current: SlotMap, weight: dict[tuple[int, int], int]) -> SlotMap:
    """The next version: units move from the fullest to the emptiest shard, the best fitting one first, while that helps."""
    owners = dict(current.owners)
    held: list[list[tuple[int, tuple[int, int]]]] = [[] for _ in range(current.shards)]
    for unit, shard in owners.items():
        if weight.get(unit, 0):
            held[shard].append((weight[unit], unit))
    loads = [sum(w for w, _ in units) for units in held]
    for units in held:
        units.sort()
    while True:
        full, least = max(range(current.shards), key=lambda s: (loads[s], -s)), min(range(current.shards), key=lambda s: (loads[s], s))
        gap = loads[full] - loads[least]
        units = held[full]
        at = bisect_left(units, ((gap + 1) // 2, (-1, -1)))
        # a move helps if it weighs less than the gap; the best one weighs half of it
        fitting = [k for k in (at - 1, at) if 0 <= k < len(units) and units[k][0] < gap]
        if not fitting:
            return SlotMap(current.version + 1, current.shards, owners, current.parts)
        moved = units.pop(min(fitting, key=lambda k: abs(2 * units[k][0] - gap)))
        owners[moved[1]] = least
        insort(held[least], moved)
        loads[full] -= moved[0]
        loads[least] += moved[0]


def grow(current: SlotMap, weight: dict[tuple[int, int], int]) -> SlotMap:
    """The next version with one more shard, which takes units from the fullest shards until it has its share."""
    owners, new = dict(current.owners), current.shards
    held: list[list[tuple[int, tuple[int, int]]]] = [[] for _ in range(new)]
    for unit, shard in owners.items():
        held[shard].append((weight.get(unit, 0), unit))
    for units in held:
        units.sort()
    loads = [sum(w for w, _ in units) for units in held]
    share, got = sum(loads) / (new + 1), 0
    for full in sorted(range(new), key=lambda s: -loads[s]):
        while loads[full] > share and got < share:
            most = min(loads[full] - share, share - got)
            at = bisect_right(held[full], (int(most), (1 << 40, 0))) - 1
            if at < 0 or not held[full][at][0]:
                break
            w, unit = held[full].pop(at)
            owners[unit] = new
            loads[full] -= w
            got += w
    return SlotMap(current.version + 1, new + 1, owners, current.parts)


def save_map(spark: SparkSession, slot_map: SlotMap, folder: str) -> None:
    """Each version is written once; writing a version again fails."""
    spark.createDataFrame(slot_map.rows(), MAP_SCHEMA).coalesce(1).write.parquet(f"{folder.rstrip('/')}/version={slot_map.version}")


def load_map(spark: SparkSession, folder: str, version: int) -> SlotMap:
    found = spark.read.schema(MAP_SCHEMA).parquet(f"{folder.rstrip('/')}/version={version}").collect()
    return SlotMap(version, found[0]["shards"], {(r["virtual_slot"], r["part"]): r["shard"] for r in found},
                   {r["virtual_slot"]: r["parts"] for r in found if r["parts"] > 1})


def records(docs: DataFrame, id_column: str, text_column: str, slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, row) of every row, stored, so that rows keep their numbers."""
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    crc = F.crc32(text)
    return stored(docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"), crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_column).cast("string"), crc), F.lit(slots)).cast("int").alias("virtual_slot"), F.monotonically_increasing_id().alias("row")))


def crowded_parts(slot_rows: DataFrame, slots: int = SLOTS) -> dict[int, int]:
    """Number of parts of the slots that are far above their share; at most 2 / CROWDED of the number of slots in all."""
    found = slot_rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # a row per slot
    total, rows = sum(r["bytes"] for r in found), sum(r["n"] for r in found)
    wanted = {r["virtual_slot"]: min(r["n"], max(r["bytes"] * slots // (CROWDED * total), r["n"] * slots // (CROWDED * rows))) for r in found}
    return {slot: parts for slot, parts in wanted.items() if parts > 1}


def shard(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = 8, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, part, shard, position, version): every row's shard under the rebalanced map, whose
    versions are saved in ``folder`` (default: a new one in the shared folder)."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "slot-map")
    rows = records(docs, id_column, text_column, slots)
    parts = crowded_parts(rows, slots)
    split = spark.createDataFrame(sorted(parts.items()), "virtual_slot int, parts int")
    dealt = rows.join(F.broadcast(split), "virtual_slot", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"), F.lit(0)))
    units = dealt.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # a row per entry of the map
    first = even_map(shards, slots, parts)
    balanced = rebalance(first, {(r["virtual_slot"], r["part"]): r["bytes"] for r in units})
    for version in (first, balanced):
        save_map(spark, version, folder)
    saved = load_map(spark, folder, balanced.version)
    begins, owned = [0] * saved.shards, []
    for r in sorted(units, key=lambda r: (r["virtual_slot"], r["part"])):
        owner = saved.owners[r["virtual_slot"], r["part"]]
        owned.append((r["virtual_slot"], r["part"], owner, begins[owner]))
        begins[owner] += r["n"]
    entries = spark.createDataFrame(owned, "virtual_slot int, part int, shard int, begin long")
    inside = Window.partitionBy("virtual_slot", "part").orderBy("row")
    return dealt.withColumn("at", F.row_number().over(inside)).join(F.broadcast(entries), ["virtual_slot", "part"]).select(
        "id", "size", "text_crc32", "virtual_slot", "part", "shard", (F.col("begin") + F.col("at") - 1).alias("position"), F.lit(saved.version).alias("version"))
