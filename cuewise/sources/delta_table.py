"""A keyed table that takes batches of changes without being rewritten.

``base`` holds the rows in hash buckets of the key; a bucket is written anew, under the next generation, only when deltas
with keys in it are merged. ``deltas`` holds one folder per batch with the newest change of every key, deletions included as
tombstones. ``manifest`` says, version by version, which generation each bucket is at and up to which batch it is merged.

The row with the highest version of a key counts; of equal versions that of the later batch. So a late change never
replaces a newer row, and a batch that is delivered or run again changes nothing: it lands in the same folder, or has
versions that are there already. Tombstones stay, so that a late change does not bring a deleted row back.

Files of earlier generations are left for readers of earlier manifests; removing them is up to the owner of the folder.
One writer at a time is assumed, as a stream is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE_BATCH = -1


@dataclass(frozen=True)
class DeltaTable:
    spark: SparkSession
    folder: str
    schema: StructType
    keys: tuple[str, ...]
    version: str
    buckets: int

    @classmethod
    def create(cls, rows: DataFrame, folder: str, keys: Sequence[str], version: str, buckets: int = 64) -> DeltaTable:
        """Start with the newest row of every key of ``rows``. Keys must not be null; ``version`` names the column that orders changes."""
        table = cls(rows.sparkSession, folder.rstrip("/"), rows.schema, tuple(keys), version, buckets)
        table._write_base(table._newest(rows.withColumns({"_deleted": F.lit(False), "_batch": F.lit(BASE_BATCH).cast("long")})), 0)
        table._save_manifest(0, {}, BASE_BATCH)
        return table

    @property
    def _names(self) -> list[str]:
        return [name for name in self.schema.names if name not in self.keys]

    @property
    def _stored(self) -> StructType:
        return StructType(list(self.schema.fields)).add("_deleted", "boolean").add("_batch", "long")

    def _newest(self, rows: DataFrame) -> DataFrame:
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*self._names, "_deleted", "_batch"), F.struct(self.version, "_batch")).alias("_row"))
        return newest.select(*self.keys, "_row.*").select(*self._stored.names)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write_base(self, rows: DataFrame, generation: int) -> None:
        """Rows of a bucket go to a few tasks each, so that one large bucket is not one task's work."""
        spread = F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(4))
        rows.withColumn("bucket", self._bucket()).repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/base/gen={generation}")

    def _save_manifest(self, number: int, changed: dict[int, int], upto: int) -> None:
        """A row per bucket: the table has as many as ``buckets``."""
        at = dict.fromkeys(range(self.buckets), 0) if number == 0 else self._manifest()[1] | changed
        rows = [(bucket, generation, upto) for bucket, generation in at.items()]
        self.spark.createDataFrame(rows, "bucket int, generation int, upto long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={number}")

    def _manifest(self) -> tuple[int, dict[int, int], int]:
        """Number of the newest manifest, generation of every bucket, last merged batch."""
        saved = self.spark.read.schema("bucket int, generation int, upto long, version int").parquet(f"{self.folder}/manifest")
        number = saved.agg(F.max("version")).first()[0]
        rows = saved.where(F.col("version") == number).collect()
        return number, {row["bucket"]: row["generation"] for row in rows}, rows[0]["upto"]

    def _base(self, generations: dict[int, int]) -> DataFrame:
        """Base rows; only the folders named by the manifest are read."""
        by_generation: dict[int, list[int]] = {}
        for bucket, generation in generations.items():
            by_generation.setdefault(generation, []).append(bucket)
        wanted = F.lit(False)
        for generation, members in by_generation.items():
            wanted = wanted | ((F.col("gen") == generation) & F.col("bucket").isin(members))
        return self.spark.read.schema(self._stored.add("gen", "integer").add("bucket", "integer")).parquet(f"{self.folder}/base").where(wanted).drop("gen", "bucket")

    def _changes(self, after: int) -> DataFrame | None:
        """Newest change of every key in the batches after one; null if there is none."""
        path = f"{self.folder}/deltas"
        reader = self.spark.read.schema(self._stored.add("batch", "long"))
        # the folder comes with the first batch
        try:
            found = reader.parquet(path)
        except Exception as missing:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None
        return self._newest(found.where(F.col("batch") > after).drop("batch"))

    def append(self, changes: DataFrame, number: int, deleted: Column | None = None) -> None:
        """Take a batch of changes. What it costs follows the batch: nothing of the table is read."""
        marked = changes.withColumns({"_deleted": F.lit(False) if deleted is None else deleted, "_batch": F.lit(number).cast("long")})
        self._newest(marked.select(*self._stored.names)).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={number}")

    def _merged(self, base: DataFrame, changes: DataFrame) -> DataFrame:
        """Base rows that no change beats, and changes that beat their base row. Only keys with changes are compared, and only
        these are joined; a small batch is broadcast by its size."""
        keys = list(self.keys)
        rank = F.struct(self.version, "_batch")
        against = changes.select(*keys, rank.alias("_theirs"))
        kept = base.join(against, keys, "left").where(F.col("_theirs").isNull() | (rank >= F.col("_theirs"))).drop("_theirs")
        met = base.join(changes.select(*keys), keys, "left_semi").select(*keys, rank.alias("_ours"))
        fresh = changes.join(met, keys, "left").where(F.col("_ours").isNull() | (rank > F.col("_ours"))).drop("_ours")
        return kept.unionByName(fresh)

    def read(self) -> DataFrame:
        _, generations, upto = self._manifest()
        base, changes = self._base(generations), self._changes(upto)
        whole = base if changes is None else self._merged(base, changes)
        return whole.where("NOT _deleted").select(*self.schema.names)

    def compact(self) -> list[int]:
        """Merge the deltas into the buckets that they touch and return these; others are not read or written."""
        number, generations, upto = self._manifest()
        changes = self._changes(upto)
        if changes is None:
            return []
        touched = sorted(row["bucket"] for row in changes.select(self._bucket().alias("bucket")).distinct().collect())  # at most ``buckets``
        if not touched:
            return []
        last = self.spark.read.schema(self._stored.add("batch", "long")).parquet(f"{self.folder}/deltas").agg(F.max("batch")).first()[0]
        self._write_base(self._merged(self._base({bucket: generations[bucket] for bucket in touched}), changes), number + 1)
        self._save_manifest(number + 1, dict.fromkeys(touched, number + 1), last)
        return touched
