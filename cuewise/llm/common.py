"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.session import bounded_batches, ensure_checkpoint_dir  # noqa: F401  (for the modules of this package)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(name: str) -> str:
    """A column name that may hold any character."""
    return "`" + name.replace("`", "``") + "`"


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """Write a frame once to the shared folder and read it back: it is reused without being computed again, has no
    lineage, and survives lost executors."""
    spark = frame.sparkSession
    path = shared_folder(spark, "stored")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def join_crowded(rows: DataFrame, facts: DataFrame, key: str, count: str, spread: str, parts: int = 64) -> DataFrame:
    """Inner join of ``rows`` with the one row per key of ``facts`` (materialised), whose ``count`` says how many rows have it.

    Keys of over a thousandth of all these rows, hence fewer than a thousand keys, are broadcast as marks; their rows are
    dealt out by ``spread`` as well, and their facts are repeated for each of the ``parts``.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    crowded = F.col(count) * 1000 > total
    marks = facts.where(crowded).select(key, F.lit(True).alias("crowded"))
    dealt = rows.join(F.broadcast(marks), key, "left").withColumn("salt", F.when(F.col("crowded"), F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int")).otherwise(0))
    repeated = facts.withColumn("salt", F.explode(F.when(crowded, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(repeated, [key, "salt"]).drop("salt", "crowded")


def local_forest(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of every node of a small graph with links i-j."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Alternating star contraction: all larger neighbours of a node are linked to its smallest neighbour, then all smaller
    ones. It ends when a round changes nothing. Links stay distributed; a count and a checksum reach the driver.
    """
    def turn(links: DataFrame, larger: bool) -> DataFrame:
        down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else down
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(lowest, "u")
        if larger:
            out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(lowest.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    def mark(links: DataFrame):
        return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    before = mark(links)
    while before[0]:
        links = stored(turn(turn(links, True), False))
        after = mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
