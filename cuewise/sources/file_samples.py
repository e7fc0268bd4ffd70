"""Fingerprints of large files from samples: no file is read whole.

Spark lists the files with their sizes and times; tasks read a range at the head, in the middle and at the tail of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: kind of fingerprint, and the least and usual size of a sample
KIND, LEAST_SAMPLE, USUAL_SAMPLE = "sampled-file-v1", 4096, 1 << 20


def sample_offsets(size: int, sample: int) -> list[int]:
    """Where the samples begin; those of a small file fall together."""
    last = max(0, size - sample)
    return sorted({0, last // 2, last})


def sampled_digest(uri: str, sample: int) -> tuple[int, str]:
    """Size and fingerprint of one file: of its size, time of change, and samples with their places."""
    store, path = fs.FileSystem.from_uri(uri)
    before = store.get_file_info(path)
    digest = hashlib.sha256(f"{KIND} {before.size} {before.mtime_ns}".encode())
    with store.open_input_file(path) as handle:
        for offset in sample_offsets(before.size, sample):
            handle.seek(offset)
            part = handle.read(sample)
            digest.update(f" {offset} {len(part)} ".encode())
            digest.update(part)
    after = store.get_file_info(path)
    if (after.size, after.mtime_ns) != (before.size, before.mtime_ns):
        raise ValueError(f"the file changed while it was read: {uri}")
    return before.size, f"{KIND}:sha256:{digest.hexdigest()}"


def fingerprints(spark: SparkSession, path: str, sample: int = USUAL_SAMPLE, glob: str | None = None) -> DataFrame:
    """(path, size, fingerprint) of every file in a folder.

    A change in size, time or a sampled byte changes the fingerprint. Files that change while they are read fail the job.
    The store must be one that Arrow's file systems open by address (local, HDFS, S3, GCS). Spark does not list empty files.
    """
    if sample < LEAST_SAMPLE:
        raise ValueError(f"samples must have {LEAST_SAMPLE} bytes at least, not {sample}")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(uri, *sampled_digest(uri, sample)) for uri in batch["path"]], columns=["path", "size", "fingerprint"])

    reader = spark.read.format("binaryFile")
    listed = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select(F.regexp_replace("path", "^file:/(?=[^/])", "file:///").alias("path"))
    # listing is cheap and comes in few tasks; reading is dealt out
    return listed.repartition(spark.sparkContext.defaultParallelism, "path").mapInPandas(read, "path string, size long, fingerprint string")
