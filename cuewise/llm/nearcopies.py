"""Near copies by exact Jaccard similarity of word shingles, found through SimHash groups and min-hash buckets.

Texts with the same shingle set are one node. Nodes meet if their SimHash fingerprints are linked (``simhash.links``: bit planes
with carry-save counters inside band buckets, three differing bits or fewer), directly or over others. They also meet if ``ROWS`` of their min-hashes agree in one of ``BANDS``
bands; a pair of similarity s meets with probability 1 - (1 - s ** ROWS) ** BANDS, 0.998 at 0.8. Inside a bucket
the whole shingle sets are compared, and nodes of similarity ``least`` or more are linked; a breadth-first walk compares each
node with those not reached yet, so a flood of near copies takes few comparisons. Buckets with the same members are
compared once. Buckets of more than ``WEIGHT`` shingles are cut into blocks that are compared pair by pair.

Fingerprints alone do not reach all: at similarity 0.8 about ten of 64 bits differ, so sixteen bands of four bits
would be needed, and each of their buckets would hold a sixteenth of all texts. Nor do they judge: texts in which one passage
is repeated often share a fingerprint whatever else they say.

Defined cases: letters A-Z count as a-z; a text of fewer words than a shingle is one shingle; texts without words, and
null ones, are copies of each other. The first row of a group is the one with the smallest (id, key), null ids first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm import simhash
from cuewise.llm.common import components, join_crowded, stored
from cuewise.llm.simhash import FOLD
from cuewise.llm.substrings import gram_hashes, word_hashes

WIDTH, LEAST, BANDS, ROWS, WEIGHT = 5, 0.8, 12, 4, 1 << 19
FACTORS = np.random.default_rng(11).integers(0, 2 ** 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    return np.unique(gram_hashes(word_hashes(words), max(1, min(width, len(words)))))


def band_keys(grams: np.ndarray) -> np.ndarray:
    """One key a band, of the smallest hashes under ``ROWS`` multipliers each."""
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for begin in range(0, len(grams), 4096):  # bounded memory for very long texts
        np.minimum(low, (grams[None, begin:begin + 4096] * FACTORS[:, None]).min(axis=1), out=low)
    return gram_hashes(low, ROWS)[::ROWS].view(np.int64)


def _sketch(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            sets = [shingles(t, width) for t in frame["text"]]
            prints = np.array([simhash.fingerprint(t) for t in frame["text"]], np.uint64).view(np.int64)
            yield frame[["id", "key"]].assign(fp=prints, node=[xxhash.xxh3_64_intdigest(s.tobytes()) - 2 ** 63 for s in sets], size=[len(s) for s in sets],
                                              bands=[band_keys(s) if len(s) else None for s in sets])
    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame[["node"]].assign(grams=[shingles(t, width).tobytes() for t in frame["text"]])
    return run


def similar_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect the sets exactly as all pairs of Jaccard similarity ``least`` or more would."""
    size = np.array([len(s) for s in sets], np.int64)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(size)])
    parts = [number[a:b] for a, b in zip(starts, starts[1:])]
    mark = np.zeros(int(number.max()) + 1, bool)
    left, out, queue = np.arange(len(sets)), [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        one = queue.pop()
        mark[parts[one]] = True
        both = np.add.reduceat(mark[np.concatenate([parts[k] for k in left])], np.cumsum(size[left]) - size[left], dtype=np.int64)
        mark[parts[one]] = False
        hit = both / (size[left] + size[one] - both) >= least
        out += [(one, int(k)) for k in left[hit]]
        queue += left[hit].tolist()
        left = left[~hit]
    return out


def _verify(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket and pair of blocks; such a group may go on in the next batch."""
        def settle():
            return [(nodes[a], nodes[b]) for a, b in similar_links(sets, least)] if len(sets) > 1 else []

        group, nodes, sets = None, [], []
        for frame in batches:
            found = []
            for key, node, grams in zip(zip(frame["bucket"], frame["i"], frame["j"]), frame["node"], frame["grams"]):
                if key != group:
                    found += settle()
                    group, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.frombuffer(grams, np.uint64))
            yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)
        yield pd.DataFrame(settle(), columns=["a", "b"], dtype=np.int64)
    return run


def fingerprint_buckets(nodes: DataFrame) -> DataFrame:
    """(node, size, band, value): one more band, whose buckets are the groups of linked fingerprints. ``nodes`` is materialised."""
    told = nodes.where("size > 0").select("node", "size", "fp")
    prints = stored(told.groupBy("fp").agg(F.count("*").alias("n")))
    near = components(simhash.links(prints.select("fp"))).withColumnRenamed("node", "fp")
    named = stored(prints.join(near, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("value")))
    return join_crowded(told, named, "fp", "n", "node").select("node", "size", F.lit(BANDS).alias("band"), "value")


def links(nodes: DataFrame, texts: DataFrame, width: int = WIDTH, least: float = LEAST, weight: int = WEIGHT) -> DataFrame:
    """Links (a, b) between similar nodes. ``nodes``: (node, size, bands, key, fp), materialised; ``texts``: (key, text)."""
    banded = nodes.select("node", "size", F.posexplode("bands").alias("band", "value")).unionByName(fingerprint_buckets(nodes))
    met = banded.groupBy("band", "value").agg(F.count("*").alias("n"), F.sum("size").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x")).where("n > 1")
    # buckets of the same members are compared once
    met = met.groupBy("n", "w", "x").agg(F.min(F.struct("band", "value")).alias("at"))
    met = met.select("at.band", "at.value", F.xxhash64("at.band", "at.value").alias("bucket"), F.ceil(F.col("w") / weight).cast("int").alias("blocks"))
    members = banded.join(met, ["band", "value"]).withColumn("own", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: (k != F.col("own")) | (F.col("blocks") == 1))
    members = members.withColumn("other", F.explode(others))
    members = stored(members.select("node", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))
    needed = members.select("node").distinct().join(nodes.select("node", "key"), "node")
    grams = texts.join(needed, "key").select("node", "text").mapInPandas(_sets(width), "node long, grams binary")
    groups = members.join(grams, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return groups.mapInPandas(_verify(least), "a long, b long")


def first_rows(rows: DataFrame, id_column: str = "doc_id", key_column: str = "key", text_column: str = "text", width: int = WIDTH,
               least: float = LEAST, weight: int = WEIGHT) -> DataFrame:
    """(key) of the first row of every group. ``rows`` is materialised and ``key_column`` a long that no two rows share."""
    texts = rows.select(F.col(key_column).alias("key"), F.col(text_column).alias("text"))
    named = rows.select(F.col(id_column).alias("id"), F.col(key_column).alias("key"), F.col(text_column).alias("text"))
    kind = rows.schema[id_column].dataType.simpleString()
    hashed = named.mapInPandas(_sketch(width), f"id {kind}, key long, fp long, node long, size int, bands array<long>")
    nodes = stored(hashed.groupBy("node").agg(F.min(F.struct("id", "key", "fp")).alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    groups = components(links(nodes.select("node", "size", "bands", F.col("first.key").alias("key"), F.col("first.fp").alias("fp")), texts, width, least, weight))
    named = nodes.select("node", "first").join(groups, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    return named.groupBy("root").agg(F.min("first").alias("first")).select("first.key")
