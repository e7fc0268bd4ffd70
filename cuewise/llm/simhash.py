"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared in vertical bit planes.

Every text gives one fingerprint. Fingerprints that differ in at most ``radius`` bits are linked. Links are sought among
fingerprints that agree on one of ``radius + 1`` bands of bits (two fingerprints within the radius always do), and inside
a band's bucket 64 fingerprints are compared at once: bit b of all of them lies in one machine word, and a saturating
carry-save counter per lane adds up the differing bits, plane by plane. A word is abandoned as soon as all its lanes are
beyond the radius. Large buckets are cut into blocks of bounded size, compared pair by pair; each pair of blocks passes
on only a spanning forest of its links.

Defined cases: a null or blank text has fingerprint zero, linked like any other; equal texts share a fingerprint; rows
that repeat give one row each; a null id stays null and names no component unless all ids of it are null. No rows give
no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import components, local_forest, stored

SEED = 42
BLOCK = 1024
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER, LOWER)


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    buffer = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(buffer, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = len(words) - width + 1
    view = memoryview(buffer)
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:count].tolist(), ends[width - 1:].tolist())), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for begin in range(0, count, 65536):  # bounded memory for very long texts
        bits = np.unpackbits(hashes[begin:begin + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(id_column).alias("id"), hashed(F.col(text_column)).alias("fp"))


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(words, 64): plane b of a word holds bit b of its 64 values, one lane each. len(values) is a multiple of 64."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def lanes_within(planes: np.ndarray, word: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """For each item (a word of ``planes``, a query value): mask of the lanes within ``radius`` differing bits.

    Counters are kept as bit-sliced numbers; once a lane has passed the radius it stays marked.
    """
    bits = max(1, int(radius).bit_length())
    out = np.zeros(len(word), np.uint64)
    live = np.arange(len(word))
    beyond = np.zeros(len(word), np.uint64)
    count = [np.zeros(len(word), np.uint64) for _ in range(bits)]
    for b in range(64):
        wanted = np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1))
        carry = planes[word, b] ^ wanted
        for k in range(bits):
            count[k], carry = count[k] ^ carry, count[k] & carry
        beyond |= carry
        if radius + 1 < 1 << bits:  # values between radius and the counter's end are beyond too
            over = np.zeros_like(beyond)
            equal = ~over
            for k in reversed(range(bits)):
                if radius >> k & 1:
                    equal &= count[k]
                else:
                    over |= equal & count[k]
                    equal &= ~count[k]
            beyond |= over
        if b % 8 == 7 and b < 63:
            keep = ~beyond != 0
            if not keep.all():
                live, word, query, beyond = live[keep], word[keep], query[keep], beyond[keep]
                count = [c[keep] for c in count]
                if not len(live):
                    return out
    out[live] = ~beyond
    return out


def bucket_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside ``left``, or between ``left`` and ``right``, as two arrays of values."""
    nodes = left if right is None else np.concatenate([left, right])
    base = left if right is None else right
    shift = 0 if right is None else len(left)
    padded = np.concatenate([base, np.zeros(-len(base) % 64, base.dtype)])
    planes = bit_planes(padded)
    words = len(planes)
    word = np.tile(np.arange(words), len(left))
    item = np.repeat(np.arange(len(left)), words)
    mask = lanes_within(planes, word, left[item], radius)
    hit = np.flatnonzero(mask)
    lanes = np.unpackbits(mask[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    other = word[hit[row]] * 64 + lane
    one = item[hit[row]]
    good = (other < len(base)) & ((other > one) if right is None else True)
    one, other = one[good], other[good] + shift
    root = local_forest(len(nodes), one, other)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[moved]], nodes[moved]


def small_bucket_links(values: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All links inside buckets of 64 values or fewer, laid out one after another; every bucket is one machine word."""
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    lane = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded = np.zeros(len(sizes) * 64, np.uint64)
    padded[bucket * 64 + lane] = values
    mask = lanes_within(bit_planes(padded), bucket, values, radius)
    used = np.where(sizes == 64, ~np.uint64(0), (np.uint64(1) << (sizes % 64).astype(np.uint64)) - np.uint64(1))
    later = (~np.uint64(0) << lane.astype(np.uint64)) << np.uint64(1)
    mask &= used[bucket] & later
    hit = np.flatnonzero(mask)
    row, other = np.nonzero(np.unpackbits(mask[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    one = hit[row]
    return values[one], padded[bucket[one] * 64 + other]


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            lefts = [np.asarray(x, np.int64).view(np.uint64) for x in frame["ones"]]
            rights = [np.asarray(x, np.int64).view(np.uint64) for x in frame["twos"]]
            alone = frame["i"].to_numpy() == frame["j"].to_numpy()
            sizes = np.array([len(x) for x in lefts], np.int64)
            small = alone & (sizes <= 64)
            found = []
            chosen = np.flatnonzero(small)
            for begin in range(0, len(chosen), 4096):
                part = chosen[begin:begin + 4096]
                found.append(small_bucket_links(np.concatenate([lefts[k] for k in part]), sizes[part], radius))
            for k in np.flatnonzero(~small):
                if alone[k] or len(lefts[k]) and len(rights[k]):
                    found.append(bucket_links(lefts[k], None if alone[k] else rights[k], radius))
            if found:
                yield pd.DataFrame({"a": np.concatenate([a for a, _ in found]).view(np.int64), "b": np.concatenate([b for _, b in found]).view(np.int64)})
    return run


def links(fps: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints ``fp`` exactly as all pairs within ``radius`` bits would."""
    bands = radius + 1
    edges = [64 * k // bands for k in range(bands + 1)]
    keys = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in zip(edges, edges[1:])]
    banded = fps.select("fp", F.posexplode(F.array(*keys)).alias("band", "key"))
    crowded = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    placed = banded.join(crowded, ["band", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    # lists hold about ``block`` values each, whatever the bucket's size
    lists = pairs.groupBy("band", "key", "i", "j").agg(
        F.collect_list(F.when(F.col("own") == F.col("i"), F.col("fp"))).alias("ones"),
        F.collect_list(F.when(F.col("own") != F.col("i"), F.col("fp"))).alias("twos"))
    return lists.select("i", "j", "ones", "twos").mapInPandas(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component): component is the smallest id of all texts reachable over links."""
    hashed = stored(with_fingerprints(docs, id_column, text_column, width))
    firsts = stored(hashed.groupBy("fp").agg(F.min("id").alias("first")))
    groups = components(links(firsts.select("fp"), radius))
    linked = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    roots = linked.withColumnRenamed("node", "fp").join(firsts, "fp")
    lowest = roots.groupBy("root").agg(F.min("first").alias("lowest"))
    named = roots.select("fp", "root").join(lowest, "root").select("fp", "lowest")
    final = firsts.join(named, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component"))
    return hashed.join(final, "fp").select("id", "fp", "component")


def hex16(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")
