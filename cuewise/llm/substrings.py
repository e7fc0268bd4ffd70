"""Repeated passages: seeds from winnowed anchors, extended to maximal repeats of at least ``length`` words.

A word sequence of ``length`` words has ``length - gram + 1`` word grams; the one with the smallest hash is its anchor, so
equal sequences have equal anchors. Anchors of all texts are joined on their hash; an anchor met in one place only ends
there. From each matched seed the extension goes both ways, window by window: the windows of ``length`` words that have the
seed as anchor are joined on their own hash (96 bits), and each is kept as a repeat if an earlier text, or an earlier
place of its own text, has it too. Neighbouring repeats merge into maximal ones by covering words.

Rows of an anchor or of a whole text that very many have are dealt out by id before they meet its facts.
Windows whose seed is shared by more than ``HOT`` places are dealt out by id as well, and the earliest of the parts are compared in
a second round, so a passage that a third of all texts share needs no list of its places, no pairs and no single task.
Texts are shuffled once, compressed. Whole texts of the same words, however these are spaced, are settled by their digest
without windows.

Defined cases: a null or blank text has no words and nothing is removed; texts of fewer than ``length`` words lose nothing;
rows with equal id and words count as one document and are both reported; rows with equal id and different words are
ordered by digest; a null id comes first. No rows give no rows. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewise.llm.common import join_crowded, quoted, stored

GRAM, LENGTH, HOT = 6, 20, 5000
EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
FIRST, SECOND, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, width: int, factor: np.uint64 = FIRST) -> np.ndarray:
    """Hash of every run of ``width`` words."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:count].copy()
    for k in range(1, width):
        out *= factor
        out += hashes[k:k + count]
    out ^= out >> np.uint64(32)
    out *= FINAL
    return out ^ (out >> np.uint64(29))


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """For every run of ``span`` grams the index of its smallest hash, the leftmost on ties."""
    best = np.arange(len(grams))
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = best[:-step], best[step:]
        best = np.where(grams[right] < grams[left], right, left)
        reach += step
    return best


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def text_digest(words: list[bytes]) -> bytes:
    """Digest of the words joined by one space: the one measure of what a copy is."""
    return hashlib.md5(b" ".join(words)).digest()


def _seeds(gram: int, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            ids, places, found, marks = [], [], [], []
            for key, text in zip(frame["id"], frame["text"]):
                words = words_of(text)
                if len(words) < length:
                    continue
                grams = gram_hashes(word_hashes(words), gram)
                at = np.unique(anchors(grams, length - gram + 1))
                ids += [key] * len(at)
                places.append(at)
                found.append(grams[at])
                # the same place of a text of the same words has the same mark
                marks.append((at.astype(np.uint64) * FINAL + np.uint64(int.from_bytes(text_digest(words)[:8], "little"))) >> np.uint64(33))
            if ids:
                yield pd.DataFrame({"h": np.concatenate(found).view(np.int64), "id": ids, "pos": np.concatenate(places).astype(np.int32), "mark": np.concatenate(marks).astype(np.int32)})
    return run


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    squeeze = zstandard.ZstdCompressor(1).compress
    for frame in batches:
        raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in frame["text"]]
        yield frame.drop(columns="text").assign(th=[text_digest((r or b"").split()) for r in raw], packed=[None if r is None else squeeze(r) for r in raw])


def _names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        yield frame[["id"]].assign(th=[text_digest(words_of(t)) for t in frame["text"]])


def _mark(digest: bytes) -> int:
    """A part of the text's digest that tells apart rows of equal id and different texts."""
    return int.from_bytes(digest[:4], "little")


def _is_copy(digest: bytes, copies) -> bool:
    return copies is not None and any(bytes(c) == digest for c in copies)


def _windows(gram: int, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor().decompress
        for frame in batches:
            keys, found = [], []
            for key, packed, th, seeds, copies in zip(frame["id"], frame["packed"], frame["th"], frame["seeds"], frame["copies"]):
                if seeds is None or packed is None or _is_copy(th, copies):
                    continue
                hashes = word_hashes(expand(packed).split())
                if len(hashes) < length:
                    continue
                seeds = np.asarray(seeds)
                seeds = seeds[seeds >> 1 < len(hashes)]  # another text of this id may be longer
                seed = anchors(gram_hashes(hashes, gram), length - gram + 1)
                known = np.zeros(len(hashes), np.int8)
                known[seeds >> 1] = 1 + (seeds & 1)
                chosen = np.flatnonzero(known[seed])
                if len(chosen):
                    keys += [key] * len(chosen)
                    found.append((gram_hashes(hashes, length)[chosen].view(np.int64), (gram_hashes(hashes, length, SECOND)[chosen] >> np.uint64(33)).astype(np.int32),
                                  known[seed[chosen]] == 2, (_mark(th) << 31) + chosen))
            if found:
                h, g, crowded, place = map(np.concatenate, zip(*found))
                yield pd.DataFrame({"h": h, "g": g, "hot": crowded, "id": keys, "place": place})
    return run


def _settle(length: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor().decompress
        for frame in batches:
            rows = []
            for packed, th, gone, copies in zip(frame["packed"], frame["th"], frame["gone"], frame["copies"]):
                raw = b"" if packed is None else expand(packed)
                words = kept = raw.split()
                if len(words) >= length and _is_copy(th, copies):
                    kept = []
                elif gone is not None:
                    at = np.asarray(gone)
                    at = at[at >> 31 == _mark(th)] & (2 ** 31 - 1)
                    change = np.zeros(len(words) + 1, np.int32)
                    np.add.at(change, at, 1)
                    np.add.at(change, at + length, -1)
                    kept = [w for w, k in zip(words, np.cumsum(change[:-1]).tolist()) if not k]
                removed = len(words) - len(kept)
                rows.append((len(words), removed, _digest(kept), None if packed is None or not with_text else (b" ".join(kept) if removed else raw).decode("utf-8", "surrogatepass")))
            extra = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
            out = pd.concat([frame[["id", "rest"]].reset_index(drop=True), extra], axis=1)
            yield out if with_text else out.drop(columns="kept_text")
    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, gram: int = GRAM,
                   with_text: bool = False, hot: int = HOT, parts: int = 64) -> DataFrame:
    """(id, rest, n_words, n_removed, kept_sha256[, kept_text]) of every row; ``rest`` is a struct of all other columns.

    ``kept_text`` is the text itself where nothing was removed, else the kept words joined by one space.
    """
    others = [c for c in docs.columns if c not in (id_column, text_column)]
    kind = docs.schema[id_column].dataType.simpleString()
    # the other columns travel as one text, so that their names and types cannot clash with the operator's own
    rest = F.to_json(F.struct(*[F.col(quoted(c)) for c in others]), EXACT_TIMES) if others and with_text else F.lit(None).cast("string")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), rest.alias("rest"))

    seeds = rows.select("id", "text").mapInPandas(_seeds(gram, length), f"h long, id {kind}, pos int, mark int")
    shared = stored(seeds.groupBy("h").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.count("*").alias("n")).where("low != high").select("h", "n"))
    # the last bit of a seed tells whether very many places have it
    matched = join_crowded(seeds.select("h", "id", "pos"), shared, "h", "n", "id", parts).withColumn("hot", (F.col("n") > hot).cast("int")).groupBy("id").agg(
        F.collect_list(F.col("pos") * 2 + F.col("hot")).alias("seeds"))

    names = rows.select("id", "text").mapInPandas(_names, f"id {kind}, th binary")
    firsts = stored(names.groupBy("th").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max(F.col("id").isNull()).alias("without")).where("n > 1"))
    copies = join_crowded(names, firsts, "th", "n", "id", parts).where(F.when(F.col("without"), F.col("id").isNotNull()).otherwise(F.col("id") > F.col("first"))).groupBy("id").agg(
        F.collect_set("th").alias("copies"))

    texts = rows.mapInPandas(_packed, f"id {kind}, rest string, th binary, packed binary")
    windows = _with_facts(texts, matched, copies, "seeds").mapInPandas(_windows(gram, length), f"h long, g int, hot boolean, id {kind}, place long")
    # windows of crowded seeds are dealt out by id too; the earliest of each part then meet in a second, small round
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(parts))).otherwise(-1)
    placed = windows.select("h", "g", salt.alias("salt"), F.struct("id", "place").alias("at")).withColumn(
        "first", F.min("at").over(Window.partitionBy("h", "g", "salt")))
    later = placed.where("at > first").select("at")
    heads = placed.where(F.when(F.col("at") == F.col("first"), F.col("salt")).otherwise(-1) >= 0)
    beaten = heads.withColumn("over", F.min("at").over(Window.partitionBy("h", "g"))).where("at > over").select("at")
    gone = later.unionByName(beaten).groupBy("at.id").agg(F.collect_set("at.place").alias("gone"))
    out = f"id {kind}, rest string, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return _with_facts(texts, gone, copies, "gone").mapInPandas(_settle(length, with_text), out)


def _with_facts(texts: DataFrame, facts: DataFrame, copies: DataFrame, name: str) -> DataFrame:
    """Texts with what is known of their ids; both uses deal the texts out alike, so that they are shuffled once."""
    kind = facts.schema[name].dataType
    both = facts.select("id", name, F.lit(None).cast("array<binary>").alias("copies")).unionByName(
        copies.select("id", F.lit(None).cast(kind).alias(name), "copies")).groupBy("id").agg(F.first(name, True).alias(name), F.first("copies", True).alias("copies"))
    return texts.alias("t").join(both.alias("m"), F.col("t.id").eqNullSafe(F.col("m.id")), "left").select("t.*", f"m.{name}", "m.copies")
