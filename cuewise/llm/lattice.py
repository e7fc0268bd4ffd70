"""SentencePiece encoding and decoding as relations: a lattice of pieces, joined by Spark and folded in batches of edges.

Texts are cut into units (a run of space marks and the characters up to the next one; no piece reaches over such a
border). Rows are packed into blocks of about ``BLOCK`` bytes of text, each a compressed table, so that texts are moved
once. A block sends its distinct units to slices by their hash. There each distinct unit is settled once: its substrings
up to the longest piece are exploded and joined to the piece table, and the edges, which leave that join unit by unit, are
folded into best paths, those of many units at once. Each block gets the ids of its units back, in the order it sent them,
and puts its texts together. Ties: at each end position edges come from the leftmost start on, and a later one must be
strictly better. A character without a piece of its own gives its byte pieces.

Decoding looks ids up in the piece table and turns byte pieces back to characters.

Defined cases: a null or empty text has no ids and decodes to an empty text; equal rows each give a row; a text without
spaces is one unit, whose edges one task holds at a time, in time that grows in proportion to its length. A text that holds
the space mark itself decodes to spaces there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.llm.common import bounded_batches, quoted
from cuewise.llm.unigram import MODEL, SPACE, load_vocabulary

BLOCK, SLICE = 4 << 20, 8 << 20  # bytes of text to a block, and to a slice of the distinct units
EDGES, CHUNK, TOGETHER = 200_000, 256, 100_000  # edges folded at once, characters of a long unit's chunk, units put together at once
PREFIX = 3  # characters of a piece by which its length is bounded


def piece_table(spark: SparkSession, vocabulary: dict) -> DataFrame:
    """(piece, id, score); as many rows as the vocabulary has, which bounds its broadcast."""
    return spark.createDataFrame([(p, k, s) for p, (s, k) in vocabulary["pieces"].items()], "piece string, id int, score double")


def units_of(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many units each text has, and the units of all texts in turn; no unit holds a plain space."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    plain = pc.replace_substring(texts, SPACE, " ")
    cut = pc.binary_join_element_wise(SPACE, pc.replace_substring(plain, " ", " " + SPACE), "")
    # marks that follow each other are one run; a pass joins every second of them, the next one the rest
    for _ in range(2):
        cut = pc.replace_substring(cut, f"{SPACE} {SPACE}", SPACE + SPACE)
    lists = pc.split_pattern(pc.if_else(pc.equal(pc.binary_length(texts), 0), None, cut), " ")
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def encode_units(distinct: DataFrame, pieces: DataFrame, vocabulary: dict) -> DataFrame:
    """(slice, first, counts, found) of (slice, n, unit), the units of a slice standing together: compressed, how many ids the
    units from number ``first`` on have, and those ids."""
    longest = max(map(len, vocabulary["pieces"]))
    # long units are cut into overlapping chunks first, so that no row but theirs holds them whole
    sized = distinct.select("slice", "n", "unit", F.length("unit").alias("size"))
    chunks = sized.select("slice", "n", "size", "unit", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(CHUNK))).alias("first"))
    chunks = chunks.select("slice", "n", "size", "first", F.substring("unit", F.col("first") + 1, F.lit(CHUNK + longest)).alias("part"))
    starts = chunks.select("slice", "n", "size", "first", "part", F.explode(F.sequence(F.lit(0), F.least(F.lit(CHUNK), F.length("part")) - 1)).alias("at"))
    tails = starts.select("slice", "n", "size", (F.col("first") + F.col("at")).alias("start"), F.substring("part", F.col("at") + 1, F.lit(longest)).alias("tail"))
    # no piece of three characters or more is sought where none begins with the next three; equal digests only widen the bound
    prefix = F.xxhash64(F.substring("piece", 1, PREFIX))
    reach = pieces.where(F.length("piece") >= PREFIX).groupBy(prefix.alias("prefix")).agg(F.max(F.length("piece")).alias("reach"))
    bound = tails.withColumn("prefix", F.xxhash64(F.substring("tail", 1, PREFIX))).join(F.broadcast(reach), "prefix", "left")
    upto = F.least(F.length("tail"), F.coalesce("reach", F.lit(PREFIX - 1)))
    substrings = bound.select("slice", "n", "size", "start", "tail", F.explode(F.sequence(F.lit(1), upto)).alias("length"))
    sought = substrings.select("slice", "n", "size", "start", "length", F.substring("tail", F.lit(1), F.col("length")).alias("piece"))
    edges = sought.join(F.broadcast(pieces), "piece", "left").where((F.col("length") == 1) | F.col("id").isNotNull())
    # a character without a piece becomes an edge of its bytes
    shown = edges.select("slice", "n", "size", "start", "length", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(vocabulary["unknown"])).alias("score"),
                         F.when(F.col("id").isNull(), F.encode("piece", "UTF-8")).alias("raw"))
    by_byte = np.array([vocabulary["bytes"].get(b, vocabulary["unk_id"]) for b in range(256)], np.int32)
    by_bytes, unknown = bool(vocabulary["bytes"]), vocabulary["unk_id"]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= EDGES:
                table = pa.Table.from_batches(held)
                last = np.flatnonzero(borders(table))[-1]  # the last unit may go on in the next batch
                if last:
                    yield from settled(table.slice(0, last))
                    # a copy, as a slice would keep all of its table
                    held = table.slice(last).take(pa.array(np.arange(len(table) - last))).to_batches()
                    rows = len(table) - last
                else:
                    rows = len(table) - len(table) // 2  # one long unit: look again when it has grown by half
        if held:
            yield from settled(pa.Table.from_batches(held))

    def borders(table: pa.Table) -> np.ndarray:
        key = (table["slice"].to_numpy().astype(np.int64) << 32) | table["n"].to_numpy()
        return np.concatenate([[True], key[1:] != key[:-1]])

    def settled(table: pa.Table) -> Iterator[pa.RecordBatch]:
        begins = np.flatnonzero(borders(table))
        table = table.combine_chunks()
        sizes = table["size"].to_numpy()[begins].astype(np.int64)
        start, length, piece = (table[name].to_numpy() for name in ("start", "length", "id"))
        used = best_edges(begins, sizes, start, length, table["score"].to_numpy())
        raw = table["raw"].combine_chunks() if isinstance(table["raw"], pa.ChunkedArray) else table["raw"]
        own, unit = piece[used], np.searchsorted(begins, used, "right") - 1
        odd = np.flatnonzero(own < 0)
        width = np.ones(len(own), np.int64)
        if len(odd) and by_bytes:
            raw = raw.take(pa.array(used[odd]))
            width[odd] = pc.binary_length(raw).to_numpy(zero_copy_only=False)
        ids = np.repeat(own, width).astype(np.int32)
        if len(odd):
            ids[ids < 0] = by_byte[np.frombuffer(b"".join(raw.to_pylist()), np.uint8)] if by_bytes else unknown
        counts = np.bincount(unit, width, len(begins)).astype(np.int32)
        slices, numbers = table["slice"].to_numpy()[begins], table["n"].to_numpy()[begins]
        cuts = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(begins)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        for low, high in zip(cuts, cuts[1:]):
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([slices[low]], pa.int32()), "first": pa.array([numbers[low]], pa.int32()),
                "counts": pa.array([zlib.compress(counts[low:high].tobytes(), 1)], pa.binary()), "found": pa.array([zlib.compress(ids[upto[low]:upto[high]].tobytes(), 1)], pa.binary())})

    return shown.mapInArrow(folded, "slice int, first int, counts binary, found binary")


def best_edges(begins: np.ndarray, sizes: np.ndarray, start: np.ndarray, length: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Numbers of the edges on the best paths. Unit u has ``sizes[u]`` characters and the edges from ``begins[u]`` on, by start;
    every character is an edge too, so no end is missing."""
    unit = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(start))))
    if not np.array_equal(np.bincount(unit[length == 1], minlength=len(sizes)), sizes):
        raise RuntimeError("edges of a unit do not stand together")
    base = np.cumsum(sizes + 1) - (sizes + 1)
    end = (start + length).astype(np.int64)
    source, target = base[unit] + start, base[unit] + end
    order = np.argsort(end.astype(np.uint16) if end.max() < 1 << 16 else end, kind="stable")  # ends in turn; in each, units in turn and starts from the left
    bounds = np.searchsorted(end[order], np.arange(1, int(end.max()) + 2))
    source, target, gain = source[order], target[order], score[order]
    best, back = np.zeros(int(sizes.sum()) + len(sizes)), np.zeros(int(sizes.sum()) + len(sizes), np.int64)
    for low, high in zip(bounds.tolist(), bounds[1:].tolist()):
        value, node = best[source[low:high]] + gain[low:high], target[low:high]
        groups = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        top = np.maximum.reduceat(value, groups)
        reached = np.flatnonzero(value == np.repeat(top, np.diff(np.append(groups, high - low))))
        first = reached[np.concatenate([[True], node[reached][1:] != node[reached][:-1]])]  # of equal paths that with the leftmost start
        best[node[groups]], back[node[groups]] = top, order[low + first]
    used, at, left = np.zeros(len(start), bool), sizes.copy(), np.arange(len(sizes))
    while len(left):
        edge = back[base[left] + at[left]]
        used[edge], at[left] = True, start[edge]
        left = left[at[left] > 0]
    return np.flatnonzero(used)


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def hashes(units: pa.Array) -> np.ndarray:
    """A number for each unit, from its bytes and their places alone."""
    texts = units.cast(pa.binary())
    lengths = pc.binary_length(texts).to_numpy().astype(np.int64)
    if not len(lengths):
        return np.zeros(0, np.uint64)
    held, begins = np.frombuffer(b"".join(texts.to_pylist()), np.uint8), np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
    sums = np.add.reduceat((held.astype(np.uint64) + np.uint64(1)) * powers[np.arange(len(held)) - np.repeat(begins, lengths)], begins)
    return ((sums ^ (sums >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)


def in_slices(units: pa.Array, slices: int) -> dict[int, np.ndarray]:
    """Numbers of the units that go to each slice, in the order of the units' text."""
    turn = pc.array_sort_indices(units).to_numpy().astype(np.int64)
    owner = (hashes(units) % np.uint64(slices)).astype(np.int64)[turn]
    order = np.argsort(owner, kind="stable")
    owner, turn = owner[order], turn[order]
    cuts = [0, *(np.flatnonzero(owner[1:] != owner[:-1]) + 1).tolist(), len(owner)]
    return {int(owner[low]): turn[low:high] for low, high in zip(cuts, cuts[1:]) if high > low}


def gathered(pool: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` in turn."""
    return pool[np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = MODEL, block: int = BLOCK) -> DataFrame:
    """(row, id, text, ids): piece ids of every row's text; ``row`` numbers the rows."""
    spark = docs.sparkSession
    vocabulary = load_vocabulary(path)
    if not vocabulary["units"]:
        raise ValueError("a piece of this vocabulary reaches over a space mark")
    bounded_batches(spark, rows=20_000)
    rows = docs.select(F.col(quoted(id_column)).alias("id"), F.col(quoted(text_column)).alias("text"))
    slices = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE
    id_type = rows.schema["id"].dataType.simpleString()
    small = np.uint16 if max(k for _, k in vocabulary["pieces"].values()) < 2 ** 16 and max(vocabulary["bytes"].values(), default=0) < 2 ** 16 else np.int32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = row = TaskContext.get().partitionId() << 33
        held, size = [], 0

        def full() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            table = table.append_column("row", pa.array(np.arange(first, first + len(table))))
            return pa.RecordBatch.from_pydict({"block": pa.array([first], pa.int64()), "rows": pa.array([packed(table)], pa.binary())})

        for batch in batches:
            held.append(batch)
            row, size = row + len(batch), size + batch.nbytes
            if size >= block:
                yield full()
                held, size, first = [], 0, row
        if row > first:
            yield full()

    def distinct_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch["block"].to_pylist(), batch["rows"]):
                units = pc.unique(units_of(unpacked(rows.as_py())["text"])[1])
                sent = in_slices(units, slices)
                cuts = np.cumsum([0, *map(len, sent.values())]).astype(np.int32)
                ordered = units.take(pa.array(np.concatenate([np.zeros(0, np.int64), *sent.values()])))
                told = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), ordered), " ").cast(pa.binary())
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([number] * len(sent), pa.int64()), "slice": pa.array(list(sent), pa.int32()),
                    "size": pc.binary_length(told), "units": pa.array([pa.compress(own.as_py(), "zstd", asbytes=True) for own in told], pa.binary())})
                pa.default_memory_pool().release_unused()

    def settled_units(asked: pa.Table) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """How many units each row asks for, these units, and the distinct ones in the order of their text."""
        lists = pc.split_pattern(pa.array([pa.decompress(units.as_py(), size, "zstd", asbytes=True) for units, size in zip(asked["units"], asked["size"].to_pylist())], pa.binary()).cast(pa.string()), " ")
        every = lists.flatten()
        own = pc.unique(every)
        return pc.list_value_length(lists).to_numpy().astype(np.int64), every, own.take(pc.array_sort_indices(own))

    def once(table: pa.Table) -> pa.Table:
        own = settled_units(table)[2]
        return pa.table({"slice": pa.array(np.full(len(own), table["slice"][0].as_py(), np.int32)), "n": pa.array(np.arange(len(own), dtype=np.int32)), "unit": own})

    def answer(asked: pa.Table, settled: pa.Table) -> pa.Table:
        wanted, every, own = settled_units(asked)
        turn = np.argsort(settled["first"].to_numpy(), kind="stable")
        counts = np.concatenate([np.frombuffer(zlib.decompress(settled["counts"][int(k)].as_py()), np.int32) for k in turn]).astype(np.int64)
        pool = np.concatenate([np.frombuffer(zlib.decompress(settled["found"][int(k)].as_py()), np.int32) for k in turn]).astype(small)
        if len(counts) != len(own):
            raise RuntimeError("a unit of a slice was not settled")
        begins, at = np.cumsum(counts) - counts, pc.index_in(every, own).to_numpy()
        cuts = np.concatenate([[0], np.cumsum(wanted)])
        packed_counts, found = [], []
        for low, high in zip(cuts, cuts[1:]):
            part = at[low:high]
            packed_counts.append(zlib.compress(counts[part].astype(np.int32).tobytes(), 1))
            found.append(zlib.compress(gathered(pool, begins[part], counts[part]).tobytes(), 1))
        return pa.table({"block": asked["block"], "slice": asked["slice"], "counts": pa.array(packed_counts, pa.binary()), "found": pa.array(found, pa.binary())})

    def together(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        table = unpacked(blocks["rows"][0].as_py())
        lengths, units = units_of(table["text"])
        numbered = pc.dictionary_encode(units)
        units, at = numbered.dictionary, numbered.indices.to_numpy()
        sent = in_slices(units, slices)
        begins, sizes, parts, total = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), [np.zeros(0, small)], 0
        for slice_, counts, found in zip(answers["slice"].to_pylist(), answers["counts"].to_pylist(), answers["found"].to_pylist()):
            own, n = sent[slice_], np.frombuffer(zlib.decompress(counts), np.int32).astype(np.int64)
            sizes[own], begins[own] = n, total + np.cumsum(n) - n
            parts.append(np.frombuffer(zlib.decompress(found), small))
            total += int(n.sum())
        pool = np.concatenate(parts)
        values = [gathered(pool, begins[at[low:low + TOGETHER]], sizes[at[low:low + TOGETHER]]) for low in range(0, len(at), TOGETHER)]
        upto = np.concatenate([[0], np.cumsum(sizes[at])])[np.concatenate([[0], np.cumsum(lengths)])]
        ids = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, small), *values]).astype(np.int32)))
        del units, at, pool, values
        pa.default_memory_pool().release_unused()
        return pa.table({"row": table["row"], "id": table["id"], "text": table["text"], "ids": ids})

    # every use below takes all columns of these two shuffles, so each is made once
    blocks = rows.mapInArrow(pack, "block long, rows binary").repartition("block")
    asked = blocks.mapInArrow(distinct_units, "block long, slice int, size int, units binary").repartition(slices, "slice")
    distinct = asked.groupBy("slice").applyInArrow(once, "slice int, n int, unit string")
    settled = encode_units(distinct, piece_table(spark, vocabulary), vocabulary)
    answers = asked.groupBy("slice").cogroup(settled.groupBy("slice")).applyInArrow(answer, "block long, slice int, counts binary, found binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(together, f"row long, id {id_type}, text string, ids array<int>")


def decoded(ids: Column, path: str = MODEL) -> Column:
    """The text of an array of piece ids."""
    vocabulary = load_vocabulary(path)
    raw = {k: p.replace(SPACE, " ").encode("utf-8") for p, (_, k) in vocabulary["pieces"].items()} | {k: bytes([b]) for b, k in vocabulary["bytes"].items()}
    pieces = [raw.get(k) for k in range(max(raw) + 1)]

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        found = pa.array(pieces, pa.binary()).take(lists.flatten())
        if found.null_count:
            raise ValueError("an id has no piece")
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        joined = pc.binary_join(pa.ListArray.from_arrays(offsets, found), b"")
        try:
            return pc.utf8_slice_codeunits(joined.cast(pa.string()), 1)
        except pa.ArrowInvalid:  # bytes that are no characters
            return pa.array([each.decode("utf-8", "replace")[1:] for each in joined.to_pylist()], pa.string())

    return text(ids)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(row, id, text) of (row, id, ids)."""
    return encoded.select("row", "id", decoded(F.col("ids"), path).alias("text"))
