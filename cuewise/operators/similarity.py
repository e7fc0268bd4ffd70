"""Vector similarity: reference matching, near-duplicate pairs and duplicate groups."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cuewise.functions.vectors import cosine
from cuewise.session import cut_lineage


def semantic_tags(rows: DataFrame, tag_vectors: DataFrame, minimum: float = 0.34) -> DataFrame:
    """Tags whose vector is close enough, best first. The tag vectors are one row per broad tag, a fixed handful."""
    vocabulary = tag_vectors.agg(F.array_sort(F.collect_list(F.struct("tag_order", "tag", "tag_vector"))).alias("_tags"))
    close = F.filter(
        F.transform("_tags", lambda t: F.struct((-cosine(F.col("embedding"), t["tag_vector"])).alias("far"), t["tag_order"].alias("tag_order"), t["tag"].alias("tag"))),
        lambda t: t["far"] <= -minimum)
    return rows.crossJoin(F.broadcast(vocabulary)).withColumn(
        "semantic_tags", F.transform(F.array_sort(close), lambda t: t["tag"])).drop("_tags")


def mean_top(similarities: Column, count: int) -> Column:
    """Mean of the largest values of an array; 0 for an empty one."""
    best = F.slice(F.sort_array(similarities, asc=False), 1, count)

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value)
        return F.when(F.size(values) > 0, total / F.size(values)).otherwise(F.lit(0.0))

    # bound to a lambda variable, the sorted list is built once
    return F.get(F.transform(F.array(best), mean), F.lit(0))


PRODUCT_CELLS = 1 << 21


def highest_products(rows: np.ndarray, matrix: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` highest dot products of every row with the rows of a matrix, in no order. About ``PRODUCT_CELLS``
    products are held at once; the highest are copied out of them, as a slice would keep all the others alive."""
    top = min(count, len(matrix))
    best = np.empty((len(rows), top))
    step = max(1, PRODUCT_CELLS // len(matrix))
    for at in range(0, len(rows), step):
        dots = rows[at:at + step] @ matrix.T
        dots.partition(len(matrix) - top, axis=1)
        best[at:at + step] = dots[:, len(matrix) - top:]
    return best


def top_means(embedding: Column, sets: list[tuple[np.ndarray, int]]) -> Column:
    """For every set of vectors the mean of the ``count`` highest dot products, as one array per row.

    The sets travel in the function's closure, so callers pass only sets of a checked size. Rows are multiplied piece by
    piece, which is far cheaper than a fold per pair of vectors.
    """
    @F.pandas_udf(ArrayType(DoubleType()))
    def means(vectors: pd.Series) -> pd.Series:
        rows = np.vstack(vectors.to_numpy()).astype("float64")
        return pd.Series(list(np.column_stack([
            highest_products(rows, matrix, count).mean(axis=1) if len(matrix) else np.zeros(len(rows)) for matrix, count in sets])))
    return means(embedding)


def matrix_of(vectors: list) -> np.ndarray:
    return np.array(vectors, dtype="float64") if vectors else np.empty((0, 0))


BROADCAST_VECTORS = 4096
PART_VECTORS, LANE_ROWS = 16384, 32768


def _best_products(count: int):
    def best(rows: pd.DataFrame, references: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or references.empty:
            return pd.DataFrame({"_vector": pd.Series(dtype="int64"), "_top": pd.Series(dtype="object")})
        tops = highest_products(np.vstack(rows["embedding"].to_numpy()), np.vstack(references["ref_vector"].to_numpy()), count)
        return pd.DataFrame({"_vector": rows["_vector"], "_top": list(tops)})
    return best


def mean_top_similarity(rows: DataFrame, references: DataFrame, count: int, out: str, block: int = 256, spread: int = 64,
                        broadcast_limit: int = BROADCAST_VECTORS, part: int = PART_VECTORS, lane: int = LANE_ROWS) -> DataFrame:
    """Mean of the ``count`` highest dot products of each row with the reference vectors; 0 without references.

    The references are counted first. Up to ``broadcast_limit`` vectors travel to the rows as one matrix. Beyond that
    equal vectors count once: of equal references at most ``count`` can matter, and equal rows have one result. The
    references are cut into parts of ``part`` vectors (``block``, if that is more) and the rows into at least ``spread``
    lanes of about ``lane``. Every part meets every lane in a task that multiplies them piece by piece and keeps each
    row's best ``count`` values, and the partial bests are merged. No pair is ever written out.
    """
    total = references.count()
    if total <= broadcast_limit:
        matrix = matrix_of([row[0] for row in references.select("ref_vector").limit(broadcast_limit).collect()])
        return rows.withColumn(out, F.get(top_means(F.col("embedding"), [(matrix, count)]), F.lit(0)))
    distinct = references.where(F.col("ref_vector").isNotNull()).groupBy("ref_vector").agg(F.count("*").alias("_n"))
    kept = cut_lineage(distinct.select("ref_vector", F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(count)).cast("int"))).alias("_copy")))
    vectors = cut_lineage(rows.where(F.col("embedding").isNotNull()).select("embedding").distinct().withColumn("_vector", F.monotonically_increasing_id()))
    parts, lanes = max(1, -(-kept.count() // max(block, part))), max(spread, -(-vectors.count() // lane))
    left = vectors.withColumn("_lane", F.pmod(F.xxhash64("_vector"), F.lit(lanes)).cast("bigint")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = kept.withColumn("_part", F.pmod(F.xxhash64("ref_vector", "_copy"), F.lit(parts)).cast("int")).withColumn(
        "_lane", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint"))))
    scored = left.groupBy("_part", "_lane").cogroup(right.select("_part", "_lane", "ref_vector").groupBy("_part", "_lane")).applyInPandas(
        _best_products(count), "_vector bigint, _top array<double>")
    merged = scored.groupBy("_vector").agg(F.flatten(F.collect_list("_top")).alias("_all")).select("_vector", mean_top(F.col("_all"), count).alias(out))
    found = vectors.join(merged, "_vector").select("embedding", out)
    return rows.join(found, "embedding", "left").select(*rows.columns, F.coalesce(out, F.lit(0.0)).alias(out))


# ---- near-duplicate pairs ----------------------------------------------------------------------------------------
BLOCK_ROWS = 2048


def _blocked(rows: DataFrame, block_rows: int) -> DataFrame:
    """Spread every recording over blocks of about ``block_rows`` rows and pair the blocks.

    A row goes once to every pair of blocks that contains its own block, so a task sees at most two blocks however
    large the recording is.
    """
    sizes = rows.groupBy("video_id").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    placed = rows.join(sizes, "video_id").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    spread = placed.withColumn("_partner", partner)
    return spread.withColumn("_low", F.least("_block", "_partner")).withColumn("_high", F.greatest("_block", "_partner"))


def _near_mask(one: pd.DataFrame, two: pd.DataFrame, threshold: float, overlap_similarity: float, overlap_ratio: float):
    """Similarity of all rows of two small blocks and which of them count as near-duplicates."""
    left, right = np.vstack(one["embedding"].to_numpy()), np.vstack(two["embedding"].to_numpy())
    similar = left @ right.T
    s1, e1 = one["start_seconds"].to_numpy()[:, None], one["end_seconds"].to_numpy()[:, None]
    s2, e2 = two["start_seconds"].to_numpy()[None, :], two["end_seconds"].to_numpy()[None, :]
    shared = np.clip(np.minimum(e1, e2) - np.maximum(s1, s2), 0.0, None)
    shorter = np.maximum(0.1, np.minimum(e1 - s1, e2 - s2))
    mask = (similar >= threshold) | ((shared / shorter >= overlap_ratio) & (similar >= overlap_similarity))
    return similar, mask & (one["id"].to_numpy()[:, None] != two["id"].to_numpy()[None, :])


def _split_blocks(group: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    low, high = group["_low"].iloc[0], group["_high"].iloc[0]
    return group[group["_block"] == low], group[group["_block"] == high]


def _no_pairs(group: pd.DataFrame) -> pd.DataFrame:
    return group.iloc[:0].assign(left_id=group["id"], right_id=group["id"])[["video_id", "left_id", "right_id"]]


def near_duplicate_pairs(rows: DataFrame, threshold: float = 0.88, overlap_similarity: float = 0.70,
                         overlap_ratio: float = 0.55, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every pair of one recording that is similar, or that overlaps in time and is fairly similar."""
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one, two = _split_blocks(group)
        if one.empty or two.empty:
            return _no_pairs(group).assign(similarity=0.0)
        similar, mask = _near_mask(one, two, threshold, overlap_similarity, overlap_ratio)
        i, j = np.nonzero(mask)
        a, b = one["id"].to_numpy()[i], two["id"].to_numpy()[j]
        pairs = pd.DataFrame({"video_id": group["video_id"].iloc[0], "left_id": np.minimum(a, b), "right_id": np.maximum(a, b), "similarity": similar[i, j]})
        return pairs.drop_duplicates(["left_id", "right_id"])

    slim = rows.where(F.col("embedding").isNotNull()).select("video_id", "id", "start_seconds", "end_seconds", "embedding")
    schema = f"video_id {_type(rows, 'video_id')}, left_id {_type(rows, 'id')}, right_id {_type(rows, 'id')}, similarity double"
    return _blocked(slim, block_rows).groupBy("video_id", "_low", "_high").applyInPandas(compare, schema)


def _type(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def _forest(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of every node of a small graph."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[i], label[j])
        updated = label.copy()
        np.minimum.at(updated, i, low)
        np.minimum.at(updated, j, low)
        updated = updated[updated]
        if np.array_equal(updated, label):
            return label
        label = updated


def duplicate_links(rows: DataFrame, threshold: float = 0.88, overlap_similarity: float = 0.70, overlap_ratio: float = 0.55,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links that connect the same groups as all near-duplicate pairs would.

    Inside one pair of blocks only a spanning forest is kept, so a group of many copies yields one link per row and
    block pair instead of all its pairs.
    """
    def link(group: pd.DataFrame) -> pd.DataFrame:
        one, two = _split_blocks(group)
        if one.empty or two.empty:
            return _no_pairs(group)
        _, mask = _near_mask(one, two, threshold, overlap_similarity, overlap_ratio)
        i, j = np.nonzero(mask)
        ids = np.unique(np.concatenate([one["id"].to_numpy(), two["id"].to_numpy()]))
        a, b = np.searchsorted(ids, one["id"].to_numpy())[i], np.searchsorted(ids, two["id"].to_numpy())[j]
        label = _forest(len(ids), a, b)
        moved = label != np.arange(len(ids))
        return pd.DataFrame({"video_id": group["video_id"].iloc[0], "left_id": ids[label[moved]], "right_id": ids[moved]})

    slim = rows.where(F.col("embedding").isNotNull()).select("video_id", "id", "start_seconds", "end_seconds", "embedding")
    schema = f"video_id {_type(rows, 'video_id')}, left_id {_type(rows, 'id')}, right_id {_type(rows, 'id')}"
    return _blocked(slim, block_rows).groupBy("video_id", "_low", "_high").applyInPandas(link, schema)


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest member id of every linked node, as (video_id, id, component).

    Rounds of alternating star contraction: first every node links its larger neighbours to its smallest one, then its
    smaller neighbours to it. Trees turn into stars in about log(n) rounds, however long the chains are. The loop ends
    when a round changes nothing; only a count and a checksum of the links reach the driver.
    """
    def contract(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.select("video_id", F.col("a").alias("u"), F.col("b").alias("v"))
        if larger:
            both = both.unionByName(edges.select("video_id", F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = edges.select("video_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        smallest = both.groupBy("video_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(smallest, ["video_id", "u"])
        moved = joined.where(F.col("v") > F.col("u")) if larger else joined
        rewired = moved.select("video_id", F.col("v").alias("a"), F.col("m").alias("b"))
        if not larger:
            rewired = rewired.unionByName(smallest.select("video_id", F.col("u").alias("a"), F.col("m").alias("b")))
        return rewired.where(F.col("a") != F.col("b")).distinct()

    def state(edges: DataFrame) -> tuple:
        checksum = F.bit_xor(F.xxhash64("video_id", F.greatest("a", "b"), F.least("a", "b")))
        return tuple(edges.agg(F.count("*"), checksum).first())

    edges = cut_lineage(links.select("video_id", F.greatest("left_id", "right_id").alias("a"), F.least("left_id", "right_id").alias("b")).distinct())
    before = state(edges)
    while True:
        edges = cut_lineage(contract(contract(edges, larger=True), larger=False))
        after = state(edges)
        if after == before:
            break
        before = after
    members = edges.select("video_id", F.greatest("a", "b").alias("id"), F.least("a", "b").alias("component"))
    roots = members.select("video_id", F.col("component").alias("id"), "component").distinct()
    return members.unionByName(roots)


def assign_duplicate_groups(rows: DataFrame, **limits) -> DataFrame:
    """Add ``duplicate_group``: ``repeat-N`` per recording in the order of first members, '' for single rows."""
    groups = connected_components(duplicate_links(rows, **limits))
    # numbering touches one row per group, in the order of the first member's time; ids may be of any type
    members = groups.join(rows.select("video_id", "id", "start_seconds"), ["video_id", "id"])
    firsts = members.groupBy("video_id", "component").agg(F.min(F.struct("start_seconds", "id")).alias("_first"))
    from cuewise.operators.ordering import keyed_index

    numbered = keyed_index(firsts, ["video_id"], [F.col("_first")], out="_number").select("video_id", "component", "_number")
    labels = groups.join(numbered, ["video_id", "component"]).select(
        "video_id", "id", F.concat(F.lit("repeat-"), F.col("_number").cast("string")).alias("duplicate_group"))
    return rows.drop("duplicate_group").join(labels, ["video_id", "id"], "left").withColumn(
        "duplicate_group", F.coalesce("duplicate_group", F.lit("")))


def suppress_duplicates(rows: DataFrame, keep_alternatives: bool = False) -> DataFrame:
    """Best row of every duplicate group; rows without a group always stay.

    The winner is found with a map-side aggregate, so a group of very many copies does not meet in one task.
    """
    grouped = F.coalesce("duplicate_group", F.lit("")) != ""
    order = F.struct((-F.coalesce("ranking_score", F.lit(0))).alias("s"), F.col("start_seconds"), F.col("id"))
    best = rows.where(grouped).groupBy("video_id", "duplicate_group").agg(F.min_by("id", order).alias("_best"))
    flagged = rows.join(best, ["video_id", "duplicate_group"], "left").withColumn(
        "duplicate_alternative", F.coalesce(grouped & (F.col("id") != F.col("_best")), F.lit(False))).drop("_best")
    return flagged if keep_alternatives else flagged.where(~F.col("duplicate_alternative"))


