"""Exact top-k by inner product with cover trees over queries and data together.

All vectors are dealt to the nearest of a few pivots (a bounded sample) and to blocks of bounded size; queries likewise.
For a block or tree node of queries (centre c, covering radius r) and one of data (centre d, radius s) no inner product
exceeds <c, d> + |c| s + |d| r + r s. A pair is pruned if that is below the worst kth score of the query group. Blocks are
pruned so before they are joined, with kth scores from a bounded sample of the data; inside a pair of blocks
the dual-tree search descends both cover trees, best bound first, and the kth scores rise as it goes.

Defined cases: rows without a usable vector take no part; repeated equal rows count once; a query leaves out all rows of
its own id; of several vectors of one id the best pair counts; only vectors of equal length are compared; fewer than k
candidates give fewer rows. Scores are exact integers: sums that could pass 2^53 are computed with whole numbers of any
size; what lies outside 64 bits becomes the largest or smallest score there, ties by id.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import stored
from cuewise.llm.vectors import best, vector_rows

DATA_PIVOTS, QUERY_PIVOTS, BLOCK, SEEDS, LEAF = 24, 6, 2048, 512, 64


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    members: np.ndarray
    children: list["Node"] = field(default_factory=list)


def cover_tree(points: np.ndarray, members: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Each level covers the node's points by balls of half its radius around some of them; ``radius`` covers all descendants."""
    members = np.arange(len(points)) if members is None else members
    centre = points[members[0]].astype(np.float64)
    far = np.linalg.norm(points[members] - centre, axis=1)
    node = Node(centre, float(far.max()), members)
    if len(members) <= leaf or node.radius == 0:
        return node
    rest, half = members, node.radius / 2
    while len(rest):
        if len(node.children) == 16:  # in high dimensions few points share a ball: the others form one more child each nearest the last centre
            node.children.extend(cover_tree(points, part, leaf) for part in np.array_split(rest, -(-len(rest) // leaf)))
            break
        near = np.linalg.norm(points[rest] - points[rest[0]], axis=1) <= half
        node.children.append(cover_tree(points, rest[near], leaf))
        rest = rest[~near]
    return node


def upper_bound(q: Node, d: Node) -> float:
    size_q, size_d = np.linalg.norm(q.centre), np.linalg.norm(d.centre)
    exact = float(q.centre @ d.centre) + size_q * d.radius + size_d * q.radius + q.radius * d.radius
    # never below the true value after rounding, nor below the smallest score
    return max(exact + 1e-9 * (1 + (size_q + q.radius) * (size_d + d.radius)), -2.0 ** 63)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * a.shape[1] < 2 ** 53:
        return (x @ y.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LOWEST + 1, NOBODY).astype(np.int64)


LOWEST, NOBODY = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def keep_best(scores: np.ndarray, ids: np.ndarray) -> None:
    """In every row only the highest score of each id stays."""
    order = np.lexsort((~scores, ids), axis=1)
    names = np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    np.put_along_axis(again, order[:, 1:], names[:, 1:] == names[:, :-1], 1)
    scores[again], ids[again] = LOWEST, NOBODY


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best of ``data`` for each query, by falling score, then id; missing ones are (LOWEST, NOBODY)."""
    scores, ids = np.full((len(queries), k), LOWEST), np.full((len(queries), k), NOBODY)
    floor = np.full(len(queries), LOWEST) if floor is None else floor
    repeats = len(np.unique(data_ids)) < len(data_ids)
    a, b = cover_tree(queries), cover_tree(data)
    heap, count = [(-upper_bound(a, b), 0, a, b)], 1
    while heap:
        bound, _, a, b = heapq.heappop(heap)
        worst = np.maximum(scores[a.members, -1], floor[a.members]).min()
        if -bound < worst:
            continue
        if not a.children and not b.children:
            found = products(queries[a.members], data[b.members])
            found[query_ids[a.members][:, None] == data_ids[b.members][None, :]] = LOWEST
            names = np.where(found == LOWEST, NOBODY, np.broadcast_to(data_ids[b.members], found.shape))
            all_scores, all_ids = np.concatenate([scores[a.members], found], axis=1), np.concatenate([ids[a.members], names], axis=1)
            if repeats:
                keep_best(all_scores, all_ids)
            order = np.lexsort((all_ids, ~all_scores), axis=1)[:, :k]
            scores[a.members], ids[a.members] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
            continue
        # the larger ball is opened first
        if a.children and (not b.children or a.radius >= b.radius):
            pairs = [(child, b) for child in a.children]
        else:
            pairs = [(a, child) for child in b.children]
        for x, y in pairs:
            limit = upper_bound(x, y)
            if limit >= np.maximum(scores[x.members, -1], floor[x.members]).min():
                heapq.heappush(heap, (-limit, count, x, y))
                count += 1
    return scores, ids


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array([np.asarray(r) for r in rows], dtype=np.int64)


def _blocks(rows: DataFrame, pivots: dict[int, np.ndarray], block: int, seeds: dict[int, tuple], k: int) -> DataFrame:
    """One row per block: dim, block, ids and vectors as bytes, centre, radius, and the worst kth score over the seeds."""
    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        out = np.zeros(len(vectors), np.int32)
        sizes = vectors.map(len).to_numpy()
        for dim in np.unique(sizes):
            if dim in pivots:
                at = np.flatnonzero(sizes == dim)
                x, p = np.array([vectors.iloc[i] for i in at], np.float64), pivots[dim]
                out[at] = ((p * p).sum(axis=1) - 2 * (x @ p.T)).argmin(axis=1)
        return pd.Series(out)

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        v, ids, dim = _matrix(frame["v"]), frame["vec_id"].to_numpy(), int(frame["dim"].iloc[0])
        centre = v.mean(axis=0)
        floor = np.full(len(v), LOWEST)
        if dim in seeds:
            floor = dual_search(v, ids, seeds[dim][1], seeds[dim][0], k)[0][:, -1]
        return pd.DataFrame([{
            "dim": dim, "block": f"{dim}-{frame['cell'].iloc[0]}-{frame['salt'].iloc[0]}", "ids": ids.tobytes(), "vectors": v.tobytes(), "floor": floor.tobytes(),
            "centre": centre.tolist(), "radius": float(np.linalg.norm(v - centre, axis=1).max()), "worst": int(floor.min()),
        }])

    placed = rows.withColumn("cell", nearest("v"))
    sizes = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).alias("salts"))
    dealt = placed.join(sizes, ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("salts")))
    return stored(dealt.select("dim", "cell", "salt", "vec_id", "v").groupBy("dim", "cell", "salt").applyInPandas(
        gather, "dim int, block string, ids binary, vectors binary, floor binary, centre array<double>, radius double, worst long"))


def top_k(table: DataFrame, component, queries, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", parts: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of every query."""
    rows = vector_rows(table, id_column, vector_column, component, queries)
    sample = rows.orderBy(F.xxhash64("v"), "vec_id").limit(SEEDS).collect()
    longest = rows.orderBy(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x).desc(), "vec_id").limit(SEEDS).collect()
    pivots, seeds = {}, {}
    for dim in {r["dim"] for r in sample + longest}:
        own = [r for r in sample if r["dim"] == dim]
        if own:
            pivots[dim] = np.unique(np.array([r["v"] for r in own[:DATA_PIVOTS]], np.float64), axis=0)
        kept = {(r["vec_id"], tuple(r["v"])) for r in own + [r for r in longest if r["dim"] == dim]}
        # a query leaves out its own id, so one seed for each id keeps the kth score a lower bound
        by_id = dict(sorted(kept))
        seeds[dim] = (np.array(list(by_id), np.int64), np.array(list(by_id.values()), np.int64).reshape(len(by_id), dim))
    data = _blocks(rows, pivots, BLOCK, {}, k)
    asking = _blocks(rows.where("query"), {d: p[:QUERY_PIVOTS] for d, p in pivots.items()}, BLOCK // 4, seeds, k)

    def size(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    left = asking.select("dim", F.col("block").alias("q"), F.col("centre").alias("c"), F.col("radius").alias("r"), "worst",
                         F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    right = data.select("dim", F.col("block").alias("d"), F.col("centre").alias("e"), F.col("radius").alias("s"), F.pmod(F.hash("block"), F.lit(parts)).alias("part"))
    dot = F.aggregate(F.zip_with("c", "e", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    product = (size(F.col("c")) + F.col("r")) * (size(F.col("e")) + F.col("s"))
    bound = dot + size(F.col("c")) * F.col("s") + size(F.col("e")) * F.col("r") + F.col("r") * F.col("s") + 1e-9 * (1 + product)
    bound = F.greatest(bound, F.lit(-2.0 ** 63))
    pairs = left.join(right, ["dim", "part"]).where(bound >= F.col("worst")).select("q", "d")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in frame.itertuples():
            a, b = np.frombuffer(row.q_vectors, np.int64), np.frombuffer(row.d_vectors, np.int64)
            x, y, floor = np.frombuffer(row.q_ids, np.int64), np.frombuffer(row.d_ids, np.int64), np.frombuffer(row.floor, np.int64)
            scores, ids = dual_search(a.reshape(len(x), -1), x, b.reshape(len(y), -1), y, k, floor)
            good = ids != NOBODY
            out.append(pd.DataFrame({"query_id": np.repeat(x, k)[good.ravel()], "vec_id": ids[good], "score": scores[good]}))
        return pd.concat(out)

    sides = pairs.join(asking.select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "floor"), "q").join(
        data.select(F.col("block").alias("d"), F.col("ids").alias("d_ids"), F.col("vectors").alias("d_vectors")), "d")
    return best(sides.groupBy("q", "d").applyInPandas(search, "query_id long, vec_id long, score long"), k)
