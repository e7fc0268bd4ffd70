"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees' projections and medians are fitted on a bounded sample (``SAMPLE`` rows with the smallest hashes); then every
row is routed to one leaf of each tree. A query descends all trees through one priority queue, ordered by the distance
to the hyperplanes passed on the wrong side, until the leaves popped hold ``share`` of the rows, counted over all trees.
All rows of those leaves are compared; what comes near the best is ranked again with the exact measure, in double precision.

Leaves are processed in blocks of bounded size, whatever their number of rows; queries of a leaf likewise. With
fewer rows than a leaf holds all are compared.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; repeated equal rows
count once; a query leaves out all rows of its own id; of several vectors of one id the nearest pair counts; only vectors of equal length are compared; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import stored
from cuewise.llm.vectors import best, vector_rows

TREES, LEAF, SAMPLE, SHARE, BLOCK = 5, 256, 20000, 1.7, 4096


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that very large or small components keep their direction."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows of length one, the same for equal rows wherever they stand."""
    return np.clip((a * b).sum(axis=1), -1.0, 1.0)


def grow(sample: np.ndarray, rng: np.random.Generator, leaf: int = LEAF) -> dict:
    """One tree as arrays: normal, threshold and children of each inner node (negative: leaf number - 1 below zero)."""
    normals, cuts, children, leaves = [], [], [], 0

    def split(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            normal = rng.normal(size=sample.shape[1])
            normal /= np.linalg.norm(normal)
            heights = sample[rows] @ normal
            cut = float(np.median(heights))
            low = heights <= cut
            if low.any() and not low.all():
                at = len(normals)
                normals.append(normal)
                cuts.append(cut)
                children.append([0, 0])
                children[at] = [split(rows[low]), split(rows[~low])]
                return at
        leaves += 1
        return -leaves

    root = split(np.arange(len(sample)))
    dim = sample.shape[1]
    return {"root": root, "normals": np.array(normals).reshape(-1, dim), "cuts": np.array(cuts), "children": np.array(children, np.int64).reshape(-1, 2)}


def leaf_of(tree: dict, rows: np.ndarray) -> np.ndarray:
    node = np.full(len(rows), tree["root"])
    while (node >= 0).any():
        at = np.flatnonzero(node >= 0)
        own = node[at]
        high = (rows[at] * tree["normals"][own]).sum(axis=1) > tree["cuts"][own]
        node[at] = tree["children"][own, high.astype(np.int64)]
    return -node - 1


def visit(trees: list[dict], sizes: list[np.ndarray], row: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared priority queue, until they hold ``wanted`` rows."""
    heap = [(0.0, n, tree, t["root"]) for n, (tree, t) in enumerate(enumerate(trees))]
    heights = [t["normals"] @ row - t["cuts"] for t in trees]
    count, held, out = len(heap), 0.0, []
    while heap and held < wanted:
        margin, _, tree, node = heapq.heappop(heap)
        if node < 0:
            out.append((tree, -node - 1))
            held += sizes[tree][-node - 1]
            continue
        height = heights[tree][node]
        near = int(height > 0)
        for side, limit in ((near, margin), (1 - near, max(margin, abs(height)))):
            heapq.heappush(heap, (limit, count, tree, int(trees[tree]["children"][node, side])))
            count += 1
    return out


def nearest(table: DataFrame, queries, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", trees: int = TREES, leaf: int = LEAF,
            sample: int = SAMPLE, share: float = SHARE, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query."""
    rows = vector_rows(table, id_column, vector_column, lambda x: x, queries).where(F.exists("v", lambda x: x != 0))
    forests: dict[int, list[dict]] = {}
    chosen = rows.orderBy(F.xxhash64("v"), "vec_id").limit(sample).collect()
    for dim in sorted({r["dim"] for r in chosen}):
        points = unit(np.array([r["v"] for r in chosen if r["dim"] == dim], np.float64))
        rng = np.random.default_rng(seed)
        forests[dim] = [grow(points, rng, leaf) for _ in range(trees)]

    @F.pandas_udf("array<int>")
    def route(vectors: pd.Series) -> pd.Series:
        out = np.zeros((len(vectors), trees), np.int32)
        sizes = vectors.map(len).to_numpy()
        for dim in np.unique(sizes):
            if dim in forests:  # a length that the sample lacks is one leaf
                at = np.flatnonzero(sizes == dim)
                x = unit(np.array([vectors.iloc[i] for i in at], np.float64))
                out[at] = np.stack([leaf_of(t, x) for t in forests[dim]], axis=1)
        return pd.Series(list(out))

    routed = stored(rows.withColumn("leaves", route("v")))
    index = routed.select("dim", "vec_id", "v", F.posexplode("leaves").alias("tree", "leaf"))
    # one row per leaf: their number is bounded by the sample
    held = index.groupBy("dim", "tree", "leaf").agg(F.count("*").alias("n"))
    sizes: dict[int, list[np.ndarray]] = {}
    for r in held.collect():
        own = sizes.setdefault(r["dim"], [np.zeros(2 * sample + 2) for _ in range(trees)])
        own[r["tree"]][r["leaf"]] = r["n"]
    sizes = {d: [s[:max(1, int(np.flatnonzero(s).max(initial=0)) + 1)] for s in own] for d, own in sizes.items()}

    @F.pandas_udf("array<struct<tree:int,leaf:int>>")
    def plan(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            dim = len(v)
            forest = forests.get(dim)
            if forest is None:
                out.append([{"tree": 0, "leaf": 0}])
                continue
            counts = [np.pad(s, (0, max(0, 2 * len(t["cuts"]) + 2 - len(s)))) for t, s in zip(forest, sizes[dim])]
            visited = visit(forest, counts, unit(np.array([v], np.float64))[0], share * counts[0].sum())
            out.append([{"tree": t, "leaf": n} for t, n in visited])
        return pd.Series(out)

    asking = stored(routed.where("query").select("dim", "vec_id", "v", F.explode(plan("v")).alias("p")).select("dim", "vec_id", "v", "p.tree", "p.leaf"))
    asked = asking.groupBy("dim", "tree", "leaf").agg(F.count("*").alias("asked"))
    cells = stored(held.join(asked, ["dim", "tree", "leaf"]).select(
        "dim", "tree", "leaf", F.ceil(F.col("n") / block).cast("int").alias("salts"), F.ceil(F.col("asked") / block).cast("int").alias("groups")))
    dealt = index.join(cells, ["dim", "tree", "leaf"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("salts")).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    asks = asking.join(cells, ["dim", "tree", "leaf"]).withColumn("group", F.pmod(F.xxhash64("vec_id", "v"), F.col("groups")).cast("int")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    keys = ["dim", "tree", "leaf", "salt", "group"]

    def rerank(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if one.empty or two.empty:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        two = two.sort_values("vec_id")
        q, d = unit(np.array(one["v"].tolist(), np.float64)), unit(np.array(two["v"].tolist(), np.float64))
        names, ids = one["vec_id"].to_numpy(), two["vec_id"].to_numpy()
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        out = []
        for begin in range(0, len(q), 256):
            part = slice(begin, begin + 256)
            near = q[part] @ d.T
            near[names[part][:, None] == ids[None, :]] = -2.0
            tops = np.maximum.reduceat(near, first, axis=1)
            kth = np.partition(tops, -k, axis=1)[:, -k] if tops.shape[1] > k else np.full(len(near), -1.5)
            i, j = np.nonzero((near >= kth[:, None] - 1e-9) & (near > -1.5))
            out.append(pd.DataFrame({"query_id": names[part][i], "vec_id": ids[j], "score": exact_cosine(q[part][i], d[j])}))
        found = pd.concat(out).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.drop_duplicates(["query_id", "vec_id"]).groupby("query_id", sort=False).head(k)

    scored = asks.select(*keys, "vec_id", "v").groupBy(*keys).cogroup(dealt.select(*keys, "vec_id", "v").groupBy(*keys)).applyInPandas(
        rerank, "query_id long, vec_id long, score double")
    return best(scored, k)
