"""Merkle manifest of a dataset with a witness for every row.

Rows are leaves; the leaves of each tree stand in order, every ``ARITY`` neighbours become one node until a single one
remains, and the roots of the trees form one more tree. The witness of a leaf holds its siblings on every level.

Trees are built by aligned appends (``Frontier``). An appended digest joins the open run of its level; members of the open
subtrees carry partial witnesses, and when the last sibling of a run arrives, the witnesses below it grow by that run.
Spark numbers the leaves of a tree by a range sort, so one tree may hold all rows, and appends aligned blocks of
``ARITY ** DEPTH`` leaves apart from each other. The roots of the blocks are appended the same way, block by block, until
one is left, and their witnesses extend those of the rows below. A task holds one block at a time; the driver
reads the largest number of blocks of a tree, once a round.

Defined cases: a null field is written ``-``; rows without an id come first in their tree, equal ids are ordered by their
leaves, and repeated rows are leaves of their own; rows without a tree name form the first tree; a tree of one leaf has that
leaf as root and no siblings. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import stored
from cuewise.operators.ordering import keyed_index

ARITY = 8
DEPTH = 3
BLOCK = ARITY ** DEPTH
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Frontier:
    """Append-only tree; ``witness[k]`` holds the (left, right) siblings of member k on the levels closed so far."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: list[list[tuple[str, int, int]]] = []  # by level: nodes of the open run with the range of their members
        self.witness: list[list[tuple[str, str]]] = []

    def append(self, leaf: str) -> None:
        self.witness.append([])
        self._push(0, (leaf, len(self.witness) - 1, len(self.witness)))

    def _push(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [node[0] for node in run]
        for k, (_, begin, end) in enumerate(run):
            step = "".join(digests[:k]), "".join(digests[k + 1:])
            for member in range(begin, end):
                self.witness[member].append(step)
        self._push(level + 1, (digest("".join(digests)), run[0][1], run[-1][2]))

    def finish(self, levels: int | None = None) -> str:
        """Close the short runs at the end and return the root: on the given level, or where one node remains."""
        level = 0
        while level < levels if levels is not None else any(self.open[level + 1:]) or len(self.open[level]) > 1:
            if level < len(self.open) and self.open[level]:
                self._close(level)
            level += 1
        return self.open[level][0][0]


def grown(leaves: list[str], levels: int | None) -> tuple[str, list[list[tuple[str, str]]]]:
    frontier = Frontier()
    for leaf in leaves:
        frontier.append(leaf)
    return frontier.finish(levels), frontier.witness


def fold(leaf: str, witness: list[tuple[str, str]]) -> str:
    for left, right in witness:
        leaf = digest(left + leaf + right)
    return leaf


def written(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(written, fields)).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def append_blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, blocks, members, root) of (tree, index, leaf, ...): aligned blocks with their roots; ``blocks`` counts those
    of the tree. Blocks of a tree with several ones reach up to the level that their roots share."""
    members = F.array_sort(F.collect_list(F.struct("index", *[c for c in nodes.columns if c not in ("tree", "index")])))
    blocks = nodes.groupBy("tree", F.floor(F.col("index") / BLOCK).alias("block")).agg(members.alias("members"))
    counted = nodes.groupBy("tree").agg((F.floor(F.max("index") / BLOCK) + 1).alias("blocks"))
    joined = blocks.join(counted, "tree").withColumn("leaves", F.transform("members", lambda m: m["leaf"]))

    @F.arrow_udf("string")
    def root(leaves: pa.Array, several: pa.Array) -> pa.Array:
        return pa.array([grown(run.as_py(), DEPTH if many.as_py() else None)[0] for run, many in zip(leaves, several, strict=True)], pa.string())

    return stored(joined.select("tree", "block", "blocks", "members", root("leaves", F.col("blocks") > 1).alias("root")))


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (tree, index, leaf): (tree, index, path), the witness of every node, and (tree, root)."""
    blocks = append_blocks(nodes)
    paths = with_paths(blocks)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, members, several, path in zip(*(batch.column(name) for name in ("tree", "members", "several", "path")), strict=True):
                rows, above = members.as_py(), [(s["left"], s["right"]) for s in path.as_py()]
                _, witness = grown([m["leaf"] for m in rows], DEPTH if several.as_py() else None)
                whole = [[{"left": left, "right": right} for left, right in own + above] for own in witness]
                yield pa.RecordBatch.from_arrays([pa.array([tree.as_py()] * len(rows)), pa.array([m["index"] for m in rows], pa.int64()),
                                                  pa.array(whole, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))], names=["tree", "index", "path"])

    extended = paths.select("tree", "members", (F.col("blocks") > 1).alias("several"), "path").mapInArrow(extend, f"tree string, index long, path {STEP}")
    return stored(extended), stored(paths.where("block = 0").select("tree", F.col("top").alias("root")))


def with_paths(blocks: DataFrame) -> DataFrame:
    """Blocks with the witness ``path`` of their root up to ``top``, the root of their tree."""
    single = blocks.select("*", F.array().cast(STEP).alias("path"), F.col("root").alias("top"))
    if (blocks.agg(F.max("blocks")).first()[0] or 0) <= 1:
        return single
    paths, tops = climb(blocks.where("blocks > 1").select("tree", F.col("block").alias("index"), F.col("root").alias("leaf")))
    several = blocks.where("blocks > 1").join(paths.withColumnRenamed("index", "block"), ["tree", "block"]).join(tops.withColumnRenamed("root", "top"), "tree")
    return single.where("blocks <= 1").unionByName(several)


def manifest(docs: DataFrame, identity: Column, tree: Column, fields: list[Column], altered: list[Column] | None = None, alter: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded) of every row: digest of its fields, the root of its tree and of all trees, the
    digest of its siblings from the leaf up, and the root that the witness gives for it; where ``alter`` holds, for the digest of
    ``altered`` in its place."""
    changed = F.when(alter, leaf_digest(altered)) if alter is not None else F.lit(None).cast("string")
    # a prefix keeps the null tree apart from the empty name, and first
    name = F.coalesce(F.concat(F.lit("-"), tree.cast("string")), F.lit(""))
    leaves = stored(docs.select(identity.alias("id"), name.alias("tree"), leaf_digest(fields).alias("leaf"), changed.alias("changed")))
    placed = keyed_index(leaves, ["tree"], [F.col("id").asc_nulls_first(), F.col("leaf")])
    blocks = append_blocks(placed.select("tree", (F.col("position") - 1).alias("index"), "leaf", "changed", "id"))
    paths = with_paths(blocks)

    subroots = stored(paths.where("block = 0").select("tree", F.col("top").alias("subroot")))
    forest = keyed_index(subroots.withColumn("all", F.lit("")), ["all"], [F.col("tree")])
    forest = stored(forest.select(F.col("all").alias("tree"), (F.col("position") - 1).alias("index"), F.col("subroot").alias("leaf"), F.col("tree").alias("name")))
    ways, top = climb(forest.select("tree", "index", "leaf"))
    summit = forest.join(ways, ["tree", "index"]).join(top, "tree").select(F.col("name").alias("tree"), F.col("path").alias("rest"), "root")

    @F.arrow_udf("array<string>")
    def witnessed(leaves: pa.Array, changed: pa.Array, several: pa.Array, path: pa.Array) -> pa.Array:
        """The digest of a leaf's siblings and the folded root, in one string."""
        out = []
        for run, others, many, above in zip(leaves, changed, several, path, strict=True):
            run, upper = run.as_py(), [(s["left"], s["right"]) for s in above.as_py()]
            rest = "".join(left + right for left, right in upper)
            _, witness = grown(run, DEPTH if many.as_py() else None)
            out.append([digest("".join(left + right for left, right in own) + rest) + fold(other or leaf, own + upper)
                        for leaf, other, own in zip(run, others.as_py(), witness, strict=True)])
        return pa.array(out, pa.list_(pa.string()))

    whole = paths.withColumnRenamed("root", "block_root").join(summit, "tree").select(
        "members", F.col("top").alias("subroot"), "root",
        witnessed(F.transform("members", lambda m: m["leaf"]), F.transform("members", lambda m: m["changed"]), F.col("blocks") > 1, F.concat("path", "rest")).alias("found"))
    rows = whole.select("subroot", "root", F.inline(F.arrays_zip("members", "found")))
    return rows.select("members.id", "members.leaf", "subroot", "root", F.substring("found", 1, 64).alias("proof"), F.substring("found", 65, 64).alias("folded"))
