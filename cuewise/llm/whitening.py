"""Whitening of vectors by polarised covariances.

Every entry becomes the whole number x = floor(scale * entry). Over the distinct x-vectors (the fit list: n of them, with
sums S) each dimension and each sum of two dimensions gets its exact sum of squared centred values,
sum((n * x_i - S_i)^2) and sum((n * (x_i + x_j) - (S_i + S_j))^2). Half the difference of the second from the first two is
the cross-covariance, in whole numbers, so nothing cancels; only the finished matrix is rounded, for ``eigh``.

Spark deals out the rows. A task folds its rows into one total per pair of dimensions, split into digits of 40 bits, and
Spark adds the digits; the driver receives dimension^2 / 2 totals, whatever the number of rows.

Defined cases: rows with a null, empty or non-finite vector take no part; rows without an id, repeated rows and equal
vectors of several ids stay rows, while their vector counts once in the fit. Vectors of each length are fitted apart.
Entries beyond a long after scaling stand at the ends of its range. A component without variance (all vectors equal, or
fewer distinct ones than components) has a null ``whitened``, and no part in ``identity_error``; ``explained`` is null where
nothing varies. A ``deviation`` beyond a long is null. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.llm.common import stored
from cuewise.llm.vectors import usable

DIGIT = 40
LIMB = 20
SAFE = 1 << 61
SLICE = 2048


@dataclass(frozen=True)
class Fit:
    """The fit of all vectors of one length: exact sums, and the projection that whitens."""

    n: int
    sums: list[int]
    values: np.ndarray
    explained: list[float | None]
    projection: np.ndarray
    identity_error: float | None = None


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(dimension, rows x dimension whole numbers, the rows) of bounded slices of a batch with columns dim and x."""
    for begin in range(0, batch.num_rows, SLICE):
        part = batch.slice(begin, SLICE)
        dims = part.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            rows = part.filter(pa.array(dims == dim))
            yield int(dim), rows.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), rows


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where sums of two fit into them, else as Python's whole numbers."""
    most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if most < SAFE // 2:
        return x * np.int64(n) - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def square_sums(values: np.ndarray) -> list[int]:
    """Exact sum of squares of every column."""
    if values.dtype == object:
        return [int(total) for total in (values * values).sum(axis=0)]
    bits = int(np.abs(values).max()).bit_length()
    if 2 * bits + len(values).bit_length() <= 62:
        return np.einsum("ij,ij->j", values, values).tolist()
    limbs = [(values >> shift) & ((1 << LIMB) - 1) for shift in range(0, bits, LIMB)]
    limbs[-1] = values >> LIMB * (len(limbs) - 1)  # the highest limb keeps the sign
    totals = [0] * values.shape[1]
    for a, high in enumerate(limbs):
        for b, low in enumerate(limbs):
            part = np.einsum("ij,ij->j", high, low)
            totals = [t + (int(p) << LIMB * (a + b)) for t, p in zip(totals, part, strict=True)]
    return totals


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of rows and sum of every dimension, by vector length."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for dim, x, _ in blocks(batch):
                high, low = (x >> 32).sum(axis=0).astype(object), (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                n, sums = found.get(dim, (0, np.zeros(dim, dtype=object)))
                found[dim] = n + len(x), sums + high * 2 ** 32 + low
        rows = [(dim, at, n, Decimal(int(s))) for dim, (n, sums) in found.items() for at, s in enumerate(sums)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))],
                                         names=["dim", "at", "n", "total"])

    added = fit.mapInArrow(fold, "dim int, at int, n long, total decimal(38,0)").groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found: dict[int, tuple[int, list[int]]] = {}
    for row in sorted(added.collect(), key=lambda r: (r["dim"], r["at"])):  # one row per length and dimension
        found.setdefault(row["dim"], (int(row["n"]), []))[1].append(int(row["total"]))
    return found


def squares(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, dict[tuple[int, int], int]]:
    """Exact sums of squared centred values of every dimension (i, i) and every sum of two dimensions (i, j), by length."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for dim, x, _ in blocks(batch):
                y = centred(x, *sums[dim])
                for i in range(dim):
                    # the first column is the dimension itself, the others its sums with later dimensions
                    pairs = np.concatenate([y[:, i:i + 1], y[:, i:i + 1] + y[:, i + 1:]], axis=1)
                    for j, total in enumerate(square_sums(pairs), start=i):
                        found[dim, i, j] = found.get((dim, i, j), 0) + total
        rows = [(*key, place, (total >> DIGIT * place) & ((1 << DIGIT) - 1)) for key, total in found.items() for place in range(total.bit_length() // DIGIT + 1)]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["dim", "i", "j", "place", "digit"])

    added = fit.mapInArrow(fold, "dim int, i int, j int, place int, digit long").groupBy("dim", "i", "j", "place").agg(F.sum("digit").alias("digit"))
    found: dict[int, dict[tuple[int, int], int]] = {dim: {} for dim in sums}
    for row in added.collect():  # digits of dimension^2 / 2 totals
        pair = row["i"], row["j"]
        found[row["dim"]][pair] = found[row["dim"]].get(pair, 0) + (row["digit"] << DIGIT * row["place"])
    return found


def decompose(n: int, sums: list[int], square: dict[tuple[int, int], int], components: int) -> Fit:
    """Covariances out of the squares, rounded once, and their leading unit eigenvectors over the roots of the eigenvalues."""
    dim = len(sums)
    matrix = np.empty((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            product = square[i, i] if i == j else (square[i, j] - square[i, i] - square[j, j]) // 2
            matrix[i, j] = matrix[j, i] = product / n ** 3
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(matrix))
    varies = values > trace * dim * np.finfo(float).eps
    projection = np.where(varies, vectors / np.sqrt(np.where(varies, values, 1.0)), np.nan)
    return Fit(n, sums, values, [float(v) / trace if trace > 0 else None for v in values], projection)


def project(y: np.ndarray, fit: Fit) -> np.ndarray:
    return (y / fit.n).astype(float) @ fit.projection


def identity_errors(fit: DataFrame, fits: dict[int, Fit], components: int) -> dict[int, float | None]:
    """Largest entry of the whitened fit list's covariance minus the identity, by length."""
    names = [f"z{k}" for k in range(components)]

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, x, _ in blocks(batch):
                z = np.full((len(x), components), np.nan)
                z[:, :fits[dim].projection.shape[1]] = project(centred(x, fits[dim].n, fits[dim].sums), fits[dim])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), dim, dtype=np.int32)), *[pa.array(z[:, k], from_pandas=True) for k in range(components)]], names=["dim", *names])

    z = fit.mapInArrow(transform, ",".join(["dim int", *[f"{name} double" for name in names]]))
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    found = z.groupBy("dim").agg(*[F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs]).collect()
    return {row["dim"]: max((abs(row[f"c{a}_{b}"] - (a == b)) for a, b in pairs if row[f"c{a}_{b}"] is not None), default=None) for row in found}


def whiten(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 4, scale: float = 256.0) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and leading component."""
    vector = F.col(vector_column).cast("array<double>")
    rows = stored(table.where(usable(vector)).select(
        F.col(id_column).alias("id"), F.transform(vector, lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("x"), F.size(vector).alias("dim")))
    distinct = stored(rows.select("dim", "x").distinct())
    sums = totals(distinct)
    square = squares(distinct, sums)
    fits = {dim: decompose(n, s, square[dim], components) for dim, (n, s) in sums.items()}
    errors = identity_errors(distinct, fits, components)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, x, part in blocks(batch):
                fit = fits[dim]
                y = centred(x, fit.n, fit.sums)
                exact = y if y.dtype == object or dim * int(np.abs(y).max()) ** 2 < 2 ** 63 else y.astype(object)
                deviation = [d if d < 2 ** 63 else None for d in map(int, (exact * exact).sum(axis=1))]
                count = fit.projection.shape[1]
                each = np.repeat(np.arange(len(x)), count)
                yield pa.RecordBatch.from_arrays([
                    part.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), fit.n)), pa.array(deviation, pa.int64()).take(pa.array(each)),
                    pa.array(project(y, fit).ravel(), from_pandas=True), pa.array(fit.explained * len(x), pa.float64()),
                    pa.array([errors[dim]] * len(each), pa.float64())],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(transform, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
