"""Whitening, sharding and manifest against brute force and on edge cases: nulls, ties, repeats, hot keys, clashing columns, no rows."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewise.llm import manifest, sharding, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars int, tree string, id string, x int, index int, leaf string, size string, part int, row int"


def docs(spark, rows):
    """Columns named like the operators' own ride along."""
    return spark.createDataFrame([(*r, "a", "b", 1, 2, "c", "d", 3, 4) for r in rows], DOCS)


def whitened_by_hand(vectors, k):
    """Covariance in fractions, rounded once."""
    fit = sorted(set(vectors))
    n, dim = len(fit), len(fit[0])
    sums = [sum(v[i] for v in fit) for i in range(dim)]
    cov = np.array([[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n ** 3)) for j in range(dim)] for i in range(dim)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, sums, cov, values, axes


@pytest.mark.parametrize("spread", [1.0, 1e7, 1e15])
def test_whitening_equals_exact_covariances(spark, spread):
    rng = random.Random(7)
    vectors = [[rng.gauss(0, 1) * spread * (k + 1) + 3 * spread for k in range(6)] for _ in range(60)]
    vectors += [vectors[0]] * 30  # a third of the rows are one vector
    rows = [(k, v, 5, "t") for k, v in enumerate(vectors)] + [(None, vectors[1], 5, "t"), (90, None, 5, "t"), (91, [], 5, "t"), (92, [1.0, None, 1.0, 1.0, 1.0, 1.0], 5, "t"),
                                                              (93, [float("nan")] * 6, 5, "t"), (94, [float("inf")] * 6, 5, "t")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, id string")
    got = whitening.whiten(table).collect()
    whole = {k: tuple(math.floor(256 * c) for c in v) for k, v in enumerate(vectors)} | {None: tuple(math.floor(256 * c) for c in vectors[1])}
    n, sums, cov, values, axes = whitened_by_hand(list(whole.values()), 4)
    assert len(got) == 4 * len(whole)
    signs = {}
    for r in got:
        x, c = whole[r["id"]], r["component"] - 1
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        assert r["n"] == n and r["deviation"] == (deviation if deviation < 2 ** 63 else None)
        want = float(np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)]) @ axes[:, c] / math.sqrt(values[c]))
        signs.setdefault(c, 1 if want * r["whitened"] > 0 else -1)
        assert r["whitened"] * signs[c] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_without_variance_and_of_several_lengths(spark):
    table = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [1.0, 2.0, 3.0]), (4, [2.0, 2.0, 3.5]), (5, [1e300, -1e300, 0.0])], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in whitening.whiten(table).collect():
        got[r["id"]].append(r)
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got[1]] == [(1, 0, None, None, None)] * 2
    assert len(got[3]) == 3 and got[3][0]["n"] == 3 and got[5][0]["deviation"] is None
    varied = sorted(got[3], key=lambda r: r["component"])
    assert varied[0]["whitened"] is not None and varied[2]["whitened"] is None  # three vectors vary in two directions at most
    assert whitening.whiten(table.where("false")).count() == 0


@pytest.mark.parametrize("bits", [10, 30, 45, 59, 80])
def test_square_sums_are_exact(bits):
    rng = random.Random(bits)
    values = [[rng.getrandbits(bits) * rng.choice((1, -1)) for _ in range(3)] for _ in range(50)]
    array = np.array(values, dtype=np.int64 if bits < 62 else object)
    assert whitening.square_sums(array) == [sum(r[k] ** 2 for r in values) for k in range(3)]


def shards_of(rows):
    held = defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r)
    return held


def test_shards_are_even_gapless_and_complete(spark):
    rng = random.Random(2)
    texts = ["é" * rng.randint(0, 400) + str(k) for k in range(600)] + [None, "", "same"]
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts)]
    rows += [(None, f"no id {k}", "en", "s", 1) for k in range(100)] + [(7000, "one row many times", "en", "s", 1)] * 350
    got = sharding.shard(docs(spark, rows), shards=8).collect()
    assert Counter((r["id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    held = shards_of(got)
    for members in held.values():
        assert sorted(r["position"] for r in members) == list(range(len(members)))
    loads = [sum(r["size"] for r in members) for members in held.values()]
    assert set(held) == set(range(8)) and max(loads) - min(loads) <= 20
    # a slot that is not split has one owner, and the repeated row is spread
    owners = defaultdict(set)
    for r in got:
        owners[r["virtual_slot"], r["part"]].add(r["shard"])
    assert all(len(o) == 1 for o in owners.values())
    assert max(Counter(r["shard"] for r in got if r["id"] == 7000).values()) < 200
    assert sharding.shard(docs(spark, rows).where("false")).count() == 0


def test_map_versions_edit_and_grow(spark, tmp_path):
    rng = random.Random(4)
    first = sharding.even_map(8, 512, {5: 3})
    weight = {unit: int(rng.paretovariate(1.2) * 100) for unit in first.owners}
    second = sharding.rebalance(first, weight)
    loads = Counter()
    for unit, shard in second.owners.items():
        loads[shard] += weight[unit]
    full = max(loads, key=loads.get)
    # no single move helps any more
    assert max(loads.values()) - min(loads.values()) <= min(weight[unit] for unit, shard in second.owners.items() if shard == full)
    grown = sharding.grow(second, weight)
    moved = [unit for unit in first.owners if grown.owners[unit] != second.owners[unit]]
    assert moved and all(grown.owners[unit] == 8 for unit in moved) and (grown.version, grown.shards) == (3, 9)
    got = sum(weight[unit] for unit in moved)
    assert abs(got - sum(weight.values()) / 9) < sum(weight.values()) / 90
    for version in (first, second, grown):
        sharding.save_map(spark, version, str(tmp_path))
    assert [sharding.load_map(spark, str(tmp_path), v) for v in (1, 2, 3)] == [first, second, grown]
    with pytest.raises(Exception, match="(?i)exists"):
        sharding.save_map(spark, first, str(tmp_path))
    assert sharding.rebalance(second, weight).owners == second.owners  # nothing left to edit


def h(text):
    return sha256(text.encode()).hexdigest()


def tree_by_hand(digests):
    """Root, and the (left, right) siblings of every leaf."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k in range(len(digests)):
            run = level[at[k] // 8 * 8:at[k] // 8 * 8 + 8]
            paths[k].append(("".join(run[:at[k] % 8]), "".join(run[at[k] % 8 + 1:])))
            at[k] //= 8
        level = [h("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


@pytest.mark.parametrize("count", [1, 2, 7, 8, 9, 63, 64, 65, 511, 512])
def test_frontier_keeps_whole_witnesses(count):
    leaves = [h(str(k)) for k in range(count)]
    assert manifest.grown(leaves, None) == tree_by_hand(leaves)
    root, witness = manifest.grown(leaves, 3)
    assert all(manifest.fold(leaf, own) == root and len(own) == 3 for leaf, own in zip(leaves, witness, strict=True))


def test_manifest_equals_trees_by_hand(spark):
    rng = random.Random(9)
    fold_case = str.maketrans(manifest.UPPER, manifest.LOWER)
    rows = [(rng.randrange(10 ** 6), rng.choice([None, "", "Text Ü", "lower é", f"Word {k}"]), "en" if k < 1500 else rng.choice([None, "", "de", "pl", "Ü"]), rng.choice([None, "web"]), rng.choice([None, k]))
            for k in range(1600)]
    rows += [(None, "no id", "en", "web", 1), (None, None, None, None, None), rows[0], rows[0], (3, "ALONE", "zz", None, 4)]
    trees = defaultdict(list)
    for i, text, lang, source, n in rows:
        head = field(i) + field(source) + field(lang) + field(n)
        leaf = h(head + field(text))
        wrong = h(head + field(text.translate(fold_case))) if text is not None and i is not None and i % 2 else leaf
        trees[lang].append((i is not None, i or 0, leaf, wrong, i))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: r[:3])
    roots, paths = zip(*(tree_by_hand([r[2] for r in trees[name]]) for name in names), strict=True)
    root, tops = tree_by_hand(list(roots))
    want = Counter()
    for name, subroot, own, top in zip(names, roots, paths, tops, strict=True):
        for (*_, leaf, wrong, i), path in zip(trees[name], own, strict=True):
            want[i, leaf, subroot, root, h("".join(a + b for a, b in path + top)), manifest.fold(wrong, path + top)] += 1
    table = docs(spark, rows)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    got = manifest.manifest(table, F.col("doc_id"), F.col("lang"), fields, [*fields[:-1], manifest.lower_ascii(F.col("text"))], F.col("doc_id") % 2 == 1)
    assert Counter(map(tuple, got.collect())) == want
    assert manifest.manifest(table.where("false"), F.col("doc_id"), F.col("lang"), fields).count() == 0


def test_long_texts_are_hashed_whole(spark):
    long = "wörd " * 400_000
    table = docs(spark, [(1, long, "en", "s", 1), (2, long + "X", "en", "s", 1)])
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    rows = {r["id"]: r for r in manifest.manifest(table, F.col("doc_id"), F.col("lang"), fields).collect()}
    assert rows[2]["leaf"] == h(field(2) + field("s") + field("en") + field(1) + field(long + "X")) and rows[1]["folded"] == rows[1]["root"]
    assert {r["id"]: r["size"] for r in sharding.shard(table).collect()} == {1: 2_400_001, 2: 2_400_002}
