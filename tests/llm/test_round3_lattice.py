"""The lattice of pieces: units cut by Arrow, best paths of many units at once, and texts without a space."""

import itertools

import numpy as np
import pyarrow as pa

from cuewise.llm import lattice, unigram


def test_units_are_those_of_the_pattern():
    texts = ["", None, " ", "  ", "   a    b ", "▁ x▁y", "a\n b", "▁", "x", " \t  z", *map("".join, itertools.product(" a▁", repeat=5))]
    counts, units = lattice.units_of(pa.array(texts))
    want = [unigram.UNIT.findall(unigram.normalise(t or "")) for t in texts]
    assert counts.tolist() == list(map(len, want)) and units.to_pylist() == [u for own in want for u in own]


def test_best_paths_equal_those_of_all_segmentations():
    rng = np.random.default_rng(3)
    begins, sizes, edges = [], [], []
    for size in (1, 2, 5, 7, 8):
        begins.append(len(edges))
        sizes.append(size)
        # few scores, so that paths are often equal
        edges += [(start, length, float(rng.integers(-3, 0))) for start in range(size) for length in range(1, min(4, size - start) + 1) if length == 1 or rng.random() < 0.7]
    start, length, score = (np.array(column) for column in zip(*edges))
    used = lattice.best_edges(np.array(begins), np.array(sizes), start, length, score)
    for begin, upto, size in zip(begins, [*begins[1:], len(edges)], sizes):
        own = edges[begin:upto]

        def paths(end):
            return [[]] if end == 0 else [path + [edge] for edge in own if edge[0] + edge[1] == end for path in paths(edge[0])]

        def best(end):  # of equal paths that whose last piece starts first, on every stretch
            return [] if end == 0 else max((best(edge[0]) + [edge] for edge in sorted(e for e in own if e[0] + e[1] == end)), key=lambda path: sum(e[2] for e in path))

        found = [edges[k] for k in used if begin <= k < upto]
        assert found == best(size) and sum(e[2] for e in found) == max(sum(e[2] for e in path) for path in paths(size))


def test_a_text_without_spaces_takes_time_in_proportion_to_its_length(spark):
    # a path of each end was copied before, and a text of this length did not end within minutes
    texts = ["Heiterkeit☃" * 6000, "the then", None]
    encoded = lattice.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    counter = unigram.Counter(unigram.load_vocabulary())
    assert [len(r["ids"]) for r in encoded.orderBy("id").collect()] == [counter.tokens(t) for t in texts]
    assert [r["text"] for r in lattice.decode(encoded).orderBy("id").collect()] == [t or "" for t in texts]
