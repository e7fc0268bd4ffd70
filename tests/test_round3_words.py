"""Word times: sums of token lengths by Arrow in small batches."""

import pyarrow as pa

from cuewise.operators import intervals


def test_sums_of_a_slice_are_those_of_its_rows():
    lists = pa.array([[9, 9], [1, 2, 3], [], None, [4]], pa.list_(pa.int32())).slice(1)
    assert intervals._running_totals.func(lists).to_pylist() == [[1, 3, 6], [], [], [4]]
    assert intervals._running_totals.func(lists.slice(4)).to_pylist() == []


def test_words_are_timed_and_python_gets_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    rows = spark.createDataFrame([(1, 0.0, 12.0, " ab c  żół "), (2, 0.0, 4.0, None), (3, 0.0, 4.0, "  "), (4, 2.0, 6.0, "one")], "id long, s double, e double, text string")
    words = intervals.word_times(rows, "text", "s", "e").drop("text")
    assert sorted(map(tuple, words.collect())) == [(1, 0.0, 12.0, 0, "ab", 0.0, 4.0), (1, 0.0, 12.0, 1, "c", 4.0, 6.0), (1, 0.0, 12.0, 2, "żół", 6.0, 12.0), (4, 2.0, 6.0, 0, "one", 2.0, 6.0)]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_words_meet_their_ranges_without_a_sort(spark):
    words = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 3.0, 4.0), (2, 0, 0.0, 2.0)], "id long, position int, word_start double, word_end double")
    ranges = spark.createDataFrame([(1, 0.0, 1.1), (1, 2.9, 4.0), (2, 0.0, 2.0)], "id long, range_start double, range_end double")
    moved = intervals.remap_words(words, ranges, ["id"])
    assert "shuffle_hash" in moved._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["id"], r["position"], round(r["new_start"], 6), round(r["new_end"], 6)) for r in moved.collect()) == [(1, 0, 0.0, 1.0), (1, 1, 1.2, 2.2), (2, 0, 0.0, 2.0)]
