"""Pipeline stages keep whatever columns documents have."""

import datetime as dt
import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, n_removed int, __row int, row string, kept int, c0 string, at timestamp, counts map<int,string>, `odd ``name` double"


def test_stages_keep_columns_of_any_name_and_type(spark):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(400)]
    rows = []
    for k in range(60):
        text = " ".join(rng.choices(words, k=60))
        if k % 9 == 8:
            text = rows[k - 8][1] if k % 2 else text + " password=abcdef123456 end"
        rows.append((None if k % 3 == 0 else k, text, "en" if k % 2 else "de", "s", len(text), f"f{k}", k, -k, f"r{k}", k, None if k % 5 == 0 else "c",
                     dt.datetime(2024, 1, 1, 12, 30, 15, 123456 + k), {k: "v", 7: None}, k / 7))
    docs = spark.createDataFrame(rows, SCHEMA)
    of = {r[5]: r for r in rows}
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns, name
        got = [tuple(r) for r in after.collect()]
        left[name] = len(got)
        for r in got:
            assert (r[0], *r[2:4], *r[5:]) == (of[r[5]][0], *of[r[5]][2:4], *of[r[5]][5:]), name
            assert r[4] == len(r[1])
    assert left["language_id"] == 60 and left["near_duplicates"] < 60 and left["repeated_passages"] < 60 and left["secret_scan"] == 60
