import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from cuewise.operators import captions
from cuewise.plans import catalog
from cuewise.schemas import check_machine_columns, project_segments
from cuewise.sources import benchmark_files, chat_files, chat_lines
from cuewise.streaming import jobs


def chat(frame):
    return sorted((r["video_id"], r["seconds"], r["author"], r["message"]) for r in frame.collect())


def test_chat_files_of_every_format(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"comments": [
        {"content_offset_seconds": 3.5, "commenter": {"display_name": "Ala"}, "message": {"body": "hej  tam"}},
        {"time": "0:07", "user": "Ola", "fragments": [{"text": "a"}, "b"]}, {"seconds": True, "text": "x"}, {"seconds": 4, "text": ""}]}), encoding="utf-8")
    (tmp_path / "two.jsonl").write_text('{"time": "1:02:03.5", "text": "[ok] tak", "name": 7}\n\n{"seconds": 99999, "text": "za daleko"}\n', encoding="utf-8")
    (tmp_path / "three.csv").write_bytes("text;time;author\nzażółć;0:05;Ewa\n;0:06;x\n".encode("cp1250"))
    (tmp_path / "four.tsv").write_text("12\tcześć\tJan\n13\tbez autora\n", encoding="utf-8-sig")
    (tmp_path / "five.txt").write_text("[00:09] Kot: miau: miau\n0:10 samo\nbez czasu\n", encoding="utf-8")
    assert chat(chat_lines.read_chat_files(spark, str(tmp_path))) == sorted([
        ("one", 3.5, "Ala", "hej tam"), ("one", 7.0, "Ola", "a b"), ("two", 3723.5, "7", "[ok] tak"), ("three", 5.0, "Ewa", "zażółć"),
        ("four", 12.0, "Jan", "cześć"), ("four", 13.0, "", "bez autora"), ("five", 9.0, "Kot", "miau: miau"), ("five", 10.0, "", "samo")])


def test_a_broken_line_fails_the_import(spark):
    lines = spark.createDataFrame([("v", '{"seconds": 1, "text": "ok"}'), ("v", "{broken")], "video_id string, line string")
    with pytest.raises(Exception, match="invalid JSON line"):
        chat_files.from_json_lines(lines).collect()


def test_files_without_messages_are_reported(spark):
    texts = spark.createDataFrame([("a", "txt", "nic"), ("b", "txt", "0:01 x: y")], "video_id string, _suffix string, text string")
    assert [r["video_id"] for r in chat_files.empty_imports(texts, chat_files.parse_chat_texts(texts)).collect()] == ["a"]


def test_import_overwrites_only_its_recordings(spark, tmp_path):
    kind = "video_id string, seconds double, author string, message string"
    chat_files.write_messages(spark.createDataFrame([("a", 1.0, "x", "old"), ("b", 1.0, "x", "old")], kind), str(tmp_path / "m"))
    chat_files.write_messages(spark.createDataFrame([("a", 2.0, "x", "new")], kind), str(tmp_path / "m"))
    assert {(r["video_id"], r["message"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {("a", "new"), ("b", "old")}


def test_anonymous_ids_are_keyed_digests(spark):
    secret = b"k" * 32
    got = spark.createDataFrame([("abc",)], "id string").select(benchmark_files.anonymous_id(secret, "segment", F.col("id")).alias("x"))
    assert got.first()["x"] == hmac.new(secret, b"segment:abc", hashlib.sha256).hexdigest()[:24]
    assert "k" * 32 not in got._jdf.queryExecution().toString()


def test_benchmark_round_trip_refuses_bad_and_repeated_records(spark, tmp_path):
    good = {"schema_version": 1, "sample_id": "a", "group_id": "g", "decision": "accepted", "rejection_code": "", "predicted_score": 50, "features": {"quality": 10}, "tag_feedback": {}}
    lines = [{"type": "metadata"}, good, {**good, "sample_id": "b", "predicted_score": 500}, {**good, "sample_id": "c"}, {**good, "sample_id": "c"}, {**good, "sample_id": "d", "features": {"odd": 1}}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    metadata, valid, refused = benchmark_files.read_records(spark, str(tmp_path))
    assert metadata.count() == 1 and [r["sample_id"] for r in valid.collect()] == ["a"]
    assert sorted(r["sample_id"] for r in refused.collect()) == ["b", "c", "c", "d"]
    with pytest.raises(ValueError):
        benchmark_files.write_records(valid.withColumn("transcript", F.lit("x")), str(tmp_path / "out"))


def test_benchmark_records_are_judged_on_their_json(spark, tmp_path):
    good = {"schema_version": 1, "sample_id": "a", "group_id": "g", "decision": "accepted", "predicted_score": 50, "features": {"quality": 10}}
    flaws = {
        "deep": ({"extra": [[{"a": {"b": [{"video_id": 1}]}}]]}, "private fields: video_id"), "top": ({"transcript": ""}, "private fields: transcript"),
        "score": ({"predicted_score": True}, "predicted_score must be between 1 and 99"), "text": ({"predicted_score": "50"}, "predicted_score must be between 1 and 99"),
        "flag": ({"features": {"quality": False}}, "feature quality must be a finite number"), "none": ({"features": {"quality": None}}, "feature quality must be a finite number"),
        "tags": ({"tags": ["x", 3]}, "tags must be a list of strings"), "version": ({"schema_version": True}, None), "code": ({"rejection_code": []}, None),
        "odd code": ({"rejection_code": ["x"]}, "unsupported rejection code"), "id": ({"sample_id": 7}, "sample_id must be a non-empty string"), "free": ({"own": {"field": [1, "path"]}}, None),
    }
    lines = [json.dumps({**good, "sample_id": name} | change) for name, (change, _) in flaws.items()] + ["[1, 2]", "{", "   ", json.dumps({"type": "metadata", "path": "x"})]
    (tmp_path / "bad.jsonl").write_text("\n".join(lines))
    found = benchmark_files.check_lines(spark.read.text(str(tmp_path / "bad.jsonl"))).collect()
    assert len(found) == len(lines) - 1
    errors = {json.loads(r["record"].toJson()).get("sample_id"): r["errors"] for r in found if r["record"] is not None and r["record"].toJson().startswith("{")}
    assert errors == {change.get("sample_id", name): [reason] if reason else [] for name, (change, reason) in flaws.items()} | {None: []}
    assert sorted(r["errors"][0] for r in found if r["record"] is None or r["record"].toJson().startswith("[")) == ["a record must be an object", "invalid JSON"]
    with pytest.raises(ValueError, match="benchmark record deep: private fields: video_id"):
        benchmark_files.load_records(spark, str(tmp_path / "bad.jsonl"))
    for name, text, reason in (("two", [{"type": "metadata"}, good, {"type": "metadata"}], "one metadata line"), ("empty", [{"type": "metadata"}], "without records")):
        (tmp_path / name).write_text("\n".join(map(json.dumps, text)))
        with pytest.raises(ValueError, match=reason):
            benchmark_files.load_records(spark, str(tmp_path / name))
    (tmp_path / "fine").write_text(json.dumps({**good, "tags": ["x"], "expected_reading": None}))
    record = benchmark_files.load_records(spark, str(tmp_path / "fine"))[1].first()
    assert (record["predicted_score"], record["features"], record["tags"], record["schema_version"]) == (50.0, {"quality": 10.0}, ["x"], 1)


def test_projection_fills_defaults_and_guard_refuses_decisions(spark):
    row = project_segments(spark.createDataFrame([("v", 1, None)], "video_id string, id int, context_score int")).first()
    assert row["context_score"] == -1 and row["tags"] == [] and row["embedding"] is None
    check_machine_columns(["tags", "context_score"])
    with pytest.raises(ValueError):
        check_machine_columns(["rating"])


def test_captions_join_short_sentences_and_wrap_lines(spark):
    words = "Tak. To jest dłuższe zdanie które ma wiele słów. No.".split()
    rows = [(1, i, w, float(i), float(i + 1)) for i, w in enumerate(words)]
    frame = spark.createDataFrame(rows, "id int, position int, word string, word_start double, word_end double")
    got = captions.caption_cues(frame, ["id"], 14, 2).orderBy("cue").collect()
    assert " ".join(r["text"].replace("\n", " ") for r in got) == " ".join(words)
    assert all(len(line) <= 14 for r in got for line in r["text"].split("\n")) and all(r["text"].count("\n") <= 1 for r in got)


def test_a_file_delivered_again_counts_once(spark, tmp_path):
    def line(second, text):
        return json.dumps({"seconds": second, "message": text}, ensure_ascii=False)

    logs = {"one/a.jsonl": [line(1, "x"), line(1, "x"), line(2, "y")], "two/a.jsonl": [line(1, "x"), line(1, "x"), line(2, "y"), line(3, "nowe ż")], "one/b.jsonl": [line(1, "x")]}
    for name, lines in logs.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes("\r\n".join(lines).encode("cp1250"))
    messages = jobs.delivered_messages(spark, str(tmp_path / "in" / "*"), F.lit("2024-01-01").cast("timestamp"), "1 hour")
    running = messages.select("video_id", "seconds", "message").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination()
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert found == [("a", 1.0, "x"), ("a", 1.0, "x"), ("a", 2.0, "y"), ("a", 3.0, "nowe ż"), ("b", 1.0, "x")]


def test_captions_equal_a_plain_layout(spark):
    import random

    rng, clips = random.Random(12), {}
    for k in range(25):
        clips[k] = [rng.choice(["a", "słowo", "bardzodługiesłowo" * 2, "kot"]) + rng.choice(["", "", ".", "…"]) for _ in range(rng.randint(1, 40))]
    rows = [(k, i, w, float(i), float(i + 1)) for k, words in clips.items() for i, w in enumerate(words)]
    frame = spark.createDataFrame(rows, "id int, position int, word string, word_start double, word_end double")

    def layout(words):
        """Sizes of phrases from the sizes of sentences, then lines by trying every further word."""
        sizes = [len(part.split()) for part in " ".join(words).replace(".", ".|").replace("…", "…|").split("|") if part.strip()]
        groups = []
        while sizes:
            taken = 1 if sizes[0] > 4 or len(sizes) == 1 else 2
            if len(sizes) == 1 and sizes[0] <= 4 and groups:
                groups[-1] += sizes.pop()
            else:
                groups.append(sum(sizes[:taken]))
                sizes = sizes[taken:]
        cues, at = [], 0
        for size in groups:
            lines = [words[at]]
            for word in words[at + 1:at + size]:
                longer = f"{lines[-1]} {word}"
                lines = [*lines[:-1], longer] if len(longer) <= 14 else [*lines, word]
            at += size
            cues += ["\n".join(lines[i:i + 2]) for i in range(0, len(lines), 2)]
        return cues

    got = {}
    for r in captions.caption_cues(frame, ["id"], 14, 2).orderBy("id", "cue").collect():
        got.setdefault(r["id"], []).append(r["text"])
    assert got == {k: layout(words) for k, words in clips.items()}


def test_live_packing_in_any_order_equals_batch_packing(spark, tmp_path):
    import random

    from cuewise.operators.candidates import pack_candidates

    rng = random.Random(6)
    parts = []
    for name in "vw":
        at = 0.0
        for i in range(40):
            at += rng.choice([0.0, 0.5, 9.0])
            parts.append((name, i, at, at + rng.choice([0.5, 3.0, 14.0, 40.0]), "x"))
            at = parts[-1][3]
    kind = "video_id string, position long, start_seconds double, end_seconds double, text string"
    day = F.lit("2024-01-01").cast("timestamp")

    def timed(rows):
        return spark.createDataFrame(rows, kind).withColumn("event_time", jobs.event_time(day, F.col("end_seconds")))

    mixed = rng.sample(parts, len(parts))
    # one part is delivered twice; the last delivery moves the watermark past everything
    for rows in (mixed[:27], mixed[27:50], [*mixed[50:], mixed[30]], [("zz", 0, 5000.0, 5000.0, "x")]):
        timed(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(timed(parts).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = (jobs.pack_live(stream, watermark="2000 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
           .trigger(availableNow=True).start())
    run.awaitTermination()
    shown = ["video_id", "first", "last", "start_seconds", "end_seconds"]
    live = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*shown).collect()))
    batch = sorted(map(tuple, pack_candidates(spark.createDataFrame(parts, kind).withColumnRenamed("position", "turn"), "turn").select(*shown).collect()))
    assert live == batch and len(batch) > 10


def test_every_statement_belongs_to_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 120


def test_queries_agree_with_their_statements_on_the_small_tables(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "embeddings", "events", "labels", "orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    for name in ("chat_window_counts", "duplicate_groups", "latest_per_key", "bench_average_precision", "logical_sense"):
        frame = catalog.QUERIES[name](spark, folder)
        result = con.execute(catalog.ORACLES[name])
        columns = [item[0] for item in result.description]
        want = sorted(map(repr, result.fetchall()))
        assert sorted(repr(tuple(row)) for row in frame.select(*columns).collect()) == want, name


def test_delimited_files_keep_quoted_breaks_and_wide_rows(spark):
    wide = [f"c{i}" for i in range(40)]
    wide[0], wide[36] = "time", "message"
    texts = {
        "breaks": 'time,message,author\n5,"two\nlines, ""quoted""",Ewa\n6,a 6" nail,x\n\n7,"",y\n8,last,\n',
        "wide": ",".join(wide) + "\n" + ",".join(["9"] + ["-"] * 35 + ["deep"] + ["-"] * 3) + "\n",
        "plain": "1;first;Ala\r\n2;second\r\n",
        "tabs": "3\tone\n4\t\"open to the end\n5\tstill it",
    }
    files = spark.createDataFrame(list(texts.items()), "video_id string, text string")
    found = {(r.video_id, r.seconds, r.message) for r in chat_files.from_delimited_texts(files).collect()}
    assert found == {
        ("breaks", 5.0, 'two lines, "quoted"'), ("breaks", 6.0, 'a 6" nail'), ("breaks", 8.0, "last"), ("wide", 9.0, "deep"),
        ("plain", 1.0, "first"), ("plain", 2.0, "second"), ("tabs", 3.0, "one"), ("tabs", 4.0, "open to the end 5 still it"),
    }


def test_silent_recordings_and_aligned_twins_keep_their_segments(spark):
    from cuewise.operators import candidates
    from cuewise.plans.analysis import analyse

    # no sentence ends, so that neighbouring candidates grow to the same range
    parts = spark.createDataFrame([("talk", k, 4.0 * k, 4.0 * k + 3.9, f"word{k} and") for k in range(10)],
                                  "video_id string, turn int, start_seconds double, end_seconds double, text string")
    durations = spark.createDataFrame([("talk", 45.0), ("silent", 80.0)], "video_id string, duration_seconds double")
    aligned = candidates.sentence_bounds(candidates.pack_candidates(parts, "turn"), parts, "turn", durations)
    assert aligned.count() > aligned.select("first", "last").distinct().count()
    found = analyse(parts, "turn", durations).select("video_id", "id", "start_seconds", "end_seconds", "transcript").collect()
    talk = [r for r in found if r.video_id == "talk"]
    assert len(talk) == aligned.count() and len({r.id for r in found}) == len(found)
    assert all(len(r.transcript.split()) == len(set(r.transcript.split()) - {"and"}) * 2 for r in talk)
    silent = sorted((r.start_seconds, r.end_seconds, r.transcript) for r in found if r.video_id == "silent")
    step = silent[1][0]
    assert silent[0][0] == 0.0 and silent[-1][1] == 80.0 and all(e - s <= step for s, e, _ in silent) and not any(t for *_, t in silent)


@pytest.mark.parametrize(("length", "delay", "longest"), [(200.0, 6.0, 240.0), (20.0, 120.0, 120.0), (200.0, 6.0, 120.0)])
def test_long_segments_and_delays_keep_their_reactions(spark, tmp_path, length, delay, longest):
    day = F.lit("2024-01-01 00:00:00").cast("timestamp")
    spark.createDataFrame([("v", 1, length / 2, length)], "video_id string, id int, middle double, end double").select(
        "video_id", "id", jobs.event_time(day, F.col("middle")).alias("middle_time"), jobs.event_time(day, F.col("end")).alias("end_time")).write.parquet(f"{tmp_path}/s")
    times = [float(t) for t in range(0, 400, 5)]
    spark.createDataFrame([("v", t, "a", "hi") for t in times], "video_id string, seconds double, author string, message string").withColumn(
        "event_time", jobs.event_time(day, F.col("seconds"))).write.parquet(f"{tmp_path}/m")
    streams = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{n}").schema).parquet(f"{tmp_path}/{n}") for n in "sm"]
    running = jobs.delayed_reactions(*streams, delay, longest_seconds=longest).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
        "checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    if length > longest:
        with pytest.raises(Exception, match="longest_seconds"):
            running.awaitTermination()
        return
    running.awaitTermination()
    found = sorted(r.seconds for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == [t for t in times if length / 2 + delay <= t <= length + delay + 18]


def test_a_streamed_table_may_be_a_folder_of_files(spark, tmp_path):
    from cuewise.plans.queries_stream import live_table, run_to_table

    spark.range(10).withColumnRenamed("id", "event_id").repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    spark.range(4).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "one.parquet")
    for name, size in (("many", 10), ("one", 4)):
        assert sorted(r[0] for r in run_to_table(live_table(spark, str(tmp_path), name)).collect()) == list(range(size))


def test_reactions_across_cells_of_time(spark, tmp_path):
    from cuewise.plans.queries_stream import run_to_table

    start = F.lit("2024-01-01").cast("timestamp")
    segments = [(k, 7.0 * k, 7.0 * k + 50) for k in range(20)]
    messages = [0.5 * k for k in range(500)]
    spark.createDataFrame(segments, "id long, middle double, end double").write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(t,) for t in messages], "seconds double").write.parquet(str(tmp_path / "m"))
    left = spark.readStream.schema("id long, middle double, end double").parquet(str(tmp_path / "s")).select(
        F.lit("v").alias("video_id"), "id", jobs.event_time(start, F.col("middle")).alias("middle_time"), jobs.event_time(start, F.col("end")).alias("end_time"))
    right = spark.readStream.schema("seconds double").parquet(str(tmp_path / "m")).select(
        F.lit("v").alias("video_id"), "seconds", jobs.event_time(start, F.col("seconds")).alias("event_time"), F.lit("a").alias("author"), F.lit("x").alias("message"))
    pairs = run_to_table(jobs.delayed_reactions(left, right, 6.0))
    assert sorted((r["id"], r["seconds"]) for r in pairs.collect()) == [(k, t) for k, m, e in segments for t in messages if m + 6 <= t <= e + 24]


def test_captions_of_texts_move_no_words(spark):
    from cuewise.operators import intervals

    rows = [(1, "Tak.  To jest dłuższe zdanie, które ma wiele słów. No. I " + "bardzodługiesłowo " * 3, 5.0, 35.0), (2, "", 0.0, 6.0), (3, None, 0.0, 6.0), (4, "raz dwa trzy. " * 50, 9.0, 9.0)]
    clips = spark.createDataFrame(rows, "id long, text string, start double, end double")
    got = captions.clip_cues(clips, ["id"], "text", "start", "end", 14, 2)
    words = intervals.word_times(clips.where("id in (1, 4)"), "text", "start", "end")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, captions.caption_cues(words, ["id"], 14, 2).collect()))
    assert got.where("id in (2, 3)").count() == 0 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
