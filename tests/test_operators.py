import random

import pytest
from pyspark.sql import functions as F

from cuewise.operators import benchmark, candidates, diversity, history, intervals, maintenance, ordering, ranking, similarity
from cuewise.plans import search


def test_chunked_ranks_and_sums_equal_a_plain_window(spark):
    rows = spark.range(500).select((F.col("id") % 3 == 0).alias("k"), F.col("id"), (F.col("id") % 7).alias("v"))
    ranked = ordering.chunked_row_number(rows, ["k"], "id", "rn", width=16)
    assert ranked.where("k").agg(F.max("rn")).first()[0] == 167
    assert ranked.where("k AND rn <> id / 3 + 1").count() == 0
    summed = ordering.chunked_running_sum(rows, ["k"], "id", "v", "s", width=16).where("k").orderBy("id").collect()
    total = 0
    for row in summed:
        total += row["v"]
        assert row["s"] == total


def test_ordered_index_is_a_total_rank(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 2).alias("hot"))
    got = ordering.ordered_index(rows, [F.col("hot").desc(), F.col("id")], {"evens": (F.col("hot") == 0).cast("int")}).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [r["id"] for r in got][:3] == [1, 3, 5] and got[-1]["evens"] == 500


def test_range_join_with_and_without_salt(spark):
    spans = spark.createDataFrame([("a", 1, 0.0, 130.0), ("a", 2, 61.0, 61.0), ("b", 3, 0.0, 5.0)], "video_id string, id int, lo double, hi double")
    points = spark.createDataFrame([("a", float(t)) for t in range(0, 200, 10)] + [("a", 61.0), ("b", 5.0), ("b", 5.1)], "video_id string, t double")
    for salts in (1, 4):
        got = intervals.range_join(spans, points, "video_id", "lo", "hi", "t", 60.0, salts=salts)
        assert {(r["id"], r["t"]) for r in got.collect()} == {(1, float(t)) for t in range(0, 131, 10)} | {(1, 61.0), (2, 61.0), (3, 5.0)}
        assert got.count() == 16 + 1


def test_components_of_a_long_chain_and_a_star(spark):
    links = [("v", i, i + 1) for i in range(60)] + [("v", 100, i) for i in range(101, 130)] + [("w", 5, 6)]
    got = similarity.connected_components(spark.createDataFrame(links, "video_id string, left_id long, right_id long"))
    pairs = {(r["video_id"], r["id"]): r["component"] for r in got.collect()}
    assert all(pairs[("v", i)] == 0 for i in range(61)) and all(pairs[("v", i)] == 100 for i in range(100, 130)) and pairs[("w", 6)] == 5
    assert len(pairs) == got.count()


def test_duplicate_links_give_the_same_groups_over_small_blocks(spark):
    draw = random.Random(3)
    rows = []
    for i in range(60):
        angle = (i % 7) * 0.9 + draw.random() * 0.05
        rows.append(("v", i, float(i * 20), float(i * 20 + 25), [__import__("math").cos(angle), __import__("math").sin(angle)]))
    frame = spark.createDataFrame(rows, "video_id string, id long, start_seconds double, end_seconds double, embedding array<double>")
    pairs = {(r["left_id"], r["right_id"]) for r in similarity.near_duplicate_pairs(frame, block_rows=7).collect()}
    expected = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and (sum(x * y for x, y in zip(a[4], b[4])) >= 0.88 or (
        max(0.0, min(a[3], b[3]) - max(a[2], b[2])) / 25 >= 0.55 and sum(x * y for x, y in zip(a[4], b[4])) >= 0.70))}
    assert pairs == expected
    grouped = similarity.assign_duplicate_groups(frame, block_rows=7).collect()
    label = {r["id"]: r["duplicate_group"] for r in grouped}
    assert all(label[a] == label[b] != "" for a, b in pairs)
    assert label[0] == "repeat-1"


def test_hot_duplicate_group_keeps_one_and_blank_groups_stay(spark):
    rows = spark.createDataFrame([("v", 1, 0.0, 50, "g"), ("v", 2, 1.0, 60, "g"), ("v", 3, 2.0, 60, "g"), ("v", 4, 3.0, 10, ""), ("w", 5, 0.0, 1, "g")],
                                 "video_id string, id int, start_seconds double, ranking_score int, duplicate_group string")
    assert {r["id"] for r in similarity.suppress_duplicates(rows).collect()} == {2, 4, 5}


def greedy_picks(rows, limit):
    """Plain statement of the rule: take the best row that is far enough from all picks, again and again."""
    picks, used = [], set()
    while len(picks) < limit:
        free = [r for r in rows if all(r["s"] > p["e"] + 35 or p["s"] > r["e"] + 35 for p in picks)]
        if not free:
            break
        best = max(free, key=lambda r: (r["score"] * .65 + r["short"] * .35 - min(12, 3 * len(set(r["tags"]) & used)), r["short"], r["score"], -r["s"], -r["id"]))
        picks.append(best)
        used |= set(best["tags"])
    return [p["id"] for p in picks]


@pytest.mark.parametrize("window", [3, 512])
def test_varied_picks_equal_the_plain_rule_for_any_window(spark, window):
    draw = random.Random(window)
    rows = [{"id": i, "s": float(draw.randrange(0, 4000)), "e": 0.0, "score": draw.randrange(40, 99), "short": draw.randrange(0, 99),
             "tags": draw.sample(["humor", "gniew", "forma: rada", "inne"], 2)} for i in range(80)]
    for r in rows:
        r["e"] = r["s"] + 20
    frame = spark.createDataFrame([("v", r["id"], r["s"], r["e"], r["score"], r["short"], r["tags"], "", "why") for r in rows],
                                  "video_id string, id long, start_seconds double, end_seconds double, ranking_score int, short_potential_score int, tags array<string>, duplicate_group string, ranking_reason string")
    counted = [{**r, "tags": [t for t in r["tags"] if t != "inne"]} for r in rows]
    got = diversity.best_of_stream(frame, 8, window=window).orderBy("pick").collect()
    assert [r["id"] for r in got] == greedy_picks(counted, 8)
    assert got[0]["ranking_reason"].startswith("why; Best of stream")


def plain_packing(parts):
    """Close at ten seconds, or before a part that would pass thirty-six; drop a tail under three."""
    out, current = [], []
    for p in parts:
        if current and p[2] - current[0][1] > 36:
            out.append(current)
            current = []
        current = current + [p]
        if p[2] - current[0][1] >= 10:
            out.append(current)
            current = []
    if current and current[-1][2] - current[0][1] >= 3:
        out.append(current)
    return [(c[0][0], c[-1][0]) for c in out]


@pytest.mark.parametrize("chunk", [3, 50_000])
def test_packing_over_chunks_equals_one_walk(spark, chunk):
    draw, parts, now = random.Random(chunk), [], 0.0
    for i in range(120):
        now += draw.choice([0.0, 0.5, 3.0, 50.0]) if i else 0.0
        length = draw.choice([1.0, 2.5, 4.0, 12.0, 40.0])
        parts.append((i, now, now + length))
        now += length
    frame = spark.createDataFrame([("v", *p, "x") for p in parts], "video_id string, turn long, start_seconds double, end_seconds double, text string")
    got = candidates.pack_candidates(frame, "turn", chunk=chunk).orderBy("first").collect()
    assert [(r["first"], r["last"]) for r in got] == plain_packing(parts)


def test_sentences_are_completed_and_a_punchline_is_added(spark):
    parts = [("v", 0, 0.0, 4.0, "Początek zdania"), ("v", 1, 4.0, 9.0, "które trwa"), ("v", 2, 9.0, 16.0, "i się kończy."), ("v", 3, 16.5, 19.0, "I nagle wygrałem."), ("v", 4, 40.0, 45.0, "Coś innego.")]
    frame = spark.createDataFrame(parts, "video_id string, turn long, start_seconds double, end_seconds double, text string")
    given = spark.createDataFrame([("v", 1, 1, 4.0, 9.0)], "video_id string, first long, last long, start_seconds double, end_seconds double")
    got = candidates.sentence_bounds(given, frame, "turn").first()
    assert (got["first"], got["last"]) == (0, 3)
    # parts that merely touch an edge belong to the candidate already, so only the punchline is an extension
    assert got["boundary_signals"] == ["extended to punchline"]


def test_windows_without_speech(spark):
    got = candidates.fixed_windows(spark.createDataFrame([("v", 80.0)], "video_id string, duration_seconds double")).orderBy("start_seconds").collect()
    assert [(r["start_seconds"], r["end_seconds"]) for r in got] == [(0.0, 36.0), (36.0, 72.0), (72.0, 80.0)]


def test_matching_equals_greedy_order(spark):
    draw = random.Random(5)
    vocabulary = "alfa beta gamma delta epsilon zeta eta theta".split()
    old = [("v", i, float(i * 4), float(i * 4 + 12), " ".join(draw.choices(vocabulary, k=6))) for i in range(25)]
    new = [("v", 100 + i, r[2] + draw.uniform(-3, 3), r[3] + draw.uniform(-3, 3), r[4] if draw.random() < .6 else " ".join(draw.choices(vocabulary, k=6))) for i, r in enumerate(old)]
    kind = "video_id string, id long, start_seconds double, end_seconds double, transcript string"
    before, after = spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)
    pairs = sorted(history.candidate_matches(before, after).where("confidence IS NOT NULL").collect(),
                   key=lambda r: (-(r["confidence"] == "high"), -r["score"], -r["text_similarity"], -r["both_coverage"], r["previous_id"], r["new_id"]))
    taken_old, taken_new, expected = set(), set(), set()
    for r in pairs:
        if r["previous_id"] not in taken_old and r["new_id"] not in taken_new:
            taken_old.add(r["previous_id"])
            taken_new.add(r["new_id"])
            expected.add((r["previous_id"], r["new_id"]))
    assert {(r["previous_id"], r["new_id"]) for r in history.match_moments(before, after).collect()} == expected


def test_activation_keeps_ids_retires_and_restores(spark):
    kind = "video_id string, id long, start_seconds double, end_seconds double, transcript string, revision_number int, lifecycle_state string, analysis_run_id string"
    current = spark.createDataFrame([("v", 1, 0.0, 10.0, "to samo zdanie", 2, "current", "r1"), ("v", 2, 100.0, 110.0, "inne zdanie", 1, "current", "r1"), ("w", 9, 0.0, 5.0, "bez zmian", 1, "current", "r1")], kind)
    retired = spark.createDataFrame([("v", 3, 300.0, 310.0, "powrót po przerwie", 4, "retired", "r0")], kind)
    records = spark.createDataFrame([("v", 51, 0.5, 10.5, "to samo zdanie"), ("v", 52, 300.0, 310.0, "powrót po przerwie"), ("v", 53, 500.0, 510.0, "nowe")], "video_id string, id long, start_seconds double, end_seconds double, transcript string")
    evidence = spark.createDataFrame([(3,)], "id long")
    got = {r["id"]: (r["revision_number"], r["lifecycle_state"], r["change"]) for r in history.activate_run(current, retired, records, "r2", evidence).collect()}
    assert got == {1: (3, "current", "matched"), 2: (1, "retired", "retired"), 3: (5, "current", "matched"), 53: (1, "current", "new"), 9: (1, "current", "kept")}


def test_ranking_components_respect_limits_and_sum(spark):
    from cuewise.functions.vocab import COMPONENT_LIMITS, PROFILE_NAMES

    draw = random.Random(1)
    names = ["quality_score", "logical_sense_score", "context_score", "self_contained_score", "extended_completeness_score", "opening_clarity_score", "extended_punchline_score",
             "chat_question_match_score", "audio_event_score", "game_reaction_score", "voice_expression_score", "vision_score", "chat_reaction_score", "chat_joy_score", "moment_reaction_score", "chat_message_count", "chat_unique_authors", "short_potential_score"]
    rows = [("v", i, 0.0, draw.uniform(1, 70), [1.0, 0.0], draw.sample(["humor", "forma: opinia", "reakcja na grę", "pytanie widza", "wyrażanie opinii"], 3), draw.random(), "game -> voice", "", *[draw.randrange(-1, 99) for _ in names]) for i in range(40)]
    kind = "video_id string, id long, start_seconds double, end_seconds double, embedding array<double>, tags array<string>, reading_likelihood double, moment_reaction_stage string, duplicate_group string, " + ", ".join(f"{n} int" for n in names)
    frame = spark.createDataFrame(rows, kind)
    for profile in PROFILE_NAMES:
        for row in ranking.score_candidates(frame, profile).collect():
            parts = row["ranking_components"].asDict()
            assert all(low <= parts[name] <= high for name, (low, high) in COMPONENT_LIMITS.items())
            assert abs(sum(parts.values()) - row["ranking_raw_score"]) < 1e-6
            assert 1 <= row["ranking_score"] <= 99
            assert not row["excluded_from_discovery"] or row["ranking_score"] <= 18
            assert row["ranking_score"] < 99 or row["ranking_exceptional"]


def test_pairwise_accuracy_equals_all_pairs(spark):
    draw = random.Random(9)
    rows = [(f"s{i}", "g", draw.choice(["accepted", "rejected"]), float(draw.randrange(1, 20))) for i in range(200)]
    frame = spark.createDataFrame(rows, "sample_id string, group_id string, decision string, predicted_score double")
    good, bad = [r[3] for r in rows if r[2] == "accepted"], [r[3] for r in rows if r[2] == "rejected"]
    expected = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in good for b in bad) / len(good) / len(bad)
    assert abs(benchmark.pairwise_accuracy(frame).first()[0] - expected) < 1e-12


def test_gate_names_its_failures(spark):
    few = spark.createDataFrame([(10, 3, 0.1)], "reviewed long, source_groups long, average_precision double")
    many = spark.createDataFrame([(100, 3, 0.1)], "reviewed long, source_groups long, average_precision double")
    limits = {"average_precision_min": 0.65}
    assert benchmark.gate(few, limits).first()["status"] == "INSUFFICIENT_DATA"
    failed = benchmark.gate(many, limits).first()
    assert failed["status"] == "FAIL" and failed["failures"] == ["average_precision=0.1000 is below 0.6500"]
    with pytest.raises(ValueError):
        benchmark.gate(many, {"average_precision": 1.0})


def test_retention_removes_old_then_over_budget(spark):
    files = spark.createDataFrame([("a", 10, 1.0), ("b", 10, 5.0), ("c", 10, 6.0), ("d", 10, 7.0)], "path string, size long, modified double")
    assert {r["path"]: r["action"] for r in maintenance.retention_plan(files, 1.0, 20).collect()} == {"a": "old", "b": "budget", "c": "keep", "d": "keep"}


def test_keyed_index_and_quantiles_with_one_hot_key(spark):
    import numpy as np

    rows = spark.range(900).select(F.when(F.col("id") < 600, "hot").otherwise((F.col("id") % 5).cast("string")).alias("k"), ((F.col("id") * 37) % 101).cast("double").alias("v"), "id")
    got = ordering.keyed_index(rows, ["k"], [F.col("v"), F.col("id")], {"upto": F.lit(2)}).where("k = 'hot'").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 601)) and [r["upto"] for r in got] == list(range(2, 1202, 2))
    assert [(r["v"], r["id"]) for r in got] == sorted(((i * 37) % 101, i) for i in range(600))
    q = ordering.exact_quantiles(rows, ["k"], "v", [0.25, 0.55, 0.99], ["a", "b", "c"]).where("k = 'hot'").first()
    assert np.allclose([q["a"], q["b"], q["c"]], np.percentile([(i * 37) % 101 for i in range(600)], [25, 55, 99]))


def test_clips_without_words_are_kept_whole(spark):
    words = spark.createDataFrame([(1, 0.0, 1.0, 5.0), (1, 3.0, 4.0, 5.0), (2, 2.0, 2.0, 5.0), (3, 0.01, 0.02, 0.05)], "id int, word_start double, word_end double, length double")
    clips = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 0.05), (4, 7.5)], "id int, length double")
    got = sorted((r["id"], r["island"], r["range_start"], round(r["range_end"], 6)) for r in intervals.pause_ranges(words, ["id"], F.col("length"), clips=clips).collect())
    assert got == [(1, 0, 0.0, 1.12), (1, 1, 2.88, 5.0), (2, 0, 0.0, 5.0), (3, 0, 0.0, 0.05), (4, 0, 0.0, 7.5)]


def test_failing_runs_leave_earlier_messages(spark):
    runs = spark.createDataFrame([(1, "running", "", True), (2, "failed", "disk full", False), (3, "running", "", True)], "run_id int, state string, error_message string, is_current boolean")
    failures = spark.createDataFrame([(1, "stopped"), (2, "stopped")], "run_id int, message string")
    assert sorted(map(tuple, history.update_run_state(runs, failures).select("run_id", "state", "error_message", "is_current").collect())) == [
        (1, "failed", "stopped", False), (2, "failed", "disk full", False), (3, "running", "", True)]


def test_searches_leave_out_retired_rejected_and_foreign_segments(spark):
    rows = spark.createDataFrame([(1, "a", "current", [1.0]), (2, "a", "retired", [1.0]), (3, "a", "current", None), (4, "b", "current", [1.0])], "id int, video_id string, lifecycle_state string, embedding array<double>")
    reviews = spark.createDataFrame([(1, "accepted"), (2, "accepted"), (4, "rejected")], "id int, rating string")
    assert [r["id"] for r in search.searchable(rows).orderBy("id").collect()] == [1, 4]
    assert [r["id"] for r in search.searchable(rows, spark.createDataFrame([("b",)], "video_id string")).collect()] == [4]
    assert [r["id"] for r in search.not_rejected(search.searchable(rows), reviews).collect()] == [1]
    with pytest.raises(ValueError, match="between 1 and 30"):
        search.checked_limit(31, search.LARGEST_PICKS)


def test_mean_top_similarity_by_parts_and_lanes(spark):
    import numpy as np

    from cuewise.operators import similarity

    rng = np.random.default_rng(4)
    rows, refs = rng.normal(size=(30, 5)), rng.normal(size=(11, 5))
    rows, refs = np.vstack([rows, rows[:7]]), np.vstack([refs, refs[:3], *[refs[:1]] * 12])  # copies on both sides
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)] + [(99, None)], "id long, embedding array<double>")
    given = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(refs)], "ref_id long, ref_vector array<double>")
    got = {r["id"]: r["s"] for r in similarity.mean_top_similarity(frame, given, 4, "s", block=2, spread=2, broadcast_limit=0, part=5, lane=9).collect()}
    assert len(got) == 38 and got.pop(99) == 0.0
    want = np.sort(rows @ refs.T, axis=1)[:, -4:].mean(axis=1)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in range(37))


def test_accepted_matches_measure_words_once(spark):
    rng = random.Random(8)
    texts = ["", None, "ala ma kota", "ala ma psa", "Ála ma kota!", "kota ma ala i psa", "zupełnie coś innego"]
    rows = [("v", k, 20.0 * (k // 3) + rng.randint(0, 5), rng.choice(texts)) for k in range(90)]
    frames = [spark.createDataFrame([(v, k + shift, s + rng.choice([0.0, 0.5, 2.0]), s + rng.choice([9.0, 11.0]), t if rng.random() < 0.6 else rng.choice(texts)) for v, k, s, t in rows],
                                    "video_id string, id long, start_seconds double, end_seconds double, transcript string") for shift in (0, 1000)]
    shown = ["previous_id", "new_id", "token_jaccard", "sequence_similarity", "score", "confidence", "reason"]
    accepted = history.accepted_matches(*frames)
    want = history.candidate_matches(*frames).where("confidence IS NOT NULL").select(*shown)
    assert sorted(accepted.select(*shown).collect()) == sorted(want.collect()) and 0 < accepted.where("sequence_similarity BETWEEN 0.01 AND 0.99").count()
    # words are compared in one place of the work, not once for every rule that reads the result
    assert accepted._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") <= 1


def test_examples_are_picked_before_they_meet_texts(spark):
    from cuewise.operators import feedback

    segments = spark.createDataFrame([(k, None if k else 4, "v", float(k), k + 5.0, f"text {k}", [float(k)]) for k in range(4)],
                                     "id long, revision_number int, video_id string, start_seconds double, end_seconds double, transcript string, embedding array<double>")
    requests = spark.createDataFrame([(c, s, 100 * k + c) for k in range(5) for c, s in ((1, 0), (1, 1), (2, 1), (2, 9), (3, 3))], "collection_id long, segment_id long, created_at long")
    kind = ("collection_id long, segment_id long, revision_number int, snapshot_video_id string, snapshot_start_seconds double, snapshot_end_seconds double, "
            "snapshot_transcript string, snapshot_embedding array<double>, created_at long")
    examples = spark.createDataFrame([(3, 3, 7, "old", 0.0, 1.0, "kept", [9.0], 5)], kind)
    after = feedback.add_examples(examples, requests, segments)
    rows = sorted((r["collection_id"], r["segment_id"], r["revision_number"], r["snapshot_transcript"], r["created_at"]) for r in after.collect())
    assert rows == [(1, 0, 4, "text 0", 1), (1, 1, 1, "text 1", 1), (2, 1, 1, "text 1", 2), (3, 3, 7, "kept", 5)] and after.columns == examples.columns
    grouped = [line for line in after._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [collection_id" in line]
    assert grouped and not any("transcript" in line for line in grouped)
