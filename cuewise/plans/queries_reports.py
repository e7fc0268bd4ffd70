"""Queries of the ranking benchmark and the review statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.functions.vocab import DEFAULT_VOCABULARY
from cuewise.operators import benchmark, stats
from cuewise.plans import carriers
from cuewise.plans.carriers import CTE, NEEDS, cte
from cuewise.plans.registry import query
from cuewise.sources import benchmark_files

CTE["br"] = "SELECT *, row_number() OVER (ORDER BY predicted_score DESC, sample_id) AS rank FROM bench"
NEEDS["br"] = ("bench",)
KS = (5, 10, 20)


def _round(frame: DataFrame) -> DataFrame:
    return frame.select(*[F.round(name, 9).alias(name) if kind == "double" else F.col(name) for name, kind in frame.dtypes])


_SUMMARY = """count(*) AS reviewed, count(*) FILTER (decision = 'accepted') AS accepted, count(*) FILTER (decision = 'rejected') AS rejected, count(DISTINCT group_id) AS source_groups,
  round(avg(CAST(decision = 'accepted' AS INT)), 9) AS approval_rate, round(avg(predicted_score) FILTER (decision = 'accepted'), 9) AS accepted_score_mean, median(predicted_score) FILTER (decision = 'accepted') AS accepted_score_median,
  round(avg(predicted_score) FILTER (decision = 'rejected'), 9) AS rejected_score_mean, median(predicted_score) FILTER (decision = 'rejected') AS rejected_score_median,
  round(avg(CAST(predicted_score >= 95 AS INT)), 9) AS score_95_plus_rate, round(avg(CAST(predicted_score = 99 AS INT)), 9) AS score_99_rate"""


@query("bench_summary", cte("bench") + f"SELECT {_SUMMARY} FROM bench")
def bench_summary(spark, sf_dir):
    return _round(benchmark.summary(carriers.bench_records(spark, sf_dir)))


_PR = ", ".join(f"round(avg(CAST(decision = 'accepted' AS INT)) FILTER (rank <= {k}), 9) AS precision_at_{k}, round(count(*) FILTER (decision = 'accepted' AND rank <= {k}) / CAST(count(*) FILTER (decision = 'accepted') AS DOUBLE), 9) AS recall_at_{k}" for k in KS)


@query("bench_precision_recall", cte("br") + f"SELECT {_PR} FROM br")
def bench_precision_recall(spark, sf_dir):
    return _round(benchmark.precision_recall(carriers.bench_records(spark, sf_dir)))


_AP = "(SELECT round(avg(found / CAST(rank AS DOUBLE)), 9) FROM (SELECT *, count(*) FILTER (decision = 'accepted') OVER (ORDER BY rank) AS found FROM br) q WHERE decision = 'accepted')"


@query("bench_average_precision", cte("br") + f"SELECT {_AP} AS average_precision")
def bench_average_precision(spark, sf_dir):
    return _round(benchmark.average_precision(carriers.bench_records(spark, sf_dir)))


_NDCG = ", ".join(f"round((SELECT sum(3.0 / log2(rank + 1)) FROM br WHERE rank <= {k} AND decision = 'accepted') / (SELECT sum(3.0 / log2(i + 1)) FROM range(1, {k + 1}) t(i) WHERE i <= (SELECT count(*) FROM bench WHERE decision = 'accepted')), 9) AS ndcg_at_{k}" for k in KS)


@query("bench_ndcg", cte("br") + f"SELECT {_NDCG}")
def bench_ndcg(spark, sf_dir):
    return _round(benchmark.ndcg(carriers.bench_records(spark, sf_dir)))


_PAIR = "(SELECT round(avg(CASE WHEN a.predicted_score > r.predicted_score THEN 1.0 WHEN a.predicted_score = r.predicted_score THEN 0.5 ELSE 0.0 END::DOUBLE), 9) FROM bench a, bench r WHERE a.decision = 'accepted' AND r.decision = 'rejected')"


@query("bench_pairwise", cte("bench") + f"SELECT {_PAIR} AS pairwise_accuracy")
def bench_pairwise(spark, sf_dir):
    return _round(benchmark.pairwise_accuracy(carriers.bench_records(spark, sf_dir)))


CTE["cal"] = "SELECT bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc, sum((p - y) * (p - y)) AS sq FROM (SELECT predicted_score / 99.0::DOUBLE AS p, CAST(decision = 'accepted' AS INT) AS y, least(9, floor(predicted_score / 99.0::DOUBLE * 10)) AS bin FROM bench) q GROUP BY bin"
NEEDS["cal"] = ("bench",)
_CAL = "(SELECT round(sum(sq) / sum(n), 9) FROM cal) AS brier_score, (SELECT round(sum(n * abs(conf - acc)) / sum(n), 9) FROM cal) AS expected_calibration_error"


@query("bench_calibration", cte("cal") + f"SELECT {_CAL}")
def bench_calibration(spark, sf_dir):
    return _round(benchmark.calibration(carriers.bench_records(spark, sf_dir)))


_READ = "round(avg(CAST(reading_likelihood >= 0.48 AS INT)) FILTER (expected_reading), 9) AS reading_recall, round(avg(CAST(reading_likelihood < 0.48 AS INT)) FILTER (NOT expected_reading), 9) AS reading_specificity"


@query("bench_reading", cte("bench") + f"SELECT {_READ} FROM bench")
def bench_reading(spark, sf_dir):
    return _round(benchmark.reading_metrics(carriers.bench_records(spark, sf_dir)))


_DUP = ", ".join(f"round((count(*) FILTER (rank <= {k}) - count(DISTINCT moment_group_id) FILTER (rank <= {k})) / CAST(count(*) FILTER (rank <= {k}) AS DOUBLE), 9) AS duplicate_exposure_at_{k}" for k in KS)
_EXP = ", ".join(f"round(avg(CAST(expected_reading AS INT)) FILTER (rank <= {k}), 9) AS reading_exposure_at_{k}" for k in KS)


@query("bench_duplicates", cte("br") + f"SELECT {_DUP} FROM br")
def bench_duplicates(spark, sf_dir):
    return _round(benchmark.duplicate_exposure(carriers.bench_records(spark, sf_dir)))


def _verdicts(spark, sf_dir) -> DataFrame:
    verdict = F.when(F.col("doc_id") % 3 == 0, "incorrect").otherwise("correct")
    pairs = F.array(F.struct(F.lit("humor").alias("key"), verdict.alias("value")), F.struct(F.lit("gniew").alias("key"), F.lit("correct").alias("value")))
    return carriers.bench_records(spark, sf_dir).withColumn("tag_feedback", F.map_from_entries(F.slice(pairs, F.lit(1), (1 + F.col("doc_id") % 2).cast("int"))))


@query("bench_exposure", cte("br") + f"SELECT {_EXP}, (SELECT round(avg(v), 9) FROM (SELECT CAST(doc_id % 3 <> 0 AS INT) AS v FROM bench UNION ALL SELECT 1 FROM bench WHERE doc_id % 2 = 1) q) AS assigned_tag_precision FROM br")
def bench_exposure(spark, sf_dir):
    records = _verdicts(spark, sf_dir)
    return _round(benchmark.reading_exposure(records).crossJoin(F.broadcast(benchmark.tag_precision(records))))


@query("bench_fp_by_code", cte("bench") + "SELECT rejection_code, round(avg(CAST(predicted_score >= 50 AS INT)), 9) AS false_positive_rate FROM bench WHERE decision = 'rejected' GROUP BY rejection_code")
def bench_fp_by_code(spark, sf_dir):
    return _round(benchmark.false_positives(carriers.bench_records(spark, sf_dir)))


CTE["met"] = f"SELECT {_SUMMARY}, {_READ}, {_PR}, {_DUP}, {_EXP}, {_AP} AS average_precision, {_PAIR} AS pairwise_accuracy, {_CAL}, {_NDCG} FROM br"
NEEDS["met"] = ("br", "cal")


def _limit(metric: str, limit: float, low: bool) -> str:
    return f"CASE WHEN {metric} {'<' if low else '>'} {limit} THEN '{metric}=' || format('{{:.4f}}', CAST({metric} AS DOUBLE)) || ' is {'below' if low else 'above'} {limit:.4f}' END"


_FAILED = "list_filter([" + ", ".join(_limit(name[:-4], limit, name.endswith("_min")) for name, limit in benchmark.DEFAULT_THRESHOLDS.items()) + "], lambda x: x IS NOT NULL)"


@query("bench_gate", cte("met") + f"SELECT CASE WHEN reviewed < 50 OR source_groups < 3 THEN 'INSUFFICIENT_DATA' WHEN len({_FAILED}) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, array_to_string({_FAILED}, '; ') AS failures, average_precision, pairwise_accuracy FROM met")
def bench_gate(spark, sf_dir):
    judged = benchmark.gate(benchmark.metrics(carriers.bench_records(spark, sf_dir)))
    return judged.select("status", F.array_join("failures", "; ").alias("failures"), F.round("average_precision", 9).alias("average_precision"), F.round("pairwise_accuracy", 9).alias("pairwise_accuracy"))


@query("bench_validate", cte("bench") + """SELECT sample_id, array_to_string(list_filter([CASE WHEN doc_id % 11 = 0 THEN 'unsupported schema version' END, CASE WHEN doc_id % 7 = 0 THEN 'unsupported rejection code' END,
  CASE WHEN doc_id % 5 = 0 THEN 'predicted_score must be between 1 and 99' END, CASE WHEN doc_id % 13 = 0 THEN 'feature reading_likelihood must be between 0 and 1' END], lambda x: x IS NOT NULL), '; ') AS errors FROM bench""")
def bench_validate(spark, sf_dir):
    i = F.col("doc_id")
    records = carriers.bench_records(spark, sf_dir).withColumns({
        "schema_version": F.when(i % 11 == 0, 2).otherwise(1), "rejection_code": F.when(i % 7 == 0, "strange").otherwise(F.col("rejection_code")),
        "predicted_score": F.when(i % 5 == 0, 120.0).otherwise(F.col("predicted_score")),
        "features": F.create_map(F.lit("reading_likelihood"), F.when(i % 13 == 0, 1.5).otherwise(F.col("reading_likelihood")))})
    return benchmark.validate(records).select("sample_id", F.array_join("errors", "; ").alias("errors"))


@query("bench_load_checks", cte("bench") + """SELECT lpad(CAST(doc_id // 2 AS VARCHAR), 10, '0') AS sample_id, count(*) AS copies FROM bench GROUP BY 1 HAVING count(*) > 1""")
def bench_load_checks(spark, sf_dir):
    doubled = carriers.bench_records(spark, sf_dir).withColumn("sample_id", F.lpad(F.floor(F.col("doc_id") / 2).cast("string"), 10, "0"))
    return benchmark.repeated_ids(doubled)


# What is wrong with the JSON line of a record, by doc_id % 23: the member that is replaced, added or (null) left out, and the reason due.
_FLAWS = {
    0: ("note", '{"deep": [1, {"transcript": null}]}', "private fields: transcript"),
    1: ("path", '"x", "features": {"quality": 5}, "more": [[{"embedding": []}]]', "private fields: embedding, path"),
    2: ("features", None, "missing features"), 3: ("features", "[1]", "features must be an object"),
    4: ("features", '{"quality": true}', "feature quality must be a finite number"), 5: ("features", '{"quality": "5"}', "feature quality must be a finite number"),
    6: ("tags", '["a", 1]', "tags must be a list of strings"), 7: ("tags", "null", "tags must be a list of strings"),
    8: ("expected_reading", '"yes"', "expected_reading must be true, false or null"), 9: ("predicted_score", "true", "predicted_score must be between 1 and 99"),
    10: ("predicted_score", None, "missing predicted_score"), 11: ("group_id", '" "', "group_id must be a non-empty string"), 12: ("decision", None, "missing decision"),
    13: ("tag_feedback", '{"a": "correct", "b": "maybe"}', "tag verdicts must be correct or incorrect"), 14: ("schema_version", '"1"', None),
    15: ("schema_version", "2", "unsupported schema version"), 16: ("features", '{"odd": 1, "vision": 3.5}', "unknown numeric feature: odd"), 17: ("rejection_code", "0", None),
    18: ("features", '{"reading_likelihood": 1.5}', "feature reading_likelihood must be between 0 and 1"), 19: ("note", "{", "invalid JSON"),
    20: ("group_id", '5, "tags": "x"', "group_id must be a non-empty string; tags must be a list of strings"),
}
_FLAW_SQL = " ".join(f"WHEN {k} THEN '{reason}'" for k, (_, _, reason) in _FLAWS.items() if reason)


@query("bench_record_walk", cte("bench") + f"""SELECT CASE WHEN k <> 19 THEN sample_id END AS sample_id,
  CASE WHEN k = 21 AND count(*) OVER (PARTITION BY sample_id) > 1 THEN 'duplicate sample_id' ELSE coalesce(CASE k {_FLAW_SQL} END, '') END AS errors
  FROM (SELECT doc_id % 23 AS k, CASE WHEN doc_id % 23 = 21 THEN 'twin-' || CAST(doc_id // 69 AS VARCHAR) ELSE sample_id END AS sample_id FROM bench) q""")
def bench_record_walk(spark, sf_dir):
    """Every record as a JSON line, most with a flaw; all reasons found in the lines."""
    rows, k = carriers.bench_records(spark, sf_dir), F.col("doc_id") % 23
    members = {"schema_version": F.lit("1"), "sample_id": F.when(k == 21, F.concat(F.lit('"twin-'), F.floor(F.col("doc_id") / 69).cast("string"), F.lit('"'))).otherwise(F.format_string('"%s"', "sample_id")),
               "predicted_score": F.col("predicted_score").cast("string"), "features": F.concat(F.lit('{"reading_likelihood": '), F.col("reading_likelihood").cast("string"), F.lit("}")),
               **{name: F.format_string('"%s"', name) for name in ("group_id", "decision", "rejection_code")}}
    for name in ("note", "path", "tags", "expected_reading", "tag_feedback"):
        members[name] = F.lit(None).cast("string")
    for role, (name, value, _) in _FLAWS.items():
        members[name] = F.when(k == role, F.lit(value).cast("string")).otherwise(members[name])
    members["features"] = F.when(k == 1, F.lit(None)).otherwise(members["features"])  # stands in the text of role 1
    lines = rows.select(F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), value) for name, value in members.items()]), F.lit("}")).alias("value"))
    return benchmark_files.check_lines(lines).select("sample_id", F.array_join("errors", "; ").alias("errors"))


# ---- statistics -------------------------------------------------------------------------------------------------------
MACHINE = ["tags", *stats.SCORES.values(), "reading_likelihood"]
CTE["facts0"] = """
SELECT t.*, CASE WHEN t.id % 6 = 5 THEN 'unrated' ELSE r.rating END AS rating, CASE WHEN t.id % 6 = 5 THEN '' ELSE r.review_reason END AS review_reason, CASE t.id % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'default' ELSE 'extended' END AS analysis_mode,
  CASE WHEN t.id % 4 = 0 THEN 'short' END AS platform, CASE WHEN t.id % 4 = 0 THEN t.n_chars END AS views, CASE WHEN t.id % 4 = 0 THEN (t.n_chars % 80)::DOUBLE END AS watch, CASE WHEN t.id % 4 = 0 THEN t.id % 9 END AS shares, CASE WHEN t.id % 4 = 0 THEN t.id % 5 END AS comments
FROM tagged t JOIN rev r ON r.segment_id = t.id"""
NEEDS["facts0"] = ("tagged", "rev")
CTE["facts1"] = "SELECT * REPLACE (CASE WHEN id % 2 = 0 THEN quality_score ELSE 99 - quality_score END AS quality_score) FROM facts0 WHERE rating <> 'unrated' OR id % 12 <> 5"
NEEDS["facts1"] = ("facts0",)


def facts(spark, sf_dir) -> DataFrame:
    """Reviewed facts: every second review refers to an older revision with another quality score."""
    i = F.col("id")
    segments = carriers.tagged(spark, sf_dir, False).withColumn("lifecycle_state", F.when(i % 12 == 5, "retired").otherwise("current")).withColumn(
        "analysis_mode", F.when(i % 3 == 0, "fast").when(i % 3 == 1, "default").otherwise("extended"))
    reviews = carriers.reviews(spark, sf_dir).select(
        F.col("segment_id").alias("id"), F.when(F.col("segment_id") % 6 == 5, "unrated").otherwise(F.col("rating")).alias("rating"),
        F.when(F.col("segment_id") % 6 == 5, "").otherwise(F.col("review_reason")).alias("review_reason"),
        F.concat(F.lit("rev-"), F.col("segment_id").cast("string")).alias("reviewed_revision_id"))
    revisions = segments.where(i % 2 == 1).withColumn("quality_score", 99 - F.col("quality_score")).withColumn(
        "revision_id", F.concat(F.lit("rev-"), i.cast("string")))
    shown = segments.where(i % 4 == 0).select("id", F.lit("short").alias("platform"), F.col("n_chars").alias("views"), (F.col("n_chars") % 80).cast("double").alias("average_watch_percent"),
                                              (i % 9).alias("shares"), (i % 5).alias("comments"))
    return stats.reviewed_facts(segments, reviews, revisions, shown, MACHINE)


@query("stats_base", cte("facts1") + "SELECT id, rating, CAST(quality_score AS INT) AS quality_score, analysis_mode FROM facts1")
def stats_base(spark, sf_dir):
    return facts(spark, sf_dir).select("id", "rating", "quality_score", "analysis_mode")


@query("stats_overview", cte("facts1") + """SELECT count(*) AS total, count(*) FILTER (rating <> 'unrated') AS reviewed, count(*) FILTER (rating = 'accepted') AS accepted, count(*) FILTER (rating = 'rejected') AS rejected,
  CAST(round_even(count(*) FILTER (rating = 'accepted') * 100 / CAST(count(*) FILTER (rating <> 'unrated') AS DOUBLE), 0) AS INT) AS approval_rate, count(*) FILTER (platform IS NOT NULL) AS published FROM facts1""")
def stats_overview(spark, sf_dir):
    return stats.overview(facts(spark, sf_dir))


_N = "count(*) FILTER (rating = 'accepted') AS accepted, count(*) FILTER (rating = 'rejected') AS rejected, count(*) FILTER (rating = 'unrated') AS unrated"


@query("stats_tags", cte("facts1") + f"""SELECT *, CAST(CASE WHEN accepted + rejected > 0 THEN round_even(accepted * 100 / CAST(accepted + rejected AS DOUBLE), 0) END AS INT) AS approval_rate FROM (
  SELECT tag, {_N}, count(*) AS total FROM (SELECT rating, unnest(tags) AS tag FROM facts1) a GROUP BY tag) b ORDER BY total DESC, tag DESC LIMIT 14""")
def stats_tags(spark, sf_dir):
    return stats.tag_report(facts(spark, sf_dir))


@query("stats_modes", cte("facts1") + f"SELECT analysis_mode AS mode, {_N} FROM facts1 GROUP BY 1")
def stats_modes(spark, sf_dir):
    return stats.mode_report(facts(spark, sf_dir))


@query("stats_reasons", cte("facts1") + """, c AS (SELECT review_reason AS reason, count(*) AS n FROM facts1 WHERE rating = 'rejected' GROUP BY 1), s AS (SELECT r_name AS reason FROM region UNION ALL SELECT 'needs context')
  SELECT s.reason, coalesce(c.n, 0) AS count, true AS saved FROM s LEFT JOIN c ON c.reason = s.reason UNION ALL SELECT * FROM (SELECT reason, n, false FROM c WHERE reason NOT IN (SELECT reason FROM s) ORDER BY n DESC, reason LIMIT 10) q""")
def stats_reasons(spark, sf_dir):
    regions = carriers.table(spark, sf_dir, "region")
    saved = regions.select(F.col("r_name").alias("reason")).unionByName(regions.select(F.lit("needs context").alias("reason")).distinct())
    return stats.reason_report(facts(spark, sf_dir), saved)


CTE["cmp"] = " UNION ALL ".join(f"""SELECT '{label}' AS score, CAST(round_even(avg({column}) FILTER (rating = 'accepted' AND {column} > 0), 0) AS INT) AS accepted, count(*) FILTER (rating = 'accepted' AND {column} > 0) AS accepted_count,
  CAST(round_even(avg({column}) FILTER (rating = 'rejected' AND {column} > 0), 0) AS INT) AS rejected, count(*) FILTER (rating = 'rejected' AND {column} > 0) AS rejected_count FROM facts1""" for label, column in stats.SCORES.items())
NEEDS["cmp"] = ("facts1",)


@query("stats_score_comparison", cte("cmp") + "SELECT * FROM cmp")
def stats_score_comparison(spark, sf_dir):
    return stats.score_comparison(facts(spark, sf_dir))


@query("stats_calibration", cte("cmp") + "SELECT score, accepted - rejected AS delta, least(accepted_count, rejected_count) AS sample_size, CASE WHEN least(accepted_count, rejected_count) < 5 THEN 'collecting_data' WHEN accepted - rejected >= 10 THEN 'strong_signal' WHEN accepted - rejected >= 4 THEN 'weak_signal' ELSE 'needs_tuning' END AS verdict FROM cmp")
def stats_calibration(spark, sf_dir):
    return stats.calibration(stats.score_comparison(facts(spark, sf_dir)))


@query("stats_published", cte("facts1") + "SELECT count(*) AS count, CAST(sum(views) AS BIGINT) AS views, round_even(median(watch) FILTER (watch > 0), 1) AS median_watch_percent, CAST(sum(shares) AS BIGINT) AS shares, CAST(sum(comments) AS BIGINT) AS comments FROM facts1 WHERE platform IS NOT NULL")
def stats_published(spark, sf_dir):
    return stats.published_performance(facts(spark, sf_dir))


@query("stats_reading_flags", cte("facts1") + f"SELECT {_N} FROM facts1 WHERE reading_likelihood >= 0.48")
def stats_reading_flags(spark, sf_dir):
    return stats.reading_flags(facts(spark, sf_dir))


@query("profile_counts", cte("rev") + "SELECT d.lang AS profile, count(r.rating) FILTER (r.rating = 'accepted') AS accepted, count(r.rating) FILTER (r.rating = 'rejected') AS rejected FROM (SELECT DISTINCT lang FROM documents UNION SELECT 'nobody') d LEFT JOIN rev r ON r.profile = d.lang GROUP BY 1")
def profile_counts(spark, sf_dir):
    documents = carriers.table(spark, sf_dir, "documents")
    profiles = documents.select(F.col("lang").alias("profile")).unionByName(documents.select(F.lit("nobody").alias("profile"))).distinct()
    return stats.profile_counts(carriers.reviews(spark, sf_dir).withColumnRenamed("rating", "decision"), profiles)


@query("pattern_set_counts", "SELECT p_partkey AS pattern_set_id, count(l_partkey) AS examples FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 45 GROUP BY 1")
def pattern_set_counts(spark, sf_dir):
    sets = carriers.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pattern_set_id"))
    examples = carriers.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("pattern_set_id"))
    return stats.member_counts(sets, examples, "pattern_set_id", "examples")


@query("collection_counts", """SELECT c_custkey AS collection_id, coalesce(o.n, 0) + coalesce(e.n, 0) AS examples, coalesce(e.n, 0) AS external_examples FROM customer
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) e ON e.user_id = c_custkey""")
def collection_counts(spark, sf_dir):
    collections = carriers.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("collection_id"))
    own = carriers.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("collection_id"))
    external = carriers.table(spark, sf_dir, "events").select(F.col("user_id").alias("collection_id"))
    counted = stats.member_counts(stats.member_counts(collections, own, "collection_id", "own"), external, "collection_id", "external_examples")
    return counted.select("collection_id", (F.col("own") + F.col("external_examples")).alias("examples"), "external_examples")


CTE["runs"] = """SELECT o_orderkey AS id, o_orderpriority AS audio_mode, o_orderstatus AS analysis_mode, 20.0::DOUBLE + o_totalprice AS duration_seconds, (o_orderkey % 97)::DOUBLE AS analysis_seconds, o_orderdate AS updated_at, o_orderkey % 5 = 0 AS waiting FROM orders"""


@query("duration_estimate", cte("runs") + """, r AS (SELECT audio_mode, analysis_mode, median(analysis_seconds / duration_seconds) AS ratio, count(*) AS samples FROM (
  SELECT *, row_number() OVER (PARTITION BY audio_mode, analysis_mode ORDER BY updated_at DESC, id DESC) AS rn FROM runs WHERE NOT waiting AND duration_seconds >= 30 AND analysis_seconds > 1) q WHERE rn <= 8 GROUP BY 1, 2)
  SELECT w.id, round(greatest(15.0::DOUBLE, w.duration_seconds * r.ratio), 4) AS estimate_seconds, coalesce(r.samples, 0) AS samples FROM runs w LEFT JOIN r ON r.audio_mode = w.audio_mode AND r.analysis_mode = w.analysis_mode WHERE w.waiting""")
def duration_estimate(spark, sf_dir):
    runs = carriers.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("audio_mode"), F.col("o_orderstatus").alias("analysis_mode"),
        (20.0 + F.col("o_totalprice")).alias("duration_seconds"), (F.col("o_orderkey") % 97).cast("double").alias("analysis_seconds"), F.col("o_orderdate").alias("updated_at"))
    waiting = F.col("id") % 5 == 0
    estimated = stats.duration_estimates(runs.where(waiting), runs.where(~waiting))
    exact = F.greatest(F.lit(15.0), F.col("duration_seconds") * F.col("ratio"))
    return estimated.select("id", F.round(exact, 4).alias("estimate_seconds"), "samples")


@query("keyword_topk", r"""SELECT source, word, n, place FROM (SELECT source, word, n, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS place FROM (
  SELECT source, word, count(*) AS n FROM (SELECT source, lower(trim(w, '.,!?;:-()[]{}"''')) AS word FROM (SELECT source, unnest(string_split(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), ' ')) AS w FROM documents) a) b
  WHERE length(word) >= 5 AND word NOT IN ('bardzo', 'tylko', 'przez') GROUP BY 1, 2) c) d WHERE place <= 6""")
def keyword_topk(spark, sf_dir):
    documents = carriers.balanced(carriers.table(spark, sf_dir, "documents"))
    top = stats.keyword_topk(documents, "source", "text", DEFAULT_VOCABULARY.prompt_stopwords)
    return top.select("source", "word", "n", F.col("place").cast("bigint").alias("place"))


@query("reference_prompts", cte("tagged") + r""", t AS (SELECT video_id, tag, count(*) AS n, min(id * 1000 + i) AS first FROM (SELECT video_id, id, unnest(tags) AS tag, unnest(range(len(tags))) AS i FROM tagged) a GROUP BY 1, 2),
  tt AS (SELECT video_id, string_agg(tag, ', ' ORDER BY place) AS said FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, first) AS place FROM t) b WHERE place <= 4 GROUP BY 1),
  w AS (SELECT video_id, word, count(*) AS n, min(id * 10000000 + i) AS first FROM (SELECT video_id, id, i, lower(trim(w, '.,!?;:-()[]{}"''')) AS word FROM (
    SELECT video_id, id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT video_id, id, string_split(trim(regexp_replace(transcript, '[\s\p{Z}]+', ' ', 'g')), ' ') AS ws FROM tagged) a) b) c
    WHERE length(word) >= 5 AND word NOT IN ('bardzo', 'tylko', 'przez') GROUP BY 1, 2),
  ww AS (SELECT video_id, string_agg(word, ', ' ORDER BY place) AS said FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, first) AS place FROM w) b WHERE place <= 6 GROUP BY 1)
  SELECT v.video_id, 'Find clips similar to the reference examples. Prioritize: ' || coalesce(tt.said, 'similar tone and context') || '. Typical context and wording: ' || coalesce(ww.said, 'the tone, topic and structure of reference clips') || '.' AS prompt
  FROM (SELECT DISTINCT video_id FROM tagged) v LEFT JOIN tt ON tt.video_id = v.video_id LEFT JOIN ww ON ww.video_id = v.video_id""")
def reference_prompts(spark, sf_dir):
    """Every recording as a collection of its clips."""
    return stats.reference_prompts(carriers.tagged(spark, sf_dir), "video_id", "id", "transcript", "tags", DEFAULT_VOCABULARY.prompt_stopwords)
