"""Queries over vectors, duplicates, ranking and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.operators import diversity, ranking, similarity
from cuewise.operators.ordering import ordered_index
from cuewise.plans import carriers, search
from cuewise.plans.carriers import CTE, NEEDS, cte
from cuewise.plans.registry import query
from cuewise.session import cut_lineage

def tie3(value: str) -> str:
    """Half-even rounding to three places on the decimal value, as Spark does it."""
    m = f"(CAST(CAST({value} AS VARCHAR) AS DECIMAL(30,20)) * 1000)"
    return f"(CAST(floor({m}) + CASE WHEN {m} - floor({m}) > 0.5 OR ({m} - floor({m}) = 0.5 AND floor({m}) % 2 <> 0) THEN 1 ELSE 0 END AS DOUBLE) / 1000)"


# the test vectors are far apart, so the near-duplicate limits are lower here than the production defaults
LIMITS = {"threshold": 0.35, "overlap_similarity": 0.10, "overlap_ratio": 0.45}

CTE["pairs"] = """
SELECT * FROM (SELECT a.video_id, a.id AS left_id, b.id AS right_id, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity,
  greatest(0.0::DOUBLE, least(a.end_seconds, b.end_seconds) - greatest(a.start_seconds, b.start_seconds)) / greatest(0.1::DOUBLE, least(a.end_seconds - a.start_seconds, b.end_seconds - b.start_seconds)) AS shared
  FROM seg a JOIN seg b ON a.video_id = b.video_id AND a.id < b.id AND a.embedding IS NOT NULL AND b.embedding IS NOT NULL) q
WHERE similarity >= 0.35 OR (shared >= 0.45 AND similarity >= 0.10)"""
NEEDS["pairs"] = ("seg",)


@query("duplicate_pairs", cte("pairs") + "SELECT video_id, left_id, right_id, round(similarity, 6) AS similarity FROM pairs")
def duplicate_pairs(spark, sf_dir):
    pairs = similarity.near_duplicate_pairs(carriers.segments(spark, sf_dir), **LIMITS)
    return pairs.withColumn("similarity", F.round("similarity", 6))


_GROUPS = cte("pairs").replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT left_id AS a, right_id AS b FROM pairs UNION SELECT right_id, left_id FROM pairs),
  r AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
  c AS (SELECT id, min(root) AS root FROM r GROUP BY id),
  n AS (SELECT c.id, 'repeat-' || dense_rank() OVER (PARTITION BY s.video_id ORDER BY c.root) AS duplicate_group FROM c JOIN seg s ON s.id = c.id)
  SELECT s.id, coalesce(n.duplicate_group, '') AS duplicate_group FROM seg s LEFT JOIN n ON n.id = s.id"""


@query("duplicate_groups", _GROUPS)
def duplicate_groups(spark, sf_dir):
    return similarity.assign_duplicate_groups(carriers.segments(spark, sf_dir), **LIMITS).select("id", "duplicate_group")


# ---- reference and feedback similarity ------------------------------------------------------------------------------
CTE["top8"] = """
SELECT id, avg(dot) AS top FROM (SELECT s.id, list_inner_product(s.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS dot,
  row_number() OVER (PARTITION BY s.id ORDER BY list_inner_product(s.embedding::DOUBLE[], r.embedding::DOUBLE[]) DESC) AS rn
  FROM seg s JOIN embeddings r ON r.vec_id % 25 = 3 WHERE s.embedding IS NOT NULL) q WHERE rn <= 8 GROUP BY id"""
NEEDS["top8"] = ("seg",)


def references(spark, sf_dir) -> DataFrame:
    return carriers.table(spark, sf_dir, "embeddings").where("vec_id % 25 = 3").select(
        F.col("vec_id").alias("ref_id"), F.col("embedding").cast("array<double>").alias("ref_vector"))


def _vectored(spark, sf_dir) -> DataFrame:
    return carriers.segments(spark, sf_dir).where(F.col("embedding").isNotNull())


@query("reference_similarity", cte("top8") + "SELECT id, round(top, 6) AS similarity FROM top8")
def reference_similarity(spark, sf_dir):
    matched = similarity.mean_top_similarity(_vectored(spark, sf_dir), references(spark, sf_dir), 8, "similarity")
    return matched.select("id", F.round("similarity", 6).alias("similarity"))


@query("mean_topk_similarity", cte("top8") + "SELECT id, round(top, 6) AS similarity FROM top8")
def mean_topk_similarity(spark, sf_dir):
    # the block path that large reference sets take
    matched = similarity.mean_top_similarity(_vectored(spark, sf_dir), references(spark, sf_dir), 8, "similarity", block=8, spread=4, broadcast_limit=0)
    return matched.select("id", F.round("similarity", 6).alias("similarity"))


PROFILE = "general"
CTE["fb"] = """
SELECT * FROM (SELECT r.segment_id, r.rating, r.review_reason, t.embedding::DOUBLE[] AS v, t.tags, t.quality_score, t.audio_event_score, t.game_reaction_score, t.voice_expression_score, t.vision_score,
  t.chat_reaction_score, t.chat_joy_score, t.logical_sense_score, t.context_score, t.self_contained_score, t.extended_completeness_score, t.chat_question_match_score, t.moment_reaction_score, t.reading_likelihood
  FROM rev r JOIN tagged t ON t.id = r.segment_id AND t.embedding IS NOT NULL WHERE r.profile = 'en' ORDER BY r.updated_at DESC, r.segment_id LIMIT 240) q"""
NEEDS["fb"] = ("rev", "tagged")


def feedback(spark, sf_dir) -> DataFrame:
    """Decisions with frozen vectors and features; English stands in for the general profile."""
    frozen = carriers.tagged(spark, sf_dir).where(F.col("embedding").isNotNull()).withColumn("features", ranking.feature_struct()).select(
        F.col("id").alias("segment_id"), "embedding", "features", "tags")
    profile = F.when(F.col("profile") == "en", "general").when(F.col("profile") == "fr", "opinions").otherwise("horror")
    return carriers.reviews(spark, sf_dir).select("segment_id", F.col("rating").alias("decision"), "review_reason", profile.alias("profile"), "updated_at").join(frozen, "segment_id")


@query("recent_feedback", cte("fb") + "SELECT segment_id, rating AS decision FROM fb")
def recent_feedback(spark, sf_dir):
    return ranking.recent_feedback(feedback(spark, sf_dir), PROFILE).select("segment_id", "decision")


_FEATURE_SQL = [
    "least(1.0::DOUBLE, greatest(0.0::DOUBLE, {a}quality_score / 99.0::DOUBLE))",
    *[f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {{a}}{name} / 20.0::DOUBLE))" for name in (
        "audio_event_score", "game_reaction_score", "voice_expression_score", "vision_score", "chat_reaction_score", "chat_joy_score")],
    *[f"CASE WHEN {{a}}{name} < 0 THEN 0.5::DOUBLE ELSE {{a}}{name} / 100.0::DOUBLE END" for name in (
        "logical_sense_score", "context_score", "self_contained_score", "extended_completeness_score")],
    "greatest(0.0::DOUBLE, {a}chat_question_match_score / 100.0::DOUBLE)", "least(1.0::DOUBLE, {a}moment_reaction_score / 30.0::DOUBLE)", "{a}reading_likelihood",
]
CTE["cent"] = "SELECT rating, " + ", ".join(f"avg({f.format(a='')}) AS f{i}" for i, f in enumerate(_FEATURE_SQL)) + " FROM fb GROUP BY rating"
NEEDS["cent"] = ("fb",)
_DISTANCE = "(" + " + ".join(f"abs({f.format(a='t.')} - c.f{i})" for i, f in enumerate(_FEATURE_SQL)) + ") / 14"
CTE["dist"] = f"SELECT t.id, max({_DISTANCE}) FILTER (c.rating = 'accepted') AS d_acc, max({_DISTANCE}) FILTER (c.rating = 'rejected') AS d_rej FROM tagged t, cent c WHERE t.embedding IS NOT NULL GROUP BY t.id"
NEEDS["dist"] = ("tagged", "cent")


@query("feature_distance", cte("dist") + "SELECT id, round(d_acc, 9) AS accepted_distance, round(d_rej, 9) AS rejected_distance FROM dist")
def feature_distance(spark, sf_dir):
    summary = ranking.feedback_summary(ranking.recent_feedback(feedback(spark, sf_dir), PROFILE))
    rows = carriers.tagged(spark, sf_dir).where(F.col("embedding").isNotNull()).withColumn("features", ranking.feature_struct())
    return rows.crossJoin(F.broadcast(summary)).select(
        "id", F.round(ranking.feature_distance("features", "accepted_centroid"), 9).alias("accepted_distance"),
        F.round(ranking.feature_distance("features", "rejected_centroid"), 9).alias("rejected_distance"))


CTE["aff"] = """
SELECT t.id, greatest(-5.0::DOUBLE, least(5.0::DOUBLE, sum(8 * ((coalesce(k.acc, 0) + 1) / (n.a + 4.0::DOUBLE) - (coalesce(k.rej, 0) + 1) / (n.r + 4.0::DOUBLE))))) AS affinity
FROM (SELECT id, unnest(tags) AS tag FROM tagged WHERE embedding IS NOT NULL) t CROSS JOIN (SELECT count(*) FILTER (rating = 'accepted') AS a, count(*) FILTER (rating = 'rejected') AS r FROM fb) n
LEFT JOIN (SELECT tag, count(*) FILTER (rating = 'accepted') AS acc, count(*) FILTER (rating = 'rejected') AS rej FROM (SELECT rating, unnest(tags) AS tag FROM fb) u GROUP BY tag) k ON k.tag = t.tag GROUP BY t.id"""
NEEDS["aff"] = ("tagged", "fb")


@query("tag_affinity", cte("aff") + "SELECT id, round(affinity, 9) AS affinity FROM aff")
def tag_affinity(spark, sf_dir):
    from cuewise.functions.tags import canonical_tags

    summary = ranking.feedback_summary(ranking.recent_feedback(feedback(spark, sf_dir), PROFILE))
    rows = carriers.tagged(spark, sf_dir).where(F.col("embedding").isNotNull()).withColumn("tags", canonical_tags(F.col("tags")))
    return rows.crossJoin(F.broadcast(summary)).select("id", F.round(ranking.tag_affinity(F.col("tags")), 9).alias("affinity"))


CTE["fdot"] = """
SELECT s.id, f.rating, f.review_reason, list_inner_product(s.embedding::DOUBLE[], f.v) AS dot FROM seg s, fb f WHERE s.embedding IS NOT NULL"""
NEEDS["fdot"] = ("seg", "fb")
CTE["reason"] = """
SELECT id, review_reason, avg(dot) AS m FROM (SELECT *, row_number() OVER (PARTITION BY id, review_reason ORDER BY dot DESC) AS rn FROM fdot WHERE rating = 'rejected' AND review_reason <> '') q WHERE rn <= 4 GROUP BY id, review_reason"""
NEEDS["reason"] = ("fdot",)


@query("rejection_reason_match", cte("reason") + "SELECT id, arg_max(review_reason, m) AS reason, round(max(m), 6) AS match FROM reason GROUP BY id")
def rejection_reason_match(spark, sf_dir):
    rows = carriers.tagged(spark, sf_dir).where(F.col("embedding").isNotNull())
    matched = ranking.with_feedback(rows, feedback(spark, sf_dir), PROFILE)
    return matched.select("id", F.col("_reason").alias("reason"), F.round("_reason_match", 6).alias("match"))


CTE["fm"] = """
SELECT id, avg(dot) FILTER (rating = 'accepted' AND rn <= 8) AS approve, avg(dot) FILTER (rating = 'rejected' AND rn <= 4) AS reject FROM (
  SELECT *, row_number() OVER (PARTITION BY id, rating ORDER BY dot DESC) AS rn FROM fdot) q GROUP BY id"""
NEEDS["fm"] = ("fdot",)
CTE["base"] = """
SELECT t.*, t.end_seconds - t.start_seconds AS d, CASE WHEN logical_sense_score < 0 THEN 50 ELSE logical_sense_score END AS lo, CASE WHEN context_score < 0 THEN 50 ELSE context_score END AS co,
  CASE WHEN self_contained_score < 0 THEN 50 ELSE self_contained_score END AS se, CASE WHEN extended_completeness_score < 0 THEN 50 ELSE extended_completeness_score END AS cm,
  CASE WHEN chat_question_match_score < 0 THEN 50 ELSE chat_question_match_score END AS qu, greatest(0, voice_expression_score) AS vo, CASE WHEN voice_expression_score < 0 THEN 0 ELSE voice_expression_score END AS vk,
  list_has_any(tags, ['forma: opinia', 'forma: puenta']) OR (chat_reaction_score >= 8 AND logical_sense_score >= 60) AS lf,
  list_has_any(tags, ['humor', 'gniew']) OR game_reaction_score >= 11 OR voice_expression_score >= 9 AS emo, chat_joy_score >= 4 AND chat_reaction_score >= 5 AS happy,
  reading_likelihood >= 0.48 AND NOT (t.end_seconds - t.start_seconds <= 24 AND chat_question_match_score >= 40 AND chat_reaction_score >= 7 AND chat_joy_score >= 3) AS excluded,
  greatest(least(7.0::DOUBLE, audio_event_score * 0.35::DOUBLE), least(13.0::DOUBLE, game_reaction_score * 0.65::DOUBLE), least(14.0::DOUBLE, moment_reaction_score / 30.0::DOUBLE * 14.0::DOUBLE)) AS g,
  greatest(least(11.0::DOUBLE, chat_reaction_score * 0.55::DOUBLE), least(9.0::DOUBLE, chat_joy_score * 0.65::DOUBLE)) AS ch, least(7.0::DOUBLE, vision_score * 0.35::DOUBLE) AS vi,
  least(8.0::DOUBLE, CASE WHEN list_contains(tags, 'humor') THEN 5 ELSE 0 END + CASE WHEN list_contains(tags, 'gniew') THEN 4 ELSE 0 END + CASE WHEN list_contains(tags, 'reakcja na grę') THEN 6 ELSE 0 END) AS tv
FROM tagged t WHERE t.embedding IS NOT NULL"""
NEEDS["base"] = ("tagged",)
CTE["comp"] = """
SELECT b.*, fm.approve, fm.reject, greatest(-9.0::DOUBLE, least(7.0::DOUBLE, greatest(0.0::DOUBLE, (fm.approve - 0.25::DOUBLE) * 8.0::DOUBLE) - CASE WHEN fm.reject >= 0.38 THEN fm.reject * 7.0::DOUBLE ELSE 0 END
    + greatest(-4.0::DOUBLE, least(4.0::DOUBLE, (dist.d_rej - dist.d_acc) * 12.0::DOUBLE)) + aff.affinity)) AS fv,
  (lo - 50.0::DOUBLE) * 0.075::DOUBLE + (co - 50.0::DOUBLE) * 0.050::DOUBLE + (se - 50.0::DOUBLE) * 0.075::DOUBLE + (cm - 50.0::DOUBLE) * 0.045::DOUBLE + greatest(0.0::DOUBLE, qu - 50.0::DOUBLE) * 0.035::DOUBLE AS coh0
FROM base b JOIN fm ON fm.id = b.id JOIN dist ON dist.id = b.id JOIN aff ON aff.id = b.id"""
NEEDS["comp"] = ("base", "fm", "dist", "aff")
CTE["ranked0"] = """
SELECT *, round_even(greatest(12.0::DOUBLE, least(42.0::DOUBLE, 12.0::DOUBLE + quality_score * 0.30::DOUBLE)), 3) AS editorial,
  round_even(greatest(-14.0::DOUBLE, least(15.0::DOUBLE, CASE WHEN NOT emo AND lo < 42 AND happy THEN greatest(coh0, -4.0::DOUBLE) + least(3.0::DOUBLE, chat_joy_score * 0.25::DOUBLE)
    WHEN NOT emo AND lo < 42 THEN coh0 - least(5.0::DOUBLE, (42.0::DOUBLE - lo) * 0.15::DOUBLE) ELSE coh0 END)), 3) AS coherence,
  greatest(0.0::DOUBLE, least(16.0::DOUBLE, list_reverse_sort([g, ch, vi])[1] + list_reverse_sort([g, ch, vi])[2] * 0.25::DOUBLE)) AS eng,
  round_even(greatest(-6.0::DOUBLE, least(4.0::DOUBLE, least(4.0::DOUBLE, vk * 0.25::DOUBLE))), 3) AS delivery, round_even(greatest(-12.0::DOUBLE, least(10.0::DOUBLE, tv)), 3) AS profile,
  round_even(greatest(-12.0::DOUBLE, least(14.0::DOUBLE, fv)), 3) AS preference,
  CASE WHEN d BETWEEN 8 AND 26 THEN 8.0::DOUBLE WHEN d > 26 AND d <= 32 THEN 4 WHEN d > 32 AND d <= 42 AND lf THEN 1 WHEN d > 32 AND d <= 42 THEN -11 WHEN d > 42 AND lf THEN -8 WHEN d > 42 THEN -25 ELSE -4 END AS duration,
  round_even(greatest(-52.0::DOUBLE, -reading_likelihood * CASE WHEN excluded THEN 52.0::DOUBLE ELSE 10.0::DOUBLE END), 3) AS reading FROM comp"""
NEEDS["ranked0"] = ("comp",)
CTE["ranked1"] = "SELECT *, round_even(eng, 3) AS engagement, round_even(editorial + coherence + round_even(eng, 3) + delivery + profile + preference + duration + reading, 3) AS raw FROM ranked0"
NEEDS["ranked1"] = ("ranked0",)
CTE["ranked2"] = """
SELECT *, greatest(1, CAST(round_even(raw, 0) AS INT)) AS r0, quality_score >= 92 AND lo >= 86 AND co >= 80 AND se >= 86 AND cm >= 82 AND d BETWEEN 8 AND 28 AND reading_likelihood < 0.20
  AND (eng >= 12 OR voice_expression_score >= 10 OR qu >= 75) AND NOT excluded AS exceptional FROM ranked1"""
NEEDS["ranked2"] = ("ranked1",)
CTE["ranked"] = """
SELECT *, CAST(CASE WHEN excluded THEN least(18, CASE WHEN r0 >= 99 AND NOT exceptional THEN 98 ELSE least(99, r0) END) WHEN r0 >= 99 AND NOT exceptional THEN 98 ELSE least(99, r0) END AS INT) AS ranking_score FROM ranked2"""
NEEDS["ranked"] = ("ranked2",)


def _decimal_ties(sql: str) -> str:
    """Replace every ``round_even(x, 3)`` by the decimal form."""
    while (at := sql.rfind("round_even(")) >= 0:
        depth, end = 1, at + len("round_even(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + len("round_even("):end - 1]
        value, places = inner.rsplit(",", 1)
        sql = sql[:at] + (tie3(value) if places.strip() == "3" else f"round_half({inner})") + sql[end:]
    return sql.replace("round_half(", "round_even(")


for _name in ("ranked0", "ranked1"):
    CTE[_name] = _decimal_ties(CTE[_name])


def ranked(spark, sf_dir) -> DataFrame:
    """Vector-bearing segments scored for the general profile with past decisions."""
    candidates = carriers.tagged(spark, sf_dir).where(F.col("embedding").isNotNull())
    return ranking.score_candidates(candidates, PROFILE, feedback(spark, sf_dir))


@query("score_candidates", cte("ranked") + "SELECT id, editorial, coherence, engagement, delivery, profile, preference, duration, reading, raw AS ranking_raw_score, exceptional AS ranking_exceptional, excluded, ranking_score FROM ranked")
def score_candidates(spark, sf_dir):
    return ranked(spark, sf_dir).select("id", "ranking_components.*", "ranking_raw_score", "ranking_exceptional", F.col("excluded_from_discovery").alias("excluded"), "ranking_score")


CTE["uniq"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, duplicate_group ORDER BY ranking_score DESC, start_seconds, id) AS rn FROM ranked) q WHERE rn = 1 OR duplicate_group = ''"""
NEEDS["uniq"] = ("ranked",)


@query("suppress_duplicates", cte("ranked") + """SELECT id, duplicate_group <> '' AND rn > 1 AS duplicate_alternative FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, duplicate_group ORDER BY ranking_score DESC, start_seconds, id) AS rn FROM ranked) q""")
def suppress_duplicates(spark, sf_dir):
    return similarity.suppress_duplicates(ranked(spark, sf_dir), keep_alternatives=True).select("id", "duplicate_alternative")


@query("ranked_topk", cte("uniq") + "SELECT video_id, id, ranking_score FROM uniq WHERE NOT excluded ORDER BY ranking_score DESC, start_seconds, id LIMIT 100")
def ranked_topk(spark, sf_dir):
    found = search.top_ranked(ranked(spark, sf_dir), 100)
    return found.select("video_id", "id", "ranking_score")


@query("reading_filter", cte("base") + "SELECT id FROM base WHERE NOT excluded")
def reading_filter(spark, sf_dir):
    return ranking.filter_reading(carriers.scored(spark, sf_dir).where(F.col("embedding").isNotNull())).select("id")


CTE["rs"] = "SELECT r.*, v.rating FROM ranked r JOIN rev v ON v.segment_id = r.id"
NEEDS["rs"] = ("ranked", "rev")


@query("segment_search", cte("rs") + """SELECT id, ranking_score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, duplicate_group ORDER BY ranking_score DESC, start_seconds, id) AS rn FROM rs
  WHERE transcript ILIKE '%th%' AND rating = 'accepted' AND reading_likelihood < 0.48) q WHERE (rn = 1 OR duplicate_group = '') AND NOT excluded""")
def segment_search(spark, sf_dir):
    reviews = carriers.reviews(spark, sf_dir).select(F.col("segment_id").alias("id"), "rating", "review_reason")
    found = search.search_segments(carriers.tagged(spark, sf_dir), reviews, feedback(spark, sf_dir), text="TH", rating="accepted", hide_reading=True)
    return found.select("id", "ranking_score")


@query("sort_modes", cte("uniq") + " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{mode}' AS mode, id, row_number() OVER (ORDER BY {column} {direction}, start_seconds, id) AS place FROM uniq) m{i} WHERE place <= 25"""
    for i, (mode, column, direction) in enumerate((f"{label}_{d}", column, d) for label, column in (
        ("suggested", "ranking_score"), ("quality", "quality_score"), ("short_potential", "short_potential_score"), ("self_contained", "self_contained_score")) for d in ("desc", "asc"))))
def sort_modes(spark, sf_dir):
    rows = similarity.suppress_duplicates(ranked(spark, sf_dir))
    result = None
    for mode in ranking.SORT_MODES:
        page = search.page(rows, mode, 25).select(F.lit(mode).alias("mode"), "id", F.col("place").cast("bigint").alias("place"))
        result = page if result is None else result.unionByName(page)
    return result


CTE["sim"] = 'SELECT r.*, top8.top AS prompt FROM ranked1 r JOIN top8 ON top8.id = r.id'
NEEDS["sim"] = ("ranked1", "top8")
_SEARCH = """, p AS (SELECT *, round_even(greatest(-12.0::DOUBLE, least(14.0::DOUBLE, greatest(0.0::DOUBLE, prompt) * 10.0::DOUBLE + fv)), 3) AS pref2 FROM sim),
  z AS (SELECT *, CAST(greatest(1, round_even(round_even(editorial + coherence + engagement + delivery + profile + pref2 + duration + reading, 3), 0)) AS INT) AS r0 FROM p),
  y AS (SELECT *, CAST(least(98, r0) AS INT) AS score FROM z),
  x AS (SELECT *, CASE WHEN excluded THEN least(18, score) ELSE score END AS ranking_score FROM y),
  w AS (SELECT *, row_number() OVER (PARTITION BY video_id, duplicate_group ORDER BY ranking_score DESC, start_seconds, id) AS rn FROM x)
  SELECT id, round_even(prompt, 4) AS similarity, CAST(ranking_score AS INT) AS ranking_score FROM w WHERE (rn = 1 OR duplicate_group = '') AND NOT excluded ORDER BY ranking_score DESC, start_seconds, id LIMIT 50"""


@query("search_collection", cte("sim") + _SEARCH)
def search_collection(spark, sf_dir):
    found = search.search_by_references(carriers.tagged(spark, sf_dir), references(spark, sf_dir), feedback(spark, sf_dir), limit=50)
    return found.select("id", "similarity", "ranking_score")


CTE["one"] = "SELECT r.*, list_inner_product(r.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS prompt FROM ranked1 r JOIN embeddings q ON q.vec_id = 7"
NEEDS["one"] = ("ranked1",)


@query("search_description", cte("one") + _SEARCH.replace("FROM sim", "FROM one"))
def search_description(spark, sf_dir):
    # the vector of the described text is an input; one stored vector stands in for it
    described = carriers.table(spark, sf_dir, "embeddings").where("vec_id = 7").select(F.col("vec_id").alias("ref_id"), F.col("embedding").cast("array<double>").alias("ref_vector"))
    found = search.search_by_references(carriers.tagged(spark, sf_dir), described, feedback(spark, sf_dir), limit=50)
    return found.select("id", "similarity", "ranking_score")


# ---- the same searches where a part of the segments is retired and reviews are incomplete ------------------------------------
CTE["live"] = "SELECT r.*, v.rating FROM ranked r JOIN rev v ON v.segment_id = r.id WHERE r.id % 12 <> 5"
NEEDS["live"] = ("ranked", "rev")


def _lived(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Segments of which every twelfth is retired, and the reviews of those that have labels."""
    segments = carriers.tagged(spark, sf_dir).withColumn("lifecycle_state", F.when(F.col("id") % 12 == 5, "retired").otherwise("current"))
    return segments, carriers.reviews(spark, sf_dir).select(F.col("segment_id").alias("id"), "rating", "review_reason")


@query("recording_search", cte("live") + """SELECT id, ranking_score, source_removed, CAST(row_number() OVER (ORDER BY quality_score DESC, start_seconds, id) AS BIGINT) AS place FROM (
  SELECT *, n_chars % 3 = 0 AS source_removed, row_number() OVER (PARTITION BY video_id, duplicate_group ORDER BY ranking_score DESC, start_seconds, id) AS rn FROM (
    SELECT l.* EXCLUDE (n_chars), d.m AS n_chars FROM live l JOIN (SELECT source AS video_id, count(*) AS m FROM documents WHERE source <> 'src7' GROUP BY 1) d ON d.video_id = l.video_id) v
  WHERE list_contains(tags, 'format: czytanie')) q WHERE rn = 1 OR duplicate_group = ''""")
def recording_search(spark, sf_dir):
    """Clips of reading aloud, asked for by another name of the tag, of all recordings whose video is known, by quality."""
    segments, reviews = _lived(spark, sf_dir)
    videos = carriers.table(spark, sf_dir, "documents").where("source <> 'src7'").groupBy(F.col("source").alias("video_id")).agg((F.count("*") % 3 == 0).alias("source_removed"))
    found = search.search_segments(segments, reviews, feedback(spark, sf_dir), tag=" Reading ", videos=videos)
    ranked_rows = cut_lineage(search.in_order(found, "quality_desc").select("id", "ranking_score", "source_removed", "quality_score", "start_seconds"))
    return ordered_index(ranked_rows, ranking.sort_order("quality_desc"), out="place").select("id", "ranking_score", "source_removed", "place")


@query("ranked_current", cte("live") + """SELECT id, ranking_score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, duplicate_group ORDER BY ranking_score DESC, start_seconds, id) AS rn FROM live
  WHERE rating <> 'rejected') q WHERE (rn = 1 OR duplicate_group = '') AND NOT excluded ORDER BY ranking_score DESC, start_seconds, id LIMIT 100""")
def ranked_current(spark, sf_dir):
    segments, reviews = _lived(spark, sf_dir)
    return search.search_by_references(segments, None, feedback(spark, sf_dir), limit=100, reviews=reviews).select("id", "ranking_score")


_LIVE = " WHERE r.id % 12 <> 5 AND r.id IN (SELECT doc_id FROM labels WHERE quality = 1)"


@query("search_collection_current", cte("sim").replace("JOIN top8 ON top8.id = r.id", "JOIN top8 ON top8.id = r.id" + _LIVE) + _SEARCH)
def search_collection_current(spark, sf_dir):
    segments, reviews = _lived(spark, sf_dir)
    found = search.search_by_references(segments, references(spark, sf_dir), feedback(spark, sf_dir), limit=50, reviews=reviews)
    return found.select("id", "similarity", "ranking_score")


@query("search_description_current", cte("one").replace("ON q.vec_id = 7", "ON q.vec_id = 7" + _LIVE) + _SEARCH.replace("FROM sim", "FROM one"))
def search_description_current(spark, sf_dir):
    segments, reviews = _lived(spark, sf_dir)
    described = carriers.table(spark, sf_dir, "embeddings").where("vec_id = 7").select(F.col("vec_id").alias("ref_id"), F.col("embedding").cast("array<double>").alias("ref_vector"))
    found = search.search_by_references(segments, described, feedback(spark, sf_dir), limit=50, reviews=reviews)
    return found.select("id", "similarity", "ranking_score")


@query("best_of_stream")
def best_of_stream(spark, sf_dir):
    picks = diversity.best_of_stream(ranked(spark, sf_dir), 10)
    return picks.select("video_id", "pick", "id", "ranking_score")


@query("top_clips")
def top_clips(spark, sf_dir):
    reviews = carriers.reviews(spark, sf_dir).select(F.col("segment_id").alias("id"), "rating")
    picks = search.top_clips(carriers.tagged(spark, sf_dir), reviews, feedback(spark, sf_dir), limit=5, unrated_only=False)
    return picks.select("video_id", "pick", "id", "ranking_score")


@query("scan_priority_topk", cte("scored") + """SELECT id, priority FROM (SELECT id, priority, row_number() OVER (PARTITION BY video_id ORDER BY priority DESC, start_seconds, id) AS rn FROM (
  SELECT *, audio_event_score * 1.5::DOUBLE + game_reaction_score + greatest(0.0::DOUBLE, voice_expression_score) * 0.5::DOUBLE + least(12.0::DOUBLE, chat_message_count / 5.0::DOUBLE) + least(4.0::DOUBLE, (end_seconds - start_seconds) / 10.0::DOUBLE) AS priority FROM scored) p) q WHERE rn <= 12""")
def scan_priority_topk(spark, sf_dir):
    rows = search.scan_priority(carriers.scored(spark, sf_dir, False), F.col("chat_message_count"), limit=12)
    return rows.select("id", "priority")
