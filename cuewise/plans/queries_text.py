"""Queries over text scores and tags. The test texts are pseudo-words, so a probe vocabulary with words that do occur
in them replaces the default one; the arithmetic under test is the same."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewise.functions import scores, tags, text, vectors
from cuewise.functions.vocab import DEFAULT_VOCABULARY
from cuewise.plans import carriers
from cuewise.plans.carriers import CTE, NEEDS, cte
from cuewise.plans.registry import query

PROBE = replace(
    DEFAULT_VOCABULARY,
    fillers=("la", "on", "der"), hesitations=("the", "le"), trailing_connectors=("the", "of", "le", "en"),
    coherence_connectors=("and", "et", "und"), link_words=("is", "the", "ou", "la"), folded_link_words=("is", "the", "ou", "la"),
    mid_thought_words=("is", "the", "ou"), reading_words=("that", "les", "die"), reading_stems=("thou", "edt", "men"),
    document_stems=("tion", "hand", "ver"), document_phrases=("of the", "la le"), quote_phrases=("the and", "of ", "que la", "in "),
    directive_pattern=r"\b(?:the|le|of t(?:h|o)e)\b", personal_pattern=r"\b(?:that the|dans)\b",
    question_openers=("is", "it", "en"), hook_shock=("and the", "le la"), hook_claim=("of", "ou", "that"), look_call=("to", "des"),
    ending_turn=("is", "re"), ending_verdict=("on", "le"), ending_outcome=("in", "ch", "and"),
    opening_shock=("for", "un"), opening_claim=("of", "en", "by"), punch_turn=("and the", "le", "to be"), punch_outcome=("re", "in"),
    punch_superlative=("on", "que"), punch_laughter=r"\b(?:th+e|la+)\b", setup_turns=("and the", "ion"),
)

# ---- text views for the checking engine -----------------------------------------------------------------------------
CTE["tx"] = r"""
SELECT doc_id AS id, text, n_chars, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS clean,
  regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS tk,
  regexp_replace(strip_accents(lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')))), '[^\x00-\x7F]', '', 'g') AS plain,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'setup words' END AS before, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'more words' END AS after,
  CAST(doc_id % 50 AS DOUBLE) AS start_seconds, CAST(doc_id % 50 + 3 + n_chars % 45 AS DOUBLE) AS end_seconds,
  (n_chars % 61) / CAST(100 AS DOUBLE) AS base_reading
FROM documents"""


def in_list(words) -> str:
    return "(" + ", ".join(f"'{word}'" for word in words) + ")"


def sql_words(column: str, words) -> str:
    """Whole-word search that treats accented letters as letters."""
    return rf"regexp_matches({column}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(words)})(?:[^\p{{L}}\p{{N}}_]|$)')"


def sql_start(column: str, words) -> str:
    return rf"regexp_matches({column}, '(?i)^(?:{'|'.join(words)})(?:[^\p{{L}}\p{{N}}_]|$)')"


CTE["lg"] = rf"""
SELECT tx.*, len(tk) AS n, regexp_matches(clean, '[.!?]$') AS closed,
  {sql_start('clean', PROBE.link_words)} AND before <> '' AS needs_setup,
  after <> '' AND NOT regexp_matches(clean, '[.!?]$') AS continues,
  CASE WHEN len(tk) < 3 THEN 15 ELSE greatest(1, least(99, 42
    + CASE WHEN len(tk) BETWEEN 7 AND 75 THEN 18 WHEN len(tk) >= 4 THEN 7 ELSE 0 END
    - least(28, 8 * len(list_filter(tk, lambda x: x IN {in_list(PROBE.fillers)})))
    - CASE WHEN len(list_filter(tk, lambda x: x IN {in_list(PROBE.fillers)})) / CAST(len(tk) AS DOUBLE) >= 0.18 THEN 12 ELSE 0 END
    + CASE WHEN regexp_matches(clean, '[.!?]$') THEN 12 ELSE 0 END
    + CASE WHEN len(list_filter(tk, lambda x: x IN {in_list(PROBE.coherence_connectors)})) > 0 THEN 8 ELSE 0 END
    + CASE WHEN contains(clean, '?') AND len(tk) >= 5 THEN 5 ELSE 0 END
    - CASE WHEN regexp_matches(clean, '(\.\.\.|[,;:-])$') OR tk[len(tk)] IN {in_list(PROBE.trailing_connectors)} THEN 18 ELSE 0 END
    - CASE WHEN {sql_words('clean', ['(?:the|le)(?:[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_].*[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]|[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_])(?:the|le)'])} THEN 8 ELSE 0 END)) END AS logical
FROM tx"""
NEEDS["lg"] = ("tx",)
CTE["cx"] = """
SELECT lg.*, greatest(1, least(99, 50 + CAST(round_even((logical - 50) * CAST(0.55 AS DOUBLE), 0) AS BIGINT) - CASE WHEN needs_setup THEN 16 ELSE 0 END
  + CASE WHEN continues THEN -14 WHEN closed AND logical >= 68 THEN 8 ELSE 0 END - CASE WHEN n < 5 AND (before <> '' OR after <> '') THEN 10 ELSE 0 END)) AS context,
  greatest(1, least(99, logical - CASE WHEN needs_setup THEN 20 ELSE 0 END - CASE WHEN continues THEN 18 ELSE 0 END
  - CASE WHEN n < 5 THEN 12 ELSE 0 END + CASE WHEN closed AND logical >= 68 THEN 8 ELSE 0 END)) AS alone
FROM lg"""
NEEDS["cx"] = ("lg",)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as segments with stand-in neighbours."""
    i, n = F.col("doc_id"), F.col("n_chars")
    return carriers.balanced(carriers.table(spark, sf_dir, "documents")).select(
        i.alias("id"), "text", "n_chars", F.when(i % 3 == 0, "").otherwise("setup words").alias("before"),
        F.when(i % 2 == 0, "").otherwise("more words").alias("after"), (i % 50).cast("double").alias("start_seconds"),
        (i % 50 + 3 + n % 45).cast("double").alias("end_seconds"), ((n % 61) / 100.0).alias("base_reading"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.prepare(texts(spark, sf_dir), PROBE, before="before", after="after")


@query("logical_sense", cte("lg") + "SELECT id, CAST(logical AS INT) AS logical_sense_score FROM lg")
def logical_sense(spark, sf_dir):
    return prepared(spark, sf_dir).select("id", F.col("_logical").alias("logical_sense_score"))


@query("context_score", cte("cx") + """SELECT id, CAST(context AS INT) AS context_score, array_to_string(list_filter([
  CASE WHEN needs_setup THEN 'depends on setup before the clip' END, CASE WHEN continues THEN 'thought continues after the clip' END,
  CASE WHEN NOT continues AND closed AND logical >= 68 THEN 'self-contained thought' END,
  CASE WHEN NOT needs_setup AND NOT continues AND NOT (closed AND logical >= 68) AND logical < 42 THEN 'limited standalone context' END], lambda x: x IS NOT NULL), '|') AS signals FROM cx""")
def context_score(spark, sf_dir):
    parts = scores.context_scores()
    return prepared(spark, sf_dir).select("id", parts["context_score"].alias("context_score"),
                                       F.array_join(parts["context_signals"], "|").alias("signals"))


@query("self_containment", cte("cx") + "SELECT id, CAST(alone AS INT) AS self_contained_score FROM cx")
def self_containment(spark, sf_dir):
    return prepared(spark, sf_dir).select("id", scores.context_scores()["self_contained_score"].alias("self_contained_score"))


@query("completeness", cte("cx") + """SELECT id, CAST(greatest(1, least(99, CAST(round_even(context * CAST(0.46 AS DOUBLE) + alone * CAST(0.46 AS DOUBLE), 0) AS BIGINT)
  + CASE WHEN n BETWEEN 6 AND 60 THEN 5 WHEN n < 5 THEN -14 WHEN n > 90 THEN -8 ELSE 0 END + CASE WHEN closed THEN 6 ELSE -13 END
  + CASE WHEN n_chars % 2 = 0 THEN 4 ELSE 0 END - CASE WHEN needs_setup THEN 12 ELSE 0 END - CASE WHEN continues THEN 10 ELSE 0 END)) AS INT) AS completeness FROM cx""")
def completeness(spark, sf_dir):
    boundary = F.when(F.col("n_chars") % 2 == 0, F.array(F.lit("end aligned to sentence"))).otherwise(F.array(F.lit("other")))
    return prepared(spark, sf_dir).select("id", scores.completeness(boundary).alias("completeness"))


def _points(condition: str, value: int) -> str:
    return f"CASE WHEN {condition} THEN {value} ELSE 0 END"


CTE["st"] = rf"""
SELECT cx.*, array_to_string(list_slice(tk, 1, 12), ' ') AS early, list_slice(tk, 1, 12) AS early_tk,
  regexp_replace(strip_accents(array_to_string(list_slice(tk, 1, 12), ' ')), '[^\x00-\x7F]', '', 'g') AS early_plain,
  regexp_replace(strip_accents(array_to_string(list_slice(tk, greatest(1, len(tk) - 11), len(tk)), ' ')), '[^\x00-\x7F]', '', 'g') AS closing,
  {sql_start('clean', PROBE.folded_link_words)} AND before <> '' AS linked FROM cx"""
NEEDS["st"] = ("cx",)
CTE["sp"] = rf"""
SELECT st.*, {sql_start('early_plain', PROBE.question_openers)} AS h1, {sql_words('early_plain', PROBE.hook_shock)} AS h2,
  {sql_words('early_plain', PROBE.hook_claim)} AS h3, {sql_words('early_plain', PROBE.look_call)} AS h4,
  {sql_words('closing', PROBE.ending_turn)} AS e1, {sql_words('closing', PROBE.ending_verdict)} AS e2, {sql_words('closing', PROBE.ending_outcome)} AS e3 FROM st"""
NEEDS["sp"] = ("st",)
CTE["sh"] = f"""
SELECT sp.*, 34 - {_points('linked', 23)} - least(20, 8 * len(list_filter(early_tk, lambda x: x IN {in_list(PROBE.fillers)}))) + {_points('len(early_tk) >= 5', 5)}
  + {_points('h1', 15)} + {_points('h2', 13)} + {_points('h3', 11)} + {_points('h4', 10)} AS hook0,
  34 + CASE WHEN closed THEN 12 ELSE -20 END - {_points('tk[len(tk)] IN ' + in_list(PROBE.trailing_connectors), 14)}
  + {_points('e1', 13)} + {_points('e2', 10)} + {_points('e3', 10)} AS ending0 FROM sp"""
NEEDS["sh"] = ("sp",)


@query("story_shape", cte("sh") + f"""SELECT id,
  CAST(CASE WHEN n = 0 THEN 1 ELSE greatest(1, least(99, CASE WHEN h1 OR h2 OR h3 OR h4 THEN hook0 ELSE least(hook0, 52) END - {_points('n < 6', 14)})) END AS INT) AS hook,
  CAST(CASE WHEN n = 0 THEN 1 ELSE greatest(1, least(99, CASE WHEN closed AND NOT (e1 OR e2 OR e3) THEN least(ending0, 54) ELSE ending0 END - {_points('continues', 12)})) END AS INT) AS ending FROM sh""")
def story_shape(spark, sf_dir):
    shape = scores.story_shape(PROBE)
    return prepared(spark, sf_dir).select("id", shape["hook"].alias("hook"), shape["ending"].alias("ending"))


CTE["op0"] = r"""
SELECT id, tk, regexp_replace(strip_accents(array_to_string(list_slice(tk, 1, 7), ' ')), '[^\x00-\x7F]', '', 'g') AS p,
  regexp_extract_all(regexp_replace(strip_accents(array_to_string(list_slice(tk, 1, 7), ' ')), '[^\x00-\x7F]', '', 'g'), '[a-z]+') AS ot FROM tx"""
NEEDS["op0"] = ("tx",)
CTE["op"] = rf"""
SELECT op0.*, {sql_start('p', PROBE.question_openers)} AS o1, {sql_words('p', PROBE.opening_shock)} AS o2, {sql_words('p', PROBE.opening_claim)} AS o3,
  {sql_words('p', PROBE.look_call)} AS o4, 26 + CASE WHEN len(ot) >= 4 THEN 10 ELSE -12 END - {_points('len(ot) > 0 AND ot[1] IN ' + in_list(PROBE.mid_thought_words), 18)}
  - least(18, 9 * len(list_filter(ot, lambda x: x IN {in_list(PROBE.fillers)}))) AS s0 FROM op0"""
NEEDS["op"] = ("op0",)


@query("opening_clarity", cte("op") + f"""SELECT id, CAST(CASE WHEN len(tk) = 0 THEN 1 ELSE greatest(1, least(99, CASE WHEN o1 OR o2 OR o3 OR o4
  THEN s0 + {_points('o1', 16)} + {_points('o2', 13)} + {_points('o3', 11)} + {_points('o4', 10)} ELSE least(s0, 52) END)) END AS INT) AS opening FROM op""")
def opening_clarity(spark, sf_dir):
    return prepared(spark, sf_dir).select("id", scores.opening_clarity(PROBE)["score"].alias("opening"))


CTE["pu0"] = r"""
SELECT id, tk, closed, n, CAST(greatest(5, round_even(n * CAST(0.62 AS DOUBLE), 0)) AS BIGINT) AS cut FROM lg"""
NEEDS["pu0"] = ("lg",)
CTE["pu1"] = r"""
SELECT *, regexp_replace(strip_accents(array_to_string(list_slice(tk, 1, cut), ' ')), '[^\x00-\x7F]', '', 'g') AS setup,
  regexp_replace(strip_accents(array_to_string(list_slice(tk, cut + 1, n), ' ')), '[^\x00-\x7F]', '', 'g') AS closing FROM pu0"""
NEEDS["pu1"] = ("pu0",)
CTE["pu"] = rf"""
SELECT *, {sql_words('closing', PROBE.punch_turn)} AS p1, {sql_words('closing', PROBE.punch_outcome)} AS p2, {sql_words('closing', PROBE.punch_superlative)} AS p3,
  {sql_words('closing', ['th+e', 'la+'])} AS p4, {' OR '.join(f"contains(setup, '{w}')" for w in PROBE.setup_turns)} AS turned FROM pu1"""
NEEDS["pu"] = ("pu1",)


@query("punchline", cte("pu") + f"""SELECT id, CAST(CASE WHEN n < 8 THEN 1 ELSE greatest(1, least(99, CASE WHEN p1 OR p2 OR p3 OR p4 THEN
  24 + CASE WHEN closed THEN 8 ELSE -16 END + {_points('p1', 23)} + {_points('p2', 16)} + {_points('p3', 15)} + {_points('p4', 10)} + {_points('NOT turned', 7)}
  + CASE WHEN CAST(p1 AS INT) + CAST(p2 AS INT) + CAST(p3 AS INT) + CAST(p4 AS INT) >= 2 THEN 8 ELSE 0 END
  ELSE least(48, 24 + CASE WHEN closed THEN 8 ELSE -16 END) END)) END AS INT) AS punchline FROM pu""")
def punchline(spark, sf_dir):
    return prepared(spark, sf_dir).select("id", scores.punchline(PROBE)["score"].alias("punchline"))


CTE["er"] = rf"""
SELECT tx.*, regexp_extract_all(plain, '[a-z]+') AS lt, len(list_filter(regexp_extract_all(plain, '[a-z]+'), lambda x: regexp_matches(x, '^(?:{'|'.join(PROBE.document_stems)})'))) AS formal,
  len(regexp_extract_all(plain, '{PROBE.directive_pattern}')) AS directive, {' + '.join(f"CAST(contains(plain, '{p}') AS INT)" for p in PROBE.quote_phrases)} AS quotes,
  regexp_matches(plain, '{PROBE.personal_pattern}') AS personal, len(regexp_extract_all(text, '[.!?]')) AS sentences FROM tx"""
NEEDS["er"] = ("tx",)
CTE["eb"] = """
SELECT er.*, CASE WHEN formal >= 3 OR directive >= 2 THEN CAST(0.42 AS DOUBLE) WHEN formal >= 2 AND directive >= 1 THEN CAST(0.32 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
  + CASE WHEN formal >= 2 AND quotes >= 1 THEN CAST(0.16 AS DOUBLE) ELSE 0 END
  + CASE WHEN len(lt) >= 22 AND sentences >= 3 AND (formal >= 2 OR directive >= 2) THEN CAST(0.10 AS DOUBLE) ELSE 0 END AS boost FROM er"""
NEEDS["eb"] = ("er",)


@query("extended_reading", cte("eb") + """SELECT id, round_even(least(CAST(1 AS DOUBLE), base_reading + CASE WHEN personal THEN CAST(0 AS DOUBLE)
  ELSE boost + CASE WHEN boost > 0 AND before <> '' AND after <> '' THEN CAST(0.05 AS DOUBLE) ELSE 0 END END), 3) AS likelihood FROM eb""")
def extended_reading(spark, sf_dir):
    counted = prepared(spark, sf_dir).withColumns(scores.extended_reading_parts(PROBE))
    return counted.select("id", scores.extended_reading(F.col("base_reading")).alias("likelihood"))


CTE["tri"] = """
SELECT id, max(c) AS top FROM (SELECT id, gram, count(*) AS c FROM (
  SELECT id, unnest(list_transform(range(1, len(tk) - 1), lambda i: tk[i] || ' ' || tk[i + 1] || ' ' || tk[i + 2])) AS gram FROM tx) g GROUP BY id, gram) h GROUP BY id"""
NEEDS["tri"] = ("tx",)


@query("repeated_trigrams", cte("tri") + "SELECT tx.id, CAST(coalesce(top, 0) AS INT) AS repeats FROM tx LEFT JOIN tri ON tri.id = tx.id")
def repeated_trigrams(spark, sf_dir):
    return texts(spark, sf_dir).select("id", scores.max_repeats(text.tokens(F.col("text"))).alias("repeats"))


CTE["cq0"] = rf"""
SELECT tx.*, len(tk) AS n, greatest(CAST(1 AS DOUBLE), end_seconds - start_seconds) AS d, len(list_filter(tk, lambda x: x IN {in_list(PROBE.fillers)})) AS fill,
  len(list_filter(tk, lambda x: x IN {in_list(PROBE.reading_words)})) AS rw, coalesce(tri.top, 0) AS r,
  len(list_filter(tk, lambda x: regexp_matches(x, '^(?:{'|'.join(PROBE.reading_stems)})'))) AS c,
  len(list_filter(regexp_extract_all(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g'), '[a-z]+'), lambda x: regexp_matches(x, '^(?:{'|'.join(PROBE.document_stems)})')))
  + CASE WHEN {' OR '.join(f"contains(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g'), '{p}')" for p in PROBE.document_phrases)} THEN 2 ELSE 0 END AS k,
  CASE WHEN n_chars % 3 = 0 THEN 1 WHEN n_chars % 3 = 1 THEN 2 ELSE 0 END AS m FROM tx LEFT JOIN tri ON tri.id = tx.id"""
NEEDS["cq0"] = ("tx", "tri")
CTE["cq"] = """
SELECT *, least(CAST(1 AS DOUBLE), CASE WHEN n >= 10 AND n / d < 1.25 THEN CAST(0.22 AS DOUBLE) WHEN n >= 10 AND n / d < 1.55 THEN CAST(0.08 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + 0
  + CASE WHEN fill >= 2 THEN least(CAST(0.25 AS DOUBLE), fill * CAST(0.08 AS DOUBLE)) ELSE 0 END + CASE WHEN rw > 0 THEN least(CAST(0.25 AS DOUBLE), rw * CAST(0.12 AS DOUBLE)) ELSE 0 END
  + CASE WHEN r >= 2 THEN least(CAST(0.38 AS DOUBLE), CAST(0.18 AS DOUBLE) + (r - 1) * CAST(0.14 AS DOUBLE)) ELSE 0 END
  + CASE WHEN c >= 2 THEN least(CAST(0.42 AS DOUBLE), c * CAST(0.11 AS DOUBLE)) ELSE 0 END
  + CASE WHEN k >= 2 THEN least(CAST(0.22 AS DOUBLE), CAST(0.06 AS DOUBLE) + k * CAST(0.04 AS DOUBLE)) ELSE 0 END
  + CASE WHEN n >= 28 AND d >= 22 AND NOT regexp_matches(text, '[.!?]') AND n / d <= 4.2 THEN CAST(0.18 AS DOUBLE) ELSE 0 END
  + CASE WHEN n >= 55 AND d >= 30 AND m = 0 THEN CAST(0.12 AS DOUBLE) ELSE 0 END) AS reading FROM cq0"""
NEEDS["cq"] = ("cq0",)


@query("clip_quality", cte("cq") + """SELECT id, round_even(reading, 3) AS reading, CAST(greatest(1, least(99, 35 + CASE WHEN d BETWEEN 6 AND 30 THEN 12 WHEN d > 30 AND d <= 40 THEN 3 ELSE 0 END
  + CASE WHEN n / d BETWEEN 1.4 AND 4.8 THEN 10 ELSE 0 END + least(24, 8 * m) + CASE WHEN regexp_matches(text, '[!?]') THEN 7 ELSE 0 END
  - CASE WHEN reading >= 0.48 THEN 42 WHEN reading >= 0.30 THEN 12 ELSE 0 END)) AS INT) AS quality FROM cq""")
def clip_quality(spark, sf_dir):
    kind = F.col("n_chars") % 3
    given = F.when(kind == 0, F.array(F.lit("humor"), F.lit("other"))).when(kind == 1, F.array(F.lit("gniew"), F.lit("forma: puenta"))).otherwise(F.array(F.lit("other")))
    parts = scores.reading_parts(F.col("start_seconds"), F.col("end_seconds"), given, PROBE)
    measured = prepared(spark, sf_dir).withColumns(parts).withColumn("_reading", scores.base_reading())
    return measured.select("id", F.bround("_reading", 3).alias("reading"), scores.base_quality(F.col("_reading"))["score"].alias("quality"))


@query("fold_text", r"""SELECT doc_id AS id, md5(regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g')) AS folded,
  md5(trim(regexp_replace(replace(strip_accents(lower(text)), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g'))) AS match_form FROM documents""")
def fold_text(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.md5(text.ascii_fold(F.lower(F.col("text")))).alias("folded"), F.md5(text.match_form(F.col("text"))).alias("match_form"))


@query("keywords", r"""SELECT doc_id AS id, array_to_string(list_slice(list_filter(list_transform(string_split_regex(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), ' '),
  lambda x: trim(x, '.,!?;:')), lambda x: length(x) >= 6), 1, 12), ' ') AS keywords FROM documents""")
def keywords(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


@query("answer_shape", cte("tx") + "SELECT id, len(tk) >= 5 AND NOT (len(tk) < 10 AND regexp_matches(clean, '[?]$')) AS is_answer FROM tx")
def answer_shape(spark, sf_dir):
    from cuewise.operators.chat import looks_like_answer

    return texts(spark, sf_dir).select("id", looks_like_answer(F.col("text")).alias("is_answer"))


PROBE_STEMS = ("ough", "ment", "keit", "tion")


@query("profanity_count", r"""SELECT doc_id AS id, CAST(len(list_filter(list_transform(string_split_regex(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), ' '),
  lambda x: regexp_replace(lower(x), '[^a-ząćęłńóśźż]', '', 'g')), lambda x: length(x) >= 3 AND regexp_matches(x, 'ough|ment|keit|tion'))) AS INT) AS profanity FROM documents""")
def profanity_count(spark, sf_dir):
    none = F.array().cast("array<string>")
    return texts(spark, sf_dir).select("id", tags.profanity_count(none, F.col("text"), PROBE_STEMS).alias("profanity"))


@query("profanity_filter", r"""SELECT doc_id AS id FROM documents WHERE len(list_filter(list_transform(string_split_regex(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')), ' '),
  lambda x: regexp_replace(lower(x), '[^a-ząćęłńóśźż]', '', 'g')), lambda x: length(x) >= 3 AND regexp_matches(x, 'ough|ment|keit|tion'))) <= 1""")
def profanity_filter(spark, sf_dir):
    from cuewise.operators.ranking import filter_profanity

    rows = texts(spark, sf_dir).withColumn("words", F.array().cast("array<string>")).withColumnRenamed("text", "transcript")
    return filter_profanity(rows, "one", PROBE_STEMS).select("id")


@query("redact_text", r"""SELECT page_id, regexp_replace(url || ' saved to C:\clips\a b.txt"', '(?i)https?://\S+', '[url]', 'g').regexp_replace('(?i)(?:file:/+)?[A-Z]:[\\/][^\r\n"'']+', '[path]', 'g') AS safe,
  md5(regexp_replace(regexp_replace(regexp_replace(html, '(?i)https?://\S+', '[url]', 'g'), '(?i)(?:file:/+)?[A-Z]:[\\/][^\r\n"'']+', '[path]', 'g'), '\\\\[^\\/\r\n"'']+[\\/][^\r\n"'']+', '[path]', 'g')) AS body FROM pages""")
def redact_text(spark, sf_dir):
    pages = carriers.table(spark, sf_dir, "pages")
    logged = F.concat("url", F.lit(' saved to C:\\clips\\a b.txt"'))
    return pages.select("page_id", text.redact(logged).alias("safe"), F.md5(text.redact(F.col("html"))).alias("body"))


@query("duration_buckets", cte("tx") + """SELECT CASE WHEN end_seconds - start_seconds < 8 THEN 'under_8s' WHEN end_seconds - start_seconds <= 16 THEN '8_16s'
  WHEN end_seconds - start_seconds <= 26 THEN '17_26s' WHEN end_seconds - start_seconds <= 40 THEN '27_40s' ELSE 'over_40s' END AS bucket, count(*) AS n FROM tx GROUP BY 1""")
def duration_buckets(spark, sf_dir):
    bucket = scores.duration_bucket(F.col("end_seconds") - F.col("start_seconds")).alias("bucket")
    return texts(spark, sf_dir).groupBy(bucket).agg(F.count("*").alias("n"))


PROBE_RULES = {"needs_context": ("ontext", "able "), "duplicate": ("edti", "oient"), "incoherent": ("bes ", "zig"), "too_long": ("e e", "der die")}


@query("rejection_code", r"""SELECT code, count(*) AS n FROM (SELECT CASE """ + " ".join(
    "WHEN " + " OR ".join(f"contains(p, '{m}')" for m in markers) + f" THEN '{code}'" for code, markers in PROBE_RULES.items())
    + r""" ELSE 'other' END AS code FROM (SELECT regexp_replace(strip_accents(lower(text)), '[^\x00-\x7F]', '', 'g') AS p FROM documents) a) b GROUP BY code""")
def rejection_code(spark, sf_dir):
    return texts(spark, sf_dir).groupBy(scores.rejection_code(F.col("text"), PROBE_RULES).alias("code")).agg(F.count("*").alias("n"))


@query("row_fingerprint", r"""SELECT doc_id AS id, sha256(text) AS text_sha, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') AS row_sha FROM documents""")
def row_fingerprint(spark, sf_dir):
    documents = carriers.table(spark, sf_dir, "documents")
    return documents.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text_sha"),
                            F.sha2(F.to_json(F.struct("doc_id", "lang", "n_chars")), 256).alias("row_sha"))


@query("json_lists", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 WHEN event_id % 4 = 1 THEN 0 ELSE 2 END AS n,
  CASE WHEN event_id % 4 < 2 THEN '' ELSE event_type || '|x' END AS items FROM events""")
def json_lists(spark, sf_dir):
    from cuewise.sources.tables import decode_list

    kind = F.col("event_id") % 4
    raw = (F.when(kind == 0, F.lit("{broken")).when(kind == 1, F.to_json(F.struct("event_type")))
           .otherwise(F.to_json(F.array("event_type", F.lit("x")))))
    items = decode_list(raw)
    return carriers.table(spark, sf_dir, "events").select("event_id", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


# ---- tags -----------------------------------------------------------------------------------------------------------
@query("canonical_tags", cte("tagged") + "SELECT id, array_to_string(tags, '|') AS tags FROM tagged")
def canonical_tags(spark, sf_dir):
    return carriers.tagged(spark, sf_dir, False).select("id", F.array_join(tags.canonical_tags(F.col("tags")), "|").alias("tags"))


_CATEGORY_SQL = """CASE WHEN t IN ('gniew') THEN 'emotion' WHEN t = 'humor' THEN 'humour' WHEN t IN ('forma: opinia', 'forma: puenta') THEN 'speech_form'
  WHEN t = 'reakcja na grę' THEN 'game_reaction' WHEN t = 'format: czytanie' THEN 'diagnostic:format' ELSE 'tag:' || t END"""


@query("tag_categories", cte("tagged") + f"SELECT category, count(*) AS n FROM (SELECT {_CATEGORY_SQL} AS category FROM (SELECT unnest(tags) AS t FROM tagged) a) b GROUP BY category")
def tag_categories(spark, sf_dir):
    exploded = carriers.tagged(spark, sf_dir, False).select(F.explode(tags.canonical_tags(F.col("tags"))).alias("tag"))
    return exploded.groupBy(tags.tag_category(F.col("tag")).alias("category")).agg(F.count("*").alias("n"))


@query("array_dedupe", cte("tagged") + "SELECT id, CAST(len(tags) AS INT) AS n_tags FROM tagged")
def array_dedupe(spark, sf_dir):
    return carriers.tagged(spark, sf_dir, False).select("id", F.size(tags.canonical_tags(F.col("tags"))).alias("n_tags"))


@query("tag_filter", cte("tagged") + "SELECT id FROM tagged WHERE list_contains(tags, 'format: czytanie')")
def tag_filter(spark, sf_dir):
    from cuewise.operators.ranking import filter_tag

    return filter_tag(carriers.tagged(spark, sf_dir, False), "Czytanie").select("id")


@query("tag_overlap", cte("tagged") + "SELECT id, CAST(len(list_filter(tags, lambda x: x IN ('humor', 'gniew', 'forma: puenta'))) AS INT) AS shared, list_has_any(tags, ['forma: opinia', 'forma: puenta']) AS long_form FROM tagged")
def tag_overlap(spark, sf_dir):
    named = tags.canonical_tags(F.col("tags"))
    probe = F.array(*[F.lit(tag) for tag in ("humor", "gniew", "forma: puenta")])
    return carriers.tagged(spark, sf_dir, False).select(
        "id", F.size(F.array_intersect(named, probe)).alias("shared"), text.has_any(named, ("forma: opinia", "forma: puenta")).alias("long_form"))


@query("tags_per_category", cte("tagged") + f"""SELECT id, string_agg(t, '|' ORDER BY pos) AS tags FROM (
  SELECT id, t, pos, row_number() OVER (PARTITION BY id, {_CATEGORY_SQL.replace("t IN ('gniew')", "t IN ('gniew', 'złość')")} ORDER BY pos) AS rn FROM (
    SELECT id, unnest(list_concat(tags, ['złość', 'forma: rada'])) AS t, unnest(range(1, len(tags) + 3)) AS pos FROM tagged) a) b WHERE rn = 1
  AND NOT (t = 'forma: rada' AND EXISTS (SELECT 1 FROM tagged x WHERE x.id = b.id AND list_has_any(x.tags, ['forma: opinia', 'forma: puenta']))) GROUP BY id""")
def tags_per_category(spark, sf_dir):
    raw = F.concat("tags", F.array(F.lit("złość"), F.lit("forma: rada")))
    return carriers.tagged(spark, sf_dir, False).select("id", F.array_join(tags.one_per_category(raw), "|").alias("tags"))


DETAILED = {"forma: opinia": ("ble ", "ouen"), "emocja: szok": ("ough", "eaux")}
BROAD = {"radość": ("and", "ein"), "humor": ("ing", "que "), "wyrażanie opinii": ("ment", "zig")}


def _has(markers) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{m}')" for m in markers) + ")"


@query("lexical_tags", f"""SELECT doc_id AS id, array_to_string(list_filter([CASE WHEN {_has(DETAILED['forma: opinia'])} THEN 'forma: opinia' END,
  CASE WHEN {_has(DETAILED['emocja: szok'])} THEN 'emocja: szok' END, CASE WHEN {_has(BROAD['radość'])} AND NOT {_has(DETAILED['emocja: szok'])} THEN 'radość' END,
  CASE WHEN {_has(BROAD['humor'])} THEN 'humor' END, CASE WHEN {_has(BROAD['wyrażanie opinii'])} AND NOT {_has(DETAILED['forma: opinia'])} THEN 'wyrażanie opinii' END],
  lambda x: x IS NOT NULL), '|') AS tags FROM documents""")
def lexical_tags(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.array_join(tags.lexical_tags(F.col("text"), detailed=DETAILED, broad=BROAD), "|").alias("tags"))


@query("semantic_tags", """SELECT e.vec_id AS id, string_agg('tag' || t.vec_id, '|' ORDER BY list_inner_product(e.embedding::DOUBLE[], t.embedding::DOUBLE[]) DESC, t.vec_id) AS tags
  FROM embeddings e JOIN embeddings t ON t.vec_id < 8 AND list_inner_product(e.embedding::DOUBLE[], t.embedding::DOUBLE[]) >= 0.2 GROUP BY e.vec_id""")
def semantic_tags(spark, sf_dir):
    from cuewise.operators.similarity import semantic_tags as attach

    rows = carriers.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # the eight tag vectors are a fixed set, one per broad tag
    vocabulary = rows.where("id < 8").select(F.concat(F.lit("tag"), F.col("id").cast("string")).alias("tag"), F.col("id").alias("tag_order"), F.col("embedding").alias("tag_vector"))
    return attach(rows, vocabulary, minimum=0.2).where(F.size("semantic_tags") > 0).select("id", F.array_join("semantic_tags", "|").alias("tags"))


@query("enrich_tags", cte("tagged") + """SELECT id, array_to_string(list_concat(list_filter(tags, lambda x: NOT starts_with(x, 'format: ')), list_filter([
  CASE WHEN reading_likelihood >= 0.48 THEN 'format: czytanie' END,
  CASE WHEN logical_sense_score BETWEEN 0 AND 35 THEN 'struktura: urwana wypowiedź' WHEN context_score BETWEEN 0 AND 38 THEN 'struktura: wymaga kontekstu'
    WHEN self_contained_score BETWEEN 0 AND 35 THEN 'struktura: zależny od kontekstu' WHEN self_contained_score >= 75 THEN 'struktura: samowystarczalny'
    WHEN logical_sense_score >= 68 THEN 'struktura: samodzielna myśl' END,
  CASE WHEN voice_expression_score >= 7 THEN 'wypowiedź: ekspresyjna' WHEN voice_expression_score <= -7 THEN 'wypowiedź: jednostajna' END], lambda x: x IS NOT NULL)), '|') AS tags FROM tagged""")
def enrich_tags(spark, sf_dir):
    column = F.col
    return carriers.tagged(spark, sf_dir, False).select("id", F.array_join(tags.enrich_tags(
        column("tags"), column("logical_sense_score"), column("reading_likelihood"), column("voice_expression_score"),
        column("context_score"), column("self_contained_score")), "|").alias("tags"))


# ---- scores built from scores --------------------------------------------------------------------------------------
@query("moment_reaction", cte("scored") + """SELECT id, CAST(CASE WHEN game_reaction_score < 11 THEN 0 ELSE least(30, least(16, game_reaction_score)
  + CASE WHEN chat_reaction_score >= 5 THEN least(8, round_even(chat_reaction_score * CAST(0.45 AS DOUBLE), 0)) + least(6, round_even(chat_joy_score * CAST(0.45 AS DOUBLE), 0)) ELSE 0 END) END AS INT) AS score,
  CASE WHEN game_reaction_score < 11 THEN '' WHEN chat_reaction_score >= 5 THEN 'game -> voice -> chat' ELSE 'game -> voice' END AS stage FROM scored""")
def moment_reaction(spark, sf_dir):
    parts = scores.moment_reaction(F.col("game_reaction_score"), F.col("chat_reaction_score"), F.col("chat_joy_score"))
    return carriers.scored(spark, sf_dir, False).select("id", *[value.alias(name) for name, value in parts.items()])


@query("effective_reading", cte("scored") + """SELECT id, round_even(CASE WHEN vision_score > 10 THEN least(CAST(1 AS DOUBLE), CAST(0.52 AS DOUBLE) + vision_score * CAST(0.035 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END, 3) AS visual_reading_likelihood,
  round_even(greatest(reading_likelihood / 2, CASE WHEN vision_score > 10 THEN least(CAST(1 AS DOUBLE), CAST(0.52 AS DOUBLE) + vision_score * CAST(0.035 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END, reading_likelihood), 3) AS reading_likelihood FROM scored""")
def effective_reading(spark, sf_dir):
    screen = F.when(F.col("vision_score") > 10, F.col("vision_score")).otherwise(0)
    parts = scores.effective_reading(F.col("reading_likelihood") / 2, F.lit(0.0), screen, F.col("reading_likelihood"))
    return carriers.scored(spark, sf_dir, False).select("id", *[value.alias(name) for name, value in parts.items()])


_CAPS = """SELECT id, d, least(quality_score, CASE WHEN reading_likelihood >= 0.48 THEN 22 WHEN reading_likelihood >= 0.30 THEN 68 ELSE 99 END,
  CASE WHEN self_contained_score < 58 OR logical_sense_score < 55 THEN 72 WHEN self_contained_score < 72 OR logical_sense_score < 70 THEN 82 ELSE 99 END,
  CASE WHEN context_score BETWEEN 0 AND 51 THEN 86 ELSE 99 END, CASE WHEN extended_completeness_score < 0 THEN 93 WHEN extended_completeness_score < 65 THEN 88 ELSE 99 END,
  CASE WHEN strong THEN 99 ELSE 90 END, CASE WHEN d BETWEEN 6 AND 30 AND n_chars % 2 = 0 AND reading_likelihood < 0.20 AND self_contained_score >= 85 AND logical_sense_score >= 84
    AND context_score >= 72 AND extended_completeness_score >= 82 AND strong THEN 99 ELSE 95 END) AS quality
FROM (SELECT *, end_seconds - start_seconds AS d, list_has_any(tags, ['humor', 'gniew', 'zaskoczenie', 'radość', 'złość']) OR game_reaction_score >= 11 OR moment_reaction_score >= 10 OR voice_expression_score >= 10 AS strong FROM tagged) q"""


@query("quality_caps", cte("tagged") + f"SELECT id, CAST(quality AS INT) AS quality FROM ({_CAPS}) z")
def quality_caps(spark, sf_dir):
    c = F.col
    signals = F.when(c("n_chars") % 2 == 0, F.array(F.lit("natural speaking pace"))).otherwise(F.array(F.lit("long clip")))
    rows = carriers.tagged(spark, sf_dir, False).withColumn("tags", tags.canonical_tags(c("tags")))
    capped = scores.quality_caps(
        c("quality_score"), c("end_seconds") - c("start_seconds"), c("tags"), signals, c("reading_likelihood"), c("logical_sense_score"),
        c("context_score"), c("self_contained_score"), c("extended_completeness_score"), c("game_reaction_score"),
        c("voice_expression_score"), c("moment_reaction_score"))
    return rows.select("id", capped["score"].alias("quality"))


CTE["sq"] = """
SELECT *, end_seconds - start_seconds AS d, list_has_any(tags, ['humor', 'gniew', 'forma: opinia', 'forma: puenta']) AS interest,
  self_contained_score >= 78 AND logical_sense_score >= 74 AND context_score >= 62 AS solid, self_contained_score >= 58 AND logical_sense_score >= 55 AS fair,
  game_reaction_score >= 11 OR moment_reaction_score >= 11 AS game, voice_expression_score >= 10 AS voiced, chat_reaction_score >= 12 OR chat_joy_score >= 8 AS chatty,
  opening_clarity_score >= 66 AND extended_punchline_score >= 68 AS story, opening_clarity_score >= 64 AS opening, extended_punchline_score >= 66 AS punch,
  len(regexp_extract_all(lower(transcript), '[\\p{L}\\p{N}]+')) AS n FROM tagged"""
NEEDS["sq"] = ("tagged",)
CTE["sr"] = """
SELECT *, CAST(game AS INT) + CAST(voiced AS INT) + CAST(chatty AS INT) + CAST(interest AS INT) + CAST(story AS INT) + CAST(punch AS INT) AS proofs FROM sq"""
NEEDS["sr"] = ("sq",)
CTE["su"] = """
SELECT *, CASE WHEN interest THEN 7 ELSE 0 END + CASE WHEN story THEN 10 ELSE 0 END + CASE WHEN opening THEN 6 ELSE 0 END + CASE WHEN punch THEN 12 ELSE 0 END
  + CASE WHEN game THEN 18 ELSE 0 END + CASE WHEN voiced AND game THEN 8 WHEN voiced THEN 12 ELSE 0 END + CASE WHEN chat_reaction_score >= 10 THEN 8 ELSE 0 END
  + CASE WHEN chat_joy_score >= 8 THEN 6 ELSE 0 END + CASE WHEN proofs >= 2 THEN 4 ELSE 0 END AS attention FROM sr"""
NEEDS["su"] = ("sr",)


def short_row() -> dict[str, Column]:
    c = F.col
    return {
        "tags": c("tags"), "logical": c("logical_sense_score"), "context": c("context_score"), "self_contained": c("self_contained_score"),
        "complete": c("extended_completeness_score"), "hook": c("opening_clarity_score"), "ending": c("extended_punchline_score"),
        "opening": c("opening_clarity_score"), "punchline": c("extended_punchline_score"), "game": c("game_reaction_score"),
        "moment": c("moment_reaction_score"), "voice": c("voice_expression_score"), "chat": c("chat_reaction_score"),
        "joy": c("chat_joy_score"), "reading": c("reading_likelihood"), "quality": c("quality_score"),
    }


@query("short_potential", cte("su") + """SELECT id, CAST(greatest(1, least(99, 20 + CASE WHEN d BETWEEN 8 AND 28 THEN 15 WHEN d BETWEEN 5 AND 38 THEN 8 WHEN d > 50 THEN -20 WHEN d > 38 THEN -9 WHEN d < 4 THEN -12 ELSE 0 END
  + CASE WHEN solid THEN 18 WHEN fair THEN 8 ELSE -14 END + CASE WHEN extended_completeness_score >= 76 THEN 8 WHEN extended_completeness_score BETWEEN 0 AND 43 THEN -15 ELSE 0 END
  + attention + CASE WHEN n < 5 THEN -12 WHEN n > 92 THEN -10 ELSE 0 END - CASE WHEN reading_likelihood >= 0.48 THEN 42 WHEN reading_likelihood >= 0.30 THEN 14 ELSE 0 END,
  CASE WHEN NOT fair THEN 72 WHEN NOT solid THEN 82 ELSE 99 END, CASE WHEN context_score BETWEEN 0 AND 51 THEN 86 ELSE 99 END,
  CASE WHEN extended_completeness_score < 0 THEN 92 WHEN extended_completeness_score < 65 THEN 88 ELSE 99 END, CASE WHEN attention = 0 THEN 65 WHEN proofs = 1 THEN 88 ELSE 99 END,
  CASE WHEN d BETWEEN 8 AND 28 AND self_contained_score >= 85 AND logical_sense_score >= 84 AND context_score >= 72 AND extended_completeness_score >= 82 AND quality_score >= 80
    AND reading_likelihood < 0.20 AND proofs >= 2 AND attention >= 24 AND opening AND (punch OR game) THEN 99 ELSE 95 END)) AS INT) AS short_potential FROM su""")
def short_potential(spark, sf_dir):
    rows = carriers.tagged(spark, sf_dir, False).withColumn("tags", tags.canonical_tags(F.col("tags")))
    parts = scores.short_potential(F.col("transcript"), F.col("start_seconds"), F.col("end_seconds"), short_row())
    return rows.select("id", parts["score"].alias("short_potential"))


@query("duration_adjustment", cte("tagged") + """SELECT id, CASE WHEN d BETWEEN 8 AND 26 THEN CAST(8 AS DOUBLE) WHEN d > 26 AND d <= 32 THEN 4 WHEN d > 32 AND d <= 42 AND lf THEN 1 WHEN d > 32 AND d <= 42 THEN -11
  WHEN d > 42 AND lf THEN -8 WHEN d > 42 THEN -25 ELSE -4 END AS general, CASE WHEN d BETWEEN 6 AND 24 THEN CAST(6 AS DOUBLE) WHEN d > 24 AND d <= 34 THEN -3 WHEN d > 34 THEN -16 ELSE -4 END AS reactions,
  CASE WHEN d BETWEEN 12 AND 42 THEN CAST(6 AS DOUBLE) WHEN d > 42 AND d <= 60 THEN 1 WHEN d > 60 THEN -12 WHEN d BETWEEN 8 AND 26 THEN 8 ELSE -4 END AS talk
  FROM (SELECT id, end_seconds - start_seconds AS d, list_has_any(tags, ['forma: opinia', 'forma: puenta']) OR (chat_reaction_score >= 8 AND logical_sense_score >= 60) AS lf FROM tagged) q""")
def duration_adjustment(spark, sf_dir):
    named, length = tags.canonical_tags(F.col("tags")), F.col("end_seconds") - F.col("start_seconds")
    def value(profile: str) -> Column:
        return scores.duration_adjustment(length, named, F.col("chat_reaction_score"), F.col("logical_sense_score"), profile)["value"]
    return carriers.tagged(spark, sf_dir, False).select(
        "id", value("general").alias("general"), value("game_reactions").alias("reactions"), value("opinions").alias("talk"))


@query("preference_features", cte("scored") + """SELECT id, least(1.0::DOUBLE, greatest(0.0::DOUBLE, quality_score / 99.0::DOUBLE)) AS quality, CAST(audio_event_score / 20.0::DOUBLE AS DOUBLE) AS audio,
  CASE WHEN voice_expression_score < 0 THEN 0.0::DOUBLE ELSE voice_expression_score / 20.0::DOUBLE END AS voice_expression,
  CASE WHEN logical_sense_score < 0 THEN 0.5::DOUBLE ELSE logical_sense_score / 100.0::DOUBLE END AS logical_sense, moment_reaction_score / 30.0::DOUBLE AS moment_reaction,
  greatest(0.0::DOUBLE, chat_question_match_score / 100.0::DOUBLE) AS chat_question_match, least(1.0::DOUBLE, reading_likelihood) AS reading FROM scored""")
def preference_features(spark, sf_dir):
    rows = carriers.scored(spark, sf_dir, False)
    parts = scores.preference_features({name: F.col(name) for name in carriers.SCORE_COLUMNS})
    shown = ("quality", "audio", "voice_expression", "logical_sense", "moment_reaction", "chat_question_match", "reading")
    return rows.select("id", *[parts[name].alias(name) for name in shown])


@query("hashed_vectors", cte("tx") + r""", h AS (SELECT id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 64 AS slot FROM (SELECT id, unnest(tk) AS w FROM tx) a),
  c AS (SELECT id, slot, count(*) AS n FROM h GROUP BY id, slot)
  SELECT id, CAST(slot AS INT) AS slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 9) AS value FROM c""")
def hashed_vectors(spark, sf_dir):
    built = vectors.hashed_vectors(texts(spark, sf_dir), "id", "text", "vector")
    return built.select("id", F.posexplode("vector").alias("slot", "value")).where("value > 0").select("id", "slot", F.round("value", 9).alias("value"))
