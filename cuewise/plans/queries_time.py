"""Queries over time ranges: chat windows, context, boundaries, words, audio windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuewise.functions.vectors import cosine
from cuewise.operators import chat, intervals
from cuewise.plans import carriers
from cuewise.plans.carriers import CTE, NEEDS, cte
from cuewise.plans.registry import query

DELAY = 6.0

# ---- chat ---------------------------------------------------------------------------------------------------------
CTE["win"] = f"""
SELECT video_id, id, start_seconds, end_seconds, transcript, embedding, rs, re, bs, greatest(bs, rs - 8.0) AS be FROM (
  SELECT *, greatest(CAST(0 AS DOUBLE), rs - 70.0) AS bs FROM (
    SELECT *, start_seconds + (end_seconds - start_seconds) * 0.5::DOUBLE + {DELAY}::DOUBLE AS rs, end_seconds + {DELAY}::DOUBLE + 18.0::DOUBLE AS re FROM seg) a) b"""
NEEDS["win"] = ("seg",)
CTE["flag"] = r"""
SELECT msg.*, regexp_matches(message, '(?i)\b(xd+|lol+|lmao|omg|haha+|heh+|rip|gg)\b|[!?]{2,}') AS expressive,
  regexp_matches(message, '(?i)\b(xd+|lol+|lmao|rofl|haha+|heh+)\b') AS joy, regexp_matches(message, '^!') AS alert, contains(message, '?') AS question FROM msg"""
NEEDS["flag"] = ("msg",)
CTE["facts"] = """
SELECT w.video_id, w.id, w.rs, w.re, w.bs, w.be, count(*) FILTER (m.seconds BETWEEN rs AND re) AS cnt, count(*) FILTER (m.seconds >= bs AND m.seconds < be) AS base,
  count(*) FILTER (m.seconds BETWEEN rs AND re AND NOT alert AND (expressive OR joy) AND expressive) AS expressive,
  count(*) FILTER (m.seconds BETWEEN rs AND re AND NOT alert AND (expressive OR joy) AND joy) AS joy,
  count(DISTINCT CASE WHEN m.seconds BETWEEN rs AND re THEN lower(trim(author)) END) AS authors,
  count(DISTINCT CASE WHEN m.seconds BETWEEN rs AND re AND NOT alert AND (expressive OR joy) THEN lower(trim(author)) END) AS reactive
FROM win w LEFT JOIN flag m ON m.video_id = w.video_id AND m.seconds BETWEEN least(w.bs, w.rs) AND w.re GROUP BY ALL"""
NEEDS["facts"] = ("win", "flag")


@query("chat_window_counts", cte("facts") + "SELECT id, cnt AS reaction_count, base AS baseline_count, expressive, joy, authors AS unique_authors, reactive AS reactive_authors FROM facts")
def chat_window_counts(spark, sf_dir):
    facts = chat.window_facts(carriers.segments(spark, sf_dir, False), carriers.messages(spark, sf_dir), F.lit(DELAY))
    return facts.select("id", F.col("count").alias("reaction_count"), F.col("baseline").alias("baseline_count"), "expressive", "joy", "unique_authors", "reactive_authors")


CTE["surge"] = "SELECT *, (cnt + 1.0::DOUBLE) / (expected + 1.0::DOUBLE) AS surge, cnt >= greatest(3.0::DOUBLE, expected * 1.35::DOUBLE) AS active FROM (SELECT *, base / greatest(1.0::DOUBLE, be - bs) * (re - rs) AS expected FROM facts) q"
NEEDS["surge"] = ("facts",)
CTE["reaction"] = """
SELECT id, CAST(greatest(0, least(20, CASE WHEN active AND expressive >= 2 THEN least(6, greatest(2, round_even((cnt - expected) * 1.2::DOUBLE, 0))) ELSE 0 END
  + CASE WHEN active AND reactive >= 2 THEN least(5, reactive) ELSE 0 END
  + CASE WHEN active AND expressive >= 2 AND cnt >= greatest(4.0::DOUBLE, expected * 1.55::DOUBLE) THEN least(6, round_even((surge - 1) * 3.0::DOUBLE, 0)) ELSE 0 END
  + CASE WHEN active AND expressive >= 3 THEN least(3, expressive - 1) ELSE 0 END)) AS INT) AS chat_reaction_score,
  CAST(greatest(0, least(14, CASE WHEN active AND joy > 0 THEN least(6, joy * 2) ELSE 0 END + CASE WHEN active AND joy >= 2 AND reactive >= 2 THEN least(4, reactive) ELSE 0 END
  + CASE WHEN active AND joy > 0 AND cnt >= greatest(3.0::DOUBLE, expected * 1.5::DOUBLE) THEN least(4, round_even(greatest(0.0::DOUBLE, surge - 1) * 2.5::DOUBLE, 0)) ELSE 0 END)) AS INT) AS chat_joy_score,
  CAST(cnt AS INT) AS chat_message_count, CAST(authors AS INT) AS chat_unique_authors, round_even(surge, 2) AS chat_surge FROM surge"""
NEEDS["reaction"] = ("surge",)


@query("chat_reaction_scores", cte("reaction") + "SELECT * FROM reaction")
def chat_reaction_scores(spark, sf_dir):
    return chat.score_chat(carriers.segments(spark, sf_dir, False), carriers.messages(spark, sf_dir), F.lit(DELAY)).drop("video_id")


@query("chat_summary", cte("msg") + "SELECT video_id, count(*) AS message_count, count(DISTINCT nullif(author, '')) AS unique_authors FROM msg GROUP BY video_id")
def chat_summary(spark, sf_dir):
    return chat.chat_summary(carriers.messages(spark, sf_dir))


@query("message_flags", cte("flag") + "SELECT event_id, alert AS is_alert, expressive AS is_expressive, joy AS is_joy, NOT alert AND (expressive OR joy) AS is_reactive, question AS is_question FROM flag")
def message_flags(spark, sf_dir):
    flags = chat.message_flags(F.col("message"))
    return carriers.messages(spark, sf_dir).select("event_id", *[value.alias(name) for name, value in flags.items()])


@query("chat_previews", cte("win", "flag") + """SELECT id, rank, seconds, author, message FROM (SELECT w.id, m.seconds, m.author, m.message, row_number() OVER (PARTITION BY w.id ORDER BY m.seconds, m.event_id) AS rank
  FROM win w JOIN flag m ON m.video_id = w.video_id AND m.seconds BETWEEN w.rs AND w.re AND NOT alert AND (expressive OR joy)) q WHERE rank <= 4""")
def chat_previews(spark, sf_dir):
    return chat.first_reactions(carriers.segments(spark, sf_dir, False), carriers.messages(spark, sf_dir), F.lit(DELAY)).drop("video_id")


CTE["asked"] = f"""
SELECT s.id, s.transcript, s.embedding, m.seconds, m.message, m.event_id, row_number() OVER (PARTITION BY s.id ORDER BY m.seconds DESC, m.event_id DESC) AS rank
FROM seg s JOIN flag m ON m.video_id = s.video_id AND m.question AND m.seconds BETWEEN greatest(0.0::DOUBLE, s.start_seconds + {DELAY}::DOUBLE - 45.0::DOUBLE) AND s.start_seconds + {DELAY}::DOUBLE + 5.0::DOUBLE"""
NEEDS["asked"] = ("seg", "flag")


@query("viewer_questions", cte("asked") + "SELECT id, rank, seconds, event_id FROM asked WHERE rank <= 4")
def viewer_questions(spark, sf_dir):
    found = chat.viewer_questions(carriers.segments(spark, sf_dir, False), carriers.messages(spark, sf_dir), F.lit(DELAY))
    return found.select("id", "rank", "seconds", "event_id")


@query("viewer_question_asof", cte("asked") + "SELECT id, seconds, event_id FROM asked WHERE rank = 1")
def viewer_question_asof(spark, sf_dir):
    found = chat.viewer_questions(carriers.segments(spark, sf_dir, False), carriers.messages(spark, sf_dir), F.lit(DELAY), limit=1)
    return found.select("id", "seconds", "event_id")


# a question is matched by its own stand-in vector: the embedding of its event number
CTE["matched"] = r"""
SELECT a.id, a.rank, a.message, least(20, 10 * len(list_filter(['this'], lambda w: list_contains(list_transform(regexp_extract_all(lower(a.transcript), '[\p{L}\p{N}]+'), lambda t: substr(t, 1, 6)), w)))) AS lexical,
  greatest(0.0::DOUBLE, list_cosine_similarity(a.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS semantic
FROM asked a JOIN embeddings e ON e.vec_id = a.event_id % 200 WHERE a.rank <= 4 AND a.embedding IS NOT NULL"""
NEEDS["matched"] = ("asked",)


def _scored_questions(spark, sf_dir):
    vectors = carriers.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").cast("array<double>").alias("question_vector"))
    asked = chat.viewer_questions(carriers.segments(spark, sf_dir, False), carriers.messages(spark, sf_dir), F.lit(DELAY)).select("video_id", "id", "rank", "message", "event_id")
    answers = carriers.segments(spark, sf_dir).where(F.col("embedding").isNotNull()).select("id", "transcript", "embedding")
    joined = asked.withColumn("question_id", F.col("event_id") % 200).join(vectors, "question_id").join(answers, "id")
    return joined.withColumn("match_score", chat.question_answer_score(
        F.col("message"), F.col("transcript"), F.col("question_vector"), F.col("embedding"), F.lit(70), F.lit(60)))


_MATCH = "CAST(CASE WHEN lexical >= 10 OR semantic >= 0.48 THEN least(99, greatest(0, round_even(semantic * 55.0::DOUBLE + lexical + 6.0::DOUBLE, 0))) ELSE 0 END AS INT)"


@query("qa_match_score", cte("matched") + f"SELECT id, rank, {_MATCH} AS match_score FROM matched")
def qa_match_score(spark, sf_dir):
    return _scored_questions(spark, sf_dir).select("id", "rank", "match_score")


@query("question_match_best", cte("matched") + f"""SELECT id, CASE WHEN max({_MATCH}) >= 40 THEN max({_MATCH}) ELSE 0 END AS chat_question_match_score, CASE WHEN max({_MATCH}) >= 40 THEN 'is this ok?' ELSE '' END AS chat_question_text FROM matched GROUP BY id""")
def question_match_best(spark, sf_dir):
    return chat.best_question(_scored_questions(spark, sf_dir)).drop("video_id")


# ---- context and boundaries ----------------------------------------------------------------------------------------
CTE["pc"] = "SELECT video_id, turn AS id, start_seconds, end_seconds FROM parts WHERE turn % 2 = 0"
NEEDS["pc"] = ("parts",)


@query("speech_context", cte("pc") + """SELECT c.video_id, c.id, right(coalesce(string_agg(trim(p.text), ' ' ORDER BY p.start_seconds, p.turn) FILTER (p.end_seconds BETWEEN c.start_seconds - 12 AND c.start_seconds), ''), 700) AS context_before,
  left(coalesce(string_agg(trim(p.text), ' ' ORDER BY p.start_seconds, p.turn) FILTER (p.start_seconds BETWEEN c.end_seconds AND c.end_seconds + 12), ''), 700) AS context_after
  FROM pc c LEFT JOIN parts p ON p.video_id = c.video_id AND coalesce(p.text, '') <> '' GROUP BY c.video_id, c.id""")
def speech_context(spark, sf_dir):
    parts = carriers.transcript_parts(spark, sf_dir)
    spans = parts.where("turn % 2 = 0").withColumnRenamed("turn", "id").drop("text")
    return intervals.attach_neighbour_text(spans, parts, 12.0, 700, item_id="turn").select("video_id", "id", "context_before", "context_after")


@query("neighbour_context", cte("seg") + """SELECT c.id, md5(right(coalesce(string_agg(trim(p.transcript), ' ' ORDER BY p.start_seconds, p.id) FILTER (p.end_seconds BETWEEN c.start_seconds - 16 AND c.start_seconds), ''), 900)) AS context_before,
  md5(left(coalesce(string_agg(trim(p.transcript), ' ' ORDER BY p.start_seconds, p.id) FILTER (p.start_seconds BETWEEN c.end_seconds AND c.end_seconds + 16), ''), 900)) AS context_after
  FROM seg c LEFT JOIN seg p ON p.video_id = c.video_id AND p.id <> c.id AND p.end_seconds >= c.start_seconds - 16 AND p.start_seconds <= c.end_seconds + 16 GROUP BY c.id""")
def neighbour_context(spark, sf_dir):
    segments = carriers.segments(spark, sf_dir, False)
    texted = intervals.attach_neighbour_text(segments, segments, 16.0, 900, item_id="id", text="transcript", exclude_same=True)
    return texted.select("id", F.md5("context_before").alias("context_before"), F.md5("context_after").alias("context_after"))


@query("edit_neighbours", cte("seg") + """SELECT s.id FROM seg s WHERE EXISTS (SELECT 1 FROM seg e WHERE e.id % 37 = 5 AND e.video_id = s.video_id AND e.id <> s.id
  AND s.end_seconds >= greatest(0.0::DOUBLE, e.start_seconds - 16) AND s.start_seconds <= e.end_seconds + 16)""")
def edit_neighbours(spark, sf_dir):
    segments = carriers.segments(spark, sf_dir, False)
    edits = segments.where("id % 37 = 5").select("video_id", "id", F.col("start_seconds").alias("range_start"), F.col("end_seconds").alias("range_end"))
    return intervals.overlap_semi_join(segments, edits, "video_id", 60.0, 16.0, "id").select("id")


CTE["snap"] = """
SELECT s.id, s.start_seconds, s.end_seconds, (SELECT m.seconds FROM msg m WHERE m.video_id = s.video_id AND m.event_id % 3 = 0 AND abs(m.seconds - s.start_seconds) <= 2.5 ORDER BY abs(m.seconds - s.start_seconds), m.seconds LIMIT 1) AS b1,
  (SELECT m.seconds FROM msg m WHERE m.video_id = s.video_id AND m.event_id % 3 = 0 AND abs(m.seconds - s.end_seconds) <= 2.5 ORDER BY abs(m.seconds - s.end_seconds), m.seconds LIMIT 1) AS b2 FROM seg s"""
NEEDS["snap"] = ("seg", "msg")


@query("snap_to_boundary", cte("snap") + """SELECT id, CASE WHEN coalesce(b2, end_seconds) - coalesce(b1, start_seconds) >= 3 THEN greatest(0.0::DOUBLE, coalesce(b1, start_seconds)) ELSE start_seconds END AS snapped_start,
  CASE WHEN coalesce(b2, end_seconds) - coalesce(b1, start_seconds) >= 3 THEN coalesce(b2, end_seconds) ELSE end_seconds END AS snapped_end FROM snap""")
def snap_to_boundary(spark, sf_dir):
    boundaries = carriers.messages(spark, sf_dir).where("event_id % 3 = 0").select("video_id", F.col("seconds").alias("boundary"))
    return intervals.snap_to_boundaries(carriers.segments(spark, sf_dir, False), boundaries).select("id", "snapped_start", "snapped_end")


@query("pad_interval", cte("seg") + """SELECT s.id, greatest(0.0::DOUBLE, s.start_seconds - 0.6::DOUBLE) AS padded_start, least(d.duration, s.end_seconds + 1.0::DOUBLE) AS padded_end
  FROM seg s JOIN (SELECT video_id, max(end_seconds) AS duration FROM seg GROUP BY video_id) d ON d.video_id = s.video_id""")
def pad_interval(spark, sf_dir):
    segments = carriers.segments(spark, sf_dir, False)
    durations = segments.groupBy("video_id").agg(F.max("end_seconds").alias("duration"))
    start, end = intervals.pad_interval(F.col("start_seconds"), F.col("end_seconds"), F.col("duration"))
    return segments.join(durations, "video_id").select("id", start.alias("padded_start"), end.alias("padded_end"))


# ---- words -----------------------------------------------------------------------------------------------------------
CTE["words"] = r"""
SELECT id, start_seconds, end_seconds, position, word, start_seconds + (end_seconds - start_seconds) * (run - length(word)) / total AS word_start, start_seconds + (end_seconds - start_seconds) * run / total AS word_end FROM (
  SELECT *, sum(length(word)) OVER (PARTITION BY id ORDER BY position) AS run, sum(length(word)) OVER (PARTITION BY id) AS total FROM (
    SELECT id, start_seconds, end_seconds, unnest(tk) AS word, unnest(range(0, len(tk))) AS position FROM (
      SELECT *, list_filter(string_split(trim(regexp_replace(transcript, '[\s\p{Z}]+', ' ', 'g')), ' '), lambda x: x <> '') AS tk FROM seg) a) b) c"""
NEEDS["words"] = ("seg",)


def _words(spark, sf_dir):
    segments = carriers.segments(spark, sf_dir, False).select("id", "start_seconds", "end_seconds", "transcript")
    return intervals.word_times(segments, "transcript", "start_seconds", "end_seconds").drop("transcript")


def _spaced(spark, sf_dir):
    """Words with every fifth one missing, so that pauses exist; times relative to the clip."""
    kept = _words(spark, sf_dir).where("position % 5 <> 3")
    return kept.withColumns({"word_start": F.col("word_start") - F.col("start_seconds"), "word_end": F.col("word_end") - F.col("start_seconds")}).withColumn(
        "clip_length", F.col("end_seconds") - F.col("start_seconds")).drop("start_seconds", "end_seconds")


@query("approx_word_times", cte("words") + "SELECT id, position, word, round(word_start, 9) AS word_start, round(word_end, 9) AS word_end FROM words")
def approx_word_times(spark, sf_dir):
    return _words(spark, sf_dir).select("id", "position", "word", F.round("word_start", 9).alias("word_start"), F.round("word_end", 9).alias("word_end"))


CTE["spaced"] = "SELECT id, position, word, word_start - start_seconds AS l, word_end - start_seconds AS r, end_seconds - start_seconds AS d FROM words WHERE position % 5 <> 3"
NEEDS["spaced"] = ("words",)
CTE["isle"] = """
SELECT *, sum(CASE WHEN l - prev >= 0.85 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY l, r) AS isle FROM (
  SELECT id, l, least(d, r) AS r, d, max(least(d, r)) OVER (PARTITION BY id ORDER BY l, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM spaced WHERE least(d, r) > l) q"""
NEEDS["isle"] = ("spaced",)
CTE["kept"] = """
SELECT id, isle, range_start, range_end FROM (SELECT id, isle, CASE WHEN isle = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, min(l) - 0.12::DOUBLE) END AS range_start,
  CASE WHEN isle = max(isle) OVER (PARTITION BY id) THEN max(d) ELSE least(max(d), max(r) + 0.12::DOUBLE) END AS range_end FROM isle GROUP BY id, isle) q WHERE range_end - range_start >= 0.08"""
NEEDS["kept"] = ("isle",)


def _kept_ranges(spark, sf_dir):
    clips = carriers.segments(spark, sf_dir, False).select("id", (F.col("end_seconds") - F.col("start_seconds")).alias("clip_length"))
    return intervals.pause_ranges(_spaced(spark, sf_dir), ["id"], F.col("clip_length"), clips=clips)


@query("pause_ranges", cte("kept", "seg") + """SELECT id, isle AS island, round(range_start, 9) AS range_start, round(range_end, 9) AS range_end FROM kept
  UNION ALL SELECT id, 0, 0.0, round(end_seconds - start_seconds, 9) FROM seg WHERE id NOT IN (SELECT id FROM kept)""")
def pause_ranges(spark, sf_dir):
    return _kept_ranges(spark, sf_dir).select("id", F.col("island"), F.round("range_start", 9).alias("range_start"), F.round("range_end", 9).alias("range_end"))


@query("remap_words", cte("kept", "spaced") + """SELECT w.id, w.position, round(o.range_start, 9) AS range_start, round(off + greatest(o.range_start, w.l) - o.range_start, 9) AS new_start, round(off + least(o.range_end, w.r) - o.range_start, 9) AS new_end
  FROM (SELECT *, coalesce(sum(range_end - range_start) OVER (PARTITION BY id ORDER BY range_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS off FROM kept) o
  JOIN spaced w ON w.id = o.id AND least(o.range_end, w.r) > greatest(o.range_start, w.l)""")
def remap_words(spark, sf_dir):
    moved = intervals.remap_words(_spaced(spark, sf_dir), _kept_ranges(spark, sf_dir), ["id"])
    return moved.select("id", "position", F.round("range_start", 9).alias("range_start"), F.round("new_start", 9).alias("new_start"), F.round("new_end", 9).alias("new_end"))


@query("hook_reorder", cte("words") + """SELECT id, position, round(CASE WHEN l >= cut THEN word_start - cut ELSE word_start + 3 END, 9) AS new_start, round(CASE WHEN l >= cut THEN word_end - cut ELSE word_end + 3 END, 9) AS new_end
  FROM (SELECT *, word_start - start_seconds AS l, word_end - start_seconds AS r, end_seconds - start_seconds - 3.0::DOUBLE AS cut FROM words) q WHERE r > 0 AND l < end_seconds - start_seconds AND (l >= cut OR r <= cut)""")
def hook_reorder(spark, sf_dir):
    moved = intervals.hook_reorder(_words(spark, sf_dir), F.col("start_seconds"), F.col("end_seconds"), 3.0)
    return moved.select("id", "position", F.round("new_start", 9).alias("new_start"), F.round("new_end", 9).alias("new_end"))


@query("censor_ranges", cte("words") + r"""SELECT id, position, round(word_start + (word_end - word_start) / 2, 9) AS mute_start, round(word_end, 9) AS mute_end FROM words
  WHERE regexp_matches(regexp_replace(lower(word), '[^a-ząćęłńóśźż]', '', 'g'), 'ough|ment|keit') AND length(regexp_replace(lower(word), '[^a-ząćęłńóśźż]', '', 'g')) >= 3""")
def censor_ranges(spark, sf_dir):
    muted = intervals.censor_ranges(_words(spark, sf_dir), F.col("end_seconds"), ("ough", "ment", "keit"))
    return muted.select("id", "position", F.round("mute_start", 9).alias("mute_start"), F.round("mute_end", 9).alias("mute_end"))


@query("long_pauses", cte("spaced") + "SELECT id, count(*) FILTER (l - prev >= 0.9) AS pauses FROM (SELECT *, lag(r) OVER (PARTITION BY id ORDER BY position) AS prev FROM spaced) q GROUP BY id")
def long_pauses(spark, sf_dir):
    from cuewise.functions.scores import long_pauses as pauses

    timed = F.array_sort(F.collect_list(F.struct("position", F.col("word_start").alias("start"), F.col("word_end").alias("end"))))
    # a list holds the words of one segment
    return _spaced(spark, sf_dir).groupBy("id").agg(timed.alias("words")).select("id", pauses(F.col("words")).cast("bigint").alias("pauses"))


@query("cosine_pairs", "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, sf_dir):
    left = carriers.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("left_id"), F.col("embedding").cast("array<double>").alias("a"))
    right = left.select((F.col("left_id") - 1).alias("left_id"), F.col("left_id").alias("right_id"), F.col("a").alias("b"))
    return left.join(right, "left_id").select("left_id", "right_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("cosine"))
