"""Chat reactions: delayed windows, activity scores, previews and viewer questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions import vocab as V
from cuewise.functions.text import blank_null, clip, found, half_even, points, tokens
from cuewise.functions.vectors import cosine
from cuewise.functions.vocab import DEFAULT_VOCABULARY, Vocabulary
from cuewise.operators.intervals import range_join

CELL_SECONDS = 60.0


def message_flags(message: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, Column]:
    text = F.trim(blank_null(message))
    expressive, joyful = found(blank_null(message), vocab.reaction_pattern), found(blank_null(message), vocab.joy_pattern)
    alert = (text == "") | found(text, vocab.alert_pattern)
    return {
        "is_alert": alert, "is_expressive": expressive, "is_joy": joyful,
        "is_reactive": ~alert & (found(text, vocab.reaction_pattern) | found(text, vocab.joy_pattern)),
        "is_question": found(blank_null(message), vocab.viewer_question_pattern),
    }


def chat_summary(messages: DataFrame) -> DataFrame:
    return messages.groupBy("video_id").agg(
        F.count("*").alias("message_count"), F.count_distinct(F.nullif("author", F.lit(""))).alias("unique_authors"))


def reaction_windows(segments: DataFrame, delay: Column) -> DataFrame:
    """Delayed reaction window of every segment and the baseline window before it."""
    middle = F.col("start_seconds") + F.greatest(F.lit(0.0), (F.col("end_seconds") - F.col("start_seconds")) * 0.5)
    framed = segments.select("video_id", "id", (middle + delay).alias("reaction_start"), (F.col("end_seconds") + delay + 18.0).alias("reaction_end"))
    baseline = F.greatest(F.lit(0.0), F.col("reaction_start") - 70.0)
    return framed.withColumn("baseline_start", baseline).withColumn(
        "baseline_end", F.greatest(F.col("baseline_start"), F.col("reaction_start") - 8.0)).withColumn(
        "hull_start", F.least("baseline_start", "reaction_start"))


def window_facts(segments: DataFrame, messages: DataFrame, delay: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Message counts of both windows for every segment, with zeros where the chat was silent.

    Equal (time, author, flags) rows are counted before the join, so a flood of copies costs one row; the join covers
    both windows at once and its result is aggregated on the map side.
    """
    flags = message_flags(F.col("message"), vocab)
    slim = messages.select(
        "video_id", "seconds", F.nullif(F.lower(F.trim(blank_null(F.col("author")))), F.lit("")).alias("author"),
        *[flags[name].alias(name) for name in ("is_reactive", "is_expressive", "is_joy")])
    packed = slim.groupBy(*slim.columns).agg(F.count("*").alias("copies"))
    windows = reaction_windows(segments, delay)
    pairs = range_join(windows, packed, "video_id", "hull_start", "reaction_end", "seconds", CELL_SECONDS)
    reacting = F.col("seconds") >= F.col("reaction_start")
    resting = (F.col("seconds") >= F.col("baseline_start")) & (F.col("seconds") < F.col("baseline_end"))
    by_author = pairs.groupBy("video_id", "id", "author").agg(
        F.sum(F.when(reacting, F.col("copies"))).alias("count"), F.sum(F.when(resting, F.col("copies"))).alias("baseline"),
        F.sum(F.when(reacting & F.col("is_reactive") & F.col("is_expressive"), F.col("copies"))).alias("expressive"),
        F.sum(F.when(reacting & F.col("is_reactive") & F.col("is_joy"), F.col("copies"))).alias("joy"),
        F.max(F.when(reacting, 1)).alias("present"), F.max(F.when(reacting & F.col("is_reactive"), 1)).alias("reacted"))
    named = F.col("author").isNotNull()
    counts = by_author.groupBy("video_id", "id").agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in ("count", "baseline", "expressive", "joy")],
        F.count(F.when(named, F.col("present"))).alias("unique_authors"),
        F.count(F.when(named, F.col("reacted"))).alias("reactive_authors"))
    measures = ["count", "baseline", "expressive", "joy", "unique_authors", "reactive_authors"]
    return windows.join(counts, ["video_id", "id"], "left").fillna(0, measures)


def reaction_scores(facts: DataFrame) -> DataFrame:
    """Chat reaction (0..20) and amusement (0..14) from the window counts."""
    count, expressive, joy, authors = (F.col(name) for name in ("count", "expressive", "joy", "reactive_authors"))
    rate = F.col("baseline") / F.greatest(F.lit(1.0), F.col("baseline_end") - F.col("baseline_start"))
    framed = facts.withColumn("expected", rate * (F.col("reaction_end") - F.col("reaction_start"))).withColumn(
        "surge", (F.col("count") + 1.0) / (F.col("expected") + 1.0))
    expected, surge = F.col("expected"), F.col("surge")
    active = count >= F.greatest(F.lit(3.0), expected * 1.35)
    moved = active & (expressive >= 2)
    score = (
        points(moved, F.least(F.lit(6), F.greatest(F.lit(2), half_even((count - expected) * 1.2))))
        + points(active & (authors >= 2), F.least(F.lit(5), authors))
        + points(moved & (count >= F.greatest(F.lit(4.0), expected * 1.55)), F.least(F.lit(6), half_even((surge - 1) * 3.0)))
        + points(active & (expressive >= 3), F.least(F.lit(3), expressive - 1))
    )
    fun = active & (joy > 0)
    amusement = (
        points(fun, F.least(F.lit(6), joy * 2)) + points(active & (joy >= 2) & (authors >= 2), F.least(F.lit(4), authors))
        + points(fun & (count >= F.greatest(F.lit(3.0), expected * 1.5)),
                 F.least(F.lit(4), half_even(F.greatest(F.lit(0.0), surge - 1) * 2.5)))
    )
    return framed.select(
        "video_id", "id", clip(score, 0, 20).cast("int").alias("chat_reaction_score"),
        clip(amusement, 0, 14).cast("int").alias("chat_joy_score"), count.cast("int").alias("chat_message_count"),
        F.col("unique_authors").cast("int").alias("chat_unique_authors"), F.bround(surge, 2).alias("chat_surge"))


def score_chat(segments: DataFrame, messages: DataFrame, delay: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    return reaction_scores(window_facts(segments, messages, delay, vocab))


def first_reactions(segments: DataFrame, messages: DataFrame, delay: Column, order: str = "event_id", limit: int = 4,
                    vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """First reactive messages of every reaction window, ranked from 1."""
    reactive = messages.where(message_flags(F.col("message"), vocab)["is_reactive"])
    pairs = range_join(reaction_windows(segments, delay), reactive, "video_id", "reaction_start", "reaction_end", "seconds", CELL_SECONDS)
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("video_id", "id").orderBy("seconds", order)))
    return ranked.where(F.col("rank") <= limit).select("video_id", "id", "rank", "seconds", "author", "message")


def viewer_questions(segments: DataFrame, messages: DataFrame, delay: Column, order: str = "event_id", limit: int = 4,
                     vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Latest question-shaped messages shortly before a segment; rank 1 is the latest."""
    asked = messages.where(message_flags(F.col("message"), vocab)["is_question"])
    windows = segments.select(
        "video_id", "id", F.greatest(F.lit(0.0), F.col("start_seconds") + delay - 45.0).alias("_low"),
        (F.col("start_seconds") + delay + 5.0).alias("_high"))
    pairs = range_join(windows, asked, "video_id", "_low", "_high", "seconds", CELL_SECONDS)
    latest = Window.partitionBy("video_id", "id").orderBy(F.col("seconds").desc(), F.col(order).desc())
    return pairs.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= limit).drop("_low", "_high")


def looks_like_answer(text: Column, minimum: int = 5) -> Column:
    n = F.size(tokens(text))
    return (n >= minimum) & ~((n < 10) & F.rtrim(F.regexp_replace(blank_null(text), r"(?U)\s+$", "")).endswith("?"))


def question_stems(text: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    stop = list(vocab.question_stopwords)
    kept = F.filter(tokens(text), lambda word: (F.length(word) >= 4) & ~word.isin(stop))
    return F.array_distinct(F.transform(kept, lambda word: F.substring(word, 1, 6)))


def question_answer_score(question: Column, answer: Column, question_vector: Column, answer_vector: Column, context: Column,
                          self_contained: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Conservative 0..99 match of a viewer question and the spoken answer."""
    overlap = F.size(F.array_intersect(question_stems(question, vocab), question_stems(answer, vocab)))
    semantic = F.greatest(F.lit(0.0), F.coalesce(cosine(answer_vector, question_vector), F.lit(0.0)))
    typed = (
        (found(F.lower(question), vocab.yes_no_question_pattern) & found(F.lower(answer), vocab.yes_no_answer_pattern))
        | (found(F.lower(question), vocab.opinion_question_pattern) & found(F.lower(answer), vocab.opinion_answer_pattern))
    )
    total = (
        semantic * 55.0 + F.least(F.lit(20.0), overlap * 10.0) + points(found(answer, vocab.answer_opening_pattern), 18.0)
        + points((context >= 65) & (self_contained >= 60), 6.0)
    )
    total = F.when(typed, F.greatest(total, F.lit(46.0))).otherwise(total)
    return F.when((overlap >= 1) | (semantic >= 0.48) | typed, clip(half_even(total), 0, 99)).otherwise(0).cast("int")


def best_question(scored: DataFrame) -> DataFrame:
    """Best scored question per segment; ties go to the earliest, and only a match of at least 40 counts."""
    best = scored.groupBy("video_id", "id").agg(F.max(F.struct(F.col("match_score"), F.col("rank"), F.col("message"))).alias("_best"))
    matched = F.col("_best.match_score") >= V.QUESTION_MATCH_CUT
    return best.select(
        "video_id", "id", F.when(matched, F.col("_best.match_score")).otherwise(0).alias("chat_question_match_score"),
        F.when(matched, F.col("_best.message")).otherwise("").alias("chat_question_text"))
