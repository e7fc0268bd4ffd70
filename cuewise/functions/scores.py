"""Explainable text scores as Column expressions.

All scores are integers in 1..99 unless noted. Each function takes Columns of one segment row and a vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.functions import vocab as V
from cuewise.functions.text import (
    any_phrase, ascii_fold, blank_null, clip, contains_any, count_in, count_prefixed, found, half_even, has_any, listed,
    points, score_1_99, squish, starts_with_word, tokens,
)
from cuewise.functions.vocab import DEFAULT_VOCABULARY, Vocabulary


def prepare(frame: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, text: str = "text", words: str | None = None,
            before: str | None = None, after: str | None = None, punched: Column | None = None) -> DataFrame:
    """Add the shared pieces of a text (names start with ``_``) so that every regex runs once per row.

    The scorers below read these columns; ``drop_prepared`` removes them again. The two large parts that only ``punchline``
    reads are made where ``punched`` holds, by default everywhere.
    """
    timed = F.col(words) if words else F.array().cast("array<struct<start:double,end:double,word:string>>")
    staged = frame.withColumns({
        "_clean": squish(F.col(text)), "_raw": blank_null(F.col(text)), "_timed": F.coalesce(timed, F.array().cast("array<struct<start:double,end:double,word:string>>")),
        "_before": squish(F.col(before)) if before else F.lit(""), "_after": squish(F.col(after)) if after else F.lit(""),
    })
    first = F.get("_timed", F.lit(0))["start"]

    def opening(seconds: float, fallback: int) -> Column:
        spoken = F.array_join(F.transform(F.filter("_timed", lambda w: w["start"] <= first + seconds), lambda w: w["word"]), " ")
        return F.when(F.size("_timed") > 0, spoken).otherwise(F.array_join(F.slice("_tokens", 1, fallback), " "))

    staged = staged.withColumn("_tokens", tokens(F.col("_clean"))).withColumns({
        "_count": F.size("_tokens"), "_closed": F.col("_clean").rlike(r"[.!?]$"),
        "_linked": found(F.col("_clean"), starts_with_word(vocab.link_words)) & (F.col("_before") != ""),
        "_folded_linked": found(F.col("_clean"), starts_with_word(vocab.folded_link_words)) & (F.col("_before") != ""),
        "_last": F.element_at("_tokens", -1), "_early": opening(3.5, 12), "_opening": opening(2.0, 7),
    })
    cut = F.greatest(F.lit(5), half_even(F.col("_count") * 0.62))

    def large(part: Column) -> Column:
        return part if punched is None else F.when(punched, part)

    staged = staged.withColumns({
        "_early_plain": ascii_fold(F.lower("_early")), "_early_tokens": tokens(F.col("_early")),
        "_opening_plain": ascii_fold(F.lower("_opening")),
        "_closing": ascii_fold(F.array_join(F.slice("_tokens", F.greatest(F.lit(1), F.col("_count") - 11), F.lit(12)), " ")),
        "_setup_part": large(ascii_fold(F.array_join(F.slice("_tokens", F.lit(1), cut), " "))),
        "_last_part": large(ascii_fold(F.array_join(F.slice("_tokens", cut + 1, F.greatest("_count", F.lit(1))), " "))),
        "_continues": (F.col("_after") != "") & ~F.col("_closed"),
    })
    return staged.withColumn("_logical", logical_sense(vocab))


PREPARED = (
    "_clean", "_raw", "_timed", "_before", "_after", "_tokens", "_count", "_closed", "_linked", "_folded_linked", "_last", "_early",
    "_opening", "_early_plain", "_early_tokens", "_opening_plain", "_closing", "_setup_part", "_last_part", "_continues", "_logical",
)


def drop_prepared(frame: DataFrame) -> DataFrame:
    return frame.drop(*PREPARED)


def _evidence(start: Column, proofs: list[tuple[Column, int]]) -> tuple[Column, Column]:
    """Start value plus the points of all proofs that hold, and the number of them."""
    score, count = start, F.lit(0)
    for condition, value in proofs:
        score, count = score + points(condition, value), count + points(condition, 1)
    return score, count


def logical_sense(vocab: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """How well a text reads as a thought of its own."""
    n, fillers, clean = F.col("_count"), count_in(F.col("_tokens"), vocab.fillers), F.col("_clean")
    hesitation = any_phrase(vocab.hesitations)
    total = (
        F.lit(42)
        + F.when(n.between(7, 75), 18).when(n >= 4, 7).otherwise(0)
        - F.least(F.lit(28), fillers * 8)
        - points(fillers / n >= 0.18, 12)
        + points(F.col("_closed"), 12)
        + points(has_any(F.col("_tokens"), vocab.coherence_connectors), 8)
        + points(clean.contains("?") & (n >= 5), 5)
        - points(clean.rlike(r"(\.\.\.|[,;:-])$") | F.col("_last").isin(*vocab.trailing_connectors), 18)
        - points(found(clean, hesitation + ".*" + hesitation), 8)
    )
    return F.when(n < 3, F.lit(15)).otherwise(score_1_99(total)).cast("int")


def context_scores() -> dict[str, Column]:
    """Context score, its signals, and how well the text works without its surroundings."""
    n, logical, linked, continues = (F.col(name) for name in ("_count", "_logical", "_linked", "_continues"))
    rounded_off = F.col("_closed") & (logical >= 68)
    score = (
        F.lit(50) + half_even((logical - 50) * 0.55) - points(linked, 16)
        + F.when(continues, -14).when(rounded_off, 8).otherwise(0)
        - points((n < 5) & ((F.col("_before") != "") | (F.col("_after") != "")), 10)
    )
    limited = ~linked & ~continues & ~rounded_off & (logical < 42)
    alone = logical - points(linked, 20) - points(continues, 18) - points(n < 5, 12) + points(rounded_off, 8)
    return {
        "context_score": score_1_99(score),
        "context_signals": F.slice(listed(
            (linked, "depends on setup before the clip"), (continues, "thought continues after the clip"),
            (~continues & rounded_off, "self-contained thought"), (limited, "limited standalone context")), 1, 2),
        "self_contained_score": score_1_99(alone),
    }


def completeness(boundary_signals: Column) -> Column:
    """Strict full-thought check, before the hook and ending are mixed in."""
    parts, n = context_scores(), F.col("_count")
    total = (
        half_even(parts["context_score"] * 0.46 + parts["self_contained_score"] * 0.46)
        + F.when(n.between(6, 60), 5).when(n < 5, -14).when(n > 90, -8).otherwise(0)
        + F.when(F.col("_closed"), 6).otherwise(-13)
        + points(F.coalesce(has_any(boundary_signals, V.BOUNDARY_SIGNALS), F.lit(False)), 4)
        - points(F.col("_linked"), 12) - points(F.col("_continues"), 10)
    )
    return score_1_99(total)


def story_shape(vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, Column]:
    """Strength of the opening hook and of the closing payoff."""
    early, plain, closing, closed = F.col("_early"), F.col("_early_plain"), F.col("_closing"), F.col("_closed")
    start = (
        F.lit(34) - points(F.col("_folded_linked"), 23) - F.least(F.lit(20), count_in(F.col("_early_tokens"), vocab.fillers) * 8)
        + points(F.size("_early_tokens") >= 5, 5)
    )
    hook, proofs = _evidence(start, [
        (early.contains("?") | found(plain, starts_with_word(vocab.question_openers)), 15),
        (found(plain, any_phrase(vocab.hook_shock)), 13),
        (found(plain, any_phrase(vocab.hook_claim)), 11),
        (found(plain, any_phrase(vocab.look_call)), 10),
    ])
    hook = F.when(proofs > 0, hook + points(early.contains("!"), 4)).otherwise(F.least(hook, F.lit(52))) - points(F.col("_count") < 6, 14)
    start = F.lit(34) + F.when(closed, 12).otherwise(-20) - points(F.col("_last").isin(*vocab.trailing_connectors), 14)
    ending, payoffs = _evidence(start, [
        (found(closing, any_phrase(vocab.ending_turn)), 13),
        (found(closing, any_phrase(vocab.ending_verdict)), 10),
        (found(closing, any_phrase(vocab.ending_outcome)), 10),
    ])
    ending = F.when(closed & (payoffs == 0), F.least(ending, F.lit(54))).otherwise(ending) - points(F.col("_continues"), 12)
    empty = F.col("_count") == 0
    return {
        "hook": F.when(empty, 1).otherwise(score_1_99(hook)).cast("int"),
        "ending": F.when(empty, 1).otherwise(score_1_99(ending)).cast("int"),
    }


def story_signals(hook: Column, ending: Column) -> Column:
    """Up to two findings about the finished hook and ending scores."""
    return F.when(F.col("_count") == 0, F.array(F.lit("empty spoken fragment"))).otherwise(F.slice(listed(
        (F.col("_folded_linked"), "weak opening depends on earlier speech"),
        (~F.col("_closed"), "ending does not resolve the thought"),
        (hook >= 66, "clear opening hook"), (ending >= 68, "resolved ending or payoff")), 1, 2))


def opening_clarity(vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, Column]:
    """Whether the first two seconds set up a clear premise."""
    opening, plain = F.col("_opening"), F.col("_opening_plain")
    latin = F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))
    sparse, fillers = F.size(latin) < 4, count_in(latin, vocab.fillers)
    mid_thought = F.coalesce(F.get(latin, F.lit(0)).isin(*vocab.mid_thought_words), F.lit(False))
    start = F.lit(26) + F.when(sparse, -12).otherwise(10) - points(mid_thought, 18) - F.least(F.lit(18), fillers * 9)
    score, proofs = _evidence(start, [
        (opening.contains("?") | found(plain, starts_with_word(vocab.question_openers)), 16),
        (found(plain, any_phrase(vocab.opening_shock)), 13),
        (found(plain, any_phrase(vocab.opening_claim)), 11),
        (found(plain, any_phrase(vocab.look_call)), 10),
    ])
    score = F.when(proofs > 0, score).otherwise(F.least(score, F.lit(52)))
    empty = F.col("_count") == 0
    return {
        "score": F.when(empty, 1).otherwise(score_1_99(score)).cast("int"),
        "signals": F.when(empty, F.array(F.lit("no spoken opening"))).otherwise(F.slice(listed(
            (sparse, "opening is too sparse"), (mid_thought, "opening starts mid-thought"),
            (fillers > 0, "filler-heavy opening"), (proofs > 0, "clear first-two-seconds premise"),
            (proofs == 0, "opening has no clear premise")), 1, 2)),
    }


def punchline(vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, Column]:
    """A turn, outcome or joke in the last part of the text."""
    closing, closed, short = F.col("_last_part"), F.col("_closed"), F.col("_count") < 8
    score, proofs = _evidence(F.lit(24) + F.when(closed, 8).otherwise(-16), [
        (found(closing, any_phrase(vocab.punch_turn)), 23),
        (found(closing, any_phrase(vocab.punch_outcome)), 16),
        (found(closing, any_phrase(vocab.punch_superlative)), 15),
        (found(closing, vocab.punch_laughter), 10),
    ])
    late = (proofs > 0) & ~contains_any(F.col("_setup_part"), vocab.setup_turns)
    score = score + points(late, 7) + points(proofs >= 2, 8)
    score = F.when(proofs > 0, score).otherwise(F.least(score, F.lit(48)))
    return {
        "score": F.when(short, 1).otherwise(score_1_99(score)).cast("int"),
        "signals": F.when(short, F.array(F.lit("too little speech for a punchline"))).otherwise(F.slice(listed(
            (~closed, "ending cuts off before payoff"), (late, "late turn or reveal"),
            (proofs > 0, "clear punchline or outcome"), (proofs == 0, "no verified punchline")), 1, 2)),
    }


def extended_reading_parts(vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, Column]:
    """Counts of formal, directive and quoted wording; materialise them before ``extended_reading``."""
    plain = F.transform(F.array(ascii_fold(F.lower("_clean"))), lambda p: F.struct(
        p.alias("plain"), F.regexp_extract_all(p, F.lit("[a-z]+"), F.lit(0)).alias("latin")))
    one = F.transform(plain, lambda p: F.struct(
        count_prefixed(p["latin"], vocab.document_stems).alias("formal"), F.size(p["latin"]).alias("words"),
        F.regexp_count(p["plain"], F.lit(vocab.directive_pattern)).alias("directive"),
        sum((points(p["plain"].contains(phrase), 1) for phrase in vocab.quote_phrases), F.lit(0)).alias("quotes"),
        found(p["plain"], vocab.personal_pattern).alias("personal")))
    return {"_formal": F.get(one, F.lit(0)), "_sentences": F.regexp_count("_raw", F.lit("[.!?]"))}


def extended_reading(base: Column) -> Column:
    """Reading-aloud likelihood (0..1) from formal wording together with directive or quoted wording."""
    formal, directive = F.col("_formal.formal"), F.col("_formal.directive")
    boost = (
        F.when((formal >= 3) | (directive >= 2), 0.42).when((formal >= 2) & (directive >= 1), 0.32).otherwise(0.0)
        + points((formal >= 2) & (F.col("_formal.quotes") >= 1), 0.16)
        + points((F.col("_formal.words") >= 22) & (F.col("_sentences") >= 3) & ((formal >= 2) | (directive >= 2)), 0.10)
    )
    boost = boost + points((boost > 0) & (F.col("_before") != "") & (F.col("_after") != ""), 0.05)
    base = F.coalesce(base.cast("double"), F.lit(0.0))
    return F.bround(F.least(F.lit(1.0), base + F.when(F.col("_formal.personal"), 0.0).otherwise(boost)), 3)


def max_repeats(words: Column, span: int = 3) -> Column:
    """Highest number of times one run of ``span`` neighbouring words occurs.

    Sorting the runs first makes equal ones neighbours, so one linear fold over them finds the longest streak.
    """
    none = F.array().cast("array<string>")
    # binding the list to a lambda variable keeps it from being evaluated once per position
    grams = F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) >= span, F.transform(
        F.slice(w, F.lit(1), F.size(w) - (span - 1)), lambda word, i: F.concat_ws(" ", word, *[F.get(w, i + k) for k in range(1, span)]))).otherwise(none)))
    start = F.struct(F.lit("").alias("gram"), F.lit(0).alias("streak"), F.lit(0).alias("best"))

    def step(state: Column, gram: Column) -> Column:
        streak = F.when(gram == state["gram"], state["streak"] + 1).otherwise(F.lit(1))
        return F.struct(gram.alias("gram"), streak.alias("streak"), F.greatest(state["best"], streak).alias("best"))

    return F.aggregate(F.sort_array(grams), start, step, lambda state: state["best"])


def long_pauses(words: Column, seconds: float = 0.9) -> Column:
    """Gaps of at least ``seconds`` between neighbouring timed words."""
    gaps = F.zip_with(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1))),
                      lambda later, earlier: later["start"] - earlier["end"])
    return F.when(F.size(words) > 1, F.size(F.filter(gaps, lambda gap: gap >= seconds))).otherwise(F.lit(0))


def reading_parts(start: Column, end: Column, tags: Column, vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, Column]:
    """Measurements behind the base quality score, on a prepared frame; materialise them before combining them."""
    spoken = F.col("_tokens")
    document = F.get(F.transform(F.array(ascii_fold(F.lower("_raw"))), lambda plain: count_prefixed(
        F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0)), vocab.document_stems) + points(contains_any(plain, vocab.document_phrases), 2)), F.lit(0))
    return {
        "_n": F.col("_count"),
        "_length": F.greatest(F.lit(1.0), end - start),
        "_pauses": long_pauses(F.col("_timed")),
        "_fillers": count_in(spoken, vocab.fillers),
        "_reading_words": count_in(spoken, vocab.reading_words),
        "_repeats": max_repeats(spoken),
        "_ui_cues": count_prefixed(spoken, vocab.reading_stems),
        "_document_cues": document,
        "_unpunctuated": ~F.col("_raw").rlike("[.!?]"),
        "_loud": F.col("_raw").rlike("[!?]"),
        "_matched": count_in(F.coalesce(tags, F.array().cast("array<string>")), V.EMOTION_OR_OPINION_TAGS),
    }


def base_reading() -> Column:
    """Unrounded reading likelihood (0..1) from the measurements of ``reading_parts``."""
    n, length, rate = F.col("_n"), F.col("_length"), F.col("_n") / F.col("_length")
    likelihood = (
        F.when((n >= 10) & (rate < 1.25), 0.22).when((n >= 10) & (rate < 1.55), 0.08).otherwise(0.0)
        + points((n >= 10) & (F.col("_pauses") >= F.greatest(F.lit(2), F.floor(n / 9))), 0.25)
        + points(F.col("_fillers") >= 2, F.least(F.lit(0.25), F.col("_fillers") * 0.08))
        + points(F.col("_reading_words") > 0, F.least(F.lit(0.25), F.col("_reading_words") * 0.12))
        + points(F.col("_repeats") >= 2, F.least(F.lit(0.38), 0.18 + (F.col("_repeats") - 1) * 0.14))
        + points(F.col("_ui_cues") >= 2, F.least(F.lit(0.42), F.col("_ui_cues") * 0.11))
        + points(F.col("_document_cues") >= 2, F.least(F.lit(0.22), 0.06 + F.col("_document_cues") * 0.04))
        + points((n >= 28) & (length >= 22) & F.col("_unpunctuated") & (rate <= 4.2), 0.18)
        + points((n >= 55) & (length >= 30) & (F.col("_matched") == 0), 0.12)
    )
    return F.least(F.lit(1.0), likelihood)


def base_quality(reading: Column) -> dict[str, Column]:
    """Base quality score and its first three signals from the measurements of ``reading_parts``."""
    length, rate = F.col("_length"), F.col("_n") / F.col("_length")
    short, long = length.between(6, 30), (length > 30) & (length <= 40)
    natural, matched, loud = rate.between(1.4, 4.8), F.col("_matched") > 0, F.col("_loud")
    likely, some = reading >= V.READING_CUT, (reading >= 0.30) & (reading < V.READING_CUT)
    score = (
        F.lit(35) + points(short, 12) + points(long, 3) + points(natural, 10)
        + F.least(F.lit(24), F.col("_matched") * 8) + points(loud, 7) - points(likely, 42) - points(some, 12)
    )
    positive = listed(
        (short, "good clip length"), (long, "long clip"), (natural, "natural speaking pace"),
        (matched, "emotion or opinion"), (loud, "expressive delivery"),
    )
    warned = F.concat(F.slice(positive, 1, 2), F.array(F.lit("possible reading aloud")))
    mild = F.slice(F.concat(positive, listed((some, "some reading cues"))), 1, 3)
    return {"score": score_1_99(score), "signals": F.when(likely, warned).otherwise(mild)}


def moment_reaction(game: Column, chat: Column, joy: Column) -> dict[str, Column]:
    """A game event, then a voice reaction, then chat: 0..30 and the stage reached."""
    answered = chat >= 5
    total = F.least(F.lit(16), game) + F.when(
        answered, F.least(F.lit(8), half_even(chat * 0.45)) + F.least(F.lit(6), half_even(joy * 0.45))).otherwise(0)
    active = game >= V.GAME_MIN_SCORE
    return {
        "score": F.when(active, F.least(F.lit(30), total)).otherwise(0).cast("int"),
        "stage": F.when(active & answered, "game -> voice -> chat").when(active, "game -> voice").otherwise(""),
    }


def effective_reading(text_reading: Column, visual: Column, screen: Column, extended: Column) -> dict[str, Column]:
    screen = F.greatest(F.lit(0.0), F.coalesce(screen.cast("double"), F.lit(0.0)))
    on_screen = F.when(screen > 0, F.least(F.lit(1.0), 0.52 + screen * 0.035)).otherwise(0.0)
    seen = F.greatest(F.coalesce(visual.cast("double"), F.lit(0.0)), on_screen)
    strongest = F.greatest(F.coalesce(text_reading, F.lit(0.0)), seen, F.coalesce(extended, F.lit(0.0)))
    return {
        "visual_reading_likelihood": F.bround(clip(seen, 0.0, 1.0), 3),
        "reading_likelihood": F.bround(clip(strongest, 0.0, 1.0), 3),
    }


def quality_caps(score: Column, duration: Column, tags: Column, signals: Column, reading: Column, logical: Column,
                 context: Column, self_contained: Column, complete: Column, game: Column, voice: Column,
                 moment: Column) -> dict[str, Column]:
    """Final ceilings on quality: related bonuses alone must not reach the top range."""
    strong = (
        has_any(tags, V.STRONG_EMOTION_TAGS) | F.array_contains(signals, "expressive delivery")
        | (game >= V.GAME_MIN_SCORE) | (moment >= 10) | (voice >= 10)
    )
    exceptional = (
        duration.between(6, 30) & F.array_contains(signals, "natural speaking pace") & (reading < 0.20)
        & (self_contained >= 85) & (logical >= 84) & (context >= 72) & (complete >= 82) & strong
    )
    caps = F.least(
        F.when(reading >= V.READING_CUT, 22).when(reading >= 0.30, 68).otherwise(99),
        F.when((self_contained < 58) | (logical < 55), 72).when((self_contained < 72) | (logical < 70), 82).otherwise(99),
        F.when((context >= 0) & (context < 52), 86).otherwise(99),
        F.when(complete < 0, 93).when(complete < 65, 88).otherwise(99),
        F.when(strong, 99).otherwise(90),
        F.when(exceptional, 99).otherwise(95),
    )
    return {"score": score_1_99(F.least(score, caps)), "exceptional": exceptional}


def assembled_quality(base: Column, base_signals: Column, row: dict[str, Column]) -> dict[str, Column]:
    """Quality from the base score plus evidence, then the ceilings."""
    game, voice, tags = row["game"], row["voice"], row["tags"]
    loud_game = game >= V.GAME_MIN_SCORE
    voice_led = has_any(tags, V.EMOTION_OR_OPINION_TAGS) | F.exists(tags, lambda tag: tag.startswith("forma:"))
    expressive = ~loud_game & voice_led & (voice >= 7)
    flat = ~loud_game & ~expressive & (voice <= -7)
    score = (
        F.when(loud_game, F.least(F.lit(99), base + F.least(F.lit(10), game)))
        .when(expressive, F.least(F.lit(99), base + F.least(F.lit(6), voice - 5)))
        .when(flat, F.greatest(F.lit(1), base - 7)).otherwise(base)
    )
    good_context, poor_context = row["context"] >= 72, row["context"].between(0, 38)
    score = F.when(good_context, F.least(F.lit(99), score + 3)).when(poor_context, F.greatest(F.lit(1), score - 6)).otherwise(score)
    shaped = (row["hook"] >= 0) & (row["ending"] >= 0)
    score = F.when(shaped, clip(
        score + half_even((row["hook"] - 50) * 0.10) + half_even((row["ending"] - 50) * 0.12), 1, 99)).otherwise(score)
    whole, broken = row["complete"] >= 76, row["complete"].between(0, 43)
    score = F.when(whole, F.least(F.lit(99), score + 6)).when(broken, F.greatest(F.lit(1), score - 14)).otherwise(score)
    reading, text_reading = row["reading"], F.coalesce(row["text_reading"], F.lit(0.0))
    verified = (reading >= V.READING_CUT) & (reading > text_reading)
    cues = ~verified & (reading >= 0.30) & (reading > text_reading + 0.08)
    none = F.array().cast("array<string>")
    signals = F.concat(
        base_signals,
        listed((loud_game, "game sound followed by microphone reaction"), (expressive, "expressive vocal delivery"),
               (flat, "monotonous vocal delivery")),
        F.when(good_context | poor_context, row["context_signals"]).otherwise(none),
        listed((row["vision"] >= 7, "visual action")),
        F.coalesce(row["boundary_signals"], none),
        F.when(shaped, row["story_signals"]).otherwise(none),
        listed((whole, "extended complete-thought verification"), (broken, "extended incomplete-thought warning"),
               (verified, "extended or visual reading verification"), (cues, "extended or visual reading cues")),
    )
    capped = quality_caps(score, row["duration"], tags, signals, reading, row["logical"], row["context"],
                          row["self_contained"], row["complete"], game, voice, row["moment"])
    return {
        "score": capped["score"],
        "signals": F.array_distinct(F.concat(signals, listed((capped["exceptional"], "exceptional quality criteria met")))),
    }


def short_potential(text: Column, start: Column, end: Column, row: dict[str, Column], count: Column | None = None) -> dict[str, Column]:
    """Whether a candidate works as a concise clip of its own. ``count`` is the number of its words, if it is known."""
    n, length, tags = F.size(tokens(text)) if count is None else count, F.greatest(F.lit(0.1), end - start), row["tags"]
    logical, context, alone, complete = row["logical"], row["context"], row["self_contained"], row["complete"]
    ideal, usable = length.between(8, 28), length.between(5, 38)
    solid = (alone >= 78) & (logical >= 74) & (context >= 62)
    fair = (alone >= 58) & (logical >= 55)
    whole, broken = complete >= 76, complete.between(0, 43)
    interest = has_any(tags, V.HOOK_TAGS) | has_any(tags, V.EMOTION_OR_OPINION_TAGS) | F.exists(tags, lambda t: t.startswith("emocja:"))
    answer = F.array_contains(tags, V.ANSWER_TAG)
    game = (row["game"] >= V.GAME_MIN_SCORE) | (row["moment"] >= V.GAME_MIN_SCORE)
    voiced = row["voice"] >= 10
    chatty = (row["chat"] >= 12) | (row["joy"] >= 8)
    story = (row["hook"] >= 66) & (row["ending"] >= 68)
    opening, punch = row["opening"] >= 64, row["punchline"] >= 66
    proofs = sum((points(c, 1) for c in (game, voiced, chatty, answer, interest, story, punch)), F.lit(0))
    attention = (
        points(interest, 7) + points(story, 10) + points(opening, 6) + points(punch, 12) + points(answer, 12)
        + points(game, 18) + F.when(voiced & game, 8).when(voiced, 12).otherwise(0)
        + points(row["chat"] >= 10, 8) + points(row["joy"] >= 8, 6) + points(proofs >= 2, 4)
    )
    likely = (row["reading"] >= V.READING_CUT) | F.array_contains(tags, "reading")
    cues = ~likely & (row["reading"] >= 0.30)
    score = (
        F.lit(20)
        + F.when(ideal, 15).when(usable, 8).when(length > 50, -20).when(length > 38, -9).when(length < 4, -12).otherwise(0)
        + F.when(solid, 18).when(fair, 8).otherwise(-14)
        + F.when(whole, 8).when(broken, -15).otherwise(0)
        + attention
        + F.when(n < 5, -12).when(n > 92, -10).otherwise(0)
        - points(likely, 42) - points(cues, 14)
    )
    exceptional = (
        ideal & (alone >= 85) & (logical >= 84) & (context >= 72) & (complete >= 82) & (row["quality"] >= 80)
        & (row["reading"] < 0.20) & (proofs >= 2) & (attention >= 24) & opening & (punch | answer | game)
    )
    caps = F.least(
        F.when(~fair, 72).when(~solid, 82).otherwise(99),
        F.when((context >= 0) & (context < 52), 86).otherwise(99),
        F.when(complete < 0, 92).when(complete < 65, 88).otherwise(99),
        F.when(attention == 0, 65).when(proofs == 1, 88).otherwise(99),
        F.when(exceptional, 99).otherwise(95),
    )
    signals = listed(
        (ideal, "short-friendly length"), (~ideal & usable, "usable short length"),
        (length > 50, "too long for a short"), ((length > 38) & (length <= 50), "long for a short"),
        (length < 4, "very brief clip"),
        (solid, "stands on its own"), (~solid & fair, "mostly self-contained"), (~solid & ~fair, "needs surrounding context"),
        (whole, "verified complete ending"), (broken, "incomplete ending"),
        (interest, "clear content hook"), (story, "hook and payoff verified"),
        (opening, "clear first-two-seconds premise"), (punch, "late punchline or outcome verified"),
        (answer, "answer with context"), (game, "game moment to reaction"), (voiced, "expressive voice"),
        (row["chat"] >= 10, "chat reacted"), (row["joy"] >= 8, "chat amusement"),
        (n < 5, "not enough spoken content"), (n > 92, "too much spoken content"),
        (likely, "likely reading aloud"), (cues, "reading cues"),
        (exceptional, "exceptional short criteria met"),
    )
    return {"score": score_1_99(F.least(score, caps)), "signals": F.slice(signals, 1, 4)}


def disallowed_reading(reading: Column, duration: Column, question: Column, chat: Column, joy: Column) -> Column:
    """Likely reading aloud, unless a short matched answer amused the chat."""
    excused = (duration <= 24) & (question >= V.QUESTION_MATCH_CUT) & (chat >= 7) & (joy >= 3)
    return (F.coalesce(reading, F.lit(0.0)) >= V.READING_CUT) & ~F.coalesce(excused, F.lit(False))


def duration_adjustment(duration: Column, tags: Column, chat: Column, logical: Column, profile: str) -> dict[str, Column]:
    """Preference for concise clips, by profile and speech form."""
    long_form = has_any(tags, V.LONG_FORM_TAGS) | ((chat >= 8) & (F.coalesce(logical, F.lit(0)) >= 60))
    rules: list[tuple[Column, float, str]] = []
    if profile in ("funny_moments", "game_reactions"):
        rules += [(duration.between(6, 24), 6.0, "tight reaction length"),
                  ((duration > 24) & (duration <= 34), -3.0, "reaction is starting to run long"),
                  (duration > 34, -16.0, "too long for a fast reaction")]
    if profile in ("chat_interactions", "opinions"):
        rules += [(duration.between(12, 42), 6.0, "complete conversational length"),
                  ((duration > 42) & (duration <= 60), 1.0, "long but usable answer"),
                  (duration > 60, -12.0, "too long for a focused answer")]
    rules += [
        (duration.between(8, 26), 8.0, "concise length"),
        ((duration > 26) & (duration <= 32), 4.0, "reviewable length"),
        ((duration > 32) & (duration <= 42) & long_form, 1.0, "long complete answer"),
        ((duration > 32) & (duration <= 42), -11.0, "too long for a focused clip"),
        ((duration > 42) & long_form, -8.0, "extended opinion or answer"),
        (duration > 42, -25.0, "far too long for a focused clip"),
    ]
    value, reason = F, F
    for condition, amount, label in rules:
        value, reason = value.when(condition, F.lit(amount)), reason.when(condition, F.lit(label))
    return {"value": value.otherwise(F.lit(-4.0)), "reason": reason.otherwise(F.lit("very short clip"))}


def duration_bucket(seconds: Column) -> Column:
    return (F.when(seconds < 8, "under_8s").when(seconds <= 16, "8_16s").when(seconds <= 26, "17_26s")
            .when(seconds <= 40, "27_40s").otherwise("over_40s"))


def rejection_code(reason: Column, rules: dict[str, tuple] = V.REJECTION_RULES) -> Column:
    """Free-text reason to a fixed code; the first matching rule wins."""
    plain = ascii_fold(F.lower(blank_null(reason)), stroked_l=False)
    result = F
    for code, markers in rules.items():
        result = result.when(contains_any(plain, markers), F.lit(code))
    return result.otherwise(F.lit("other"))


def preference_features(row: dict[str, Column]) -> dict[str, Column]:
    """Fourteen features scaled to 0..1; unknown structure scores count as 0.5."""
    def scaled(name: str, top: float) -> Column:
        return clip(F.coalesce(row[name].cast("double"), F.lit(0.0)) / top, 0.0, 1.0)

    def structure(name: str) -> Column:
        value = row[name].cast("double")
        return clip(F.when(value >= 0, value).otherwise(50.0) / 100, 0.0, 1.0)

    return {
        "quality": scaled("quality_score", 99), "audio": scaled("audio_event_score", 20),
        "game_reaction": scaled("game_reaction_score", 20), "voice_expression": scaled("voice_expression_score", 20),
        "visual": scaled("vision_score", 20), "chat": scaled("chat_reaction_score", 20),
        "chat_joy": scaled("chat_joy_score", 20), "logical_sense": structure("logical_sense_score"),
        "context": structure("context_score"), "self_contained": structure("self_contained_score"),
        "extended_completeness": structure("extended_completeness_score"),
        "chat_question_match": scaled("chat_question_match_score", 100),
        "moment_reaction": scaled("moment_reaction_score", 30), "reading": scaled("reading_likelihood", 1),
    }
