"""Ranking of candidates: eight capped components from evidence, references and past decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.functions import scores
from cuewise.functions import vocab as V
from cuewise.functions.tags import canonical_tag, canonical_tags, profanity_count
from cuewise.functions.text import clip, half_even, has_any, known, points
from cuewise.operators.similarity import matrix_of, mean_top_similarity, top_means
from cuewise.session import cut_lineage

FEATURES = (
    "quality", "audio", "game_reaction", "voice_expression", "visual", "chat", "chat_joy", "logical_sense", "context",
    "self_contained", "extended_completeness", "chat_question_match", "moment_reaction", "reading",
)
FEEDBACK_ROWS = 240


def recent_feedback(feedback: DataFrame, profile: str, limit: int = FEEDBACK_ROWS) -> DataFrame:
    """Newest decisions of one profile (never more than ``limit`` rows)."""
    return feedback.where(F.col("profile") == profile).orderBy(F.col("updated_at").desc(), F.col("segment_id")).limit(limit)


def feedback_summary(recent: DataFrame) -> DataFrame:
    """One row describing at most 240 decisions: counts, centroids and tags."""
    accepted, rejected = F.col("decision") == "accepted", F.col("decision") == "rejected"
    return recent.agg(
        F.count(F.when(accepted, 1)).alias("n_accepted"), F.count(F.when(rejected, 1)).alias("n_rejected"),
        F.flatten(F.collect_list(F.when(accepted, canonical_tags(F.col("tags"))))).alias("accepted_tags"),
        F.flatten(F.collect_list(F.when(rejected, canonical_tags(F.col("tags"))))).alias("rejected_tags"),
        F.struct(*[F.avg(F.when(accepted, F.coalesce(f"features.{name}", F.lit(0.5)))).alias(name) for name in FEATURES]).alias("accepted_centroid"),
        F.struct(*[F.avg(F.when(rejected, F.coalesce(f"features.{name}", F.lit(0.5)))).alias(name) for name in FEATURES]).alias("rejected_centroid"),
    )


def feature_struct() -> Column:
    names = (
        "quality_score", "audio_event_score", "game_reaction_score", "voice_expression_score", "vision_score", "chat_reaction_score",
        "chat_joy_score", "logical_sense_score", "context_score", "self_contained_score", "extended_completeness_score",
        "chat_question_match_score", "moment_reaction_score", "reading_likelihood",
    )
    parts = scores.preference_features({name: F.col(name) for name in names})
    return F.struct(*[parts[name].alias(name) for name in FEATURES])


def feature_distance(features: str, centroid: str) -> Column:
    total = sum((F.abs(F.col(f"{features}.{name}") - F.col(f"{centroid}.{name}")) for name in FEATURES), F.lit(0.0))
    return total / len(FEATURES)


def tag_affinity(tags: Column) -> Column:
    """How much more often the tags occur among accepted than among rejected decisions, clipped to +-5."""
    def share(tag: Column, pool: str, size: str) -> Column:
        return (F.size(F.filter(pool, lambda other: other == tag)) + 1) / (F.col(size) + 4)

    gains = F.transform(tags, lambda tag: (share(tag, "accepted_tags", "n_accepted") - share(tag, "rejected_tags", "n_rejected")) * 8)
    total = F.aggregate(gains, F.lit(0.0), lambda acc, value: acc + value)
    return F.when((F.col("n_accepted") >= 4) & (F.col("n_rejected") >= 4), clip(total, -5.0, 5.0)).otherwise(F.lit(0.0))


def with_feedback(candidates: DataFrame, feedback: DataFrame | None, profile: str) -> DataFrame:
    """Attach what past decisions say about every candidate."""
    if feedback is None:
        zero = F.lit(0.0)
        return candidates.withColumns({
            "_n_accepted": F.lit(0), "_n_rejected": F.lit(0), "approval_match": zero, "_rejection_match": zero,
            "_reason": F.lit(""), "_reason_match": zero, "_feedback": zero})
    recent = cut_lineage(recent_feedback(feedback, profile))
    summary = feedback_summary(recent)
    # at most ``FEEDBACK_ROWS`` decisions, so their vectors fit into the driver and every task
    decided = recent.select("decision", "review_reason", "embedding").collect()
    accepted = [row["embedding"] for row in decided if row["decision"] == "accepted"]
    rejected = [row for row in decided if row["decision"] == "rejected"]
    reasons = sorted({row["review_reason"] for row in rejected if row["review_reason"]})
    sets = [(matrix_of(accepted), 8), (matrix_of([row["embedding"] for row in rejected]), 4)]
    sets += [(matrix_of([row["embedding"] for row in rejected if row["review_reason"] == reason]), 4) for reason in reasons]
    joined = candidates.crossJoin(F.broadcast(summary)).withColumns({"_features": feature_struct(), "_means": top_means(F.col("embedding"), sets)})
    ranked_reasons = [F.struct(F.get("_means", F.lit(i + 2)).alias("match"), F.lit(reason).alias("reason")) for i, reason in enumerate(reasons)]
    none = F.lit(None).cast("struct<match:double,reason:string>")
    matched = joined.withColumns({
        "approval_match": F.get("_means", F.lit(0)), "_rejection_match": F.get("_means", F.lit(1)),
        "_top_reason": F.array_max(F.array(*ranked_reasons)) if reasons else none})
    a, r = F.col("n_accepted"), F.col("n_rejected")
    distance = clip((feature_distance("_features", "rejected_centroid") - feature_distance("_features", "accepted_centroid")) * 12.0, -4.0, 4.0)
    value = (
        points(a >= 3, F.greatest(F.lit(0.0), (F.col("approval_match") - 0.25) * 8.0))
        - points((r >= 3) & (F.col("_rejection_match") >= 0.38), F.col("_rejection_match") * 7.0)
        + points((a >= 4) & (r >= 4), distance) + tag_affinity(F.col("tags"))
    )
    extra = [name for name in summary.columns if name not in ("n_accepted", "n_rejected")]
    return matched.withColumn("_feedback", clip(value, -9.0, 7.0)).withColumns({
        "_reason": F.coalesce("_top_reason.reason", F.lit("")), "_reason_match": F.coalesce("_top_reason.match", F.lit(0.0)),
    }).withColumnsRenamed({"n_accepted": "_n_accepted", "n_rejected": "_n_rejected"}).drop(*extra, "_features", "_means", "_top_reason")


def _profile_rule(profile: str, c: dict[str, Column]) -> Column:
    staged = F.col("moment_reaction_stage").isin("game -> voice", "game -> voice -> chat")
    if profile == "game_quote_reaction":
        return F.when(staged, 7.0 + F.least(F.lit(4.0), c["game"] * 0.25)).otherwise(-12.0)
    if profile == "funny_moments":
        humour = F.array_contains("tags", "humor")
        return (F.when(c["punchline"] >= 66, 7.0).when(humour & (c["punchline"] < 52), -7.0).otherwise(0.0)
                + points(c["joy"] >= 6, F.least(F.lit(3.0), c["joy"] * 0.25)))
    if profile == "game_reactions":
        return F.when(staged, 8.0 + F.least(F.lit(3.0), c["game"] * 0.2)).otherwise(-14.0)
    if profile == "chat_interactions":
        return (F.when(c["question"] >= 40, 9.0 + F.least(F.lit(3.0), (c["question"] - 40.0) * 0.08)).otherwise(-10.0)
                + points((c["chat"] >= 7) & (F.coalesce("chat_unique_authors", F.lit(0)) >= 2), 2.0))
    if profile == "opinions":
        opinion = has_any(F.col("tags"), V.OPINION_FORM_TAGS)
        return F.when(opinion & (c["opening"] >= 60) & (c["complete"] >= 65), 7.0).when(opinion, -5.0).otherwise(-7.0)
    return F.lit(0.0)


def _tag_value(profile: str) -> Column:
    weights = sum((points(F.array_contains("tags", tag), weight) for tag, weight in V.PROFILE_TAG_WEIGHTS[profile].items()), F.lit(0))
    bonus = V.GAME_TAG_BONUS.get(profile, V.GAME_TAG_BONUS_OTHER)
    return F.least(F.lit(8.0), weights + points(F.array_contains("tags", V.GAME_TAG), bonus))


def score_candidates(candidates: DataFrame, profile: str = "general", feedback: DataFrame | None = None,
                     references: DataFrame | None = None, pattern_tags: list[str] | None = None,
                     pattern_name: str = "") -> DataFrame:
    """Add ranking components, raw score, 1..99 score and the reasons.

    ``feedback`` holds past decisions; ``references`` (ref_id, ref_vector) is what the candidates should resemble.
    """
    profile = profile if profile in V.PROFILE_TAG_WEIGHTS else "general"
    rows = candidates.withColumn("tags", canonical_tags(F.col("tags")))
    has_reference = references is not None
    rows = mean_top_similarity(rows, references, 8, "_prompt") if has_reference else rows.withColumn("_prompt", F.lit(0.0))
    rows = with_feedback(rows, feedback, profile)
    c = {
        "quality": known(F.col("quality_score")), "logical": known(F.col("logical_sense_score")), "context": known(F.col("context_score")),
        "self": known(F.col("self_contained_score")), "complete": known(F.col("extended_completeness_score")),
        "opening": known(F.col("opening_clarity_score")), "punchline": known(F.col("extended_punchline_score")),
        "question": known(F.col("chat_question_match_score")), "audio": known(F.col("audio_event_score"), 0.0),
        "game": known(F.col("game_reaction_score"), 0.0), "voice": known(F.col("voice_expression_score"), 0.0),
        "visual": known(F.col("vision_score"), 0.0), "chat": known(F.col("chat_reaction_score"), 0.0),
        "joy": known(F.col("chat_joy_score"), 0.0), "moment": known(F.col("moment_reaction_score"), 0.0),
    }
    # measured once per row; the rules below only read these columns
    rows = rows.withColumns({f"_c_{name}": value for name, value in c.items()} | {
        "_c_length": F.greatest(F.lit(0.0), F.col("end_seconds") - F.col("start_seconds")),
        "_c_reading": F.greatest(F.lit(0.0), F.coalesce(F.col("reading_likelihood"), F.lit(0.0))), "_c_tag_value": _tag_value(profile)})
    c = {name: F.col(f"_c_{name}") for name in c}
    length, reading, tag_value = F.col("_c_length"), F.col("_c_reading"), F.col("_c_tag_value")
    excluded = scores.disallowed_reading(F.col("reading_likelihood"), length, F.col("chat_question_match_score"),
                                         F.col("chat_reaction_score"), F.col("chat_joy_score"))
    adjustment = scores.duration_adjustment(length, F.col("tags"), c["chat"].cast("int"), F.col("logical_sense_score"), profile)
    emotional = has_any(F.col("tags"), V.STRONG_EMOTION_TAGS) | (c["game"] >= V.GAME_MIN_SCORE) | (c["voice"] >= 9)
    happy = (c["joy"] >= 4) & (c["chat"] >= 5)
    coherence = (
        (c["logical"] - 50.0) * 0.075 + (c["context"] - 50.0) * 0.050 + (c["self"] - 50.0) * 0.075
        + (c["complete"] - 50.0) * 0.045 + F.greatest(F.lit(0.0), c["question"] - 50.0) * 0.035
    )
    adrift = ~emotional & (c["logical"] < 42)
    coherence = (
        F.when(adrift & happy, F.greatest(coherence, F.lit(-4.0)) + F.least(F.lit(3.0), c["joy"] * 0.25))
        .when(adrift, coherence - F.least(F.lit(5.0), (42.0 - c["logical"]) * 0.15)).otherwise(coherence)
    )
    game = F.greatest(F.least(F.lit(7.0), c["audio"] * 0.35), F.least(F.lit(13.0), c["game"] * 0.65), F.least(F.lit(14.0), c["moment"] / 30.0 * 14.0))
    chat = F.greatest(F.least(F.lit(11.0), c["chat"] * 0.55), F.least(F.lit(9.0), c["joy"] * 0.65))
    channels = F.sort_array(F.array(game, chat, F.least(F.lit(7.0), c["visual"] * 0.35)), asc=False)
    reference = F.greatest(F.lit(0.0), F.col("_prompt")) * 10.0 if has_reference else F.lit(0.0)
    if pattern_tags:
        shared = F.size(F.array_intersect("tags", F.array(*[F.lit(tag) for tag in pattern_tags])))
        reference = F.greatest(reference, F.least(F.lit(3.0), shared.cast("double")))
    raw = {
        "editorial": 12.0 + c["quality"] * 0.30,
        "coherence": coherence,
        "engagement": channels[0] + channels[1] * 0.25,
        "delivery": F.least(F.lit(4.0), F.greatest(F.lit(0.0), c["voice"]) * 0.25) - F.least(F.lit(6.0), F.greatest(F.lit(0.0), -c["voice"]) * 0.65),
        "profile": tag_value + _profile_rule(profile, c),
        "preference": reference + F.col("_feedback"),
        "duration": adjustment["value"],
        "reading": -reading * F.when(excluded, 52.0).otherwise(10.0),
    }
    facts = {"_emotional": emotional, "_happy": happy, "_excluded": excluded, "_duration_reason": adjustment["reason"]}
    rows = rows.withColumns({f"_{name}": clip(value, *V.COMPONENT_LIMITS[name]) for name, value in raw.items()} | facts)
    emotional, happy, excluded = F.col("_emotional"), F.col("_happy"), F.col("_excluded")
    adrift = ~emotional & (c["logical"] < 42)
    rows = rows.withColumn("ranking_components", F.struct(*[F.bround(f"_{name}", 3).alias(name) for name in raw]))
    total = sum((F.col(f"ranking_components.{name}") for name in raw), F.lit(0.0))
    exceptional = (
        (c["quality"] >= 92) & (c["logical"] >= 86) & (c["context"] >= 80) & (c["self"] >= 86) & (c["complete"] >= 82)
        & length.between(8, 28) & (reading < 0.20)
        & ((F.col("_engagement") >= 12) | (c["voice"] >= 10) | (c["question"] >= 75)) & ~excluded
    )
    rows = rows.withColumns({"ranking_raw_score": F.bround(total, 3), "ranking_exceptional": exceptional, "excluded_from_discovery": excluded})
    rounded = F.greatest(F.lit(1), half_even(F.col("ranking_raw_score")))
    capped = F.when((rounded >= 99) & ~F.col("ranking_exceptional"), 98).otherwise(F.least(F.lit(99), rounded))
    rows = rows.withColumn("ranking_score", F.when(F.col("excluded_from_discovery"), F.least(capped, F.lit(18))).otherwise(capped).cast("int"))
    source = f"discovery patterns: {pattern_name}" if pattern_name else "prompt"
    a, r, value = F.col("_n_accepted"), F.col("_n_rejected"), F.col("_feedback")
    staged = F.col("moment_reaction_stage").isin("game -> voice", "game -> voice -> chat")

    def number(column: Column) -> Column:
        return half_even(column).cast("string")

    def says(condition: Column, *text) -> Column:
        return F.when(condition, F.concat(*[part if isinstance(part, Column) else F.lit(part) for part in text]))

    likes = (r >= 3) & (F.col("_rejection_match") >= 0.42)
    measured = F.col("extended_completeness_score") >= 0
    reasons = [
        says(F.lit(has_reference), f"matches {source} ", number(F.greatest(F.lit(0.0), F.col("_prompt")) * 100), "%"),
        says(F.lit(True), "quality ", number(c["quality"]), "/99"),
        F.col("_duration_reason"),
        says((a >= 3) & (F.col("approval_match") >= 0.30), f"matches your {profile} approvals"),
        says(likes, f"similar to your {profile} rejections",
             F.when((F.col("_reason_match") >= 0.42) & (F.col("_reason") != ""), F.concat(F.lit(": "), F.col("_reason"))).otherwise("")),
        says(~likes & (a >= 4) & (r >= 4) & (value >= 3), f"fits your {profile} review pattern"),
        F.when(c["game"] >= V.GAME_MIN_SCORE, "game event followed by microphone reaction").when(c["voice"] >= 7, "expressive vocal delivery")
        .when(c["voice"] <= -7, "monotonous vocal delivery"),
        says(c["visual"] >= 7, "visual action"),
        says(c["chat"] >= 7, "chat reacted: ", F.coalesce("chat_message_count", F.lit(0)).cast("string"), " messages",
             F.when(F.col("chat_unique_authors") > 0, F.concat(F.lit(" / "), F.col("chat_unique_authors").cast("string"), F.lit(" viewers"))).otherwise("")),
        says(c["question"] >= 40, "viewer question matched ", number(c["question"]), "/99"),
        F.when(F.col("moment_reaction_stage") == "game -> voice -> chat", F.concat(F.lit("game moment -> voice -> chat "), number(c["moment"]), F.lit("/30")))
        .when(c["moment"] >= 7, F.concat(F.lit("game moment -> voice "), number(c["moment"]), F.lit("/30"))),
        F.when(F.lit(profile == "game_quote_reaction"), F.when(staged, "game cue before microphone reaction").otherwise("no game cue -> microphone reaction sequence")),
        F.when(c["context"] >= 72, "context confirms a complete thought").when((c["context"] <= 38) & ~happy, "surrounding speech suggests a cut-off thought"),
        F.when(c["self"] >= 75, "works without prior context").when((c["self"] <= 35) & ~happy, "needs surrounding conversation to make sense"),
        says(measured, "extended completeness ", number(c["complete"]), "/99"),
        F.when(F.arrays_overlap("quality_signals", F.array(*[F.lit(s) for s in V.BOUNDARY_SIGNALS])), F.concat(F.lit("smart boundaries: "), F.array_join(
            F.filter("quality_signals", lambda s: s.isin(*V.BOUNDARY_SIGNALS)), ", "))) if "quality_signals" in rows.columns else F.lit(None).cast("string"),
        F.when(~emotional & (c["logical"] >= 68), "clear standalone thought").when(adrift & happy, "chat enjoyed an unexpected or absurd moment")
        .when(adrift, "contextless or incomplete speech without chat reaction"),
        says(tag_value >= 7, "matches active content profile"),
        says(F.col("ranking_exceptional") & (F.col("ranking_score") == 99), "exceptional complete evidence"),
        F.when(F.col("excluded_from_discovery"), "likely task/note reading - excluded from best clips").when(reading >= V.READING_CUT, "short reading kept because chat reacted"),
    ]
    rows = rows.withColumn("ranking_reason", F.concat_ws("; ", *reasons))
    rows = rows.withColumns({"approval_match": F.bround("approval_match", 4), "profile_feedback_score": F.bround("_feedback", 2)})
    if has_reference:
        rows = rows.withColumn("similarity", F.bround("_prompt", 4))
    return rows.drop(*[f"_{name}" for name in raw], *facts, *[name for name in rows.columns if name.startswith("_c_")], "_prompt", "_n_accepted", "_n_rejected", "_rejection_match", "_reason", "_reason_match", "_feedback")


# ---- filters ----------------------------------------------------------------------------------------------------
def filter_profanity(rows: DataFrame, mode: str = "allow", stems=V.PROFANITY_STEMS) -> DataFrame:
    """Modes: allow everything, at most one profane word, none."""
    if mode == "allow":
        return rows
    spoken = F.transform("words", lambda word: word["word"]) if dict(rows.dtypes).get("words", "").startswith("array<struct") else (
        F.col("words") if "words" in rows.columns else F.array().cast("array<string>"))
    return rows.where(profanity_count(spoken, F.col("transcript"), stems) <= (1 if mode == "one" else 0))


def filter_tag(rows: DataFrame, tag: str) -> DataFrame:
    return rows.where(F.array_contains(canonical_tags(F.col("tags")), canonical_tag(F.lit(tag))))


def read_aloud() -> Column:
    length = F.greatest(F.lit(0.0), F.col("end_seconds") - F.col("start_seconds"))
    return scores.disallowed_reading(F.col("reading_likelihood"), length, F.col("chat_question_match_score"), F.col("chat_reaction_score"), F.col("chat_joy_score"))


def filter_reading(rows: DataFrame) -> DataFrame:
    return rows.where(~read_aloud())


SORT_MODES = {
    f"{label}_{direction}": (column, direction == "desc")
    for label, column in (("suggested", "ranking_score"), ("quality", "quality_score"),
                          ("short_potential", "short_potential_score"), ("self_contained", "self_contained_score"))
    for direction in ("desc", "asc")
}


def sort_order(mode: str) -> list[Column]:
    """Order of a sort mode; unknown values count as 0 and ties go by time and id."""
    column, descending = SORT_MODES.get(mode, SORT_MODES["suggested_desc"])
    value = F.coalesce(F.col(column), F.lit(0))
    return [value.desc() if descending else value.asc(), F.col("start_seconds"), F.col("id")]


