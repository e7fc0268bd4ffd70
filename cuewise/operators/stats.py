"""Review statistics: every report is a small aggregate over the reviewed facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions import vocab as V
from cuewise.functions.tags import canonical_tags
from cuewise.functions.text import half_even
from cuewise.operators.ordering import exact_quantiles

RATINGS = ("accepted", "rejected", "unrated")
SCORES = {
    "quality": "quality_score", "short_potential": "short_potential_score", "logical_sense": "logical_sense_score",
    "context": "context_score", "self_contained": "self_contained_score", "extended_completeness": "extended_completeness_score",
    "opening_clarity": "opening_clarity_score", "punchline": "extended_punchline_score",
}


def reviewed_facts(segments: DataFrame, reviews: DataFrame, revisions: DataFrame, publications: DataFrame, machine: list[str]) -> DataFrame:
    """One row per current or decided segment; columns of the reviewed revision replace the current ones."""
    frozen = revisions.select(F.col("revision_id").alias("reviewed_revision_id"), F.struct(*machine).alias("_frozen"))
    joined = (segments.join(reviews, "id").join(frozen, "reviewed_revision_id", "left").join(publications, "id", "left")
              .where((F.col("lifecycle_state") == "current") | F.col("rating").isin("accepted", "rejected")))
    rating = F.when(F.col("rating").isin(*RATINGS), F.col("rating")).otherwise("unrated")
    return joined.withColumns({name: F.coalesce(F.col(f"_frozen.{name}"), F.col(name)) for name in machine}).withColumn(
        "rating", rating).drop("_frozen")


def published() -> Column:
    any_number = F.lit(False)
    for name in ("views", "shares", "comments"):
        any_number = any_number | (F.coalesce(F.col(name), F.lit(0)) != 0)
    return (F.coalesce("platform", F.lit("")) != "") | any_number


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, half_even(part * 100 / whole))


def _counts() -> list[Column]:
    return [F.count(F.when(F.col("rating") == rating, 1)).alias(rating) for rating in RATINGS]


def overview(facts: DataFrame) -> DataFrame:
    counted = facts.agg(F.count("*").alias("total"), *_counts(), F.count(F.when(published(), 1)).alias("published"))
    reviewed = F.col("accepted") + F.col("rejected")
    return counted.select("total", reviewed.alias("reviewed"), "accepted", "rejected", percent(F.col("accepted"), reviewed).alias("approval_rate"), "published")


def tag_report(facts: DataFrame, limit: int = 14) -> DataFrame:
    counted = facts.select("rating", F.explode(canonical_tags(F.col("tags"))).alias("tag")).groupBy("tag").agg(*_counts(), F.count("*").alias("total"))
    decided = F.col("accepted") + F.col("rejected")
    return counted.withColumn("approval_rate", percent(F.col("accepted"), decided)).orderBy(F.col("total").desc(), F.col("tag").desc()).limit(limit)


def mode_report(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.coalesce("analysis_mode", F.lit("default")).alias("mode")).agg(*_counts())


def reason_report(facts: DataFrame, saved: DataFrame, limit: int = 10) -> DataFrame:
    """Saved reasons with their counts, zero included, then the most frequent other ones."""
    reason = F.when(F.coalesce("review_reason", F.lit("")) == "", "No reason given").otherwise(F.col("review_reason"))
    counts = facts.where("rating = 'rejected'").groupBy(reason.alias("reason")).agg(F.count("*").alias("count"))
    listed = saved.select("reason").join(counts, "reason", "left").select("reason", F.coalesce("count", F.lit(0)).alias("count"), F.lit(True).alias("saved"))
    others = counts.join(saved.select("reason"), "reason", "left_anti").orderBy(F.col("count").desc(), "reason").limit(limit)
    return listed.unionByName(others.select("reason", "count", F.lit(False).alias("saved")))


def score_comparison(facts: DataFrame) -> DataFrame:
    """Mean score of accepted and rejected clips. A stored 0 counts as not measured here, like -1."""
    pairs = F.explode(F.array(*[F.struct(F.lit(label).alias("score"), F.col(column).cast("double").alias("value")) for label, column in SCORES.items()]))
    long = facts.where(F.col("rating").isin("accepted", "rejected")).select("rating", pairs.alias("p")).select("rating", "p.score", F.when(F.col("p.value") > 0, F.col("p.value")).alias("value"))
    parts = []
    for rating in ("accepted", "rejected"):
        value = F.when(F.col("rating") == rating, F.col("value"))
        parts += [half_even(F.avg(value)).alias(rating), F.count(value).alias(f"{rating}_count")]
    return long.groupBy("score").agg(*parts)


def calibration(comparison: DataFrame) -> DataFrame:
    size, delta = F.least("accepted_count", "rejected_count"), F.col("accepted") - F.col("rejected")
    verdict = F.when(size < 5, "collecting_data").when(delta >= 10, "strong_signal").when(delta >= 4, "weak_signal").otherwise("needs_tuning")
    return comparison.select("score", delta.alias("delta"), size.alias("sample_size"), verdict.alias("verdict"))


def published_performance(facts: DataFrame) -> DataFrame:
    shown = facts.where(published())
    watched = shown.where(F.col("average_watch_percent") > 0).select(F.lit(0).alias("_all"), F.col("average_watch_percent").cast("double").alias("_watch"))
    middle = exact_quantiles(watched, ["_all"], "_watch", [0.5], ["_median"])
    sums = shown.agg(F.lit(0).alias("_all"), F.count("*").alias("count"), F.coalesce(F.sum("views"), F.lit(0)).alias("views"),
                     F.coalesce(F.sum("shares"), F.lit(0)).alias("shares"), F.coalesce(F.sum("comments"), F.lit(0)).alias("comments"))
    return sums.join(middle, "_all", "left").withColumn("median_watch_percent", F.bround("_median", 1)).drop("_all", "_median")


def reading_flags(facts: DataFrame) -> DataFrame:
    flagged = F.coalesce("reading_likelihood", F.lit(0.0)) >= V.READING_CUT
    return facts.agg(*[F.count(F.when(flagged & (F.col("rating") == rating), 1)).alias(rating) for rating in RATINGS])


def profile_counts(feedback: DataFrame, profiles: DataFrame) -> DataFrame:
    """Decisions per known profile, zero included. Profiles are a short fixed list."""
    counts = feedback.groupBy("profile").agg(*[F.count(F.when(F.col("decision") == d, 1)).alias(d) for d in ("accepted", "rejected")])
    return F.broadcast(profiles).join(counts, "profile", "left").fillna(0, ["accepted", "rejected"])


def member_counts(parents: DataFrame, children: DataFrame, key: str, out: str) -> DataFrame:
    counts = children.groupBy(key).agg(F.count("*").alias(out))
    return parents.join(counts, key, "left").fillna(0, [out])


def duration_estimates(waiting: DataFrame, finished: DataFrame, latest: int = 8, floor: float = 15.0) -> DataFrame:
    """Expected run time of queued recordings: median ratio of the newest finished runs of the same modes."""
    newest = Window.partitionBy("audio_mode", "analysis_mode").orderBy(F.col("updated_at").desc(), F.col("id").desc())
    useful = finished.where((F.col("duration_seconds") >= 30) & (F.col("analysis_seconds") > 1))
    recent = useful.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= latest)
    ratios = recent.groupBy("audio_mode", "analysis_mode").agg(
        F.median(F.col("analysis_seconds") / F.col("duration_seconds")).alias("ratio"), F.count("*").alias("samples"))
    joined = waiting.where(F.col("duration_seconds") > 0).join(ratios, ["audio_mode", "analysis_mode"], "left")
    return joined.withColumn("estimate_seconds", F.bround(F.greatest(F.lit(floor), F.col("duration_seconds") * F.col("ratio")), 1)).withColumn(
        "estimate_seconds", F.when(F.col("ratio").isNotNull(), F.col("estimate_seconds"))).fillna(0, ["samples"])


def keyword_topk(texts: DataFrame, key: str, text: str, stopwords, limit: int = 6, minimum: int = 5) -> DataFrame:
    """Most frequent long words per key. Counts combine on the map side; ties go to the word, then only the rank limit travels."""
    from cuewise.functions.text import white_tokens

    word = F.lower(F.regexp_replace("word", r"""^[.,!?;:\-()\[\]{}"']+|[.,!?;:\-()\[\]{}"']+$""", ""))
    words = texts.select(key, F.explode(white_tokens(F.col(text))).alias("word")).select(key, word.alias("word"))
    counts = words.where((F.length("word") >= minimum) & ~F.col("word").isin(*stopwords)).groupBy(key, "word").agg(F.count("*").alias("n"))
    best = Window.partitionBy(key).orderBy(F.col("n").desc(), "word")
    return counts.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)


def reference_prompt(top_tags: Column, top_words: Column) -> Column:
    """Search prompt from the commonest tags and words of a reference collection."""
    tags = F.when(F.size(top_tags) > 0, F.array_join(top_tags, ", ")).otherwise("similar tone and context")
    words = F.when(F.size(top_words) > 0, F.array_join(top_words, ", ")).otherwise("the tone, topic and structure of reference clips")
    return F.concat(F.lit("Find clips similar to the reference examples. Prioritize: "), tags, F.lit(". Typical context and wording: "), words, F.lit("."))


def _commonest(items: DataFrame, key: str, limit: int, out: str) -> DataFrame:
    """(key, out): the most frequent ``item`` values of every key, those of equal counts in the order of their first place
    (``order``, ``at``). Counts and first places combine on the map side."""
    counted = items.groupBy(key, "item").agg(F.count("*").alias("n"), F.min(F.struct("order", "at")).alias("first"))
    best = Window.partitionBy(key).orderBy(F.col("n").desc(), "first")
    top = counted.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda p: p["item"]).alias(out))


def reference_prompts(examples: DataFrame, key: str, order: str, text: str, tags: str, stopwords, minimum: int = 5) -> DataFrame:
    """(key, prompt): the search prompt of every reference collection, from the four commonest tags and the six commonest longer
    words of its examples. Tags count under their canonical names. Collections whose examples have neither still get a prompt."""
    from cuewise.functions.tags import canonical_tags
    from cuewise.functions.text import white_tokens

    word = F.lower(F.regexp_replace("item", r"""^[.,!?;:\-()\[\]{}"']+|[.,!?;:\-()\[\]{}"']+$""", ""))
    said = examples.select(key, F.col(order).alias("order"), F.posexplode(white_tokens(F.col(text))).alias("at", "item")).withColumn("item", word)
    words = _commonest(said.where((F.length("item") >= minimum) & ~F.col("item").isin(*stopwords)), key, 6, "_words")
    marked = examples.select(key, F.col(order).alias("order"), F.posexplode(canonical_tags(F.col(tags))).alias("at", "item"))
    none = F.array().cast("array<string>")
    joined = examples.select(key).distinct().join(_commonest(marked, key, 4, "_tags"), key, "left").join(words, key, "left")
    return joined.select(key, reference_prompt(F.coalesce("_tags", none), F.coalesce("_words", none)).alias("prompt"))
