"""Ranking-quality metrics over reviewed records, without ordering all records in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.operators.ordering import exact_quantiles, ordered_index
from cuewise.operators.json_walk import kind_of, pin

SCHEMA_VERSION = 1
# --- fixed values: gate limits, allowed codes, feature ranges and private field names
DEFAULT_THRESHOLDS = {
    "precision_at_20_min": 0.70, "average_precision_min": 0.65, "pairwise_accuracy_min": 0.70, "reading_recall_min": 0.80,
    "reading_specificity_min": 0.80, "duplicate_exposure_at_20_max": 0.10, "score_99_rate_max": 0.05,
}
REJECTION_CODES = (
    "reading_game_text", "incomplete_cut", "needs_context", "duplicate", "incoherent", "not_interesting", "monotone_delivery",
    "too_long", "false_visual_event", "greeting_housekeeping", "song_copyright", "profanity", "technical", "other", "",
)
FEATURE_RANGES = {
    "quality": (0, 99), "short_potential": (-1, 99), "logical_sense": (-1, 99), "context": (-1, 99), "self_contained": (-1, 99),
    "extended_completeness": (-1, 99), "reading_likelihood": (0, 1), "audio_event": (0, 99), "game_reaction": (0, 99),
    "voice_expression": (-99, 99), "moment_reaction": (0, 99), "vision": (0, 99), "chat_reaction": (0, 99), "chat_joy": (0, 99),
    "chat_question_match": (0, 99),
}
PRIVATE_FIELDS = (
    "archive_audio_path", "chat_messages", "chat_question_text", "context_after", "context_before", "embedding", "original_name",
    "path", "review_reason", "review_reason_text", "source_url", "start_seconds", "end_seconds", "transcript", "video_id",
    "segment_id", "word_timestamps",
)


def _accepted() -> Column:
    return F.col("decision") == "accepted"


def _score() -> Column:
    return F.col("predicted_score").cast("double")


def ranked_records(records: DataFrame) -> DataFrame:
    """Records with their rank (score descending, then id) and the accepted ones found so far."""
    return ordered_index(records, [_score().desc(), F.col("sample_id")], {"found": _accepted().cast("int")})


def top_records(records: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` records with their rank; a top-k, not a full sort."""
    order = [_score().desc(), F.col("sample_id")]
    top = records.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def summary(records: DataFrame) -> DataFrame:
    accepted, rejected, score = _accepted(), F.col("decision") == "rejected", _score()
    # medians by rank over the distinct scores, one small job per decision
    halves = [exact_quantiles(records.where(F.col("decision") == decision).select(F.lit(0).alias("_all"), score.alias("_score")), ["_all"], "_score", [0.5], [f"{decision}_score_median"])
              for decision in ("accepted", "rejected")]
    counted = records.agg(
        F.count("*").alias("reviewed"), F.count(F.when(accepted, 1)).alias("accepted"), F.count(F.when(rejected, 1)).alias("rejected"),
        F.count_distinct("group_id").alias("source_groups"), F.avg(accepted.cast("double")).alias("approval_rate"),
        F.avg(F.when(accepted, score)).alias("accepted_score_mean"),
        F.avg(F.when(rejected, score)).alias("rejected_score_mean"),
        F.avg((score >= 95).cast("double")).alias("score_95_plus_rate"), F.avg((score == 99).cast("double")).alias("score_99_rate"), F.lit(0).alias("_all"))
    for half in halves:
        counted = counted.join(half, "_all", "left")
    return counted.drop("_all")


def precision_recall(records: DataFrame, limits: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    top, hit = top_records(records, max(limits)), _accepted().cast("int")
    parts = [F.sum(F.when(F.col("rank") <= k, hit)).alias(f"hits_{k}") for k in limits]
    sizes = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"size_{k}") for k in limits]
    total = records.agg(F.count(F.when(_accepted(), 1)).alias("positives"))
    hits = top.agg(*parts, *sizes).crossJoin(F.broadcast(total))
    return hits.select(*[F.try_divide(f"hits_{k}", f"size_{k}").alias(f"precision_at_{k}") for k in limits],
                       *[F.coalesce(F.try_divide(f"hits_{k}", "positives"), F.lit(0.0)).alias(f"recall_at_{k}") for k in limits])


def average_precision(records: DataFrame) -> DataFrame:
    hits = ranked_records(records).where(_accepted())
    return hits.agg(F.coalesce(F.avg(F.col("found") / F.col("rank")), F.lit(0.0)).alias("average_precision"))


def ndcg(records: DataFrame, limits: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    gain = 3.0 / F.log2(F.col("rank") + 1)
    top = top_records(records, max(limits))
    got = top.agg(*[F.coalesce(F.sum(F.when((F.col("rank") <= k) & _accepted(), gain)), F.lit(0.0)).alias(f"dcg_{k}") for k in limits])
    total = records.agg(F.count(F.when(_accepted(), 1)).alias("positives"))
    ideal = [F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda acc, rank: acc + F.when(rank <= F.col("positives"), 3.0 / F.log2(rank + 1)).otherwise(0.0)).alias(f"best_{k}")
             for k in limits]
    both = got.crossJoin(F.broadcast(total)).select("*", *ideal)
    return both.select(*[F.coalesce(F.try_divide(f"dcg_{k}", f"best_{k}"), F.lit(0.0)).alias(f"ndcg_at_{k}") for k in limits])


def pairwise_accuracy(records: DataFrame) -> DataFrame:
    """Chance that an accepted record outscores a rejected one, ties counting half.

    Records are first counted per score value; running totals over the distinct scores replace the pairs. Whole and
    half points are summed as exact integers of half points.
    """
    by_score = records.groupBy(_score().alias("score")).agg(
        F.count(F.when(_accepted(), 1)).alias("a"), F.count(F.when(F.col("decision") == "rejected", 1)).alias("r"))
    indexed = ordered_index(by_score, [F.col("score")], {"r_upto": F.col("r")})
    half = F.col("a").cast("decimal(38,0)") * (2 * (F.col("r_upto") - F.col("r")) + F.col("r"))
    totals = indexed.agg(F.sum(half).alias("won"), F.sum("a").alias("pa"), F.sum("r").alias("pr"))
    return totals.select(F.coalesce(F.try_divide(F.col("won").cast("double"), 2.0 * F.col("pa") * F.col("pr")), F.lit(0.0)).alias("pairwise_accuracy"))


def calibration(records: DataFrame, bins: int = 10) -> DataFrame:
    chance, label = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _score() / 99.0)), _accepted().cast("double")
    scored = records.select(chance.alias("p"), label.alias("y"), F.least(F.lit(bins - 1), F.floor(chance * bins)).alias("bin"))
    binned = scored.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg("y").alias("accuracy"),
                                       F.sum((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("squares"))
    return binned.agg((F.sum("squares") / F.sum("n")).alias("brier_score"),
                      (F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("expected_calibration_error"))


def reading_metrics(records: DataFrame, cut: float = 0.48) -> DataFrame:
    predicted = (F.coalesce("reading_likelihood", F.lit(0.0)) >= cut).cast("double")
    return records.agg(F.avg(F.when(F.col("expected_reading"), predicted)).alias("reading_recall"),
                       F.avg(F.when(~F.col("expected_reading"), 1.0 - predicted)).alias("reading_specificity"))


def duplicate_exposure(records: DataFrame, limits: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Share of repeated moments among the best records; works on at most ``max(limits)`` rows."""
    top, group = top_records(records, max(limits)), F.nullif(F.col("moment_group_id").cast("string"), F.lit(""))
    return top.agg(*[((F.count(F.when(F.col("rank") <= k, group)) - F.count_distinct(F.when(F.col("rank") <= k, group)))
                      / F.count(F.when(F.col("rank") <= k, 1))).alias(f"duplicate_exposure_at_{k}") for k in limits])


def reading_exposure(records: DataFrame, limits: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    top = top_records(records, max(limits))
    return top.agg(*[F.avg(F.when(F.col("rank") <= k, F.coalesce("expected_reading", F.lit(False)).cast("double"))).alias(f"reading_exposure_at_{k}") for k in limits])


def tag_precision(records: DataFrame) -> DataFrame:
    verdicts = records.select(F.explode(F.map_values("tag_feedback")).alias("verdict"))
    return verdicts.agg(F.avg((F.col("verdict") == "correct").cast("double")).alias("assigned_tag_precision"))


def false_positives(records: DataFrame, cut: float = 50) -> DataFrame:
    code = F.when(F.coalesce("rejection_code", F.lit("")) == "", "other").otherwise(F.col("rejection_code"))
    return records.where("decision = 'rejected'").groupBy(code.alias("rejection_code")).agg(
        F.avg((_score() >= cut).cast("double")).alias("false_positive_rate"))


def metrics(records: DataFrame) -> DataFrame:
    """All scalar metrics in one row; every part is a single-row aggregate."""
    parts = [summary(records), precision_recall(records), average_precision(records), ndcg(records), pairwise_accuracy(records),
             calibration(records), reading_metrics(records), duplicate_exposure(records), reading_exposure(records)]
    result = parts[0]
    for part in parts[1:]:
        result = result.crossJoin(F.broadcast(part))
    return result


def gate(measured: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Verdict and the list of failed limits."""
    limits = DEFAULT_THRESHOLDS if thresholds is None else thresholds
    failures = []
    for name, limit in limits.items():
        if not name.endswith(("_min", "_max")):
            raise ValueError(f"threshold names end in _min or _max: {name}")
        value, low = F.col(name[:-4]).cast("double"), name.endswith("_min")
        text = F.concat(F.lit(f"{name[:-4]}="), F.format_string("%.4f", value), F.lit(f" is {'below' if low else 'above'} {limit:.4f}"))
        failures.append(F.when((value < limit) if low else (value > limit), text))
    failed = F.array_compact(F.array(*failures)) if failures else F.array().cast("array<string>")
    enough = (F.col("reviewed") >= 50) & (F.col("source_groups") >= 3)
    status = F.when(~enough, "INSUFFICIENT_DATA").when(F.size(failed) > 0, "FAIL").otherwise("PASS")
    return measured.withColumn("failures", failed).withColumn("status", status)


def validate(records: DataFrame, private_keys: list[str] | None = None) -> DataFrame:
    """Add ``errors``: why a record must not be used. A record without errors has an empty list."""
    def blank(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name)), F.lit("")) == ""

    leaked = sorted(set(private_keys or []) & set(PRIVATE_FIELDS)) or sorted(set(records.columns) & set(PRIVATE_FIELDS))
    checks = [
        (F.lit(bool(leaked)), f"private fields: {', '.join(leaked)}"),
        (F.coalesce(F.col("schema_version"), F.lit(0)) != SCHEMA_VERSION, "unsupported schema version"),
        (blank("sample_id"), "sample_id must be a non-empty string"), (blank("group_id"), "group_id must be a non-empty string"),
        (~F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False)), "decision must be accepted or rejected"),
        (~F.coalesce("rejection_code", F.lit("")).isin(*REJECTION_CODES), "unsupported rejection code"),
        (~F.coalesce(_score().between(1, 99), F.lit(False)), "predicted_score must be between 1 and 99"),
        (F.exists(F.map_keys("features"), lambda name: ~name.isin(*FEATURE_RANGES)), "unknown numeric feature"),
    ]
    for name, (low, high) in FEATURE_RANGES.items():
        value = F.try_element_at("features", F.lit(name))
        checks.append((F.coalesce(F.isnan(value) | ~value.between(low, high), F.lit(False)), f"feature {name} must be between {low} and {high}"))
    if "tag_feedback" in records.columns:
        checks.append((F.exists(F.map_values("tag_feedback"), lambda verdict: ~verdict.isin("correct", "incorrect")), "tag verdicts must be correct or incorrect"))
    listed = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in checks]))
    return records.withColumn("errors", listed)


def is_metadata(record: Column) -> Column:
    return F.coalesce(F.try_variant_get(record, "$.type", "string") == "metadata", F.lit(False))


def with_record_errors(frame: DataFrame, record: str, private: str) -> DataFrame:
    """Add ``errors``: why the JSON value in ``record`` must not be used; empty if it may. ``private`` lists the private field
    names inside it, or is null. Other reasons are given in the order of the checks, each as often as it has a cause."""
    value = F.col(record)

    def field(name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", "variant")

    def kind(name: str) -> Column:
        return F.col(f"_kind_{name}")

    def text(name: str) -> Column:
        return F.when(kind(name) == "STRING", F.try_variant_get(value, f"$.{name}", "string"))

    def number(name: str) -> Column:
        return F.when(kind(name) == "NUMBER", F.try_variant_get(value, f"$.{name}", "double"))

    # types are looked up once per row
    names = ("schema_version", "sample_id", "group_id", "decision", "rejection_code", "predicted_score", "features", "tags", "tag_feedback", "expected_reading")
    pinned = pin(frame, **{f"_kind_{name}": F.coalesce(kind_of(field(name)), F.lit("ABSENT")) for name in names},
                 _features=F.map_entries(F.try_variant_get(value, "$.features", "map<string,variant>")))
    version = (F.when(kind("schema_version") == "NUMBER", F.floor(number("schema_version")) == SCHEMA_VERSION)
               .when(kind("schema_version") == "STRING", F.trim(text("schema_version")).try_cast("int") == SCHEMA_VERSION)
               .when(kind("schema_version") == "BOOLEAN", F.try_variant_get(value, "$.schema_version", "boolean")))
    code, code_kind = text("rejection_code"), kind("rejection_code")
    no_code = (code_kind.isin("ABSENT", "VOID") | (code_kind == "NUMBER") & (number("rejection_code") == 0)
               | (code_kind == "BOOLEAN") & ~F.try_variant_get(value, "$.rejection_code", "boolean")
               | code_kind.isin("ARRAY", "OBJECT") & F.to_json(field("rejection_code")).isin("[]", "{}"))
    checks = [(F.col(private).isNotNull(), F.concat(F.lit("private fields: "), F.col(private))),
              (~F.coalesce(version, F.lit(False)), "unsupported schema version")]
    checks += [(kind(name) == "ABSENT", f"missing {name}") for name in ("sample_id", "group_id", "decision", "features", "predicted_score")]
    checks += [((kind(name) != "ABSENT") & (F.coalesce(F.trim(text(name)), F.lit("")) == ""), f"{name} must be a non-empty string") for name in ("sample_id", "group_id")]
    checks += [
        ((kind("decision") != "ABSENT") & ~F.coalesce(text("decision").isin("accepted", "rejected"), F.lit(False)), "decision must be accepted or rejected"),
        (~no_code & ~F.coalesce(code.isin(*REJECTION_CODES), F.lit(False)), "unsupported rejection code"),
        ((kind("predicted_score") != "ABSENT") & ~F.coalesce(number("predicted_score").between(1, 99), F.lit(False)), "predicted_score must be between 1 and 99"),
        (~kind("features").isin("ABSENT", "OBJECT"), "features must be an object"),
        (~kind("tags").isin("ABSENT", "ARRAY") | F.exists(F.try_variant_get(value, "$.tags", "array<variant>"), lambda tag: F.coalesce(kind_of(tag), F.lit("VOID")) != "STRING"),
         "tags must be a list of strings"),
        (~kind("tag_feedback").isin("ABSENT", "OBJECT") | F.exists(F.map_values(F.try_variant_get(value, "$.tag_feedback", "map<string,variant>")), lambda verdict: ~F.coalesce(
            (kind_of(verdict) == "STRING") & F.try_variant_get(verdict, "$", "string").isin("correct", "incorrect"), F.lit(False))), "tag verdicts must be correct or incorrect"),
        (~kind("expected_reading").isin("ABSENT", "VOID", "BOOLEAN"), "expected_reading must be true, false or null"),
    ]
    listed = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(message) if isinstance(message, str) else message) for bad, message in checks]))
    limits = F.create_map(*[F.lit(part) if isinstance(part, str) else part for name, (low, high) in FEATURE_RANGES.items()
                            for part in (name, F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.lit(f"{low} and {high}").alias("said")))])

    def judge(entry: Column) -> Column:
        name, limit = entry["name"], entry["limit"]
        amount = entry["amount"]
        return (F.when(limit.isNull(), F.concat(F.lit("unknown numeric feature: "), name))
                .when(amount.isNull() | F.isnan(amount) | (F.abs(amount) == float("inf")), F.concat(F.lit("feature "), name, F.lit(" must be a finite number")))
                .when(~amount.between(limit["low"], limit["high"]), F.concat(F.lit("feature "), name, F.lit(" must be between "), limit["said"])))

    read = F.transform("_features", lambda entry: F.struct(
        entry["key"].alias("name"), F.when(kind_of(entry["value"]) == "NUMBER", F.try_variant_get(entry["value"], "$", "double")).alias("amount"),
        F.try_element_at(limits, entry["key"]).alias("limit")))
    about_features = F.array_compact(F.transform(read, judge))
    whole = F.concat(listed, F.coalesce(about_features, F.array().cast("array<string>")))
    errors = F.when(value.isNull(), F.array(F.lit("invalid JSON"))).when(kind_of(value) != "OBJECT", F.array(F.lit("a record must be an object"))).otherwise(whole)
    return pin(pinned, errors=errors).drop("_features", *[f"_kind_{name}" for name in names])


def repeated_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("sample_id").agg(F.count("*").alias("copies")).where("copies > 1")
