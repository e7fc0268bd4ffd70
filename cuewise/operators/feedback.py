"""Reviews, training snapshots, tag verdicts and keyed table updates.

Updates are written as whole-table rewrites of joins and aggregates, so a batch of any size is one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewise.functions.tags import canonical_tag, canonical_tags
from cuewise.functions.text import squish

RATINGS = ("accepted", "rejected", "unrated")
VERDICTS = ("correct", "incorrect", "unmarked")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest row per key of the table and the changes; a change wins a tie, and a late one does not replace a newer row."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    columns = [name for name in table.columns if name not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(version, "_new")).alias("_row"))
    return newest.select(*keys, "_row.*")


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add rows whose key is new; among several new rows of one key the first wins."""
    return table.unionByName(new_rows(table, rows.select(*table.columns), keys, order).select(*table.columns))


def new_rows(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key that the table does not have."""
    columns = [name for name in rows.columns if name not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("_row")).select(*keys, "_row.*")
    return first.join(table.select(*keys), keys, "left_anti")


def delete_keys(table: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(removed.select(*keys).distinct(), keys, "left_anti")


def latest_events(events: DataFrame, keys: list[str]) -> DataFrame:
    columns = [name for name in events.columns if name not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct("updated_at", "event_id")).alias("_row")).select(*keys, "_row.*")


def review_changes(events: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What review events change: the newest review of every segment, and per segment and profile the newest training snapshot,
    where ``deleted`` tells that it is to go.

    ``current`` holds the current revision of every segment (revision_id, revision_number, embedding, features). An
    unrated decision, or one on a revision without a vector, removes the snapshot of that profile.
    """
    rating = F.lower(F.trim("rating"))
    clean = events.withColumns({"rating": rating, "profile": F.lower(F.trim("profile"))}).where(F.col("rating").isin(*RATINGS)).withColumn(
        "review_reason", F.when(F.col("rating") == "rejected", squish(F.col("review_reason"))).otherwise(""))
    # only the newest events meet the revisions, so that no vector is carried through the grouping; an event of no segment leaves there
    newest = latest_events(clean.select("segment_id", "rating", "review_reason", "updated_at", "event_id"), ["segment_id"])
    reviews = newest.join(current.select("segment_id", F.col("revision_id").alias("reviewed_revision_id")), "segment_id")
    by_profile = latest_events(clean, ["segment_id", "profile"]).join(current, "segment_id")
    usable = (F.col("rating") != "unrated") & F.col("embedding").isNotNull()
    return reviews, by_profile.withColumn("deleted", ~usable).withColumnsRenamed({"rating": "decision", "revision_number": "reviewed_revision_number"})


def apply_reviews(reviews: DataFrame, snapshots: DataFrame, events: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply review events: the review binds to the current revision, the profile's training snapshot follows it.

    An event that is older than the row it meets changes neither table. Rows that went earlier leave no trace in plain
    tables; ``DeltaTable`` keeps their versions.
    """
    reviewed, changed = review_changes(events, current)
    merged = upsert(reviews, reviewed.select(*reviews.columns), ["segment_id"], "updated_at")
    keys = ["segment_id", "profile"]
    known = snapshots.select(*keys, F.col("updated_at").alias("_known"))
    newer = changed.join(known, keys, "left").where(F.col("_known").isNull() | (F.col("updated_at") >= F.col("_known")))
    kept = delete_keys(snapshots, newer, keys)
    return merged, kept.unionByName(newer.where("NOT deleted").select(*snapshots.columns))


def refresh_snapshots(snapshots: DataFrame, reviews: DataFrame, current: DataFrame) -> DataFrame:
    """New vector and features only where the decision was made on the current revision."""
    live = reviews.where(F.col("rating").isin("accepted", "rejected")).join(
        current.where(F.col("embedding").isNotNull()).select("segment_id", F.col("revision_id").alias("reviewed_revision_id"), F.col("revision_number").alias("_number"),
                                                            F.col("embedding").alias("_embedding"), F.col("features").alias("_features")), ["segment_id", "reviewed_revision_id"])
    joined = snapshots.join(live.select("segment_id", "_number", "_embedding", "_features"), "segment_id", "left")
    fits = F.col("_number").isNotNull() & (F.col("_number") == F.col("reviewed_revision_number"))
    return joined.withColumns({"embedding": F.when(fits, F.col("_embedding")).otherwise(F.col("embedding")),
                               "features": F.when(fits, F.col("_features")).otherwise(F.col("features"))}).drop("_number", "_embedding", "_features")


def apply_tag_verdicts(verdicts: DataFrame, events: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply verdict events on assigned tags (aliases merged, ``unmarked`` removes); other events come back as rejected."""
    named = events.withColumns({"tag": canonical_tag(F.col("tag")), "verdict": F.lower(F.trim("verdict"))})
    assigned = current.select("segment_id", F.col("revision_id").alias("reviewed_revision_id"), F.explode(canonical_tags(F.col("tags"))).alias("tag"))
    valid = named.where(F.col("verdict").isin(*VERDICTS)).join(assigned, ["segment_id", "tag"])
    rejected = named.join(assigned.select("segment_id", "tag"), ["segment_id", "tag"], "left_anti")
    keys = ["segment_id", "reviewed_revision_id", "tag"]
    last = latest_events(valid.select(*keys, "verdict", "updated_at", "event_id"), keys)
    kept = delete_keys(verdicts, last, keys)
    return kept.unionByName(last.where("verdict <> 'unmarked'").select(*verdicts.columns)), rejected


def add_examples(examples: DataFrame, requests: DataFrame, segments: DataFrame) -> DataFrame:
    """Freeze revision, interval, text and vector of requested segments; an existing pair stays as it is.

    Requests are reduced to new pairs before they meet texts and vectors, so that a text is copied once per new pair."""
    wanted = segments.join(requests.select(F.col("segment_id").alias("id")).distinct(), "id", "left_semi")
    frozen = wanted.select(
        F.col("id").alias("segment_id"), F.coalesce("revision_number", F.lit(1)).alias("revision_number"), F.col("video_id").alias("snapshot_video_id"),
        F.col("start_seconds").alias("snapshot_start_seconds"), F.col("end_seconds").alias("snapshot_end_seconds"),
        F.col("transcript").alias("snapshot_transcript"), F.col("embedding").alias("snapshot_embedding")).dropDuplicates(["segment_id"])
    asked = requests.select("segment_id", *[name for name in examples.columns if name not in frozen.columns])
    added = new_rows(examples, asked, ["collection_id", "segment_id"], "created_at").join(frozen, "segment_id")
    return examples.unionByName(added.select(*examples.columns))


def collection_vectors(examples: DataFrame, segments: DataFrame, external: DataFrame) -> DataFrame:
    """Vectors and texts of a collection: frozen, else live, plus the external ones."""
    live = segments.select(F.col("id").alias("segment_id"), F.col("embedding").alias("_live"), F.col("transcript").alias("_text"))
    own = examples.join(live, "segment_id").select(
        "collection_id", F.coalesce(F.nullif("snapshot_transcript", F.lit("")), "_text").alias("transcript"), F.coalesce("snapshot_embedding", "_live").alias("embedding"))
    return own.where(F.col("embedding").isNotNull()).unionByName(external.select("collection_id", "transcript", "embedding"))
