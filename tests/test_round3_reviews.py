"""Newest reviews are picked before they meet the revisions and their vectors."""

from cuewise.operators import feedback


def test_vectors_are_not_carried_through_the_grouping(spark):
    events = spark.createDataFrame(
        [(1, 1, "Accepted", "a", "", 1), (2, 1, "rejected", "a", "too  long", 2), (3, 1, "unrated", "b", "", 3), (4, 2, "accepted", "a", "", 4), (5, 9, "accepted", "a", "", 5), (6, 1, "odd", "a", "", 6)],
        "event_id long, segment_id long, rating string, profile string, review_reason string, updated_at long")
    current = spark.createDataFrame([(1, "1-1", 1, [0.5, 1.0], 1.0), (2, "2-1", 1, None, 1.0), (3, "3-1", 1, [1.0], 1.0)],
                                    "segment_id long, revision_id string, revision_number int, embedding array<double>, features double")
    reviews, changed = feedback.review_changes(events, current)
    shown = ("segment_id", "rating", "review_reason", "reviewed_revision_id", "updated_at", "event_id")
    assert sorted(map(tuple, reviews.select(*shown).collect())) == [(1, "unrated", "", "1-1", 3, 3), (2, "accepted", "", "2-1", 4, 4)]
    found = changed.select("segment_id", "profile", "decision", "review_reason", "embedding", "reviewed_revision_number", "updated_at", "deleted").collect()
    assert sorted(map(tuple, found)) == [(1, "a", "rejected", "too long", [0.5, 1.0], 1, 2, False), (1, "b", "unrated", "", [0.5, 1.0], 1, 3, True), (2, "a", "accepted", "", None, 1, 4, True)]
    plan = changed._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "embedding" in line]
