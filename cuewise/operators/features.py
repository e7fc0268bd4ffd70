"""Derived segment features as a declared graph; only what a change makes stale is recomputed.

The graph is static metadata: the driver works out which nodes are stale and emits one chain of column expressions for
just those. Users may add nodes of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuewise.functions import scores
from cuewise.functions import vocab as V
from cuewise.functions.tags import enrich_tags
from cuewise.functions.text import half_even
from cuewise.functions.vocab import DEFAULT_VOCABULARY, Vocabulary
from cuewise.schemas import default, with_defaults

# --- fixed values: which fields belong to which source, and which evidence a change makes void
SOURCES: dict[str, tuple[str, ...]] = {
    "source:transcript": ("transcript", "text"),
    "source:timing": ("start", "end", "start_seconds", "end_seconds", "words", "word_timestamps"),
    "source:tags": ("tags", "semantic_tags"),
    "source:chat": ("chat_reaction_score", "chat_joy_score", "chat_message_count", "chat_unique_authors", "chat_surge", "chat_question_match_score", "chat_question_text"),
    "source:audio": ("audio_event_score", "game_reaction_score", "voice_expression_score"),
    "source:vision": ("vision_score", "visual_reading_likelihood", "reading_screen_score"),
    "source:context": ("context_before", "context_after", "boundary_signals"),
    "source:mode": ("analysis_mode",),
}
RANGE_EVIDENCE = (
    "context_before", "context_after", "boundary_signals", "audio_event_score", "game_reaction_score", "voice_expression_score", "vision_score",
    "visual_reading_likelihood", "chat_reaction_score", "chat_joy_score", "chat_message_count", "chat_unique_authors", "chat_surge", "chat_messages",
    "chat_question_match_score", "chat_question_text",
)
TRANSCRIPT_EVIDENCE = ("boundary_signals", "chat_question_match_score", "chat_question_text")

Compute = Callable[[DataFrame, Vocabulary], DataFrame]


@dataclass(frozen=True)
class Feature:
    name: str
    needs: tuple[str, ...]
    gives: tuple[str, ...]
    compute: Compute


def _speech(frame: DataFrame, vocab: Vocabulary) -> DataFrame:
    measured = frame.withColumns(scores.reading_parts(F.col("start_seconds"), F.col("end_seconds"), F.col("tags"), vocab)).withColumn("_reading", scores.base_reading())
    quality = scores.base_quality(F.col("_reading"))
    return measured.withColumns({
        "_base_score": quality["score"], "_base_signals": quality["signals"], "_text_reading": F.bround("_reading", 3),
    }).drop("_reading", "_n", "_length", "_pauses", "_fillers", "_reading_words", "_repeats", "_ui_cues", "_document_cues", "_unpunctuated", "_loud", "_matched")


def speech_quality(frame: DataFrame, vocab: Vocabulary) -> DataFrame:
    return _speech(frame, vocab).withColumn("text_reading_likelihood", F.col("_text_reading"))


def is_extended() -> Column:
    return F.lower(F.trim(F.coalesce("analysis_mode", F.lit("default")))) == "extended"


def extended_analysis(frame: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Extra checks, filled only for recordings analysed in extended mode."""
    extended = is_extended()
    counted = frame.withColumns({name: F.when(extended, part) for name, part in scores.extended_reading_parts(vocab).items()})
    shape, opening, punch = scores.story_shape(vocab), scores.opening_clarity(vocab), scores.punchline(vocab)
    staged = counted.withColumns({name: F.when(extended, part) for name, part in {
        "_hook": shape["hook"], "_ending": shape["ending"], "_open": opening["score"], "_open_signals": opening["signals"],
        "_punch": punch["score"], "_punch_signals": punch["signals"], "_whole": scores.completeness(F.col("boundary_signals")),
        "_extended_reading": scores.extended_reading(F.col("text_reading_likelihood"))}.items()})
    mixed = F.greatest(F.lit(1), F.least(F.lit(99), half_even(F.col("_whole") * 0.76 + F.col("_hook") * 0.08 + F.col("_ending") * 0.16)))
    signals = F.array_distinct(F.concat(scores.story_signals(F.col("_hook"), F.col("_ending")), "_open_signals", "_punch_signals"))
    values = {
        "extended_reading_likelihood": F.col("_extended_reading"), "extended_hook_score": F.col("_hook"), "extended_ending_score": F.col("_ending"),
        "opening_clarity_score": F.col("_open"), "extended_punchline_score": F.col("_punch"), "extended_completeness_score": mixed,
        "extended_story_signals": signals,
    }
    blank = {name: F.lit(-1) for name in values} | {"extended_reading_likelihood": F.lit(0.0), "extended_story_signals": F.array().cast("array<string>")}
    return staged.withColumns({name: F.when(extended, value).otherwise(blank[name]) for name, value in values.items()}).drop(
        "_formal", "_sentences", "_hook", "_ending", "_open", "_open_signals", "_punch", "_punch_signals", "_whole", "_extended_reading")


def effective_reading(frame: DataFrame, vocab: Vocabulary) -> DataFrame:
    screen = F.col("reading_screen_score") if "reading_screen_score" in frame.columns else F.lit(0.0)
    return frame.withColumns(scores.effective_reading(F.col("text_reading_likelihood"), F.col("visual_reading_likelihood"), screen, F.col("extended_reading_likelihood")))


def _capped(value):
    return F.when(F.col("reading_likelihood") >= V.READING_CUT, F.least(value, F.lit(35))).otherwise(value)


def logical_sense(frame: DataFrame, vocab: Vocabulary) -> DataFrame:
    return frame.withColumn("logical_sense_score", _capped(F.col("_logical")))


def context(frame: DataFrame, vocab: Vocabulary) -> DataFrame:
    parts = scores.context_scores()
    return frame.withColumns({"context_score": _capped(parts["context_score"]), "context_signals": parts["context_signals"],
                              "self_contained_score": _capped(parts["self_contained_score"])})


def moment_reaction(frame: DataFrame, vocab: Vocabulary) -> DataFrame:
    parts = scores.moment_reaction(F.col("game_reaction_score"), F.col("chat_reaction_score"), F.col("chat_joy_score"))
    return frame.withColumns({"moment_reaction_score": parts["score"], "moment_reaction_stage": parts["stage"]})


def tag_enrichment(frame: DataFrame, vocab: Vocabulary) -> DataFrame:
    stable = F.array_except("tags", F.array(F.lit(V.GAME_TAG), F.lit(V.QUESTION_TAG), F.lit(V.ANSWER_TAG)))
    enriched = enrich_tags(stable, F.col("logical_sense_score"), F.col("reading_likelihood"), F.col("voice_expression_score"),
                           F.col("context_score"), F.col("self_contained_score"))
    proven = F.array_compact(F.array(
        F.when(F.col("game_reaction_score") >= V.GAME_MIN_SCORE, F.lit(V.GAME_TAG)),
        F.when(F.col("chat_question_match_score") >= V.QUESTION_MATCH_CUT, F.lit(V.QUESTION_TAG)),
        F.when(F.col("chat_question_match_score") >= V.QUESTION_MATCH_CUT, F.lit(V.ANSWER_TAG))))
    return frame.withColumn("tags", F.array_distinct(F.concat(enriched, proven)))


def _row() -> dict:
    c = F.col
    return {
        "game": c("game_reaction_score"), "voice": c("voice_expression_score"), "tags": c("tags"), "context": c("context_score"),
        "hook": c("extended_hook_score"), "ending": c("extended_ending_score"), "complete": c("extended_completeness_score"),
        "reading": c("reading_likelihood"), "text_reading": c("text_reading_likelihood"), "context_signals": c("context_signals"),
        "vision": c("vision_score"), "boundary_signals": c("boundary_signals"), "story_signals": c("extended_story_signals"),
        "duration": F.greatest(F.lit(0.0), c("end_seconds") - c("start_seconds")), "logical": c("logical_sense_score"),
        "self_contained": c("self_contained_score"), "moment": c("moment_reaction_score"), "opening": c("opening_clarity_score"),
        "punchline": c("extended_punchline_score"), "chat": c("chat_reaction_score"), "joy": c("chat_joy_score"), "quality": c("quality_score"),
    }


def quality(frame: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Quality from the base of this run; a run that did not rebuild the base measures it here, with the current tags."""
    based = frame if "_base_score" in frame.columns else _speech(frame, vocab)
    built = scores.assembled_quality(F.col("_base_score"), F.col("_base_signals"), _row())
    return based.withColumns({"quality_score": built["score"], "quality_signals": built["signals"]}).drop("_base_score", "_base_signals", "_text_reading")


def short_potential(frame: DataFrame, vocab: Vocabulary) -> DataFrame:
    built = scores.short_potential(F.col("transcript"), F.col("start_seconds"), F.col("end_seconds"), _row(), F.col("_count"))
    return frame.withColumns({"short_potential_score": built["score"], "short_potential_signals": built["signals"]})


# --- fixed values: the graph, that is which node needs and gives what
FEATURES: tuple[Feature, ...] = (
    Feature("speech_quality", ("source:transcript", "source:timing", "source:tags"), ("text_reading_likelihood",), speech_quality),
    Feature("extended_analysis", ("source:transcript", "source:timing", "source:context", "source:mode", "speech_quality"),
            ("extended_reading_likelihood", "extended_hook_score", "extended_ending_score", "opening_clarity_score", "extended_punchline_score",
             "extended_story_signals", "extended_completeness_score"), extended_analysis),
    Feature("effective_reading", ("source:vision", "speech_quality", "extended_analysis"), ("visual_reading_likelihood", "reading_likelihood"), effective_reading),
    Feature("logical_sense", ("source:transcript", "effective_reading"), ("logical_sense_score",), logical_sense),
    Feature("context", ("source:transcript", "source:timing", "source:context", "effective_reading"),
            ("context_score", "context_signals", "self_contained_score"), context),
    Feature("moment_reaction", ("source:audio", "source:chat"), ("moment_reaction_score", "moment_reaction_stage"), moment_reaction),
    Feature("tag_enrichment", ("source:tags", "source:audio", "source:chat", "source:vision", "effective_reading", "logical_sense", "context", "moment_reaction"),
            ("tags",), tag_enrichment),
    Feature("quality", ("source:transcript", "source:timing", "source:audio", "source:vision", "source:context", "speech_quality", "effective_reading",
                        "extended_analysis", "logical_sense", "context", "moment_reaction", "tag_enrichment"), ("quality_score", "quality_signals"), quality),
    Feature("short_potential", ("source:transcript", "source:timing", "source:audio", "source:chat", "effective_reading", "extended_analysis", "logical_sense",
                                "context", "moment_reaction", "tag_enrichment", "quality"), ("short_potential_score", "short_potential_signals"), short_potential),
)


def in_order(features: Sequence[Feature] = FEATURES) -> list[Feature]:
    """Features so that every one follows what it needs; refuses double outputs, unknown needs and cycles."""
    givers: dict[str, str] = {}
    for feature in features:
        for output in feature.gives:
            if not output.strip() or output in givers:
                raise ValueError(f"output {output!r} of {feature.name} is empty or given twice")
            givers[output] = feature.name
    names = {feature.name for feature in features}
    if len(names) != len(features):
        raise ValueError("feature names must be unique")
    for feature in features:
        unknown = set(feature.needs) - names - set(SOURCES)
        if unknown:
            raise ValueError(f"{feature.name} needs unknown inputs: {sorted(unknown)}")
    done: list[Feature] = []
    while len(done) < len(features):
        ready = [f for f in features if f not in done and not (set(f.needs) & names) - {d.name for d in done}]
        if not ready:
            raise ValueError("features need each other in a cycle")
        done += ready
    return done


def void_evidence(changed: set[str]) -> list[str]:
    """Evidence columns that a change makes void, except those the caller supplies fresh."""
    fresh = set(changed).union(*[fields for source, fields in SOURCES.items() if source in changed])
    def touched(source: str) -> bool:
        return source in changed or bool(set(SOURCES[source]) & changed)
    void = (TRANSCRIPT_EVIDENCE if touched("source:transcript") else ()) + (RANGE_EVIDENCE if touched("source:timing") else ())
    return [name for name in dict.fromkeys(void) if name not in fresh]


def stale_features(changed: Iterable[str] | None, features: Sequence[Feature] = FEATURES) -> list[Feature]:
    """Features to recompute after some fields, sources or nodes changed; None means all."""
    ordered = in_order(features)
    if changed is None:
        return ordered
    fields = set(changed)
    dirty = {source for source, names in SOURCES.items() if source in fields or set(names) & fields}
    stale: list[Feature] = []
    for feature in ordered:
        if feature.name in fields or set(feature.gives) & fields or set(feature.needs) & dirty:
            stale.append(feature)
            dirty.add(feature.name)
    return stale


def recompute(segments: DataFrame, changed: Iterable[str] | None = None, vocab: Vocabulary = DEFAULT_VOCABULARY,
              features: Sequence[Feature] = FEATURES) -> DataFrame:
    """Segments with their stale features rebuilt; other columns pass through unchanged."""
    fields = None if changed is None else set(changed)
    void = [] if fields is None else void_evidence(fields)
    has_context = bool({"context_before", "context_after"} & set(segments.columns))
    frame = with_defaults(segments, [name for name in _NEEDED if name not in void]).withColumns({name: default(name) for name in void})
    todo = stale_features(None if fields is None else fields | set(void), features)
    if not has_context and not {"context_before", "context_after"} & set(void):
        todo = [feature for feature in todo if feature.name != "context"]
    if not todo:
        return frame
    if "analysis_mode" not in frame.columns:
        frame = frame.withColumn("analysis_mode", F.lit("default"))
    frame = frame.withColumn("tags", F.array_distinct(F.filter("tags", lambda tag: F.trim(tag) != "")))
    frame = scores.prepare(frame, vocab, "transcript", "word_timestamps", "context_before", "context_after", is_extended())
    for feature in todo:
        frame = feature.compute(frame, vocab)
    return scores.drop_prepared(frame).drop("_base_score", "_base_signals", "_text_reading")


_NEEDED = (
    "transcript", "start_seconds", "end_seconds", "tags", "word_timestamps", "context_before", "context_after", "boundary_signals", "audio_event_score",
    "game_reaction_score", "voice_expression_score", "vision_score", "visual_reading_likelihood", "text_reading_likelihood", "extended_reading_likelihood",
    "extended_hook_score", "extended_ending_score", "opening_clarity_score", "extended_punchline_score", "extended_story_signals",
    "extended_completeness_score", "reading_likelihood", "logical_sense_score", "context_score", "context_signals", "self_contained_score",
    "moment_reaction_score", "moment_reaction_stage", "chat_reaction_score", "chat_joy_score", "chat_question_match_score", "quality_score",
    "quality_signals", "short_potential_score",
)

