"""Tag vocabulary as Column expressions: canonical names, categories, lexical tags, enrichment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewise.functions import vocab as V
from cuewise.functions.text import blank_null, contains_any, listed, squish, white_tokens


def _string_map(pairs: dict[str, str]) -> Column:
    entries = [F.lit(item) for pair in pairs.items() for item in pair]
    return F.create_map(*entries)


def _canonical_names() -> dict[str, str]:
    names = [*V.EMOTION_TAGS, *V.HUMOUR_TAGS, *V.SPEECH_FORM_TAGS, *V.DIAGNOSTIC_TAGS, V.GAME_TAG, V.QUESTION_TAG, V.ANSWER_TAG]
    return {name.lower(): name for name in names} | V.TAG_ALIASES


def _categories() -> dict[str, str]:
    groups = {tag: "emotion" for tag in V.EMOTION_TAGS}
    groups |= {tag: "humour" for tag in V.HUMOUR_TAGS}
    groups |= {tag: "speech_form" for tag in V.SPEECH_FORM_TAGS}
    return groups | {
        V.QUESTION_TAG: "viewer_question", V.ANSWER_TAG: "viewer_question_answer", V.GAME_TAG: "game_reaction",
    }


def _named(clean: Column) -> Column:
    """Canonical label of a tag whose white space is already collapsed."""
    key = F.lower(clean)
    return F.when((key != "") & ~key.isin(*V.REMOVED_TAGS), F.coalesce(_string_map(_canonical_names())[key], clean))


def canonical_tag(value: Column) -> Column:
    """Canonical label, or null for a blank or withdrawn one; unknown labels are kept."""
    return _named(squish(value))


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def canonical_tags(values: Column) -> Column:
    """Canonical labels in first-seen order; later repeats that differ only in letter case are dropped."""
    named = F.transform(F.transform(F.coalesce(values, _no_texts()), squish), _named)

    def keep(kept: Column, tag: Column) -> Column:
        repeated = F.exists(kept, lambda earlier: F.lower(earlier) == F.lower(tag))
        return F.when(tag.isNull() | repeated, kept).otherwise(F.array_append(kept, tag))

    return F.aggregate(named, _no_texts(), keep)


def _category(name: Column) -> Column:
    lowered = F.lower(name)
    result = F.when(name.isNull(), F.lit("invalid"))
    for prefix in V.DIAGNOSTIC_PREFIXES:
        result = result.when(lowered.startswith(prefix), F.lit("diagnostic:" + prefix.rstrip(": ")))
    return F.coalesce(_string_map(_categories())[name], result.otherwise(F.concat(F.lit("tag:"), lowered)))


def tag_category(tag: Column) -> Column:
    """Category of a tag after canonical naming."""
    return F.get(F.transform(F.array(canonical_tag(tag)), _category), F.lit(0))


def first_per_category(named: Column, limit: int = 6) -> Column:
    """First tag of every category of an already canonical list, at most ``limit``."""
    pairs = F.transform(named, lambda tag: F.struct(_category(tag).alias("category"), tag.alias("tag")))
    start = F.array().cast("array<struct<category:string,tag:string>>")

    def keep(kept: Column, pair: Column) -> Column:
        return F.when(F.exists(kept, lambda earlier: earlier["category"] == pair["category"]), kept).otherwise(F.array_append(kept, pair))

    return F.aggregate(pairs, start, keep, lambda kept: F.slice(F.transform(kept, lambda pair: pair["tag"]), 1, limit))


def one_per_category(values: Column, limit: int = 6) -> Column:
    """First tag of every category after canonical naming, at most ``limit``."""
    return first_per_category(canonical_tags(values), limit)


def marker_tags(text: Column, markers: dict[str, tuple]) -> Column:
    lowered = F.lower(blank_null(text))
    return listed(*[(contains_any(lowered, stems), tag) for tag, stems in markers.items()])


def lexical_tags(text: Column, semantic: Column | None = None, limit: int = 6,
                 detailed: dict = V.DETAILED_MARKERS, broad: dict = V.BROAD_MARKERS) -> Column:
    """Detailed, then broad, then semantic tags; one per category."""
    parts = [marker_tags(text, detailed), marker_tags(text, broad)]
    if semantic is not None:
        parts.append(F.coalesce(semantic, F.array().cast("array<string>")))
    return one_per_category(F.array_distinct(F.concat(*parts)), limit)


def enrich_tags(tags: Column, logical: Column, reading: Column, voice: Column, context: Column, self_contained: Column) -> Column:
    """Replace diagnostic tags by those that current evidence supports."""
    kept = F.filter(canonical_tags(tags), lambda tag: ~tag.rlike("^(?:" + "|".join(V.DIAGNOSTIC_PREFIXES) + ")"))
    structure = (
        F.when(logical.between(0, 35), F.lit("struktura: urwana wypowiedź"))
        .when(context.between(0, 38), F.lit("struktura: wymaga kontekstu"))
        .when(self_contained.between(0, 35), F.lit("struktura: zależny od kontekstu"))
        .when(self_contained >= 75, F.lit("struktura: samowystarczalny"))
        .when(logical >= 68, F.lit("struktura: samodzielna myśl"))
    )
    voiced = F.when(voice >= 7, F.lit("wypowiedź: ekspresyjna")).when(voice <= -7, F.lit("wypowiedź: jednostajna"))
    evidence = F.array_compact(F.array(F.when(reading >= V.READING_CUT, F.lit(V.READING_TAG)), structure, voiced))
    return F.array_distinct(F.concat(first_per_category(kept), evidence))


def variety_tags(tags: Column) -> Column:
    """Tags that count when a list of picks should stay varied."""
    def counts(tag: Column) -> Column:
        match = tag.isin(*V.VARIETY_TAGS)
        for prefix in V.VARIETY_PREFIXES:
            match = match | tag.startswith(prefix)
        return match
    return F.filter(canonical_tags(tags), counts)


def _letters_only(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-ząćęłńóśźż]", "")


def is_profane(token: Column, stems=V.PROFANITY_STEMS) -> Column:
    letters = _letters_only(token)
    return (F.length(letters) >= 3) & letters.rlike("|".join(stems))


def profanity_count(words: Column, transcript: Column, stems=V.PROFANITY_STEMS) -> Column:
    """Profane words, counted on timed words if there are any, else on the transcript."""
    spoken = F.when(F.size(F.coalesce(words, F.array().cast("array<string>"))) > 0, words).otherwise(white_tokens(transcript))
    return F.size(F.filter(spoken, lambda token: is_profane(token, stems)))


def mask_profanity(token: Column, stems=V.PROFANITY_STEMS) -> Column:
    return F.when(is_profane(token, stems), F.regexp_replace(token, r"[\p{L}\p{N}]", "*")).otherwise(token)

