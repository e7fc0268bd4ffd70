"""Text helpers: every function takes and returns Column expressions that stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_even(value: Column) -> Column:
    """Round half to even, to an integer."""
    return F.bround(value.cast("double")).cast("int")


def score_1_99(value: Column) -> Column:
    return clip(half_even(value), 1, 99)


def points(condition: Column, value) -> Column:
    """``value`` where the condition holds, else 0 (null counts as false)."""
    return F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(F.lit(0))


def known(value: Column, neutral: float = 50.0) -> Column:
    """A measured score; null and negative sentinels become the neutral value, a real 0 stays 0."""
    number = value.cast("double")
    return F.when(number >= 0, number).otherwise(F.lit(float(neutral)))


def blank_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def squish(value: Column) -> Column:
    """Collapse every run of Unicode white space to one blank and trim."""
    return F.trim(F.regexp_replace(blank_null(value), r"(?U)\s+", " "))


def tokens(value: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(blank_null(value)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def white_tokens(value: Column) -> Column:
    """Pieces between runs of white space, without empties."""
    return F.filter(F.split(squish(value), " "), lambda token: token != "")


def found(value: Column, pattern: str) -> Column:
    """Case-insensitive, Unicode-aware regex search."""
    return F.coalesce(value.rlike(f"(?iU){pattern}"), F.lit(False))


def any_phrase(phrases) -> str:
    return r"\b(?:" + "|".join(phrases) + r")\b"


def starts_with_word(words) -> str:
    return "^(?:" + "|".join(words) + r")\b"


def contains_any(value: Column, needles) -> Column:
    result = F.lit(False)
    for needle in needles:
        result = result | value.contains(needle)
    return result


def count_in(items: Column, words) -> Column:
    """How many array elements belong to a fixed word list."""
    wanted = list(words)
    return F.size(F.filter(items, lambda item: item.isin(wanted)))


def count_prefixed(items: Column, stems) -> Column:
    """How many array elements start with one of the stems."""
    pattern = "^(?:" + "|".join(stems) + ")"
    return F.size(F.filter(items, lambda item: item.rlike(pattern)))


def has_any(items: Column, words) -> Column:
    return F.arrays_overlap(items, F.array(*[F.lit(word) for word in words]))


def listed(*pairs) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in pairs]))


def _latin_folds() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition without marks, for Latin and full-width letters, derived from Unicode data."""
    source, target, longer = [], [], {}
    ranges = list(range(0xA0, 0x250)) + list(range(0x1E00, 0x1F00)) + list(range(0xFF01, 0xFF5F))
    for code in ranges:
        letter = chr(code)
        plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c))
        if plain != letter and len(plain) == 1 and plain.isascii():
            source.append(letter)
            target.append(plain)
        elif plain != letter and plain.isascii() and plain.isalpha():
            longer[letter] = plain
    return "".join(source), "".join(target), longer


_FOLD_FROM, _FOLD_TO, _FOLD_LONGER = _latin_folds()
_STROKED = {"ł": "l", "Ł": "L"}


def ascii_fold(value: Column, stroked_l: bool = True) -> Column:
    """Accents removed, the stroked l mapped, every other non-ASCII character dropped."""
    extra_from = "".join(_STROKED) if stroked_l else ""
    extra_to = "".join(_STROKED.values()) if stroked_l else ""
    folded = F.translate(blank_null(value), _FOLD_FROM + extra_from, _FOLD_TO + extra_to)
    return F.regexp_replace(folded, r"[^\x00-\x7F]", "")


def match_form(value: Column) -> Column:
    """Comparison form of a transcript: accents removed, lower case, other characters become blanks."""
    folded = F.lower(F.translate(blank_null(value), _FOLD_FROM, _FOLD_TO))
    without_marks = F.regexp_replace(F.replace(folded, F.lit("ß"), F.lit("ss")), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(without_marks, r"[^\p{L}\p{N}]+", " "))


def token_jaccard(left: Column, right: Column) -> Column:
    """Shared over all distinct words of two comparison forms; two empty texts agree fully."""
    a = F.filter(F.array_distinct(F.split(left, " ")), lambda token: token != "")
    b = F.filter(F.array_distinct(F.split(right, " ")), lambda token: token != "")
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    )


def keywords(value: Column, minimum: int = 6, limit: int = 12) -> Column:
    """First long words, stripped of outer punctuation."""
    stripped = F.transform(white_tokens(value), lambda token: F.regexp_replace(token, r"^[.,!?;:]+|[.,!?;:]+$", ""))
    return F.slice(F.filter(stripped, lambda token: F.length(token) >= minimum), 1, limit)


def redact(value: Column) -> Column:
    """Remove addresses and file paths from log text."""
    value = F.regexp_replace(value, r"(?iU)https?://\S+", "[url]")
    value = F.regexp_replace(value, r"(?i)(?:file:/+)?[A-Z]:[\\/][^\r\n\"']+", "[path]")
    return F.regexp_replace(value, r"\\\\[^\\/\r\n\"']+[\\/][^\r\n\"']+", "[path]")
