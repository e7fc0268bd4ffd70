"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece in the text; dynamic programming carries, for every position, the
best score and the number of pieces on that path. Tie rule of the tokenizer: starts are taken from left to right and a
later one must be strictly better, so among equal paths the one with the longest last piece stays. A character without a
piece of its own costs the least score minus ten and counts as its UTF-8 bytes where the vocabulary falls back to bytes.

The vocabulary's pieces hold the space mark at their beginning only, so a text falls into units that are searched on their own, each
distinct unit once per task (in a memory of bounded size). If a vocabulary has other pieces, whole texts are searched.
Scores are added in double precision.

Defined cases: a null or empty text has no tokens; repeated rows each give a row; texts of any length take linear time.
"""

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
PENALTY, REMEMBERED = 10.0, 200_000


def load_vocabulary(path: str = MODEL) -> dict:
    """Pieces with scores, the score of an unknown character, and how many tokens it gives."""
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(processor.get_piece_size())
    plain = [k for k in ids if not (processor.is_control(k) or processor.is_unknown(k) or processor.is_byte(k) or processor.is_unused(k))]
    pieces = {processor.id_to_piece(k): (processor.get_score(k), k) for k in plain}
    by_bytes = {int(processor.id_to_piece(k)[1:-1], 16): k for k in ids if processor.is_byte(k)}
    return {
        "pieces": pieces, "unknown": min(s for s, _ in pieces.values()) - PENALTY, "bytes": by_bytes, "unk_id": processor.unk_id(),
        "units": not any(SPACE in p.lstrip(SPACE) for p in pieces),
    }


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Counter:
    """Counts the tokens of texts; one per task."""

    def __init__(self, vocabulary: dict):
        self.automaton = ahocorasick.Automaton()
        for piece, (score, _) in vocabulary["pieces"].items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown, self.fallback, self.units = vocabulary["unknown"], bool(vocabulary["bytes"]), vocabulary["units"]
        self.memory: dict[str, int] = {}

    def search(self, unit: str) -> int:
        size = len(unit)
        best, count = [0.0] + [None] * size, [0] * (size + 1)
        ending: dict[int, list] = {}
        for last, found in self.automaton.iter(unit):
            ending.setdefault(last + 1, []).append(found)
        for end in range(1, size + 1):
            top = tokens = None
            single = False
            # longest pieces first: starts from left to right
            for length, score in sorted(ending.get(end, ()), reverse=True):
                single |= length == 1
                value = best[end - length] + score
                if top is None or value > top:
                    top, tokens = value, count[end - length] + 1
            if not single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    top, tokens = value, count[end - 1] + (len(unit[end - 1].encode("utf-8", "surrogatepass")) if self.fallback else 1)
            best[end], count[end] = top, tokens
        return count[size]

    def tokens(self, text: str | None) -> int:
        text = normalise(text or "")
        total = 0
        memory = self.memory
        for unit in UNIT.findall(text) if self.units else ([text] if text else []):
            known = memory.get(unit)
            if known is None:
                known = self.search(unit)
                if len(memory) >= REMEMBERED:
                    memory.clear()
                if len(unit) <= 64:
                    memory[unit] = known
            total += known
        return total


def with_counts(docs: DataFrame, keep: list, text_column: str = "text", path: str = MODEL) -> DataFrame:
    """``keep`` columns and ``n_tokens``."""
    vocabulary = load_vocabulary(path)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(vocabulary)
        for texts in batches:
            yield pd.Series([counter.tokens(t) for t in texts], dtype="int64")

    return docs.select(*keep, count(F.col(text_column)).alias("n_tokens"))
