"""Secret scan: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are all runs of ``[A-Za-z0-9+/_.=-]``, of any length and make; each may be tagged B (a secret begins), I (it goes on) or O.
The best tag path of a whole text is found exactly, by Viterbi over the runs of neighbouring tokens. Tokens that are O on every
best path, whatever their neighbours are, are settled beforehand and cut a run into short ones (``surely_outside``).
Features: shape, length, shares of digits and vowels, changes of character class, the characters around, key words before, near and
inside, the neighbours' shapes, and those of the file (how many long tokens with a digit it has,
whether a key word occurs in it). The field is trained by gradient descent on the exact log-likelihood, with the
fixed patterns' matches in a bounded sample of texts as labels (at most ``SAMPLE`` texts, ``WINDOWS`` stretches of tokens);
patterns themselves are no feature.

Spans of the patterns always stay. Of a span of the field, the parts outside them are reported.

Defined cases: a null text counts as empty and has no spans; every row gives one row, repeated ones too; a table without
any labelled token gives a field that tags nothing. Texts of any length are scanned whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 4000
WIDTH, WINDOWS = 16, 16000  # training alone: tokens of a stretch, and stretches
SLICE = 1 << 17  # characters looked at together
BUCKETS = 1 << 12
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PART = re.compile(r"[A-Za-z0-9+/_.=-]+")
ANY_PATTERN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
KEYWORD = re.compile(rb"passw|secret|token|api|key|auth|bearer|credential")
IS_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def _is(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


DIGITS, UPPER = b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
IS_TOKEN, IS_LETTER, IS_VOWEL = _is(DIGITS + UPPER + UPPER.lower() + b"+/_.=-"), _is(UPPER + UPPER.lower()), _is(b"aeiouyAEIOUY")
CLASS = np.select([_is(DIGITS), _is(UPPER), _is(UPPER.lower())], [0, 1, 2], 3).astype(np.uint8)


def _may_have_hex(text: str) -> bool:
    """False only if the text has no run of 24 hex digits: such a run has eight hits in a row at every third place."""
    hit = IS_HEX[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)[::3]]
    for step in (1, 2, 4):
        hit = hit[:-step] & hit[step:]
    return bool(hit.any())


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if len(text) >= 24 and _may_have_hex(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def secret_parts(text: str) -> list[tuple[int, int]]:
    """What the patterns hold to be secret: of an assignment its value."""
    values = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return sorted(values + [(a, b) for a, kind, b in pattern_spans(text) if kind])


class Tokens:
    """All tokens of several texts: ``start`` and ``end`` in their own text, ``text`` (its number), ``run`` (the first of a run
    of neighbours: tokens with at most two characters between them) and ``features``, one array of numbers a feature."""

    def __init__(self, texts: list[str]):
        # texts stand three line breaks apart; every character beyond ASCII is one code, so that places are code points
        points = np.frombuffer(("\n\n\n" + "\n\n\n".join(texts) + "\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(points, 128).astype(np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(size + 3) - size
        inside = IS_TOKEN[code]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        a, b = edge[::2], edge[1::2]
        self.text = np.searchsorted(base, a, "right") - 1
        self.start, self.end = a - base[self.text], b - base[self.text]
        gap = np.concatenate([[9], a[1:] - b[:-1]])[:len(a)]
        self.run = gap > 2
        self.long, self.features = self._features(code, a, b, base)

    def _features(self, code: np.ndarray, a: np.ndarray, b: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which tokens have eight characters or more and a digit, and the feature numbers."""
        def count(hits: np.ndarray, end: np.ndarray = b) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])
            return total[end] - total[a]

        length, kind = b - a, CLASS[code]
        digits, upper, lower = (count(kind == k) for k in range(3))
        hexes = count(IS_HEX[code]) == length
        shape = (digits > 0) + 2 * (upper > 0) + 4 * (lower > 0) + 8 * (digits + upper + lower < length)
        shape = np.where(hexes, 16, shape)
        changes = count(kind[1:] != kind[:-1], b - 1)
        size = np.minimum(length // 4, 12)
        low = code.tobytes().lower()
        found = np.array([m.span() for m in KEYWORD.finditer(low)], np.int64).reshape(-1, 2)
        ended = np.searchsorted(found[:, 1], b, "right")  # key words are letters, so each lies inside one token

        def word_since(place: np.ndarray) -> np.ndarray:
            return ended > np.searchsorted(found[:, 0], place, "left")

        here = base[self.text]
        same = self.text[1:] == self.text[:-1]
        before = np.concatenate([a[:1], np.where(same & (a[1:] - b[:-1] <= 40), a[:-1], a[1:])])
        left = np.where(self.run, 17, np.concatenate([[17], shape[:-1]]))
        right = np.where(np.concatenate([self.run[1:], [True]]), 17, np.concatenate([shape[1:], [17]]))
        long = (length >= 8) & (digits > 0)
        many = np.minimum(np.bincount(self.text, long, len(base)), 4).astype(np.int64)[self.text]
        word_in_file = np.bincount(np.searchsorted(base, found[:, 0], "right") - 1, minlength=len(base))[self.text] > 0
        within = word_since(a)
        word_before = np.searchsorted(found[:, 0], a, "left") > np.searchsorted(found[:, 0], before, "left")
        first = [np.minimum(code[np.minimum(a + k, len(code) - 1)], 127) for k in range(4)]
        letters = np.logical_and.reduce([IS_LETTER[c] for c in first]) & (length >= 4)
        prefix = sum(c.astype(np.int64) * f for c, f in zip(first, (389017, 16787, 443, 7)))
        vowels = count(IS_VOWEL[code])
        last, following = code[a - 1], code[b]
        values = (
            (1, np.zeros(len(a), np.int64)), (17, shape), (13, size), (9, 8 * digits // length), (9, 8 * changes // length), (129, last), (129, following),
            (2, word_before), (2, word_since(np.maximum(a - 24, here))), (2, within), (18, left), (18, right), (10, 2 * many + word_in_file),
            (4, np.minimum(count(code == 46), 3)), (2, (last == 64) | (following == 64)), (221, 13 * shape + size),
            (1025, np.where(letters, prefix % 1024, 1024)), (9 * 13, 13 * (8 * vowels // length) + size),
        )
        offset, out = 0, []
        for width, value in values:
            out.append(value.astype(np.int64) + offset)
            offset += width
        return long, out

    def scores(self, weights: np.ndarray) -> np.ndarray:
        total = np.zeros((len(self.start), 3))
        for numbers in self.features:
            total += weights[numbers]
        return total


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


FORBIDDEN = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]], np.float64)  # tags O, B, I; no I after O


def train(chains: list[tuple[list[list[int]], list[int]]], steps: int = 120, rate: float = 0.15, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x tags) and transitions by gradient ascent (Adam) on the exact log-likelihood."""
    weights, moves = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    if not chains:
        weights[:, 0] = 1.0
        return weights, moves
    longest, width = max(len(y) for _, y in chains), len(chains[0][0][0])
    x = np.zeros((len(chains), longest, width), np.int16)  # feature numbers are below ``BUCKETS``
    y = np.zeros((len(chains), longest), np.int64)
    size = np.array([len(t) for _, t in chains])
    for k, (f, t) in enumerate(chains):
        x[k, :len(t)], y[k, :len(t)] = f, t
    live = np.arange(longest) < size[:, None]
    rows = np.arange(len(chains))
    kinds, kind = np.unique(x.reshape(-1, width), axis=0, return_inverse=True)  # tokens of the same features
    kind = kind.reshape(len(chains), longest)
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        score = sum(weights[kinds[:, k]] for k in range(width))[kind]
        score[:, 0, 2] -= 1e9
        move = moves + FORBIDDEN
        forward = np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = _logsumexp(forward[:, t - 1, :, None] + move, 1) + score[:, t]
            forward[:, t] = np.where(live[:, t, None], new, forward[:, t - 1])
        total = _logsumexp(forward[:, -1], 1)
        backward = np.zeros_like(score)
        edges = np.zeros((3, 3))
        for t in range(longest - 2, -1, -1):
            step_in = move + (score[:, t + 1] + backward[:, t + 1])[:, None, :]
            inside = live[:, t + 1]
            backward[:, t] = np.where(inside[:, None], _logsumexp(step_in, 2), 0.0)
            pair = np.exp(forward[:, t, :, None] + step_in - total[:, None, None]) * inside[:, None, None]
            edges -= pair.sum(axis=0)
            np.add.at(edges, (y[inside, t], y[inside, t + 1]), 1.0)
        gap = -np.exp(forward + backward - total[:, None, None]) * live[:, :, None]
        gap[rows[:, None], np.arange(longest), y] += live
        slope = np.zeros_like(weights)
        for tag in range(3):
            slope[:, tag] = np.bincount(kinds.ravel(), np.repeat(np.bincount(kind.ravel(), gap[:, :, tag].ravel(), len(kinds)), width), BUCKETS)
        for value, grad, one, two in ((weights, slope / len(chains) - penalty * weights, state[0], state[1]), (moves, edges / len(chains) - penalty * moves, state[2], state[3])):
            one += 0.1 * (grad - one)
            two += 0.01 * (grad * grad - two)
            value += rate * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.99 ** step)) + 1e-8)
    return weights, moves


def viterbi(score: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags (0 O, 1 B, 2 I) of one run; ties go to the smaller tag."""
    best = score[0].copy()
    best[2] -= 1e9
    back = []
    for row in score[1:]:
        table = best[:, None] + moves + FORBIDDEN
        back.append(table.argmax(axis=0))
        best = table.max(axis=0) + row
    tags = [int(best.argmax())]
    for choice in reversed(back):
        tags.append(int(choice[tags[-1]]))
    return tags[::-1]


def surely_outside(score: np.ndarray, run: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Tokens that are O on every best path. If one was B or I there, making it O, and a following I B, would gain score: by the gap
    at the token, perhaps less the next one's gap from I to B, and less the most that moves into and out of it can differ."""
    gap = score[:, 0] - score[:, 1:].max(axis=1)
    into = max(0.0, (moves[:, 1:] - moves[:, :1] + FORBIDDEN[:, 1:]).max())
    plain = max(0.0, (moves[1:, :2] - moves[:1, :2]).max())
    broken = (moves[1:, 2] - moves[0, 1]).max()
    # a following B that was I has the same way on only by moves from B instead of I
    onward = max(0.0, (moves[2] - moves[1]).max())
    change = np.concatenate([score[1:, 2] - score[1:, 1], [-np.inf]])
    change[:-1][run[1:]] = -np.inf
    return gap > into + np.maximum(plain, broken + onward + change) + 1e-9


def field_spans_of(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, int]]]:
    """The field's spans in each of the texts."""
    weights, moves = model
    tokens, out = Tokens(texts), [[] for _ in texts]
    if not len(tokens.start):
        return out
    score = tokens.scores(weights)
    open_ = ~surely_outside(score, tokens.run, moves)
    begins = np.flatnonzero(open_ & (tokens.run | ~np.concatenate([[False], open_[:-1]])))
    ends = np.flatnonzero(open_ & np.concatenate([tokens.run[1:] | ~open_[1:], [True]])) + 1
    outer = np.array([[0.0, -1e12, -1e12]])  # a settled neighbour
    for a, b in zip(begins.tolist(), ends.tolist()):
        head = not tokens.run[a]
        tail = b < len(open_) and not tokens.run[b]
        tags = viterbi(np.concatenate([outer] * head + [score[a:b]] + [outer] * tail), moves)[int(head):]
        spans = out[tokens.text[a]]
        for k, tag in zip(range(a, b), tags):
            if tag == 1:
                spans.append((int(tokens.start[k]), int(tokens.end[k])))
            elif tag == 2:
                spans[-1] = (spans[-1][0], int(tokens.end[k]))
    return out


def field_spans(text: str, model: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    return field_spans_of([text], model)[0]


def sliced_spans(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> Iterator[list[tuple[int, int]]]:
    """The field's spans of each text in turn; about ``SLICE`` characters are looked at together."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > SLICE:
            yield from field_spans_of(held, model)
            held, size = [], 0
        held.append(text)
        size += len(text)
    yield from field_spans_of(held, model)


def outside(text: str, a: int, b: int) -> list[tuple[int, int, int]]:
    """The field's span over the token characters between a and b, if there are any."""
    parts = [m.span() for m in PART.finditer(text, a, b)] if a < b else []
    return [(parts[0][0], 3, parts[-1][1])] if parts else []


def all_spans(text: str, model: tuple[np.ndarray, np.ndarray] | None, found: list[tuple[int, int]] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = pattern_spans(text)
    starts = [a for a, _, _ in base]
    furthest = list(accumulate((b for _, _, b in base), max))
    added = []
    for a, b in field_spans(text, model) if found is None else found:
        at = a
        for k in range(bisect_right(furthest, a), bisect_left(starts, b)):
            added += outside(text, at, base[k][0])
            at = max(at, furthest[k])
        added += outside(text, at, b)
    return base, sorted(base + added)


def labelled_chains(texts: list[str], most: int = WINDOWS) -> list[tuple[np.ndarray, list[int]]]:
    """Stretches of at most ``WIDTH`` tokens with their tags: those with a secret or a long token with a digit, and one more a text.
    Each has its rows for itself, as a view of them would keep those of its whole text in memory."""
    out = []
    for text in texts:
        tokens = Tokens([text])
        if not len(tokens.start):
            continue
        a, b = tokens.start, tokens.end
        mark = np.zeros(len(a), bool)
        for x, y in secret_parts(text):
            mark[np.searchsorted(b, x, "right"):np.searchsorted(a, y, "left")] = True
        begin = np.flatnonzero(tokens.run)
        cuts = np.concatenate([np.arange(x, y, WIDTH) for x, y in zip(begin, [*begin[1:], len(a)])])
        rows, extra = np.stack(tokens.features, axis=1).astype(np.int16), int(cuts[len(text) % len(cuts)])
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(a)]):
            if x == extra or mark[x:y].any() or tokens.long[x:y].any():
                out.append((rows[x:y].copy(), [0 if not m else 2 if k and mark[x + k - 1] else 1 for k, m in enumerate(mark[x:y])]))
    return out if len(out) <= most else [out[k * len(out) // most] for k in range(most)]


def fit(docs: DataFrame, text_column: str = "text", sample: int = SAMPLE, longest: int = 20000) -> tuple[np.ndarray, np.ndarray]:
    """Train on at most ``sample`` distinct texts of at most ``longest`` characters: half of them with a
    match of the patterns, half without, those with the smallest hashes. The bounds hold for training alone."""
    text = F.col(text_column)
    chosen = docs.where(F.length(text).between(1, longest)).select(F.xxhash64(text).alias("h"), text.alias("t"))
    hashes = chosen.select("h", F.col("t").rlike(ANY_PATTERN).alias("hit")).groupBy("h").agg(F.max("hit").alias("hit"))
    wanted = [r["h"] for hit in (True, False) for r in hashes.where(F.col("hit") == hit).orderBy("h").limit(sample // 2).collect()]
    drawn = docs.sparkSession.createDataFrame([(h,) for h in wanted], "h long")
    rows = chosen.join(F.broadcast(drawn), "h").groupBy("h").agg(F.min("t").alias("t")).collect()
    return train(labelled_chains(sorted(r["t"] for r in rows)))


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, keep: list, text_column: str = "text", model: tuple[np.ndarray, np.ndarray] | None = None, name: str = "found") -> DataFrame:
    """``keep`` columns and a column of the given name: struct of n_assign, n_access, n_hex, base_sha256, spans, and the text with every span
    replaced by ``[secret]`` (``redacted``; null for a null text)."""
    field = fit(docs, text_column) if model is None else model

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, sliced_spans([t or "" for t in texts], field)):
            base, spans = all_spans(text or "", field, found)
            counts = [sum(k == n for _, k, _ in base) for n in range(3)]
            clean = text
            if spans:
                pieces, at = [], 0
                for a, _, b in spans:
                    if a >= at:
                        pieces += [text[at:a], "[secret]"]
                    at = max(at, b)
                clean = "".join(pieces) + text[at:]
            rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans), clean))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    return docs.select(*keep, find(F.col(text_column)).alias(name))
