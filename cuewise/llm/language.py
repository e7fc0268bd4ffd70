"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes, both ways, and labels every position; a document's probabilities are the
mean of those of all its positions, over its whole text. It is trained here, in numpy, by backpropagation through time,
on windows of a bounded sample of labelled rows (at most ``PER_LANGUAGE`` rows for each of at most ``LANGUAGES``
languages, those with the smallest draws by a hash, ``VIEWS`` windows from each).

Defined cases: a null text, or one without any letter, is ``und`` with score 0; repeated rows are labelled alike and each
is reported; without any labelled row everything is ``und``. The state starts anew in each window, so a text of any
length takes linear time and bounded memory. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW, HIDDEN = 128, 8
PER_LANGUAGE, LANGUAGES, VIEWS, DRAWN = 500, 200, 6, 4
LEAST_ROWS, SHORTEST, DEVIATIONS, NEAR_CHANCE = 30, 3, 6.0, 0.25
UNKNOWN = "und"
Model = dict


def cut(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, window) bytes, length of every window, and the number of the text that it comes from."""
    counts = np.array([-(-len(t) // window) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    size = np.full(int(counts.sum()), window, np.int64)
    ends = np.cumsum(counts)
    grid = np.zeros((len(size), window), np.uint8)
    flat = grid.reshape(-1)
    for text, end, count in zip(texts, ends.tolist(), counts.tolist()):
        if count:
            begin = (end - count) * window
            flat[begin:begin + len(text)] = np.frombuffer(text, np.uint8)
            size[end - 1] = len(text) - (count - 1) * window
    return np.ascontiguousarray(grid.T), size, owner


def _steps(bytes_: np.ndarray, way: dict, hidden: int, size: np.ndarray, backward: bool, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Hidden state after each position, in reading order. Gates are s = tanh(a / 2), the halving is part of the weights."""
    table, recur = way["E"], way["U"]
    state = np.zeros((hidden, bytes_.shape[1]), np.float32)
    order = range(len(bytes_) - 1, -1, -1) if backward else range(len(bytes_))
    shortest = int(size.min()) if len(size) else 0
    for t in order:
        seen = table.take(bytes_[t], axis=1)
        mixed = recur @ state
        gates = np.tanh(seen[:2 * hidden] + mixed[:2 * hidden])
        gates += 1
        gates *= 0.5
        fresh = np.tanh(seen[2 * hidden:] + gates[:hidden] * mixed[2 * hidden:])
        new = state - fresh
        new *= gates[hidden:]
        new += fresh
        if backward and t >= shortest:
            new *= (t < size).astype(np.float32)  # positions after the end leave the state at zero
        if keep is not None:
            keep.append((t, state, mixed, gates, fresh))
        state = new
        yield t, state


def position_scores(model: Model, bytes_: np.ndarray, size: np.ndarray, keep: tuple | None = None) -> np.ndarray:
    """(position, language, window) logits."""
    hidden = model["hidden"]
    out = np.empty((len(bytes_), len(model["b"]), bytes_.shape[1]), np.float32)
    for t, state in _steps(bytes_, model["f"], hidden, size, False, keep and keep[0]):
        np.matmul(model["Vf"], state, out=out[t])
    for t, state in _steps(bytes_, model["r"], hidden, size, True, keep and keep[1]):
        out[t] += model["Vr"] @ state
    out += model["b"][:, None]
    return out


def probabilities(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def document_probabilities(model: Model, texts: list[bytes], block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(text, language) means over all positions of each text, and the mean of each position's highest probability."""
    bytes_, size, owner = cut(texts)
    total, local = np.zeros((len(texts), len(model["b"]))), np.zeros(len(texts))
    for begin in range(0, len(size), block):
        part = size[begin:begin + block]
        p = probabilities(position_scores(model, np.ascontiguousarray(bytes_[:, begin:begin + block]), part))
        if part.min() < WINDOW:
            p *= (np.arange(WINDOW)[:, None] < part)[:, None, :]
        sums = p.sum(axis=0, dtype=np.float64).T
        np.add.at(total, owner[begin:begin + block], sums)
        np.add.at(local, owner[begin:begin + block], p.max(axis=1).sum(axis=0, dtype=np.float64))
    size = np.maximum(1, np.array([len(t) for t in texts]))
    return total / size[:, None], local / size


def start(languages: int, hidden: int, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)

    def draw(*shape, scale):
        return rng.normal(0, scale, shape).astype(np.float32)

    def way():
        return {"E": draw(3 * hidden, 256, scale=0.3), "U": draw(3 * hidden, hidden, scale=0.6 / hidden ** 0.5)}

    return {"hidden": hidden, "f": way(), "r": way(), "Vf": draw(languages, hidden, scale=0.3), "Vr": draw(languages, hidden, scale=0.3), "b": np.zeros(languages, np.float32)}


def _way_gradient(way: dict, kept: list, push: list, bytes_: np.ndarray, size: np.ndarray, backward: bool, hidden: int) -> dict:
    """Backpropagation through time: ``push[t]`` is the slope of the loss on the state after position t."""
    table, recur = np.zeros_like(way["E"]), np.zeros_like(way["U"])
    carry = np.zeros_like(kept[0][1])
    for t, state, mixed, gates, fresh in reversed(kept):
        slope = push[t] + carry
        if backward:
            slope = slope * (t < size)
        r, z = gates[:hidden], gates[hidden:]
        d_fresh = slope * (1 - z) * (1 - fresh * fresh)
        d_z = slope * (state - fresh) * z * (1 - z) * 2
        d_r = d_fresh * mixed[2 * hidden:] * r * (1 - r) * 2
        d_in = np.concatenate([d_r, d_z, d_fresh])
        d_mixed = np.concatenate([d_r, d_z, d_fresh * r])
        recur += d_mixed @ state.T
        for row in range(3 * hidden):
            table[row] += np.bincount(bytes_[t], d_in[row], 256)
        carry = way["U"].T @ d_mixed + slope * z
    return {"E": table, "U": recur}


def gradient(model: Model, bytes_: np.ndarray, size: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, Model]:
    hidden, kept = model["hidden"], ([], [])
    logits = position_scores(model, bytes_, size, kept)
    p = probabilities(logits)
    live = (np.arange(len(bytes_))[:, None] < size) * weight
    live /= live.sum()
    rows = np.arange(len(label))
    loss = -float((np.log(p[:, label, rows] + 1e-12) * live).sum())
    gap = p * live[:, None, :]
    gap[:, label, rows] -= live
    gap = gap.astype(np.float32)
    after = [{}, {}]
    for side, kept_side in enumerate(kept):
        states = [k[1] for k in kept_side]
        for k, (t, *_rest) in enumerate(kept_side):
            if k + 1 < len(states):
                after[side][t] = states[k + 1]
            else:
                _, state, _, gates, fresh = kept_side[k]
                last = (state - fresh) * gates[hidden:] + fresh
                after[side][t] = last * (t < size) if side else last
    out: Model = {"hidden": hidden, "b": gap.sum(axis=(0, 2))}
    for side, (way, head) in enumerate((("f", "Vf"), ("r", "Vr"))):
        out[head] = sum(gap[t] @ after[side][t].T for t in range(len(bytes_)))
        push = [model[head].T @ gap[t] for t in range(len(bytes_))]
        out[way] = _way_gradient(model[way], kept[side], push, bytes_, size, bool(side), hidden)
    return loss, out


def _leaves(model: Model) -> list[np.ndarray]:
    return [model["f"]["E"], model["f"]["U"], model["r"]["E"], model["r"]["U"], model["Vf"], model["Vr"], model["b"]]


def train(samples: list[tuple[bytes, str]], hidden: int = HIDDEN, steps: int = 300, batch: int = 160, rate: float = 0.02, seed: int = 7) -> Model:
    """Adam on the mean cross-entropy of all positions; every language weighs the same."""
    names = sorted({lang for _, lang in samples})
    samples = [(t, lang) for t, lang in samples if t]
    if not samples:
        return {"names": []}
    number = {n: k for k, n in enumerate(names)}
    label = np.array([number[lang] for _, lang in samples])
    share = np.bincount(label, minlength=len(names))
    weight = 1.0 / share[label]
    bytes_, size, owner = cut([t[:WINDOW] for t, _ in samples])
    model = start(len(names), hidden, seed)
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(x) for x in _leaves(model)]
    second = [np.zeros_like(x) for x in _leaves(model)]
    for step in range(1, steps + 1):
        chosen = rng.choice(len(size), min(batch, len(size)), replace=False)
        _, slope = gradient(model, np.ascontiguousarray(bytes_[:, chosen]), size[chosen], label[owner[chosen]], weight[owner[chosen]])
        now = rate * (1 - 0.9 * step / steps)
        for value, g, m, v in zip(_leaves(model), _leaves(slope), first, second):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= (now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return model | {"names": names}


def training_rows(docs: DataFrame, id_column: str, text_column: str, lang_column: str, allowed: Column) -> list[tuple[bytes, str]]:
    """The bounded sample: windows at hashed places of the chosen rows' texts."""
    text, lang = F.col(text_column), F.col(lang_column)
    usable = docs.where(allowed & lang.isNotNull() & text.isNotNull())
    counts = usable.groupBy(lang.alias("l")).agg(F.count("*").alias("many")).orderBy("l").limit(LANGUAGES)
    # a row's draw is even between 0 and 1; the share that is ranked holds about DRAWN times the rows that stay, however large the table is
    drawn = F.shiftrightunsigned(F.xxhash64(text, F.col(id_column)), 11) / F.lit(float(1 << 53))
    rows = usable.select(drawn.alias("h"), F.col(id_column).alias("i"), lang.alias("l"), text.alias("t")).join(F.broadcast(counts), "l")
    rows = rows.where(F.col("h") * F.col("many") < DRAWN * PER_LANGUAGE).select("h", "i", "l", views_of(F.col("t")).alias("v"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))).where(F.col("n") <= PER_LANGUAGE)
    kept = first.groupBy("l").agg(F.collect_list(F.struct("n", "v")).alias("rows")).orderBy("l").collect()
    return [(v.encode("utf-8", "surrogatepass"), row["l"]) for row in kept for item in sorted(row["rows"], key=lambda x: x["n"]) for v in item["v"]]


def views_of(text: Column) -> Column:
    """Windows at hashed places of a text."""
    return F.array(*[F.substring(text, F.pmod(F.xxhash64(text, F.lit(k)), F.greatest(F.lit(1), F.length(text) - WINDOW)).cast("int") + 1, F.lit(WINDOW)) for k in range(VIEWS)])


def fit(docs: DataFrame, allowed: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    return train(training_rows(docs, id_column, text_column, lang_column, allowed))


def predict(docs: DataFrame, model: Model, keep: list, text_column: str = "text", name: str = "found") -> DataFrame:
    """``keep`` columns and a column of the given name: struct of lang_pred, score, the pooled probability of that language, local, the mean
    of each position's highest probability, and has_letter."""
    @F.pandas_udf("lang_pred string, score double, local double, has_letter boolean")
    def label(texts: pd.Series) -> pd.DataFrame:
        values = texts.tolist()
        out = pd.DataFrame({"lang_pred": [UNKNOWN] * len(values), "score": 0.0, "local": 0.0, "has_letter": False})
        good = [k for k, t in enumerate(values) if t is not None and any(map(str.isalpha, t))]
        out.loc[good, "has_letter"] = True
        if not model["names"]:
            return out
        for begin in range(0, len(good), 512):
            part = good[begin:begin + 512]
            p, local = document_probabilities(model, [values[k].encode("utf-8", "surrogatepass") for k in part])
            best = p.argmax(axis=1)
            out.loc[part, "lang_pred"] = [model["names"][b] for b in best]
            out.loc[part, "score"] = np.clip(p[np.arange(len(part)), best], 0.0, 1.0)
            out.loc[part, "local"] = local
        return out

    return docs.select(*keep, label(F.col(text_column)).alias(name))


def length_class(text: Column) -> Column:
    return F.floor(F.log2(F.octet_length(text) + F.lit(1))).cast("int")


def junk_bounds(found: DataFrame, model: Model, text_column: str = "text", lang_column: str = "lang", name: str = "found") -> dict[int, float]:
    """For each class of text length (powers of two) that occurs the local probability that no clean text falls under:
    ``DEVIATIONS`` standard deviations under the mean of all the labelled rows of that class, and at most ``NEAR_CHANCE`` of
    the way from chance to that mean, as texts that switch languages are a little less sure.

    ``found``: rows of ``predict`` with their text and label, materialised. A class of fewer than ``LEAST_ROWS`` labelled rows
    takes the next shorter ones with it, which are less sure; one for which these do not suffice is measured by the
    beginnings of all longer labelled texts, cut to its length. There is no bound where fewer than ``LEAST_ROWS`` texts are
    left by then, and beginnings of under 7 bytes (classes before ``SHORTEST``), a part of a word, prove nothing.

    The pooled probability is no such measure: a clean text of several languages has a low one.
    """
    if not model["names"]:
        return {}
    local = F.col(f"{name}.local")
    known = F.col(lang_column).isNotNull() & F.col(text_column).isNotNull() & F.col(f"{name}.has_letter")
    sized = found.withColumn(name, F.struct(f"{name}.*", length_class(F.col(text_column)).alias("size")))
    moments = [F.count(F.when(known, 1)).alias("n"), F.avg(F.when(known, local)).alias("mean"), F.var_pop(F.when(known, local)).alias("var")]
    rows = {r["size"]: r for r in sized.where(f"`{name}`.has_letter").groupBy(F.col(f"{name}.size").alias("size")).agg(*moments).collect()}
    pools = {size: pooled([rows[k] for k in sorted(rows, reverse=True) if k <= size]) for size in rows}
    few = [size for size, (n, _, _) in pools.items() if n < LEAST_ROWS and size >= SHORTEST]
    if few:
        begin = F.explode(F.array(*[F.struct(F.lit(size).alias("size"), F.substring(text_column, 1, 2 ** size - 1).alias("text")) for size in sorted(few)]))
        cut_down = sized.where(known).select(F.col(f"{name}.size").alias("of"), begin.alias("b")).where("of > b.size").select("b.*")
        scored = predict(cut_down, model, ["size"]).where("found.has_letter")
        more = scored.groupBy("size").agg(F.count("*").alias("n"), F.avg("found.local").alias("mean"), F.var_pop("found.local").alias("var")).collect()
        pools |= {r["size"]: pooled([rows[k] for k in sorted(rows, reverse=True) if k <= r["size"]] + [r]) for r in more}
    chance = 1 / len(model["names"])
    return {size: min(mean - DEVIATIONS * dev, chance + NEAR_CHANCE * (mean - chance)) for size, (n, mean, dev) in pools.items() if n >= LEAST_ROWS}


def pooled(parts: list) -> tuple[int, float, float]:
    """Number, mean and standard deviation of the values of the first parts (n, mean, var), as many as give ``LEAST_ROWS``."""
    n, mean, squares = 0, 0.0, 0.0
    for part in parts:
        if part["n"] and n < LEAST_ROWS:
            gap, both = part["mean"] - mean, n + part["n"]
            squares += part["n"] * part["var"] + gap * gap * n * part["n"] / both
            n, mean = both, mean + gap * part["n"] / both
    return n, mean, (squares / max(1, n - 1)) ** 0.5


def not_junk(bounds: dict[int, float], text_column: str = "text", name: str = "found") -> Column:
    """Of rows of ``predict``: whether the text has a letter and is not under the bound of its length class."""
    least = F.lit(0.0)
    for size, bound in sorted(bounds.items()):
        least = F.when(length_class(F.col(text_column)) == size, F.lit(float(bound))).otherwise(least)
    return F.col(f"{name}.has_letter") & (F.col(f"{name}.local") >= least)
