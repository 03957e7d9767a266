"""Quality classifier: support vectors on naive Bayes features.

Indicators of word n-grams and of n-grams of word shapes are hashed to a fixed number of slots. Each slot is scaled by
its log-count ratio between the classes; a linear hinge-loss model is fitted on the scaled indicators by dual
coordinate descent; a logistic curve, fitted on rows kept out of the descent, turns margins into scores.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, fold, keep, local

SLOTS = 1 << 18
#: Labelled ids in whose texts slots are counted, and those in the descent, about; all slots of the latter. The descent is
#: done on the driver.
COUNT_ROWS, TRAIN_ROWS, TRAIN_SLOTS = 200_000, 6000, 16_000_000
PASSES = 12
COST = 1.0
#: Words whose hashes a task remembers before it starts afresh.
MEMO = 200_000
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLAIN, _PUNCT = re.compile(r"^\w+$"), re.compile(r"[^\w\s]")


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 7)


def shape(word: str) -> int:
    """Case, kind of characters, last character if it is no letter, and length class of a word."""
    letters = [c for c in word if c.isalpha()]
    case = 0 if not letters else 3 if word.isupper() and len(letters) > 1 else 2 if letters[0].isupper() else 1
    other = len(word) - len(letters)
    tail = ord(word[-1]) % 61 if not word[-1].isalpha() else 0
    return (((case * 4 + min(other, 3)) * 61 + tail) * 2 + any(c.isdigit() for c in word)) * 5 + min(len(word).bit_length(), 4)


class Features:
    """Slots of whole texts."""

    def __init__(self, slots: int = SLOTS):
        self.slots, self.memo = slots, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = (_hash(w.lower()), shape(w))
        both = np.array([memo[w] for w in words], dtype=np.uint64)
        h, s = both[:, 0], both[:, 1]
        again = np.zeros(len(h), np.uint64)
        again[1:] = h[1:] == h[:-1]
        s = s * np.uint64(2) + again
        with np.errstate(over="ignore"):
            parts = [h, s * _MIX2 + np.uint64(1)]
            if len(h) > 1:
                parts += [(h[:-1] * _MIX) ^ h[1:], (s[:-1] * _MIX + s[1:]) * _MIX2 + np.uint64(2)]
            if len(h) > 2:
                parts.append(((s[:-2] * _MIX + s[1:-1]) * _MIX + s[2:]) * _MIX2 + np.uint64(3))
            every = np.concatenate(parts)
            every ^= every >> np.uint64(29)
            every *= _MIX
        return np.unique((every >> np.uint64(40)).astype(np.int64) % self.slots)


@dataclass
class Model:
    weights: np.ndarray  # by slot, with the log-count ratio multiplied in
    bias: float
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        return self.bias + (float(self.weights[slots].sum()) / len(slots) ** 0.5 if len(slots) else 0.0)

    def score(self, slots: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(slots) + self.shift, -60, 60))))


def log_count_ratio(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """By slot, the log of the ratio of its smoothed shares in class 1 and class 0; counts(class, slot) of rows."""
    shares = counts + smooth
    shares = shares / shares.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, passes: int, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights on the scaled, length-normed indicators and a bias, for hinge loss, by dual coordinate descent.

    y is 1 or -1; each class weighs the same in total.
    """
    w, bias, rng = np.zeros(len(ratio)), 0.0, np.random.default_rng(seed)
    ratio = ratio.astype(np.float32)
    scaled = lambda x: ratio[x] / np.float32(max(len(x), 1) ** 0.5)
    norms = np.array([float(v @ v) + 1 for v in map(scaled, rows)])
    share = {1: 0.5 * len(y) / max((y > 0).sum(), 1), -1: 0.5 * len(y) / max((y < 0).sum(), 1)}
    top = np.array([cost * share[int(t)] for t in y])
    dual = np.zeros(len(y))
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(y)):
            x, t = rows[i], y[i]
            v = scaled(x)
            gradient = t * (float(w[x] @ v) + bias) - 1
            new = min(max(dual[i] - gradient / norms[i], 0.0), top[i])
            if (step := new - dual[i]) != 0:
                dual[i] = new
                w[x] += step * t * v
                bias += step * t
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method on smoothed targets."""
    if not len(labels):
        return 1.0, 0.0
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design, beta = np.column_stack([margins, np.ones(len(margins))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -60, 60)))
        hessian = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        beta += np.linalg.solve(hessian, design.T @ (goal - p) - 1e-6 * beta)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def _share(rows: int, of: int, seed: int):
    """A condition that holds for about rows of so many ids, by a hash."""
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(of, 1)))


def slot_counts(rows: DataFrame) -> np.ndarray:
    """By class and slot, in how many of rows(y, text) it is: summed in each task first; SLOTS sums a class reach the driver."""

    def run(batches):
        features, total = Features(), np.zeros((2, SLOTS), np.int64)
        for b in batches:
            for y, t in zip(b["y"], b["text"], strict=True):
                total[y][features(t)] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pd.DataFrame({"slot": at, "n0": total[0][at], "n1": total[1][at]})

    counted = rows.select("y", "text").mapInPandas(run, "slot int, n0 long, n1 long")
    got = counted.groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    out = np.zeros((2, SLOTS))
    for y in (0, 1):
        out[y][got["slot"].to_numpy()] = got[f"n{y}"].to_numpy()
    return out


def _sample(docs: DataFrame, ids: DataFrame, slots: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(apart, y, slots of each text) of ids(doc_id, y, apart) in order of a hash, until so many slots are reached.

    An id stands for one text: the least, if docs repeat it. What reaches the driver is bounded by slots and by one row.
    """
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "apart").agg(F.min("text").alias("text"))

    def run(batches):
        features = Features()
        for b in batches:
            x = [features(t).astype(np.int32) for t in b["text"]]
            yield pd.DataFrame({"k": b["k"], "y": b["y"], "apart": b["apart"], "n": [len(v) for v in x], "x": x})

    keyed = texts.select(F.xxhash64("doc_id", F.lit(33)).alias("k"), "y", "apart", "text")
    rows = keep(keyed.mapInPandas(run, "k long, y int, apart boolean, n int, x array<int>"))
    sizes = local(rows.select("k", "n")).sort_values("k")
    within = sizes["k"][(sizes["n"].cumsum() - sizes["n"] < slots).to_numpy()]
    if not len(within):
        return np.zeros(0, bool), np.zeros(0, np.int64), []
    got = rows.where(F.col("k") <= int(within.max())).toArrow()
    order = np.argsort(got["k"].to_numpy())
    # each row's slots are a view of the arrays that came: the driver holds four bytes for a slot
    x = [values[a:b] for c in got["x"].chunks for values, ends in [(c.values.to_numpy(), c.offsets.to_numpy())] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return got["apart"].to_numpy()[order], got["y"].to_numpy()[order].astype(np.int64), [x[i] for i in order]


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model of labels(doc_id, label 0/1) on the texts of docs.

    Log-count ratios are counted in Spark over the rows of about COUNT_ROWS labelled ids, chosen by a hash; about rows
    ids are in the descent, and a quarter as many set the curve of scores, which the other two don't see. Ids are joined
    as tables of these bounded sizes, so no text is shuffled but the descent's. An id labelled twice has the greater
    label. Without labels of both classes, every score is the share of label 1 (one half without any).
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = keep(known.withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(5)) == 0))
    n = {(r.y, r.apart): r.n for r in known.groupBy("y", "apart").agg(F.count("*").alias("n")).collect()}
    total = [sum(v for (y, _), v in n.items() if y == k) for k in (0, 1)]
    plain = Model(np.zeros(SLOTS, np.float32), 0.0, 1.0, float(np.log((total[1] + 1) / (total[0] + 1))))
    few = sum(total) < 50 or not all(n.get((y, False)) for y in (0, 1))
    known = known.withColumn("apart", F.col("apart") & F.lit(not few))
    counted = known.where(~F.col("apart") & _share(COUNT_ROWS, sum(total), 32)).select("doc_id", "y")
    counts = slot_counts(docs.select("doc_id", "text").join(F.broadcast(counted), "doc_id"))
    ratio = log_count_ratio(counts)
    apart, y, x = _sample(docs, known.where(_share(rows * 5 // 4, sum(total), 33)), TRAIN_SLOTS)
    inner, outer = np.flatnonzero(~apart), np.flatnonzero(apart)
    if len(set(y[inner].tolist())) < 2:
        return plain
    w, bias = dual_descent([x[i] for i in inner], 2 * y[inner] - 1, ratio, COST, PASSES)
    model = Model(w * ratio, bias, 1.0, 0.0)
    outer = outer if len(set(y[outer].tolist())) == 2 else inner
    model.slope, model.shift = _logistic(np.array([model.margin(x[i]) for i in outer]), y[outer])
    model.weights = model.weights.astype(np.float32)
    return model


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """docs' columns keep with score and predicted, for every row; null and empty texts get the score of no features."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a weight for each slot: a fixed size

    def make():
        features, own = Features(), held.value

        def work(texts):
            scores = [own.score(features(t)) for t in texts]
            return [(x, int(x >= 0.5)) for x in scores]

        return work

    return by_text(docs, make, "score double, predicted int", *keep)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; labels of the held-out third aren't learned from.

    Texts alone decide a score, so repeated texts score alike; null and empty texts have no features. An empty table gives no rows; other columns are not read.
    """
    model = learn(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return score(docs, model, "doc_id").select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
