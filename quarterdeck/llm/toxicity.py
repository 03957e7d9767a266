"""Toxicity by two Kneser-Ney word models, one of toxic and one of ordinary texts, with shared backoff counts.

A word after another has, in each class, an interpolated Kneser-Ney probability: discounted counts of the pair, then of
the different words that the word has followed in the class, then the word's share of the whole corpus, which is counted
over all documents and is the same for both. Words that have followed few others count as one, so an expression that
neither class knows well is judged by neither, and one that copies repeat counts once for each word it follows.

A text is compared word by word. The differences of both log-likelihoods by word, over the whole text, its most toxic
passage and its most toxic words, are turned into a score by a logistic fit on texts that the counts haven't seen.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, cuts, fold, keep, local, place

#: The labelled sample that is learned from: distinct texts, and characters, of each class, about.
TRAIN_ROWS, TRAIN_CHARS = 12_000, 10_000_000
#: Words of the passage that is compared by itself, and single words that are.
PASSAGE, WORDS = 2, 3
#: Words, or pairs of them, that a task counts before it hands them on.
COUNTED = 300_000
#: Different words that a word has to follow in the sample to be known; others are one word, RARE. START is before the first.
CONTEXTS, START, RARE = 10, 0, 1
#: Share of the corpus that is left to words never seen in it.
UNSEEN = 1e-9
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def _counted(texts, names: list[str], of):
    """Batches of distinct items of(text) with their numbers, handed on before they are too many for a task."""
    seen: Counter = Counter()

    def out():
        keys = [pa.array(c, pa.string()) for c in (zip(*seen, strict=True) if seen else [()] * len(names))]
        batch = pa.RecordBatch.from_arrays([*keys, pa.array(list(seen.values()), pa.int64())], names=[*names, "n"])
        seen.clear()
        return batch

    for text in texts:
        seen.update(of(text))
        if len(seen) >= COUNTED:
            yield out()
    yield out()


def corpus_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, by its hash, stands in all documents. Counted in each task before the shuffle."""

    def run(batches):
        yield from _counted((t for b in batches for t in b.column(0).to_pylist()), ["word"], lambda t: zip(words_of(t), strict=True))

    counted = docs.select("text").mapInArrow(run, "word string, n long")
    return counted.select(F.xxhash64("word").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def class_counts(sample: DataFrame) -> DataFrame:
    """(toxic, before, word, n): pairs of neighbouring words of sample(toxic, text), by class; before is '' at the start."""

    def pairs(t):
        w = words_of(t)
        return zip(["", *w[:-1]], w, strict=False)

    def run(batches):
        yield from _counted((t for b in batches for t in b.column(0).to_pylist()), ["before", "word"], pairs)

    both = None
    for toxic in (0, 1):
        one = sample.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "before string, word string, n long").select(F.lit(toxic).alias("toxic"), "*")
        both = one if both is None else both.unionByName(one)
    return both.groupBy("toxic", "before", "word").agg(F.sum("n").alias("n"))


def discount(n: np.ndarray) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2, and 3 or more, by the numbers of those seen 1 to 4 times."""
    seen = np.bincount(np.minimum(n, 5), minlength=6)[:6].astype(float)
    y = seen[1] / max(seen[1] + 2 * seen[2], 1)
    return tuple(float(np.clip(k - (k + 1) * y * seen[k + 1] / max(seen[k], 1), 0.3, k - 0.1)) for k in (1, 2, 3))


def _smoothed(n: np.ndarray, group: np.ndarray, groups: int, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of counts within their groups, and the share that each group leaves to lower (1 where it has none)."""
    off = np.array((0.0, *discount(n)))[np.minimum(n, 3)]
    total, rest = np.bincount(group, n, groups), np.bincount(group, off, groups)
    share = np.where(total > 0, rest / np.maximum(total, 1), 1.0)
    return (n - off) / total[group] + share[group] * lower, share


@dataclass
class Model:
    words: dict[str, int]  # number of each known word; START and RARE come before them
    word_gain: np.ndarray  # by number: log of toxic over ordinary probability, without a context
    rest: np.ndarray  # the same of what a word leaves, as a context, to single words
    pairs: np.ndarray  # sorted: number of a word, times as many as there are, and of that after it
    pair_gain: np.ndarray
    weights: np.ndarray  # logistic weights of features(); empty where not both classes are known
    share: float  # of toxic labels

    def gains(self, text: str | None) -> np.ndarray:
        """For each word, the log of its toxic over its ordinary probability after the word before it."""
        get = self.words.get
        word = np.array([get(w, RARE) for w in words_of(text)], np.int64)
        before = np.concatenate([[START], word[:-1]])[: len(word)].astype(np.int64)
        out = self.word_gain[word] + self.rest[before]
        if len(self.pairs):
            key = before * len(self.word_gain) + word
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            out = np.where(self.pairs[at] == key, self.pair_gain[at], out)
        return out

    def features(self, text: str | None) -> np.ndarray:
        """Difference of both log-likelihoods by word: of the whole text, its most toxic passage and words; and its length."""
        x = self.gains(text)
        if not len(x):
            return np.zeros(4)
        sums, size = np.cumsum(np.append(0, x)), min(PASSAGE, len(x))
        top = np.partition(x, -WORDS)[-WORDS:] if len(x) > WORDS else x
        return np.array([sums[-1] / len(x), (sums[size:] - sums[:-size]).max() / size, top.sum() / WORDS, np.log1p(len(x))])

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return self.share
        z = float(np.append(self.features(text), 1.0) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of the columns of x and of a constant, by Newton's method."""
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z, w = np.c_[(x - centre) / scale, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * centre / scale).sum())


def fitted(counts: pd.DataFrame, words: list[str], corpus: np.ndarray, total: int) -> Model:
    """Both classes' probabilities from counts(toxic, before, word, n) of numbers, and the corpus counts of known words."""
    size = len(words) + 2
    shared = np.full(size, UNSEEN)
    shared[2:] += corpus / max(total, 1)
    shared[RARE] = max(1 - shared[2:].sum(), UNSEEN)
    toxic, before, word, n = (counts[c].to_numpy(dtype=np.int64) for c in ("toxic", "before", "word", "n"))
    key = before * size + word
    pairs, first = np.unique(key, return_index=True)
    single, double, rest = [], [], []
    for kind in (1, 0):
        own = toxic == kind
        heads = np.bincount(word[own], minlength=size)  # different words before
        heads[RARE] = n[own & (word == RARE)].sum()  # many words, which follow many
        seen = np.flatnonzero(heads)
        p, share = _smoothed(heads[seen], np.zeros(len(seen), np.int64), 1, shared[seen])
        every = share[0] * shared
        every[seen] = p
        single.append(every)
        q, shares = _smoothed(n[own], before[own], size, every[word[own]])
        pair = shares[before[first]] * every[word[first]]
        pair[np.searchsorted(pairs, key[own])] = q
        double.append(pair)
        rest.append(shares)
    log = lambda x: np.log(x[0]) - np.log(x[1])
    return Model({w: k for k, w in enumerate(words, 2)}, log(single), log(rest), pairs, log(double), np.zeros(0), 0.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, chars: int) -> DataFrame:
    """(toxic, text) of labels(doc_id, toxic): distinct texts of each class, about as many, and characters, as given.

    Labels meet hashes and lengths of texts, not texts; the few hashes chosen then go to where the texts are.
    """
    marked = docs.select("doc_id", "text", F.xxhash64("text", F.lit(11)).alias("mark"), F.length("text").cast("long").alias("size"))
    known = marked.where("text is not null").select("doc_id", "mark", "size").join(labels, "doc_id")
    marks = keep(known.groupBy("toxic", "mark").agg(F.max("size").alias("size")).withColumn("place", place("mark", "size", chars)))
    chosen = keep(marks.join(cuts(marks, "toxic", rows, chars), "toxic").where("place < cut").select("toxic", "mark"))
    texts = marked.join(F.broadcast(chosen), "mark")  # about twice the given rows
    return texts.groupBy("toxic", "mark").agg(F.min("text").alias("text")).select("toxic", "text")


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, contexts: int = CONTEXTS) -> Model:
    """A model from labels(doc_id, toxic) and the texts of docs(doc_id, text); corpus counts are of all of docs.

    Learned from is a bounded sample of labelled texts, each once in a class. A third of it is kept out of the counts and
    sets the logistic weights. An id with several labels is toxic if one of them says so; labels other than 0 and 1 don't
    count. Without texts of both classes the score is the share of toxic labels, 0 if there are none.
    """
    mine = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    toxic, every = mine.agg(F.sum("toxic"), F.count("*")).first()
    chosen = keep(labelled_sample(docs, mine, rows, chars).withColumn("apart", F.pmod(F.xxhash64("text", F.lit(13)), F.lit(3)) == 0))
    found = keep(class_counts(chosen.where("not apart")))
    # known words, their pairs and corpus counts are bounded by the sample
    heads = keep(found.groupBy("word").agg(F.countDistinct("before").alias("heads")).where(F.col("heads") >= contexts).select("word"))
    corpus = keep(corpus_counts(docs))
    total = corpus.agg(F.sum("n")).first()[0] or 0
    counted = local(heads.join(corpus.withColumnRenamed("word", "h"), F.xxhash64(heads["word"]) == F.col("h"), "left").select(heads["word"], F.coalesce("n", F.lit(0)).alias("n"))).sort_values("word")
    words = counted["word"].tolist()
    number = F.broadcast(docs.sparkSession.createDataFrame(pd.DataFrame({"known": words, "at": np.arange(2, len(words) + 2)}), "known string, at long"))
    numbered = found
    for c in ("before", "word"):
        numbered = numbered.join(number, F.col(c) == F.col("known"), "left").withColumn(c, F.when(F.col(c) == "", F.lit(START)).otherwise(F.coalesce("at", F.lit(RARE)))).drop("known", "at")
    pairs = local(numbered.groupBy("toxic", "before", "word").agg(F.sum("n").alias("n")))
    model = fitted(pairs.sort_values(["toxic", "before", "word"]), words, counted["n"].to_numpy(dtype=float), total)
    model.share = (toxic or 0) / every if every else 0.0
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "x": [held.value.features(t).tolist() for t in b["text"]]})

    tried = chosen.where("apart").select("toxic", "text").mapInPandas(run, "toxic int, x array<double>").toPandas()
    if pairs["toxic"].nunique() == tried["toxic"].nunique() == 2:
        order = np.lexsort((tried["x"].map(sum), tried["toxic"]))
        model.weights = logistic(np.array(tried["x"].tolist())[order], tried["toxic"].to_numpy()[order])
    held.unpersist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text): whole texts, one pass, no shuffle. Null texts are empty ones."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's characters

    def make():
        own = held.value
        return lambda texts: [(own.score(t),) for t in texts]

    return by_text(docs, make, "score double", "doc_id")


#: Score from which on a text is predicted toxic.
THRESHOLD = 0.3


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; labels of the held-out quarter aren't learned from.

    Null and empty texts, and those without a letter, are judged by the constant alone; rows that repeat are judged
    alike, and rows without an id as any other. An empty table gives no rows. Columns besides doc_id and text aren't read.
    """
    model = learn(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    scored = score(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
