"""Language identification by character language models with interpolated Kneser-Ney smoothing.

The log-probability of a character after its context is a sum: for every length of n-gram, how far the n-gram that ends
with the character stands above what its shorter one gives (gain), and what its context leaves to shorter ones (rest).
Both are zero where a language hasn't seen the n-gram. So a model is, for each length, one sorted array of n-gram hashes
with gain and rest of the languages that have seen each, and a text's cross-entropy is a sum over its n-grams. The
lowest cross-entropy per character wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, fold, keep, local, sampled

ORDER = 4
DISCOUNT = 0.75
#: The sample that is learned from, chosen by a hash of texts: rows of each language, about, and characters of all together.
TRAIN_ROWS, TRAIN_CHARS = 600, 40_000_000
#: More values of lang than this are no languages: learn() raises an error.
MOST_LANGUAGES = 5000
#: Code points; letters unseen by a language share its last discount evenly.
ALPHABET = 0x110000
REJECT = 0.999
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LATIN = re.compile(r"[A-Za-z]")
CHUNK = 1 << 20


def has_letter(text: str | None) -> bool:
    """If a character is of a letter category of Unicode (Lu, Ll, Lt, Lm, Lo)."""
    return bool(text) and (bool(_LATIN.search(text)) or any(c.isalpha() for c in text))


_table: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Code points of a text in lower case; everything but letters is one space, at both ends too."""
    if not _table:
        _table.append(np.array([chr(c).isalpha() for c in range(ALPHABET)]))
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where(_table[0][c], c, 32)
    c = np.concatenate(([32], c, [32]))
    return c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))].astype(np.uint64)


def gram_hashes(c: np.ndarray) -> list[np.ndarray]:
    """For each length n up to ORDER, a hash of each run of n code points; at [n - 1][i] that which begins at i."""
    out, h = [], np.zeros(len(c), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, ORDER + 1):  # from the last character to the first: a longer run's hash goes on from its end's
            m = len(c) - n + 1
            if m <= 0:
                out.append(np.zeros(0, np.uint64))
                h = out[-1]
                continue
            h = ((h if n == 1 else h[1:]) ^ c[:m]) * _MIX
            h ^= h >> np.uint64(32)
            out.append(h)
    return out


class Grams:
    """Sorted hashes of one length; the languages that have seen the i-th, with gain and rest, at first[i] to first[i + 1].

    A directory says where the hashes of each prefix of bits begin, so that a search starts beside its end.
    """

    def __init__(self, keys: np.ndarray, first: np.ndarray, lang: np.ndarray, gain: np.ndarray, rest: np.ndarray):
        self.keys, self.first, self.lang, self.gain, self.rest, self.both = keys, first, lang, gain, rest, gain + rest
        bits = max(len(keys).bit_length() + 2, 1)
        self.shift = np.uint64(64 - bits)
        self.begins = np.searchsorted(keys >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where each hash stands, -1 where it doesn't."""
        if not len(self.keys):
            return np.full(len(h), -1)
        last = len(self.keys) - 1
        at = np.minimum(self.begins[h >> self.shift], last)
        short = np.flatnonzero(self.keys[at] < h)
        while len(short):  # as often as the fullest prefix has hashes
            short = short[at[short] < last]
            at[short] += 1
            short = short[self.keys[at[short]] < h[short]]
        return np.where(self.keys[at] == h, at, -1)

    def sums(self, at: np.ndarray, values: np.ndarray, languages: int) -> np.ndarray:
        """By language, the sum of values over all places."""
        at, times = at[at >= 0], None
        if len(self.keys) < 4 * len(at):  # the same n-grams often: each once
            times = np.bincount(at)
            at = np.flatnonzero(times)
            times = times[at]
        n = self.first[at + 1] - self.first[at]
        ends = np.cumsum(n)
        i = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - ends + n, n)
        return np.bincount(self.lang[i], values[i] if times is None else values[i] * np.repeat(times, n), languages)


@dataclass
class Model:
    languages: list[str]
    grams: list[Grams]  # by length
    floor: np.ndarray  # log-probability of a character that a language has never seen
    limit: np.ndarray  # cross-entropy of a language beyond which a text is rejected
    heat: float

    def entropies(self, text: str) -> np.ndarray:
        """Nats per character under each language, over the whole text."""
        c = codes(text)
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, max(len(c) - 1, 1), CHUNK):  # a chunk reaches back over what its first n-gram needs
            back = max(at - ORDER + 2, 0)
            part, skip = c[back : at + CHUNK + 1], at + 1 - back
            total += self.log_probability(part, skip)
            n += len(part) - skip
        return -total / max(n, 1)

    def log_probability(self, c: np.ndarray, skip: int = 1) -> np.ndarray:
        """By language, of the characters from skip on, each after up to ORDER - 1 before it."""
        total = self.floor * (len(c) - skip)
        for n, (h, g) in enumerate(zip(gram_hashes(c), self.grams, strict=True), 1):
            begin = max(skip - n, 0)  # of the first n-gram that is a context of a character counted, or ends with one
            at, end = g.places(h[begin:]), begin + n - 1
            if not len(at):
                break
            # rest counts for contexts alone, not at the last place; gain not at the place before the first counted
            total = total + g.sums(at, g.both, len(total)) - g.sums(at[-1:], g.rest, len(total)) - g.sums(at[: max(skip - end, 0)], g.gain, len(total))
        return total


def _count(docs: DataFrame) -> DataFrame:
    """(lang, n, gram, ctx, low, c): n-grams of the training texts, counted in each task before the shuffle."""

    def run(batches):
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                every = [gram_hashes(codes(t)) for t in texts]
                for n in range(1, ORDER + 1):
                    h = np.concatenate([g[n - 1] for g in every])
                    none = np.zeros(len(h), np.uint64)
                    ctx = none if n == 1 else np.concatenate([g[n - 2][: len(g[n - 1])] for g in every])
                    low = none if n == 1 else np.concatenate([g[n - 2][1 : len(g[n - 1]) + 1] for g in every])
                    gram, first, count = np.unique(h, return_index=True, return_counts=True)
                    yield pd.DataFrame({"lang": lang, "n": n, "gram": gram.view(np.int64), "ctx": ctx[first].view(np.int64), "low": low[first].view(np.int64), "c": count})

    counted = docs.select("lang", "text").mapInPandas(run, "lang string, n int, gram long, ctx long, low long, c long")
    return counted.groupBy("lang", "n", "gram", "ctx", "low").agg(F.sum("c").alias("c"))


def _language(own: dict[int, tuple[np.ndarray, ...]]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], float]:
    """(hashes, gain, rest) by length, and the floor, from one language's (gram, ctx, low, c) by length, sorted by gram.

    Counts at full length, numbers of distinct left neighbours below. A gain is log p less what the context leaves to
    the shorter n-gram, rest is the log of the share that an n-gram, as a context, leaves to shorter ones.
    """
    rest = {n: np.zeros(len(own[n][0])) for n in own}
    out, shorter, floor = [], np.zeros(0), float(-np.log(ALPHABET))
    for n in range(1, ORDER + 1):
        gram, ctx, low, c = own[n]
        if n == ORDER:
            seen = c.astype(float)
        else:
            seen = np.zeros(len(gram))
            if len(own[n + 1][0]):
                left, times = np.unique(own[n + 1][2], return_counts=True)
                seen[np.searchsorted(gram, left)] = times
        if n == 1:
            total, kinds = seen.sum(), (seen > 0).sum()
            if total:
                floor = float(np.log(DISCOUNT * kinds / total / ALPHABET))
            p = (np.maximum(seen - DISCOUNT, 0) + np.exp(floor) * total) / total if total else np.full(len(gram), 1 / ALPHABET)
            gain = np.log(p) - floor
        else:
            group, back = np.unique(ctx, return_inverse=True)
            total, kinds = np.bincount(back, seen, len(group)), np.bincount(back, seen > 0, len(group))
            share = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            rest[n - 1][np.searchsorted(own[n - 1][0], group)] = np.log(share)
            below = share[back] * shorter[np.searchsorted(own[n - 1][0], low)]
            p = np.where(total[back] > 0, np.maximum(seen - DISCOUNT, 0) / np.maximum(total[back], 1), 0) + below
            gain = np.log(p) - np.log(below)
        out.append((gram, gain, n))
        shorter = p
    return [(gram, gain, rest[n]) for gram, gain, n in out], floor


def _model(counts: pd.DataFrame, languages: list[str]) -> Model:
    """Interpolated Kneser-Ney of each language, laid out by n-gram."""
    each, floor = [], np.zeros(len(languages))
    by = dict(list(counts.groupby(["lang", "n"])))
    for j, lang in enumerate(languages):
        own = {}
        for n in range(1, ORDER + 1):
            rows = by.get((lang, n), counts.iloc[:0])
            order = np.argsort(rows["gram"].to_numpy().view(np.uint64))
            own[n] = (*[rows[k].to_numpy().view(np.uint64)[order] for k in ("gram", "ctx", "low")], rows["c"].to_numpy()[order])
        parts, floor[j] = _language(own)
        each.append(parts)
    return Model(languages, [_laid([e[n] for e in each]) for n in range(ORDER)], floor, np.full(len(languages), np.inf), 1.0)


def _laid(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Grams:
    h, gain, rest = (np.concatenate([np.zeros(0, kind), *[p[i] for p in parts]]) for i, kind in enumerate((np.uint64, float, float)))
    lang = np.repeat(np.arange(len(parts)), np.array([len(p[0]) for p in parts], np.int64))
    order = np.lexsort((lang, h))
    keys, first = np.unique(h[order], return_index=True)
    return Grams(keys, np.append(first, len(h)), lang[order], gain[order], rest[order])


def learn(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model of docs(doc_id, text, lang); rows without lang or text are left out.

    Learned from is a bounded sample, by a hash of the text: about the given number of texts of each language, of about
    the given number of characters in all languages. Whole texts, each once in a language, under whatever ids and however
    often; a very long one comes after the others. A fifth of the sample, none of a language with one text, is kept out
    of the counts; it sets the rejection limits and the sharpness of scores.
    """
    known = docs.where("lang is not null and text is not null").select("lang", "text")
    languages = sorted(r.lang for r in known.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    if not languages:
        return Model([], [_laid([])] * ORDER, np.zeros(0), np.zeros(0), 1.0)
    sample = sampled(known, "lang", rows, chars // len(languages))
    least = F.min(F.xxhash64("text")).over(Window.partitionBy("lang"))  # a sample's language is bounded
    chosen = keep(sample.withColumn("apart", (F.pmod(F.xxhash64("text", F.lit(12)), F.lit(5)) == 0) & (F.xxhash64("text") != least)))
    model = _model(local(_count(chosen.where("not apart"))), languages)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "h": [held.value.entropies(t).tolist() for t in b["text"]]})

    tried = chosen.where("apart").select("lang", "text").mapInPandas(run, "lang string, h array<double>").toPandas()
    if len(tried):
        h, y = np.array(tried.h.tolist()), np.searchsorted(languages, tried.lang.to_numpy(dtype=str))
        for j in range(len(languages)):
            if (y == j).sum() >= 20:
                model.limit[j] = float(np.quantile(h[y == j, j], REJECT)) * 1.1
        heats = np.geomspace(0.5, 500, 40)
        loss = [-(np.log(np.maximum(_softmax(-h * t)[np.arange(len(y)), y], 1e-9))).mean() for t in heats]
        model.heat = float(heats[int(np.argmin(loss))])
    held.unpersist()
    return model


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


UNKNOWN = "und"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) for every row: whole texts, one pass, no shuffle.

    und, with score 0, where the text is null or has no letter or nothing was learned. rejected: the best language's
    cross-entropy is beyond what all but a thousandth of its own texts reach, or the text is und.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's characters

    def make():
        own = held.value

        def one(t):
            if not own.languages or not has_letter(t):
                return UNKNOWN, 0.0, None, True
            h = own.entropies(t)
            j = int(np.argmin(h))
            return own.languages[j], float(_softmax(-h[None] * own.heat)[0, j]), float(h[j]), bool(h[j] > own.limit[j])

        return lambda texts: [one(t) for t in texts]

    return by_text(docs, make, "lang_pred string, score double, cross_entropy double, rejected boolean", "doc_id")


def predict(docs: DataFrame) -> DataFrame:
    """identify() with held_out; only rows outside the held-out fifth are learned from.

    An empty table gives no rows; without a language to learn, all are und. Rows that repeat are judged alike and learned
    from once; rows without an id are learned from. Columns besides doc_id, text and lang aren't read.
    """
    model = learn(docs.where(fold(F.col("doc_id"), 5) != 0))
    return identify(docs, model).withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
