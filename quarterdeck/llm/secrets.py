"""Secret scans by a linear-chain conditional random field.

Words are tagged as the begin of a secret, inside one, or outside, from their shape, their neighbours and what holds of
the file as a whole. The field is trained here by maximum likelihood on a bounded sample of texts, in which patterns of
well-known secrets mark the tags; it then finds words of like shape and surroundings that no pattern matches. Viterbi
decodes each line; lines in which no word comes near the outside tag's lead are all outside by a bound, and skipped.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, keep, local

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: The sample that the field is fitted on, by hashes of texts and lines: rows among which texts are looked for, texts with
#: a pattern's match and as many without, and words of lines with a tag and as many of lines without, all about. Lines are
#: taken whole, in order of their hashes, until the words are reached.
LOOK_ROWS, TRAIN_DOCS, TRAIN_WORDS = 2_000_000, 1500, 50_000
STEPS = 80
#: Log-odds by which a line's best tags must lead outside throughout, for spans of the field's own.
LEAD = 2.0
MEMO = 200_000
WORD = re.compile(r"\S+")
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, by start, then kind as listed."""
    out, low = [], text.lower()
    if any(k in low for k in ("password", "passwd", "secret", "token", "apikey", "api_key")) and ("=" in text or ":" in text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _class(word: str) -> int:
    """Kind of character of each sort that is present, length, mixing and a keyword flag, as one number under SHAPES."""
    digits = sum(c.isdigit() for c in word)
    lower, upper = sum("a" <= c <= "z" for c in word), sum("A" <= c <= "Z" for c in word)
    other = 3 if "@" in word or "://" in word else min(len(word) - digits - lower - upper, 2)  # an address of some kind
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(word[:-1], word[1:], strict=True)) if digits else 0
    key = any(k in word.lower() for k in ("password", "passwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential"))
    mark = "=" in word or ":" in word
    length = 0 if len(word) < 8 else 1 if len(word) < 12 else 2 if len(word) < 16 else 3 if len(word) < 24 else 4
    mix = 0 if not digits else 1 if digits == len(word) else 2 if changes < 3 else 3
    return ((((length * 4 + mix) * 3 + min(upper, 2)) * 2 + (lower > 0)) * 4 + other) * 4 + 2 * key + mark


SHAPES = 5 * 4 * 3 * 2 * 4 * 4
PAD = SHAPES  # before the first and after the last word of a line
FILE = 4


def _design() -> np.ndarray:
    """Features of each shape: every part on its own, length with mixing, length with mixing and case, and no word."""
    at = np.arange(SHAPES)
    flags, rest = at % 4, at // 4
    other, rest = rest % 4, rest // 4
    lower, rest = rest % 2, rest // 2
    upper, rest = rest % 3, rest // 3
    mix, length = rest % 4, rest // 4
    parts = [(flags, 4), (other, 4), (lower, 2), (upper, 3), (mix, 4), (length, 5), (length * 4 + mix, 20), ((length * 4 + mix) * 4 + 2 * lower + (upper > 0), 80)]
    blocks = [np.vstack([np.eye(n)[x], np.zeros(n)]) for x, n in parts]
    return np.hstack([*blocks, np.eye(SHAPES + 1)[:, [PAD]]])


def file_class(text: str) -> int:
    """What holds of the whole file: it has assignments or braces; it is long."""
    return 2 * any(c in text for c in "={};") + (len(text) > 4000)


@dataclass
class Field:
    own: np.ndarray  # shape, tag
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    step: np.ndarray  # tag, tag
    first: np.ndarray

    def emissions(self, shapes: np.ndarray, left: np.ndarray, right: np.ndarray, file: int) -> np.ndarray:
        return self.own[shapes] + self.before[left] + self.after[right] + self.file[file]


#: A secret's inside follows its begin or inside only.
FORBID = -1e4


def _neighbours(shapes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes of the word before and after within a line; starts: where lines begin."""
    left, right = np.empty_like(shapes), np.empty_like(shapes)
    left[1:], right[:-1] = shapes[:-1], shapes[1:]
    left[starts] = PAD
    right[np.append(starts[1:], len(shapes)) - 1] = PAD
    return left, right


def viterbi(field: Field, e: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tags of one line, and by how much their score leads that of outside throughout."""
    n = len(e)
    score, back = field.first + e[0], np.zeros((n, 3), np.int64)
    for t in range(1, n):
        all_ = score[:, None] + field.step
        back[t] = all_.argmax(axis=0)
        score = all_.max(axis=0) + e[t]
    tags = np.zeros(n, np.int64)
    tags[-1] = int(score.argmax())
    for t in range(n - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    outside = field.first[OUT] + e[:, OUT].sum() + (n - 1) * field.step[OUT, OUT]
    return tags, float(score.max() - outside)


#: Strength of the ridge on each group of weights: what surrounds a word counts less than the word itself.
RIDGES = {"own": 0.2, "before": 8.0, "after": 8.0, "file": 8.0, "step": 1.0, "first": 1.0}


def descend(value_and_slope, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """The least of a smooth convex function, by limited-memory BFGS with halved steps."""
    f, g = value_and_slope(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, coef = -g, []
        for s, y in reversed(pairs):
            coef.append(s @ d / (s @ y))
            d = d - coef[-1] * y
        if pairs:
            d = d * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]))
        for (s, y), c in zip(pairs, reversed(coef), strict=True):
            d = d + (c - y @ d / (s @ y)) * s
        rate = 1.0 if pairs else min(1.0, 1 / max(np.abs(g).sum(), 1e-12))
        while rate > 1e-10:
            to = x + rate * d
            f2, g2 = value_and_slope(to)
            if f2 <= f + 1e-4 * rate * (g @ d):
                break
            rate /= 2
        else:
            return x
        if (to - x) @ (g2 - g) > 1e-12:
            pairs = [*pairs[1 - memory :], (to - x, g2 - g)]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        x, f, g = to, f2, g2
        if done:
            break
    return x


def lattice(moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of a chain of steps(word, tag before, tag): each word's shares of tags and of pairs of tags, and the log-sum of all paths.

    The chain is cut into blocks: products over each block's paths first, for all blocks at once, then from block to
    block, then within blocks. So long lines take no longer than many short ones. Every product is scaled to one.
    """
    n = len(moves)
    width = int(np.ceil(np.sqrt(n)))
    most = moves.max(axis=(1, 2))
    m = np.concatenate([np.exp(moves - most[:, None, None]), np.broadcast_to(np.eye(3), (-n % width, 3, 3))]).reshape(-1, width, 3, 3)
    whole = m[:, 0]
    for t in range(1, width):
        whole = whole @ m[:, t]
        whole = whole / whole.reshape(-1, 9).max(axis=1)[:, None, None]
    blocks = len(m)
    at, after = np.full((blocks, 3), 1 / 3), np.ones((blocks, 3))  # the first word begins a line: what is before it doesn't matter
    for b in range(1, blocks):
        step = at[b - 1] @ whole[b - 1]
        at[b] = step / step.sum()
    for b in range(blocks - 1, 0, -1):
        step = whole[b] @ after[b]
        after[b - 1] = step / step.max()
    before, alpha, beta, scale = (np.empty((blocks, width, *k)) for k in ((3,), (3,), (3,), ()))
    for t in range(width):
        before[:, t] = at
        at = (at[:, None] @ m[:, t])[:, 0]
        scale[:, t] = at @ np.ones(3)
        at = alpha[:, t] = at / scale[:, t, None]
    beta[:, -1] = after
    for t in range(width - 1, 0, -1):
        after = (m[:, t] @ after[:, :, None])[:, :, 0]
        after = beta[:, t - 1] = after / after.max(axis=1)[:, None]
    one, two = alpha * beta, before[..., None] * m * beta[:, :, None]
    one, two = one.reshape(-1, 3)[:n], two.reshape(-1, 9)[:n]
    total = float(most.sum() + np.log(scale).sum())
    return one / one.sum(axis=1)[:, None], (two / two.sum(axis=1)[:, None]).reshape(-1, 3, 3), total


def objective(lines: list[tuple[np.ndarray, np.ndarray, int]]):
    """(value and slope of the negative log-likelihood with its ridge, number of weights, the field of given weights).

    Lines are (shapes, tags, file class). They stand one behind the other as one chain, in which a line's first word
    doesn't depend on what is before it; so the log-sum over all paths is that of the lines together.
    """
    design = _design()
    wide = design.shape[1]
    sizes = {"own": (wide, 3), "before": (wide, 3), "after": (wide, 3), "file": (FILE, 3), "step": (3, 3), "first": (3,)}
    ends = np.cumsum([int(np.prod(n)) for n in sizes.values()])
    parts = lambda v: {k: p.reshape(n) for (k, n), p in zip(sizes.items(), np.split(v, ends[:-1]), strict=True)}
    pull = np.concatenate([np.full(int(np.prod(n)), RIDGES[k]) for k, n in sizes.items()])

    def whole(v: np.ndarray) -> Field:
        w = parts(v)
        step, first = w["step"].copy(), w["first"].copy()
        step[OUT, INSIDE], first[INSIDE] = FORBID, FORBID
        return Field(design @ w["own"], design @ w["before"], design @ w["after"], w["file"], step, first)

    lengths = np.array([len(s) for s, _, _ in lines], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    shapes, tags = (np.concatenate([line[i] for line in lines]) if lines else np.zeros(0, np.int64) for i in (0, 1))
    before, after = _neighbours(shapes, starts) if lines else (shapes, shapes)
    places = {"own": shapes, "before": before, "after": after, "file": np.repeat(np.array([f for *_, f in lines], dtype=np.int64), lengths)}
    begins = np.zeros(len(shapes), bool)
    begins[starts] = True
    inner = np.flatnonzero(~begins)
    told = np.eye(3)[tags]
    pairs = told[inner - 1].T @ told[inner]

    def value_and_slope(v: np.ndarray) -> tuple[float, np.ndarray]:
        w = whole(v)
        e = sum(getattr(w, k)[at] for k, at in places.items())
        moves = np.where(begins[:, None, None], w.first, w.step) + e[:, None, :]
        one, two, norm = lattice(moves)
        diff = one - told
        value = norm - (e * told).sum() - w.first[tags[starts]].sum() - (pairs * w.step).sum()
        slope = {"first": diff[starts].sum(axis=0)}
        for k, at in places.items():
            by = np.column_stack([np.bincount(at, diff[:, j], FILE if k == "file" else SHAPES + 1) for j in range(3)])
            slope[k] = by if k == "file" else design.T @ by
        slope["step"] = two[inner].sum(axis=0) - pairs
        slope["step"][OUT, INSIDE] = slope["first"][INSIDE] = 0
        return float(value + (pull * v * v).sum() / 2), np.concatenate([slope[k].ravel() for k in sizes]) + pull * v

    return value_and_slope, int(ends[-1]), whole


def fit(lines: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS) -> Field:
    """Maximum likelihood with a ridge; lines are (shapes, tags, file class), none of them empty."""
    value_and_slope, n, whole = objective(lines)
    if not lines:
        field = whole(np.zeros(n))
        field.own[:, OUT] = 1e3
        return field
    return whole(descend(value_and_slope, np.zeros(n), steps))


class Lines:
    """Words of a text with their shapes, places and the line each is in."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def shapes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Shapes of all words, and where lines begin among them."""
        memo, all_, starts, n = self.memo, [], [], 0
        if len(memo) > MEMO:
            memo.clear()
        for line in text.split("\n"):
            words = line.split()
            if words:
                starts.append(n)
                n += len(words)
                all_ += words
        for w in set(all_).difference(memo):
            memo[w] = _class(w)
        return np.fromiter((memo[w] for w in all_), np.int64, n), np.array(starts, dtype=np.int64)


def _places(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in WORD.finditer(text)]


def training_lines(text: str) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The lines of a text with tags from the patterns: a word that holds any of a match's value is part of the secret.

    The words that announce a value are its neighbours, not the secret.
    """
    shapes, starts = Lines().shapes(text)
    if not len(shapes):
        return []
    places, tags = _places(text), np.zeros(len(shapes), np.int64)
    if len(places) != len(shapes):
        return []
    begins = np.array([p for p, _ in places])
    for s, e, kind in base_spans(text):
        if kind == "assign":
            s = ASSIGN.match(text, s).start(2)
        i = max(int(np.searchsorted(begins, s, "right")) - 1, 0)
        if not tags[i]:
            tags[i] = BEGIN
        i += 1
        while i < len(places) and places[i][0] < e:
            if not tags[i]:
                tags[i] = INSIDE
            i += 1
    file, bounds = file_class(text), [*starts.tolist(), len(shapes)]
    return [(shapes[a:b], tags[a:b], file) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def learn(docs: DataFrame, rows: int = TRAIN_DOCS, words: int = TRAIN_WORDS) -> Field:
    """A field fitted on about rows texts with a pattern in them and as many others, whole texts of any length.

    They are chosen by a hash of the text among about LOOK_ROWS rows, in one scan; equal texts are one, under whatever
    ids. The lines of these texts, tagged and untagged ones apart, are learned from in order of a hash until the words
    are reached. Null texts are left out; of an empty table the field finds nothing.
    """
    n = docs.count()
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    marked = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}")
    looked = docs.where("text is not null").select(place.alias("k"), "text").where(F.col("k") < LOOK_ROWS / max(n, 1)).withColumn("m", marked)
    looked = keep(looked.where(F.col("m") | (F.col("k") < 2 * rows / max(n, 1))))
    times = {r.m: r.n for r in looked.groupBy("m").agg(F.countDistinct("k").alias("n")).collect()}
    highest = {r.m: r.k for r in looked.groupBy("m").agg(F.max("k").alias("k")).collect()}
    share = lambda m: highest.get(m, 0.0) * min(1.0, rows / max(times.get(m, 0), 1)) + 1e-12
    texts = looked.where(F.col("k") < F.when(F.col("m"), share(True)).otherwise(share(False))).groupBy("k").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            out = [(bool(t.any()), len(s), zlib.crc32(s.tobytes() + t.tobytes()), s.tolist(), t.tolist(), f) for text in b["text"] for s, t, f in training_lines(text)]
            yield pd.DataFrame(out, columns=["tagged", "n", "h", "s", "t", "f"])

    lines = keep(texts.mapInPandas(run, "tagged boolean, n long, h long, s array<int>, t array<int>, f int"))
    upto = F.sum("n").over(Window.partitionBy("tagged").orderBy("h", "n").rowsBetween(Window.unboundedPreceding, -1))  # of the sample alone
    got = local(lines.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < words).select("s", "t", "f"))
    chosen = [(np.asarray(s), np.asarray(t), int(f)) for s, t, f in zip(got["s"], got["t"], got["f"], strict=True)]
    return fit(sorted(chosen, key=lambda x: (len(x[0]), x[0].tolist(), x[1].tolist(), x[2])))


def field_spans(field: Field, lines: Lines, text: str, lead: float = LEAD) -> list[tuple[int, int, str]]:
    """Spans of words that the field tags as secret, in whole texts."""
    shapes, starts = lines.shapes(text)
    if not len(shapes):
        return []
    left, right = _neighbours(shapes, starts)
    e = field.emissions(shapes, left, right, file_class(text))
    slack = 2 * float(max(field.step.max() - field.step[OUT, OUT], 0)) + float(max(field.first.max() - field.first[OUT], 0))  # that a word's tag gains by its steps
    near = np.flatnonzero(e[:, 1:].max(axis=1) - e[:, OUT] > -slack)
    if not len(near):
        return []
    ends, out, places = np.append(starts[1:], len(shapes)), [], None
    for i in np.unique(np.searchsorted(starts, near, "right") - 1).tolist():
        a, b = int(starts[i]), int(ends[i])
        tags, gain = viterbi(field, e[a:b])
        if gain < lead or not tags.any():
            continue
        places = places or _places(text)
        at = 0
        while at < b - a:
            if tags[at] == BEGIN:
                stop = at + 1
                while stop < b - a and tags[stop] == INSIDE:
                    stop += 1
                out.append((places[a + at][0], places[a + stop - 1][1], "crf"))
                at = stop
            else:
                at += 1
    return out


def _covered(span: tuple[int, int, str], base: list[tuple[int, int, str]]) -> bool:
    """Whether the base spans, by start, leave nothing of the span."""
    at = span[0]
    for s, e, _ in base:
        if s <= at < e:
            at = e
    return at >= span[1]


def find(field: Field, lines: Lines, text: str | None) -> tuple[list, list]:
    """Base spans, and those of the field that hold more than base spans do; the two may overlap."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [s for s in field_spans(field, lines, text) if not _covered(s, base)]
    return base, more


def _join(spans) -> str:
    order = (*KINDS, "crf")
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order.index(x[2]))))


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """A row for each of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans. Whole texts, no shuffle.

    Null texts are empty and have no spans; repeated rows get the same result; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(field)  # weights of a fixed number of shapes

    def make():
        lines = Lines()

        def one(t):
            base, more = find(held.value, lines, t)
            n = [sum(s[2] == k for s in base) for k in KINDS]
            return (*n, hashlib.sha256(_join(base).encode()).hexdigest(), _join(base + more))

        return lambda texts: [one(t) for t in texts]

    return by_text(docs, make, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", "doc_id")


MASK = "<secret>"


def redact(docs: DataFrame, field: Field, column: str = "text") -> DataFrame:
    """docs with every found span of the text replaced by a mask; all columns and rows stay."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def mask(lines: Lines, text: str | None) -> str | None:
        base, more = find(held.value, lines, text)
        if not base and not more:
            return text
        out, at = [], 0
        for s, e, _ in sorted(base + more):
            if e <= at:
                continue
            out += [text[at:s], MASK] if s >= at else []
            at = e
        return "".join(out) + text[at:]

    def run(batches):
        lines = Lines()
        for b in batches:
            i = b.schema.get_field_index(column)
            yield b.set_column(i, b.schema.field(i), pa.array([mask(lines, t) for t in b.column(i).to_pylist()], b.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
