"""Models refitted along a calendar: logistic regression and boosted regression trees, all dates at once.

A fit learns from all rows known at its refit date. Rows stay where they are: bins' edges are exact quantiles found by
counts, a regression's sums come from all tasks, and trees see how many rows lie in each cell of bins, which is all that
they need. A fit is a row of plain arrays; predictions are made where the rows are, with the fits of all dates.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.kept import kept
from .risk import auc, auc_pooled, average_rank, hac_mean

#: Bins of a feature in the search for splits; values of a range in the search for their edges, about; rows that a task takes at once, about.
BINS, PIECE_ROWS, BATCH_ROWS = 64, 500_000, 200_000
DEPTH = 3
#: Rounds, step, least weight of a leaf, ridge, and shares of rows and features that a tree sees.
RANKED = {"rounds": 300, "eta": 0.03, "least": 50.0, "ridge": 5.0, "share": 0.8, "squared": True}
CLASSED = {"rounds": 200, "eta": 0.05, "least": 20.0, "ridge": 5.0, "share": 0.8, "squared": False}
TREES = "k int, feature array<int>, cut array<double>, leaf array<double>, gain array<double>"
NAMES = ["at", "n_train", "dates", "base", "coef", "feature", "cut", "leaf", "gain"]


def _sums(x: np.ndarray, y: np.ndarray, mean: np.ndarray, sd: np.ndarray, w: np.ndarray) -> np.ndarray:
    """[gradient, curvature by rows] of the log-likelihood at w, a missing value standing at its mean."""
    z = np.c_[np.ones(len(x)), np.nan_to_num((x - mean) / sd)]
    p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
    return np.concatenate([z.T @ (y - p), ((z.T * (p * (1 - p))) @ z).ravel()])


def _newton(sums: np.ndarray, mean: np.ndarray, sd: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The next w, and the fit where it stands: nulls where no maximum is found."""
    none, k = np.full(2 * len(w) - 1, np.nan), len(w)
    try:
        step = np.linalg.solve(sums[k:].reshape(k, k), sums[:k])
    except np.linalg.LinAlgError:
        return w, none
    w = w + step
    if np.abs(w).max() > 50:
        return w, none
    slopes = w[1:] / sd
    return w, np.concatenate([[w[0] - slopes @ mean], slopes, mean]) if np.abs(step).max() < 1e-10 else None


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """[constant, slopes, means] in the features' units, a missing one standing at its mean; null where no maximum is found.

    The plain form for rows at hand; _logistics does the same for many groups of a table.
    """
    mean = np.array([np.nanmean(c) if np.isfinite(c).any() else 0.0 for c in x.T])
    sd = np.array([np.nanstd(c, ddof=1) if np.isfinite(c).sum() > 1 else 1.0 for c in x.T])
    sd[~(sd > 0)] = 1.0
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        w, made = _newton(_sums(x, y, mean, sd, w), mean, sd, w)
        if made is not None:
            return made
    return np.full(2 * len(w) - 1, np.nan)


def boosted(x: np.ndarray, y: np.ndarray, rounds: int, eta: float, least: float, ridge: float, share: float, squared: bool, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(feature, cut, leaf, gain): trees of DEPTH levels by second-order gain; a row goes right above the cut, a missing value left.

    feature is -1 where a node isn't split. The same rows in the same order give the same trees.
    """
    edges = [_cuts(np.quantile(c[np.isfinite(c)], QUANTILES)) if np.isfinite(c).any() else np.zeros(0) for c in x.T]
    return _boosted(_codes(x, edges), edges, y, np.ones(len(y), np.int64), rounds, eta, least, ridge, share, squared, seed)


QUANTILES = np.linspace(0, 1, BINS + 1)[1:-1]


def _cuts(values: np.ndarray) -> np.ndarray:
    return np.unique(values)


def _codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A line for each feature: 0 where it is missing, else one more than the number of edges below the value."""
    return np.array([np.where(np.isfinite(c), np.searchsorted(e, c) + 1, 0) for c, e in zip(x.T, edges, strict=True)]).reshape(len(edges), len(x))


def _boosted(code: np.ndarray, edges: list[np.ndarray], y: np.ndarray, count: np.ndarray, rounds: int, eta: float, least: float, ridge: float, share: float, squared: bool, seed: int = 0) -> tuple[np.ndarray, ...]:
    """boosted for cells of count equal rows each: rows of the same codes and target count alike, a tree sees each of them by share."""
    rng, nodes = np.random.default_rng(seed), (1 << DEPTH) - 1
    feature, cut, leaf = np.full((rounds, nodes), -1), np.zeros((rounds, nodes)), np.zeros((rounds, nodes + 1))
    gain, margin, width = np.zeros(len(code)), np.zeros(len(y)), BINS + 2
    if not squared:
        rate = np.clip((count * y).sum() / count.sum(), 1e-6, 1 - 1e-6)
        margin += np.log(rate / (1 - rate))
    for t in range(rounds):
        p = margin if squared else 1 / (1 + np.exp(-margin))
        g, h = p - y, np.ones(len(y)) if squared else p * (1 - p)
        seen = rng.binomial(count, share) if share < 1 else count
        tried = np.sort(rng.permutation(len(code))[: max(1, math.ceil(share * len(code)))])
        gs, hs, at = seen * g, seen * h, np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n = (1 << level) - 1, 1 << level
            best, where = np.full(n, 1e-12), np.full((n, 2), -1)
            for f in tried:
                key = at * width + code[f]
                left_g, left_h = (np.bincount(key, v, n * width).reshape(n, width).cumsum(axis=1) for v in (gs, hs))
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                right_g, right_h = all_g - left_g, all_h - left_h
                won = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - all_g**2 / (all_h + ridge)
                won = np.where((left_h >= least) & (right_h >= least), won, 0.0)[:, 1 : len(edges[f]) + 1]
                if won.shape[1]:
                    k = won.argmax(axis=1)
                    top = won[np.arange(n), k]
                    better = top > best
                    best, where[better] = np.where(better, top, best), np.c_[np.full(n, f), k][better]
            for node in np.flatnonzero(where[:, 0] >= 0):
                f, k = where[node]
                feature[t, first + node], cut[t, first + node] = f, edges[f][k]
                gain[f] += best[node]
            right = np.zeros(len(y), bool)
            for f in np.unique(where[where[:, 0] >= 0, 0]):
                right |= code[f] > np.where(where[:, 0] == f, where[:, 1] + 1, width)[at]
            at = 2 * at + right
        sums = [np.bincount(at, v, nodes + 1) for v in (gs, hs)]
        leaf[t] = -eta * sums[0] / (sums[1] + ridge)
        margin += leaf[t][at]
        if (feature[t] < 0).all():
            return feature[: t + 1], cut[: t + 1], leaf[: t + 1], gain
    return feature, cut, leaf, gain


def grown(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Sum of all trees' leaves for each row."""
    out, rows = np.zeros(len(x)), np.arange(len(x))
    for f, c, v in zip(feature, cut, leaf, strict=True):
        at = np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            node = at + (1 << level) - 1
            with np.errstate(invalid="ignore"):
                at = 2 * at + ((f[node] >= 0) & (x[rows, np.maximum(f[node], 0)] > c[node]))
        out += v[at]
    return out


def _back(at: dt.date, months: int) -> dt.date:
    """The same day so many months before; a month's end stays one."""
    y, m = divmod(at.year * 12 + at.month - 1 - months, 12)
    end = dt.date(y + (m + 1) // 12, (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)
    return end if (at + dt.timedelta(days=1)).day == 1 else min(end, end.replace(day=min(at.day, end.day)))


def schedule(rows: DataFrame, months: int, least: int, every: int = 1) -> dict[dt.date, tuple[dt.date, dt.date]]:
    """For each date of rows(month): the refit that serves it, and the last month known there.

    A refit learns from rows that are the given months older (0: from all dates before it), if they are of at least so
    many dates; a date with a refit less than every dates back takes that one. As many rows as months reach the driver.
    """
    dates = sorted(r.month for r in rows.select("month").where("month is not null").distinct().collect())
    out, last = {}, None
    for k, at in enumerate(dates):
        until = _back(at, months) if months else dates[k - 1] if k else at - dt.timedelta(days=1)
        if sum(d <= until for d in dates[:k]) < least:
            continue
        if last is None or k - last[0] >= every:
            last = k, at, until
        out[at] = last[1:]
    return out


def _batches(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a task, so many at once that numpy is at work and not its calls."""
    held, rows = [], 0
    for pdf in pdfs:
        held.append(pdf)
        rows += len(pdf)
        if rows >= BATCH_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, rows = [], 0
    if rows:
        yield pd.concat(held, ignore_index=True)


def _own(part: np.ndarray, groups: list[frozenset[int]]) -> Iterator[tuple[int, np.ndarray]]:
    """Each group that has some of the rows, and which."""
    parts, at = np.unique(part, return_inverse=True)
    for k, g in enumerate(groups):
        of = np.array([p in g for p in parts.tolist()], bool)
        if of.any():
            yield k, of[at]


def _moments(lines: list[Row], i: int) -> tuple[float, float]:
    """(mean, deviation) of the i-th feature over parts; 0 or 1 where there is none."""
    lines = [r for r in lines if r[f"n{i}"]]
    n = sum(r[f"n{i}"] for r in lines)
    if not n:
        return 0.0, 1.0
    if min(r[f"lo{i}"] for r in lines) == max(r[f"hi{i}"] for r in lines):
        return lines[0][f"lo{i}"], 1.0
    mean = math.fsum(r[f"n{i}"] * r[f"mean{i}"] for r in lines) / n
    return mean, math.sqrt(math.fsum(r[f"n{i}"] * (r[f"var{i}"] + (r[f"mean{i}"] - mean) ** 2) for r in lines) / (n - 1))


def _logistics(known: DataFrame, groups: list[frozenset[int]], features: list[str], moments: list[tuple[np.ndarray, np.ndarray]], rounds: int = 50) -> list[np.ndarray]:
    """logistic for each group, all at once: a step of Newton's goes through all rows once; sums of fixed size come to the driver."""
    w, out = [np.zeros(len(features) + 1) for _ in groups], [np.full(2 * len(features) + 1, np.nan) for _ in groups]
    active = list(range(len(groups)))
    for _ in range(rounds):
        if not active:
            break
        asked = [(groups[k], *moments[k], w[k]) for k in active]

        def run(pdfs: Iterator[pd.DataFrame], asked=asked) -> Iterator[pd.DataFrame]:
            sums = {}
            for b in _batches(pdfs):
                x, y = b[features].to_numpy(float), b["y"].to_numpy(float)
                for j, own in _own(b["part"].to_numpy(), [a[0] for a in asked]):
                    sums[j] = sums.get(j, 0.0) + _sums(x[own], y[own], *asked[j][1:])
            if sums:
                yield pd.DataFrame({"j": list(sums), "task": TaskContext.get().partitionId(), "sums": list(sums.values())})

        total = {}
        for r in sorted(known.select("part", *features, "y").mapInPandas(run, "j int, task int, sums array<double>").collect(), key=lambda r: (r.j, r.task)):
            total[r.j] = total.get(r.j, 0.0) + np.array(r.sums)
        going = []
        for j, k in enumerate(active):
            w[k], made = _newton(total[j], *moments[k], w[k])
            if made is None:
                going.append(k)
            else:
                out[k] = made
        active = going
    return out


def _edges(known: DataFrame, groups: list[frozenset[int]], features: list[str], rows: int) -> list[list[np.ndarray]]:
    """For each group and feature the distinct quantiles of all its values, as np.quantile has them.

    Values are counted by part and dealt into ranges; counts by range tell in which range each wanted place lies, and the
    value is looked up there. Counts by range and part, and the values at the wanted places, come to the driver.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("value")) for i, c in enumerate(features)]))
    values = known.select("part", each.alias("x")).select("x.f", "part", "x.value").where("value is not null").groupBy("f", "part", "value").agg(F.count("*").alias("n"))
    pieces = max(1, math.ceil(rows * len(features) / PIECE_ROWS))
    ranged = kept(values.repartitionByRange(pieces, "f", "value").withColumn("piece", F.spark_partition_id()))  # where ranges end changes no result
    counts = {}
    for r in ranged.groupBy("f", "piece", "part").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r.f, {}).setdefault(r.piece, {})[r.part] = r.n
    places, wanted = {}, {}
    for k, g in enumerate(groups):
        for f, by in counts.items():
            order = sorted(by)
            ends = np.cumsum([sum(n for p, n in by[piece].items() if p in g) for piece in order])
            if ends[-1]:
                at = QUANTILES * (ends[-1] - 1)
                places[k, f] = at
                low = np.floor(at).astype(np.int64)
                for rank in np.unique(np.concatenate([low, np.minimum(low + 1, ends[-1] - 1)])).tolist():
                    j = int(np.searchsorted(ends, rank, side="right"))
                    wanted.setdefault((f, order[j]), {}).setdefault(k, []).append((rank, rank - (int(ends[j - 1]) if j else 0)))

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        asked, out = wanted.get((int(key[0]), int(key[1])), {}), []
        pdf = pdf.sort_values("value", kind="stable")
        part, value, n = (pdf[c].to_numpy() for c in ("part", "value", "n"))
        for k, own in _own(part, [groups[k] for k in asked]):
            k = list(asked)[k]
            rank, place = np.array(asked[k]).T
            out.append(pd.DataFrame({"k": k, "f": int(key[0]), "rank": rank, "value": value[own][np.searchsorted(np.cumsum(n[own]), place, side="right")]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["k", "f", "rank", "value"], dtype=float)

    found = {}
    for r in ranged.groupBy("f", "piece").applyInPandas(pick, "k int, f int, rank long, value double").collect():
        found.setdefault((r.k, r.f), {})[r.rank] = r.value
    out = [[np.zeros(0) for _ in features] for _ in groups]
    for (k, f), at in places.items():
        have = found[k, f]
        low = np.floor(at).astype(np.int64)
        a, b, t = np.array([have[r] for r in low.tolist()]), np.array([have.get(r + 1, have[r]) for r in low.tolist()]), at - low
        out[k][f] = _cuts(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t))
    return out


def _forests(known: DataFrame, groups: list[frozenset[int]], features: list[str], edges: list[list[np.ndarray]], trees: dict) -> dict[int, Row]:
    """Trees for each group, from the number of all its rows in each cell of codes and target.

    Rows are counted in tasks first; a group's cells then make a task. A target of two values has at most 2 * (BINS + 1)
    cells for each feature's bins by each other's, however many rows there are; one of many values has as many as rows.
    """
    names = [f"c{i}" for i in range(len(features))]

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _batches(pdfs):
            x, y = b[features].to_numpy(float), b["y"].to_numpy(float)
            ys, y_at = np.unique(y, return_inverse=True)
            for k, own in _own(b["part"].to_numpy(), groups):
                cells, sizes = [*_codes(x[own], edges[k]), y_at[own]], [*[len(e) + 2 for e in edges[k]], len(ys)]
                n = np.ones(len(cells[0]) if features else int(own.sum()), np.int64)
                if math.prod(sizes) < 1 << 62:  # a cell is one number; otherwise rows are counted after this alone
                    at, n = np.unique(np.ravel_multi_index(cells, sizes), return_counts=True)
                    cells = np.unravel_index(at, sizes)
                yield pd.DataFrame({"k": np.full(len(n), k, np.int32), **{c: v.astype(np.int16) for c, v in zip(names, cells, strict=False)}, "y": ys[cells[-1]], "n": n})

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        pdf = pdf.sort_values([*names, "y"], kind="stable")
        f, c, v, gain = _boosted(pdf[names].to_numpy(np.int64).T.copy(), edges[k], pdf["y"].to_numpy(float), pdf["n"].to_numpy(np.int64), **trees)
        return pd.DataFrame([(k, f.ravel().astype(np.int32), c.ravel(), v.ravel(), gain)], columns=["k", "feature", "cut", "leaf", "gain"])

    counted = known.select("part", *features, "y").mapInPandas(count, "k int, " + "".join(f"{c} smallint, " for c in names) + "y double, n long")
    cells = counted.groupBy("k", *names, "y").agg(F.sum("n").alias("n")).repartition(4 * len(groups), "k")  # so many that two groups seldom share one
    return {r.k: r for r in cells.groupBy("k").applyInPandas(grow, TREES).collect()}


def _fitted(known: DataFrame, learns: dict[dt.date, Callable[[int], bool]], features: list[str], trees: dict, linear: bool) -> pd.DataFrame:
    """A fit for each at of learns, from all rows of known(part, day, features, y) whose part it learns from; those of one target value have none.

    Parts are few: dates or folds. Fits are few and of fixed size, so they are brought together.
    """
    known = kept(known)
    figures = [a for i, c in enumerate(features) for a in (F.count(c).alias(f"n{i}"), F.avg(c).alias(f"mean{i}"), F.var_pop(c).alias(f"var{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]
    lines = sorted(known.groupBy("part").agg(F.count("*").alias("n"), F.collect_set("day").alias("days"), F.sum("y").alias("sum"), F.min("y").alias("lo"), F.max("y").alias("hi"), *figures).collect(), key=lambda r: r.part)
    heads, groups, moments = [], [], []
    for at, learn in learns.items():
        of = [r for r in lines if learn(r.part)]
        n = sum(r.n for r in of)
        if n < 2 or min(r.lo for r in of) == max(r.hi for r in of):
            continue
        heads.append((at, n, len({d for r in of for d in r.days}), math.fsum(r.sum for r in of) / n))
        groups.append(frozenset(r.part for r in of))
        moments.append(tuple(np.array(m) for m in zip(*[_moments(of, i) for i in range(len(features))], strict=True)) if features else (np.zeros(0), np.zeros(0)))
    if not groups:
        return pd.DataFrame(columns=NAMES, dtype=object)
    coef = _logistics(known, groups, features, moments) if linear else [np.zeros(0)] * len(groups)
    grown_ = _forests(known, groups, features, _edges(known, groups, features, sum(r.n for r in lines)), trees)
    made = [(*head, coef[k], *(np.array(grown_[k][c]) for c in ("feature", "cut", "leaf", "gain"))) for k, head in enumerate(heads)]
    return pd.DataFrame(made, columns=NAMES)


def _known(rows: DataFrame, features: list[str], target: str, part) -> DataFrame:
    """(part, day, features, y) of rows with a target; a feature that isn't finite is missing."""
    finite = lambda c: F.when(F.col(c) - F.col(c) == 0, F.col(c))
    doubles = rows.where(F.col(target).isNotNull()).select(part.cast("int").alias("part"), F.unix_date("month").alias("day"), *[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("y"))
    return doubles.select("part", "day", *[finite(f).alias(f) for f in features], "y").where("part is not null and not isnan(y)")


def fits(rows: DataFrame, plan: dict[dt.date, tuple[dt.date, dt.date]], features: list[str], target: str, trees: dict, linear: bool, most: int | None = None) -> pd.DataFrame:
    """A fit for each refit date of a schedule, from all rows(key..., month, features, target) known there.

    most, which no query gives: a date with more rows with a target takes about as many, by a hash.
    """
    asked = sorted(set(plan.values()))
    if not asked:
        return pd.DataFrame(columns=NAMES, dtype=object)
    day = lambda d: (d - dt.date(1970, 1, 1)).days
    last = rows.where(F.col("month") <= F.lit(max(u for _, u in asked)))
    if most is None:
        return _fitted(_known(last, features, target, F.unix_date("month")), {at: lambda p, u=day(until): p <= u for at, until in asked}, features, trees, linear)
    counts = [(r.month, r.n) for r in last.where(F.col(target).isNotNull()).groupBy("month").agg(F.count("*").alias("n")).collect()]
    shares = [most / max(1, sum(n for m, n in counts if m <= until)) for _, until in asked]
    place = lambda x: F.pmod(F.xxhash64(*[c for c in rows.columns if c not in features], x["at"]), F.lit(1 << 20)) / float(1 << 20)
    every = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(u).alias("until"), F.lit(s).alias("share"), F.lit(k).alias("k")) for k, ((a, u), s) in enumerate(zip(asked, shares, strict=True))])
    taken = last.withColumn("x", F.explode(F.filter(every, lambda x: (F.col("month") <= x["until"]) & (place(x) < x["share"]))))
    return _fitted(_known(taken, features, target, F.col("x.k")), {at: lambda p, k=k: p == k for k, (at, _) in enumerate(asked)}, features, trees, linear)


def predict(rows: DataFrame, made: pd.DataFrame, plan: dict, features: list[str], squared: bool, linear: bool) -> DataFrame:
    """rows with boosted, and with logistic and base if linear, for the dates of a schedule that have a fit; others are left out."""
    models = {r["at"]: r for r in made.to_dict("records")}
    serves = {at: models[refit] for at, (refit, _) in plan.items() if refit in models}
    held = rows.sparkSession.sparkContext.broadcast(serves)  # a fit of fixed size for each date
    names = ["boosted", "logistic", "base"] if linear else ["boosted"]

    def run(batches):
        for b in batches:
            for at, part in b.groupby("month", sort=False):
                if (m := held.value.get(at)) is None:
                    continue
                x = part[features].to_numpy(float)
                nodes = (1 << DEPTH) - 1
                score = grown(x, np.asarray(m["feature"]).reshape(-1, nodes), np.asarray(m["cut"]).reshape(-1, nodes), np.asarray(m["leaf"]).reshape(-1, nodes + 1))
                part = part.copy()
                part["boosted"] = score if squared else 1 / (1 + np.exp(-(score + np.log(m["base"] / (1 - m["base"])))))
                if linear:
                    coef = np.asarray(m["coef"], float)  # a fit that found no maximum has nulls
                    k = len(features)
                    part["logistic"] = 1 / (1 + np.exp(-np.clip(coef[0] + np.where(np.isfinite(x), x, coef[k + 1 :]) @ coef[1 : k + 1], -30, 30)))
                    part["base"] = m["base"]
                yield part

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    some = rows.where(F.col("month").isin(list(serves))) if serves else rows.limit(0)
    out = some.mapInPandas(run, schema + "".join(f", {n} double" for n in names))
    return out.select(*rows.columns, *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names])


def walk_forward_trees(panel: DataFrame, features: list[str], target: str = "fwd", first: int = 36, every: int = 12, trees: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """panel(ticker, month, features, target) with boosted, and the share of each feature in each refit's gain.

    Trees learn the target less its month's mean from all months before the refit; a missing feature is 0, the middle of
    its scores. The first refit is at the month after the first ones, the next every months on. Months before it, and a
    table with no month more, give no rows.
    """
    mean = panel.where(F.col(target).isNotNull()).groupBy("month").agg(F.avg(target).alias("mean"))
    rows = panel.where(F.col(target).isNotNull()).select("ticker", "month", *[F.coalesce(f, F.lit(0.0)).alias(f) for f in features], target).join(mean, "month")
    rows = rows.select("ticker", "month", *features, (F.col(target) - F.col("mean")).alias("y"), target)
    plan = schedule(panel, 0, first, every)
    made = fits(rows.drop(target), plan, features, "y", trees or RANKED, linear=False)
    gains = [(r.at, f, float(g / sum(r.gain)) if sum(r.gain) > 0 else 0.0) for r in made.itertuples() for f, g in zip(features, r.gain, strict=True)]
    shares = panel.sparkSession.createDataFrame(gains, "month date, feature string, share double")
    return predict(rows, made, plan, features, squared=True, linear=False).drop("y"), shares


def head_to_head(first: DataFrame, second: DataFrame, *key: str) -> DataFrame:
    """(months, mean, t, won) of first less second, both (key, ic), over the keys that both have."""
    d = first.select(*key, F.col("ic").alias("a")).join(second.select(*key, F.col("ic").alias("b")), list(key)).select((F.col("a") - F.col("b")).alias("d")).where("d is not null")
    return d.agg(F.count("d").alias("months"), F.avg("d").alias("mean"), F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("t"), F.avg((F.col("d") > 0).cast("double")).alias("won"))


def walk_forward(panel: DataFrame, features: list[str], trailing: str, months: int = 12, least: int = 12, trees: dict | None = None, latest: bool = False) -> DataFrame:
    """panel(slug, month, features, y, ...) at every date with a fit, with persist, logistic, boosted and base.

    persist: laggards lag again, the rank of the trailing excess from the highest on, over the date's rows; a missing one
    counts as 0. A fit learns from rows whose label was known by its date: they are the given months old at least, and of
    so many dates at least. logistic is null where no fit converges. A table with fewer dates gives no rows. latest: of
    the last date with a fit only; the others are neither fitted nor scored.
    """
    plan = schedule(panel, months, least)
    rows = panel.select("slug", "month", *features, "y")
    made = fits(rows, {} if latest else plan, features, "y", trees or CLASSED, linear=True)
    for at in sorted(plan, reverse=True) if latest else ():
        made = fits(rows, {at: plan[at]}, features, "y", trees or CLASSED, linear=True)
        if len(made):
            plan = {at: plan[at]}
            break
    scored = predict(panel, made, plan, features, squared=False, linear=True)
    ranked = scored.withColumn("lag", -F.coalesce(F.col(trailing), F.lit(0.0)))
    persist = average_rank("lag", "month") / F.count("*").over(Window.partitionBy("month"))
    return ranked.withColumn("persist", persist).drop("lag")


MODELS = ("persist", "logistic", "boosted")


def by_date(scored: DataFrame, target: str, share: float = 0.2) -> DataFrame:
    """(model, month, n, auc, base_rate, risky, safe, spread) of labelled rows: the fifth with the highest scores against the lowest."""
    long = _long(scored, target)
    own = Window.partitionBy("model", "month")
    k = F.greatest(F.lit(1), F.rint(F.count("*").over(own) * share))
    placed = long.withColumn("k", k).withColumn("up", F.row_number().over(own.orderBy("p", "slug"))).withColumn("down", F.count("*").over(own) - F.col("up") + 1)
    ends = placed.groupBy("model", "month").agg(F.count("*").alias("n"), F.avg("y").alias("base_rate"), F.avg(F.when(F.col("down") <= F.col("k"), F.col(target))).alias("risky"), F.avg(F.when(F.col("up") <= F.col("k"), F.col(target))).alias("safe"))
    return ends.join(auc(long, "y", "p", "model", "month").select("model", "month", "auc"), ["model", "month"]).withColumn("spread", F.col("risky") - F.col("safe"))


def _long(scored: DataFrame, target: str) -> DataFrame:
    rows = scored.where("y is not null and boosted is not null").select("slug", "month", F.col("y").cast("double").alias("y"), F.col(target).alias(target), "base", *MODELS)
    return rows.unpivot(["slug", "month", "y", target, "base"], list(MODELS), "model", "p").where("p is not null")


def evaluate(scored: DataFrame, target: str, lag: int = 3) -> DataFrame:
    """A row for each model: pooled area, areas and spreads by date with Newey-West t, Brier score and skill against the base rate.

    Brier figures are null for persistence, which gives ranks. Labelled rows with a score only.
    """
    dates, long, out = by_date(scored, target), _long(scored, target), None
    for m in MODELS:
        own, rows = dates.where(F.col("model") == m), long.where(F.col("model") == m)
        above = hac_mean(own.select("month", (F.col("auc") - 0.5).alias("v")), "v", lag).select((F.col("mean") + 0.5).alias("auc_mean"), F.col("t").alias("auc_t"))
        spread = hac_mean(own.select("month", F.col("spread").alias("v")), "v", lag).select(F.col("mean").alias("spread_mean"), F.col("t").alias("spread_t"))
        one = own.agg(F.count("*").alias("dates"), F.avg((F.col("auc") > 0.5).cast("double")).alias("auc_above"))
        sq = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), F.lit(2)))
        b = rows.agg(F.count("*").alias("rows"), sq("p").alias("brier"), sq("base").alias("brier_base"))
        pooled = auc_pooled(rows, "y", "p").select(F.col("auc").alias("auc_pooled"))
        row = one.crossJoin(b).join(above, how="left").join(spread, how="left").crossJoin(pooled).withColumn("model", F.lit(m))  # one row each
        out = row if out is None else out.unionByName(row)
    brier = F.when(F.col("model") != "persist", F.col("brier"))
    return out.select("model", "rows", "dates", "auc_pooled", "auc_mean", "auc_t", "auc_above", "spread_mean", "spread_t", brier.alias("brier"), "brier_base", (1 - F.try_divide(brier, F.col("brier_base"))).alias("brier_skill"))


def out_of_fold(panel: DataFrame, features: list[str], folds: int = 5, trees: dict | None = None) -> DataFrame:
    """Labelled rows of panel(slug, month, features, y, ...) with fold, logistic and boosted, by models that never saw the manager.

    A manager's fold is a hash of its name; each fold's fit learns from all rows of the others. A fold whose others have
    one class only gives no rows.
    """
    known = panel.where("y is not null").withColumn("fold", F.pmod(F.xxhash64("slug"), F.lit(folds)).cast("int"))
    day = dt.date(2000, 1, 1)  # a fold's fit stands under a day, as others do under their dates
    days = {k: day + dt.timedelta(days=k) for k in range(folds)}
    made = _fitted(_known(known, features, "y", F.col("fold")), {d: lambda p, k=k: p != k for k, d in days.items()}, features, trees or CLASSED, linear=True)
    own = known.withColumn("own", F.col("month")).withColumn("month", F.date_add(F.lit(day), F.col("fold")))
    scored = predict(own, made, {d: (d, d) for d in days.values()}, features, squared=False, linear=True)
    return scored.withColumn("month", F.col("own")).drop("own", "base")


def fold_areas(scored: DataFrame, trailing: str) -> DataFrame:
    """(model, rows, managers, auc): one pooled area for each model over rows of all folds."""
    rows, out = scored.withColumn("persist", -F.coalesce(F.col(trailing), F.lit(0.0))), None
    for m in MODELS:
        one = auc_pooled(rows, "y", m).select(F.lit(m).alias("model"), F.col("n").alias("rows"), "auc")
        out = one if out is None else out.unionByName(one)
    return out.crossJoin(F.broadcast(rows.agg(F.countDistinct("slug").alias("managers"))))  # one row


def watch_list(scored: DataFrame, names: DataFrame) -> DataFrame:
    """(slug, manager, style, logistic, boosted, rank_logistic, rank_boosted) at the latest date of scored.

    names(slug, manager, style); a manager without a name stays. rank_boosted is by place, ties by slug; rank_logistic is
    shared by ties at their mean, null without a score.
    """
    latest = scored.join(F.broadcast(scored.agg(F.max("month").alias("month"))), "month")  # one row
    w = Window.partitionBy("month")
    high = latest.withColumn("low", -F.col("logistic")).withColumn("rank_logistic", F.when(F.col("logistic").isNotNull(), average_rank("low", "month") - F.count_if(F.col("low").isNull()).over(w)))
    placed = high.withColumn("rank_boosted", F.row_number().over(w.orderBy(F.desc("boosted"), "slug")))
    return placed.join(names.select("slug", "manager", "style"), "slug", "left").select("slug", "manager", "style", "logistic", "boosted", "rank_logistic", "rank_boosted")
