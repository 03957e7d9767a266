"""Quality rules whose cutoffs carry a risk guarantee.

Each rule compares one ratio of a text with a cutoff. Labelled good documents of a stratum bound how often a cutoff
rejects a good one: with x of n rejected, the exact (Clopper-Pearson) upper bound at a level that is divided by the
strata and rules (Bonferroni). A rule's cutoffs are tested in a fixed order, from the mildest up to the first that
fails, which needs no further division. The strictest that passed is used, if it rejects bad documents more often than
good ones, again by exact bounds. So, with the given confidence, the rules
together reject at most the given share of good documents in every stratum at once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, keep

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Good documents that all rules together may reject in a stratum, and the chance that any bound fails.
RISK, FAIL = 0.02, 0.05
#: Cutoffs tried for each rule; values are ratios, put into as many cells.
CELLS = 64
#: Rules: a name and how a ratio in 0..1 comes from the counts; above the cutoff is rejected. word_length: average over 32.
RULES = ("symbols", "dup_lines", "repeats", "long_words", "short_words")


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")  # bytes split at ASCII white space alone
    words = raw.split()
    n = len(words)
    white = sum(raw.count(c) for c in b" \t\n\x0b\x0c\r")
    symbols = sum(raw.count(c.encode()) for c in SYMBOLS)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n > WINDOW:
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        window = at
        for k in range(1, WINDOW):  # exact: a pair of numbers becomes a new number at each step
            _, window = np.unique(window[:-1] * len(ids) + at[k:], return_inverse=True)
        often = np.bincount(window)[window] > 1
        if often.any():
            cover = np.zeros(n + 1, np.int64)
            starts = np.flatnonzero(often)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + WINDOW, -1)
            repeat = int((np.cumsum(cover[:-1]) > 0).sum())
    return n, len(text) - white, symbols, dup, repeat, lines


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(docs: DataFrame) -> DataFrame:
    """docs' id and stratum with the counts of every whole text; one pass, no shuffle."""

    return by_text(docs, lambda: lambda texts: [counts(t) for t in texts], ", ".join(f"{f} long" for f in FIELDS), "doc_id", "stratum")


def ratios() -> dict[str, Column]:
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    mean = over(F.col("word_chars"), F.col("n_words"))
    return {
        "symbols": over(F.col("n_symbols"), F.col("word_chars")), "dup_lines": over(F.col("n_dup_lines"), F.col("n_lines")),
        "repeats": over(F.col("n_repeat_words"), F.col("n_words")), "long_words": F.least(mean / 32, F.lit(1.0)), "short_words": F.greatest(1 - mean / 8, F.lit(0.0)),
    }


def binomial_upper(x: int, n: int, level: float) -> float:
    """The largest p under which x or fewer of n still has a chance of level."""
    if x >= n:
        return 1.0
    lo, hi = x / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        lo, hi = (p, hi) if _at_most(x, n, p) > level else (lo, p)
    return hi


def binomial_lower(x: int, n: int, level: float) -> float:
    return 1 - binomial_upper(n - x, n, level) if n else 0.0


def _at_most(x: int, n: int, p: float) -> float:
    """Chance of x or fewer successes, summed downwards from the largest term."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(x >= n)
    start = min(x, int(p * n))
    log = math.lgamma(n + 1) - math.lgamma(start + 1) - math.lgamma(n - start + 1) + start * math.log(p) + (n - start) * math.log1p(-p)
    total, term, k = 0.0, 1.0, start
    while k >= 0 and term > 1e-18:
        total += term
        term *= k * (1 - p) / ((n - k + 1) * p)
        k -= 1
    term, k = 1.0, start
    while k < x and term > 1e-18:
        term *= (n - k) * p / ((k + 1) * (1 - p))
        k += 1
        total += term
    return min(1.0, total * math.exp(log))


def choose(table: pd.DataFrame, tests: int, risk: float = RISK, fail: float = FAIL) -> pd.DataFrame:
    """Cutoffs of one stratum from table(stratum, rule, cell, good, bad): reject above cutoff. Rules without one are absent."""
    out = []
    for rule, rows in table.groupby("rule"):
        good, bad = (np.bincount(rows["cell"], rows[c], CELLS + 1).astype(np.int64) for c in ("good", "bad"))
        n_good, n_bad = int(good.sum()), int(bad.sum())
        level, best = fail / max(tests, 1), None
        above_good, above_bad = 0, 0
        for cell in range(CELLS, 0, -1):  # reject this cell and all above
            above_good, above_bad = above_good + int(good[cell]), above_bad + int(bad[cell])
            upper = binomial_upper(above_good, n_good, level) if n_good else 1.0
            if upper > risk / len(RULES):
                break
            if binomial_lower(above_bad, n_bad, level) > upper:
                best = cell, upper
        if best:
            out.append((rows["stratum"].iloc[0], rule, best[0] / CELLS, best[1]))
    return pd.DataFrame(out, columns=["stratum", "rule", "cutoff", "risk_bound"])


def calibrate(measured: DataFrame, labels: DataFrame, risk: float = RISK, fail: float = FAIL) -> DataFrame:
    """(stratum, rule, cutoff, risk_bound) from labels(doc_id, quality 0/1); counts by cell are all that is shuffled.

    Documents that the base rule rejects are no part of the question. A null stratum is one of its own.
    """
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("y"))
    cells = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.ceil(F.least(v, F.lit(1.0)) * CELLS).cast("int").alias("cell")) for r, v in ratios().items()]))
    joined = measured.where(~base_failed()).join(known, "doc_id").select(F.coalesce("stratum", F.lit("")).alias("stratum"), "y", cells.alias("c"))
    table = keep(joined.groupBy("stratum", "c.rule", "c.cell").agg(F.sum("y").cast("long").alias("good"), F.sum(1 - F.col("y")).cast("long").alias("bad")))
    strata = table.select("stratum").distinct().count()
    tests = 2 * max(strata, 1) * len(RULES)  # two bounds each

    def run(pdf: pd.DataFrame) -> pd.DataFrame:  # as many rows as rules and cells
        return choose(pdf, tests, risk, fail)

    return table.groupBy("stratum").applyInPandas(run, "stratum string, rule string, cutoff double, risk_bound double")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, fail: float = FAIL) -> DataFrame:
    """A row for each of docs: doc_id, the counts, base_failed, kept and failed_rules.

    Null texts have no words. A stratum without labels has no cutoffs, so only the base rule judges it. Repeated rows
    are judged each. An empty table gives no rows; other columns are not read.
    """
    measured = keep(measure(docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), "text")))
    cutoffs = keep(calibrate(measured, labels, risk, fail)).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    cutoffs = cutoffs.withColumnRenamed("stratum", "of")
    joined = measured.join(cutoffs, F.coalesce("stratum", F.lit("")) == F.col("of"), "left")
    failed = F.array_compact(F.array(*[F.when(F.ceil(F.least(v, F.lit(1.0)) * CELLS) / CELLS >= F.col("cutoffs")[r], F.lit(r)) for r, v in ratios().items()]))
    return joined.withColumn("failed_rules", failed).select(
        "doc_id", *[F.col(f) for f in FIELDS if f != "n_lines"], base_failed().alias("base_failed"),
        (~base_failed() & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"),
    )
