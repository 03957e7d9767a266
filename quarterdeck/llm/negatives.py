"""Hard negatives by threshold joins over an inverted index with norm bounds.

Anchors meet all rows in blocks. In a block, components are ordered by their share of the squares, and rows are listed
under runs of components; a row isn't listed under those from which on its norm times the anchors' can't reach the
lowest threshold. Partial scores are accumulated run by run, and a pair is given up once its partial score and the
product of both remaining norms stay under the anchor's threshold. An anchor's threshold starts high and is lowered
until its windows are full, or until nothing below could be in them; so results are exact.

A first join finds each anchor's best rows of its own label, a second one the rows of other labels that score within a
window under each of these. What blocks find is merged by Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

#: Rows, and anchors, of a block, about; each pair of blocks is one group's work.
BLOCK = 4096
#: Components in a run, and anchors that are worked on at once.
RUN, SLICE = 8, 256
#: Share of live pairs from which on they are finished one by one.
SPARSE = 0.03
#: Thresholds that positives are looked for with, as shares of the largest score that norms allow; then there is none.
STEPS = (0.9, 0.7, 0.5, 0.3)
#: How far thresholds reach down in the lowest window of an anchor.
DEPTHS = (0.05, 0.2, 0.5, 1.0)


class Index:
    """Rows of a block, listed under runs of components, for scores of at least a threshold."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(-(x * x).sum(axis=0), kind="stable")
        self.x = np.ascontiguousarray(x[:, self.order])
        self.rest = self.remaining(self.x)

    @staticmethod
    def remaining(x: np.ndarray) -> np.ndarray:
        """[run, row]: norm of the components from that run on; zero after the last. A little too much, for rounding."""
        runs = [(x[:, at : at + RUN] ** 2).sum(axis=1) for at in range(0, x.shape[1], RUN)]
        return np.sqrt(np.cumsum([np.zeros(len(x)), *runs[::-1]], axis=0)[::-1]) * (1 + 1e-9)

    def lists(self, left: np.ndarray, low: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows, those under most runs first, and under how many each is listed: the rest can't lift a score to low."""
        listed = self.rest[:-1] * left.max(axis=1)[:-1, None] >= low
        depth = np.where(listed.all(axis=0), len(listed), listed.argmin(axis=0))
        rows = np.argsort(-depth, kind="stable")
        rows = rows[: np.count_nonzero(depth)]
        return rows, depth[rows]

    def above(self, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of all pairs with a score of at least the anchor's threshold."""
        q = q[:, self.order]
        left, runs = self.remaining(q), len(self.rest) - 1
        rows, depth = self.lists(left, least.min())
        if not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        partial = np.zeros((len(q), len(rows)))
        live = np.ones_like(partial, bool)
        for run in range(runs):
            n, at = np.count_nonzero(depth > run), slice(run * RUN, (run + 1) * RUN)
            partial[:, :n] += q[:, at] @ self.x[rows[:n], at].T
            seen = np.minimum(depth, run + 1)  # what a pair can still gain
            live = partial + left[seen].T * self.rest[seen, rows] >= least[:, None]
            if n < len(rows) // 8 or live.mean() < SPARSE:
                break
        i, at = np.nonzero(live)
        j = rows[at]
        score = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", q[i[s : s + 65536]], self.x[j[s : s + 65536]]) for s in range(0, len(i), 65536)]])
        ok = score >= least[i]
        return i[ok], j[ok], score[ok]


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Which entries are among the first of their i: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, i))
    group = i[order]
    place = np.arange(len(order)) - np.searchsorted(group, group)
    return order[place < most]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _meet(find, schema: str):
    """A group's function: anchors and rows of a block, worked on by slices of anchors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, anchors = pdf[pdf["anchor_side"] == 0], pdf[pdf["anchor_side"] == 1]
        out = []
        if len(rows) and len(anchors):
            width = max(int(pdf["v"].map(len).max()), 1)
            index = Index(_matrix(rows["v"], width))
            for at in range(0, len(anchors), SLICE):
                part = anchors.iloc[at : at + SLICE]
                out.append(find(index, rows, part, _matrix(part["v"], width)))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return run


def _positives(most: int):
    """The best rows of a block for each anchor, itself left out."""

    def find(index: Index, rows: pd.DataFrame, anchors: pd.DataFrame, q: np.ndarray) -> pd.DataFrame:
        own, ids, me = rows["at"].to_numpy(), rows["vec_id"].to_numpy(), anchors["at"].to_numpy()
        reach = index.remaining(q)[0] * index.rest[0].max()
        open_, found = np.arange(len(q)), []
        for step in (*STEPS, None):
            i, j, score = index.above(q[open_], reach[open_] * step if step else np.full(len(open_), -np.inf))
            other = own[j] != me[open_[i]]
            i, j, score = i[other], j[other], score[other]
            full = np.bincount(i, minlength=len(open_)) >= (most if step else 0)
            ok = full[i]
            found.append((open_[i[ok]], j[ok], score[ok]))
            open_ = open_[~full]
            if not len(open_):
                break
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        first = _best(i, ids[j], score, most)
        return pd.DataFrame({"anchor": me[i[first]], "anchor_id": anchors["vec_id"].to_numpy()[i[first]], "other_id": ids[j[first]], "score": score[first]})

    return find


def _negatives(most: int, low: int, high: int):
    """For each anchor, the rows of a block that are among the first in any of its windows, and of another label."""

    def find(index: Index, rows: pd.DataFrame, anchors: pd.DataFrame, q: np.ndarray) -> pd.DataFrame:
        ids, label, me, of = rows["vec_id"].to_numpy(), rows["label"].to_numpy(), anchors["at"].to_numpy(), anchors["label"].to_numpy()
        windows = [np.array([[low * p / 100, high * p / 100] for p in w if low * p <= high * p]).reshape(-1, 2) for w in anchors["windows"]]
        open_, found = np.array([k for k, w in enumerate(windows) if len(w)], np.int64), []
        for depth in DEPTHS:
            if not len(open_):
                break
            floor, top = (np.array([w[:, k].min() for w in (windows[x] for x in open_)]) for k in (0, 1))
            i, j, score = index.above(q[open_], floor if depth == 1 else top - (top - floor) * depth)
            other = label[j] != of[open_[i]]
            i, j, score = i[other], j[other], score[other]
            order = np.lexsort((ids[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            begin, still = np.searchsorted(i, np.arange(len(open_) + 1)), []
            for k, n in enumerate(open_.tolist()):
                part = slice(begin[k], begin[k + 1])
                falling, taken, full = -score[part], np.zeros(begin[k + 1] - begin[k], bool), True
                for a, b in windows[n]:
                    first, end = np.searchsorted(falling, -b), np.searchsorted(falling, -a, "right")
                    taken[first : min(first + most, end)] = True
                    full &= end - first >= most
                if full or depth == 1:
                    found.append((np.full(taken.sum(), n), j[part][taken], score[part][taken]))
                else:
                    still.append(n)
            open_ = np.array(still, np.int64)
        i, j, score = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2 + (np.zeros(0),), *found, strict=True))
        return pd.DataFrame({"anchor": me[i], "other_id": ids[j], "score": score})

    return find


def _joined(rows: DataFrame, anchors: DataFrame, by: list[str], sizes: tuple[int, int], find, schema: str) -> DataFrame:
    """find() on every pair of a block of rows and a block of anchors that agree in by. Blocks are dealt by row number."""
    n_rows, n_anchors = (max(1, -(-n // BLOCK)) for n in sizes)
    of = lambda n: F.pmod(F.xxhash64("at", F.lit(31)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["at", "vec_id", "label", "v"]
    left = rows.select(*cols, F.lit(None).cast("array<double>").alias("windows"), F.lit(0).alias("anchor_side"), of(n_rows).alias("x")).select("*", every(n_anchors).alias("y"))
    right = anchors.select(*cols, "windows", F.lit(1).alias("anchor_side"), of(n_anchors).alias("y")).select("*", every(n_rows).alias("x"))
    return left.unionByName(right).groupBy(*by, "x", "y").applyInPandas(_meet(find, schema), schema)


def mine(rows: DataFrame, anchors, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), rank from 1.

    rows(vec_id, label, v): a score is the inner product with the anchor; missing components count as zero. anchors is a
    condition on rows. An anchor's positives are its best other rows of the same label; a positive's negatives are the
    best rows of other labels that score from low to high per cent of it. Ties go to the smaller vec_id. Rows without id,
    label or vector, and those with a component that is null or not finite, take no part. Rows that repeat are rows of
    their own, as anchors too. Components are to be whole numbers, so that scores are exact (sums under 2 ** 53). An
    empty table gives no rows.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.col("v").cast("array<double>")
    valid = rows.select("vec_id", "label", v.alias("v")).where("vec_id is not null and label is not null and v is not null").where(~bad)
    rows = keep(valid.select(F.monotonically_increasing_id().alias("at"), F.col("vec_id").cast("long").alias("vec_id"), "label", "v"))
    chosen = rows.where(anchors)
    sizes = rows.count(), chosen.count()
    if not sizes[1]:
        return rows.sparkSession.createDataFrame([], OUT)
    # blocks of the largest label are no larger than BLOCK; those of others are smaller
    plain = chosen.withColumn("windows", F.lit(None).cast("array<double>"))
    largest = tuple(t.groupBy("label").count().agg(F.max("count")).first()[0] for t in (rows, chosen))
    found = _joined(rows, plain, ["label"], largest, _positives(positives), "anchor long, anchor_id long, other_id long, score double")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "other_id")
    best = keep(found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= positives).drop("n"))
    windows = best.groupBy("anchor").agg(F.collect_set("score").alias("windows"))  # as many as positives at most
    asked = keep(chosen.join(windows.withColumnRenamed("anchor", "at"), "at"))
    near = keep(_joined(rows, asked, [], sizes, _negatives(negatives, low, high), "anchor long, other_id long, score double"))
    p = best.select("anchor", "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), F.monotonically_increasing_id().alias("one"))
    both = keep(p).join(near.select("anchor", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score")), "anchor")
    both = both.where((100 * F.col("negative_score") >= low * F.col("positive_score")) & (100 * F.col("negative_score") <= high * F.col("positive_score")))
    rank = F.row_number().over(Window.partitionBy("one").orderBy(F.desc("negative_score"), "negative_id"))
    out = both.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("positive_score").cast("long"), F.col("negative_score").cast("long"))


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def planted(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding, label) as rows of mine(): every seventh label is the next one, components are whole."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x).otherwise(F.floor(x * 256).cast("double")))
    return vectors.select("vec_id", label.alias("label"), whole.alias("v"))


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """mine() for every hundredth id; the window in whole numbers, 80 p <= 100 n <= 100 p."""
    return mine(planted(vectors), F.col("vec_id") % 100 == 0)


def oracle() -> str:
    return """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
        SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
        FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
    ), p AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT p.anchor_id, p.positive_id,
        row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INT AS rank,
        s.other_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 5
    """
