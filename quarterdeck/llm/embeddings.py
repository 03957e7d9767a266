"""Embedding near-duplicates by dual traversal of cover trees.

Vectors of one label are points on the unit sphere; cosine >= c is a distance of at most sqrt(2 - 2 c). Each label's
points hang in a tree of nested levels: a node takes the points that are nearest to its centre, and gives way to smaller
nodes until it is small enough for one task, or so tight that all its points link. Tight nodes, and what is left after
the last level, are dealt into blocks of a task's size. Node pairs are followed downwards together: a pair lives on only
if its centres are no further apart than both true radii and the threshold. What is left at the leaves is compared
exactly, in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components

COSINE = 0.98
#: Points that a leaf holds at most (blocks, which are dealt by a hash: on average); a task compares two leaves.
LEAF = 1500
#: Centres that a node is parted into at each level, besides its own and its farthest point.
FAN = 8
#: Levels after which nodes that are still large are dealt into blocks.
LEVELS = 40
#: Allowance for rounding in a bound.
SLACK = 1e-6


def _directions(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, u) for every row: u is the unit vector, null where the vector, the label or the id isn't valid."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col("embedding").cast("array<double>")
    valid = F.expr("vec_id is not null and label is not null and v is not null and size(v) > 0") & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    ok = vectors.select("vec_id", "label", v.alias("v")).select("vec_id", "label", F.when(valid, F.col("v")).alias("v"))
    # the largest component to 1 first: neither overflow nor underflow
    even = ok.withColumn("w", F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y)))))
    length = F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x))
    return even.select("vec_id", "label", F.transform("w", lambda x: x / length).alias("u"))


def _points(directions: DataFrame) -> DataFrame:
    """(label, u, least, n, id): distinct directions of a label, the smallest vec_id and the number of rows, and a number each.

    The number is what the tree and the links go by, as a vec_id may stand at several directions. It holds once written.
    """
    found = directions.where("u is not null").groupBy("label", "u").agg(F.min("vec_id").cast("long").alias("least"), F.count("*").alias("n"))
    return found.withColumn("id", F.monotonically_increasing_id())


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))


def _centres(points: DataFrame, info: DataFrame) -> DataFrame:
    """(node, k, cv): up to FAN points of each node, by a hash of the id: the same under any partitioning.

    The smallest hash of each of FAN bins, so a node is never gathered. A node's own centre and the point farthest from
    it are taken too, so a node with a radius always parts.
    """
    hashed = points.select("node", "id", "u", F.xxhash64("id", F.lit(77)).alias("h"))
    least = hashed.groupBy("node", F.pmod("h", F.lit(FAN)).alias("k")).agg(F.min_by("u", F.struct("h", "id")).alias("cv"))
    far = points.groupBy("node").agg(F.max_by("u", F.struct("d", "id")).alias("cv")).select("node", F.lit(FAN + 1).cast("long").alias("k"), "cv")
    own = points.select("node").distinct().join(info, "node").select("node", F.lit(FAN).cast("long").alias("k"), F.col("c").alias("cv"))
    return least.select("node", F.col("k").cast("long").alias("k"), "cv").unionByName(own).unionByName(far)


def _assign(points: DataFrame, centres: DataFrame) -> DataFrame:
    """points(node, id, u) with the nearest centre k of their node and its distance d."""
    listed = centres.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "cv"))).alias("cs"))  # at most FAN a node
    both = points.join(listed, "node").select("node", "id", "u", "cs")

    def run(batches):
        for b in batches:
            k, d = np.zeros(len(b), np.int64), np.zeros(len(b))
            for rows in b.groupby("node").indices.values():
                cs = b["cs"].iloc[rows[0]]
                dist = _dist(np.stack(b["u"].iloc[rows].to_numpy()), np.stack([np.asarray(x["cv"], dtype=float) for x in cs]))
                k[rows], d[rows] = np.array([x["k"] for x in cs])[dist.argmin(axis=1)], dist.min(axis=1)
            yield pd.DataFrame({"node": b["node"], "id": b["id"], "u": b["u"], "k": k, "d": d})

    return both.mapInPandas(run, "node long, id long, u array<double>, k long, d double")


def build(points: DataFrame, threshold: float, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """(node, id, u) of leaves, and the tree (node, parent, c, r, n): centres, covering radii as measured, and sizes.

    points(label, id, u). A node of more than leaf points gives way to children around some of its points, unless its
    radius proves that all of them link. Such a node, and one that is still large after LEVELS, gives way to blocks of
    about leaf points around its centre; so every point is in one leaf.
    """
    now = keep(points.select(F.xxhash64("label", F.lit("root")).alias("node"), "id", "u"))
    centre = now.groupBy("node").agg(F.min_by("u", F.struct(F.xxhash64("id", F.lit(5)), "id")).alias("c"), F.count("*").alias("n"))
    now = keep(now.join(centre, "node").select("node", "id", "u", _distance(F.col("u"), F.col("c")).alias("d")))
    far = now.groupBy("node").agg(F.max("d").alias("r"))
    info = keep(centre.join(far, "node").select("node", F.lit(None).cast("long").alias("parent"), "c", "r", "n"))
    tree = leaves = None
    for level in range(LEVELS + 1):
        tree = info if tree is None else tree.unionByName(info)
        done = now.join(info.where(F.col("n") <= leaf).select("node"), "node").select("node", "id", "u")
        leaves = done if leaves is None else leaves.unionByName(done)
        parts = (F.col("r") > max((threshold - SLACK) / 2, SLACK)) & F.lit(level < LEVELS)
        large = keep(info.where(F.col("n") > leaf).select("node", "c", "n", parts.alias("parts")))
        kinds = {r.parts for r in large.select("parts").distinct().collect()}
        if False in kinds:
            block = F.pmod(F.xxhash64("id", F.lit(78)), F.ceil(F.col("n") / leaf))
            dealt = now.join(large.where("not parts").select("node", "c", "n"), "node")
            dealt = keep(dealt.select(F.xxhash64("node", block, F.lit("block")).alias("block"), "node", "c", "id", "u", "d"))
            sizes = dealt.groupBy("block", "node").agg(F.max("d").alias("r"), F.count("*").alias("n"))
            tree = tree.unionByName(sizes.join(info.select("node", "c"), "node").select(F.col("block").alias("node"), F.col("node").alias("parent"), "c", "r", "n"))
            leaves = leaves.unionByName(dealt.select(F.col("block").alias("node"), "id", "u"))
        if True not in kinds:
            break
        open_ = keep(now.join(large.where("parts").select("node"), "node"))
        centres = keep(_centres(open_, info))
        moved = keep(_assign(open_, centres))
        child = F.xxhash64("node", "k", F.lit("child"))
        sizes = moved.groupBy("node", "k").agg(F.max("d").alias("r"), F.count("*").alias("n"))
        info = keep(sizes.join(centres, ["node", "k"]).select(child.alias("node"), F.col("node").alias("parent"), F.col("cv").alias("c"), "r", "n"))
        now = moved.select(child.alias("node"), "id", "u", "d")
    return leaves, tree


def _distance(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0)))


def node_pairs(tree: DataFrame, threshold: float) -> DataFrame:
    """(x, y, every): pairs of leaves, x <= y, that may hold a link; every: all their points link, by the same bounds.

    Both trees are followed down together: a pair of nodes lives on only if its centres are no further apart than both
    covering radii and the threshold. Each round goes down a level, so the rounds end with the tree.
    """
    info = keep(tree)
    kids = info.where("parent is not null").select(F.col("parent").alias("p"), F.col("node").alias("kid"))
    ball = lambda s: info.select(F.col("node").alias(s), F.col("c").alias(f"{s}c"), F.col("r").alias(f"{s}r"))
    apart, radii = _distance(F.col("xc"), F.col("yc")), F.col("xr") + F.col("yr")
    top = info.where("parent is null").select("node")
    pairs, out = keep(top.select(F.col("node").alias("x"), F.col("node").alias("y"))), None
    while True:
        down = pairs
        for side in "xy":
            down = down.join(kids.select(F.col("p").alias(side), F.col("kid").alias(f"{side}_kid")), side, "left")
        end = F.col("x_kid").isNull() & F.col("y_kid").isNull()
        flat = down.where(end).select("x", "y")
        out = flat if out is None else out.unionByName(flat)
        to = [F.coalesce(f"{side}_kid", side) for side in "xy"]
        met = down.where(~end).where((F.col("x") != F.col("y")) | (to[0] <= to[1])).select(F.least(*to).alias("x"), F.greatest(*to).alias("y")).distinct()
        near = (F.col("x") == F.col("y")) | (apart <= radii + threshold + SLACK)
        pairs = keep(met.join(ball("x"), "x").join(ball("y"), "y").where(near).select("x", "y"))
        if pairs.isEmpty():
            break
    return out.join(ball("x"), "x").join(ball("y"), "y").select("x", "y", (apart + radii <= threshold - SLACK).alias("every"))


def nets(x: np.ndarray, parent: np.ndarray, radius: float) -> np.ndarray:
    """The centre (an index) of each point: greedy, within radius of it and under the same parent."""
    out = np.full(len(x), -1)
    for i in range(len(x)):
        if out[i] < 0:
            free = np.flatnonzero((out < 0) & (parent == parent[i]))
            out[free[_dist(x[free], x[i : i + 1])[:, 0] <= radius]] = i
            out[i] = i
    return out


def _within(threshold: float):
    """Carries the tree on within a leaf: each point's centres at two more levels, of 2.5 and of half the threshold's radius."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        x = np.stack(pdf["u"].to_numpy())
        coarse = nets(x, np.zeros(len(x), np.int64), 2.5 * threshold)
        pdf["coarse"], pdf["fine"] = coarse, nets(x, coarse, threshold / 2)
        return pdf[["node", "id", "n", "u", "coarse", "fine"]]

    return run


def candidates(x: np.ndarray, xn: tuple, y: np.ndarray, yn: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points that the bounds of two levels of nets leave: x and y with their (coarse, fine) centres."""
    sides = []
    for v, (coarse, fine) in ((x, xn), (y, yn)):
        c, cb = np.unique(coarse, return_inverse=True)
        f, fb = np.unique(fine, return_inverse=True)
        rc, rf = np.zeros(len(c)), np.zeros(len(f))
        np.maximum.at(rc, cb, np.sqrt(((v - v[coarse]) ** 2).sum(axis=1)))
        np.maximum.at(rf, fb, np.sqrt(((v - v[fine]) ** 2).sum(axis=1)))
        order = np.argsort(fb, kind="stable")
        sides.append((v[c], rc, v[f], rf, np.searchsorted(c, coarse[f]), order, np.searchsorted(fb[order], np.arange(len(f))), np.bincount(fb)))
    (xc, xr, xf, xs, xp, xo, xa, xk), (yc, yr, yf, ys, yp, yo, ya, yk) = sides
    far = _dist(xc, yc) > xr[:, None] + yr + threshold + SLACK
    live = ~far[np.ix_(xp, yp)] & (_dist(xf, yf) <= xs[:, None] + ys + threshold + SLACK)
    i, j = np.nonzero(live)
    size = xk[i] * yk[j]
    at = np.repeat(np.arange(len(i)), size)
    k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    return xo[xa[i[at]] + k // yk[j[at]]], yo[ya[j[at]] + k % yk[j[at]]]


def _compare(cosine: float, threshold: float):
    """Links within a leaf or between two: each point's partners, counted by rows, and edges that join what links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pdf[pdf["side"] == side].sort_values("id") for side in (0, 1)]
        same = not len(parts[1])
        a, b = parts[0], parts[0] if same else parts[1]
        x, y = np.stack(a["u"].to_numpy()), np.stack(b["u"].to_numpy())
        ia, ib, na, nb = a["id"].to_numpy(), b["id"].to_numpy(), a["n"].to_numpy(), b["n"].to_numpy()
        la, lb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        owner, edges = np.full(len(b), -1), []
        nets_b = b["coarse"].to_numpy(), b["fine"].to_numpy()
        fine_a, coarse_a = a["fine"].to_numpy(), a["coarse"].to_numpy()
        i, j = candidates(x, (coarse_a, fine_a), y, nets_b, threshold)
        if same:
            i, j = i[i != j], j[i != j]
        ok = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 65536]], y[j[s : s + 65536]]) >= cosine for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
        i, j = i[ok], j[ok]
        np.add.at(la, i, nb[j])
        if not same:
            np.add.at(lb, j, na[i])
        order = np.argsort(i, kind="stable")
        for to in np.split(order, np.flatnonzero(np.diff(i[order])) + 1) if len(i) else []:
            row, hit = i[to[0]], j[to]
            fresh = hit[owner[hit] < 0]
            edges += [(ia[row], o) for o in ib[fresh]] + [(ia[row], ia[o]) for o in np.unique(owner[hit[owner[hit] >= 0]])]
            owner[fresh] = row
        rows = [(int(v), int(n), None) for v, n in zip(ia, la, strict=True) if n] + ([] if same else [(int(v), int(n), None) for v, n in zip(ib, lb, strict=True) if n])
        out = pd.DataFrame(rows + [(int(p), 0, int(q)) for p, q in edges], columns=["id", "links", "other"])
        return out.astype({"id": "int64", "links": "int64", "other": "Int64"})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, leaf: int = LEAF) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    n_links counts the other rows of the label at cosine >= the threshold; component_id is the smallest vec_id
    reachable by links. Vectors that are null, empty, zero or hold a null or non-finite component, and those without
    label or id, link with nothing; so do vectors of different length. Vectors of equal direction are one point with a
    count, so copies cost nothing more. Rows that repeat an id with another vector or label are rows of their own, which
    link with each other like any two. An empty table gives no rows; other columns are not read.
    """
    rows = keep(_directions(vectors))
    points = keep(_points(rows))
    units = points.select(F.struct("label", F.size("u").alias("width")).alias("label"), "id", "n", "u")
    threshold = float(np.sqrt(2 - 2 * cosine))
    leaves, tree = build(units.select("label", "id", "u"), threshold, leaf)
    pairs = keep(node_pairs(tree, threshold))
    held = leaves.join(units.select("id", "n"), "id").groupBy("node")
    members = keep(held.applyInPandas(_within(threshold), "node long, id long, n long, u array<double>, coarse long, fine long"))
    pair = pairs.where("not every").withColumn("pair", F.concat_ws(":", "x", "y"))
    dealt = pair.select("pair", F.col("x").alias("node"), F.lit(0).alias("side")).unionByName(pair.where("x <> y").select("pair", F.col("y").alias("node"), F.lit(1).alias("side")))
    found = keep(dealt.join(members, "node").groupBy("pair").applyInPandas(_compare(cosine, threshold), "id long, links long, other long"))
    # leaves all of whose points link: sizes do for the counts; an edge joins each two leaves, and one each point to a leaf
    whole = members.groupBy("node").agg(F.sum("n").alias("rows"), F.min("id").alias("least"))
    both = pairs.where("every")
    both = both.select("x", "y").unionByName(both.where("x <> y").select(F.col("y").alias("x"), F.col("x").alias("y")))
    met = both.join(whole.withColumnRenamed("node", "y"), "y")
    leaf_edges = met.select("x", F.col("least").alias("b")).join(whole.select(F.col("node").alias("x"), F.col("least").alias("a")), "x").select("a", "b")
    beside = met.groupBy("x").agg(F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max(F.col("x") == F.col("y")).alias("inner"))
    joined = members.select(F.col("node").alias("x"), "id", "n").join(beside, "x")
    counts = found.where("other is null").select("id", "links").unionByName(joined.select("id", (F.col("rows") - F.when(F.col("inner"), F.col("n")).otherwise(0)).alias("links")))
    edges = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(joined.select(F.col("id").alias("a"), F.col("least").alias("b"))).unionByName(leaf_edges)
    counts = counts.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(edges).withColumnRenamed("node", "id")
    rooted = points.join(counts, "id", "left").join(roots, "id", "left").withColumn("at", F.coalesce("root", "id")).drop("root")
    named = rooted.join(rooted.groupBy("at").agg(F.min("least").alias("root")), "at")
    named = named.select(F.col("label").alias("of"), F.col("u").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "root")
    out = rows.join(named, (F.col("label") == F.col("of")) & (F.col("u") == F.col("v")), "left")
    component = F.coalesce(F.col("root"), F.col("vec_id").cast("long"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
