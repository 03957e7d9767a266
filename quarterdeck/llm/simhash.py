"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints within D bits agree closely on at least one of several groups of bits: if group i is searched up to
t_i differing bits (t_i = -1: not searched) and the sum of (t_i + 1) is D + 1, no pair is lost. Correlated bits are
put in one group, and the D + 1 credits are dealt to the groups by dynamic programming on estimated candidate counts.
"""

from __future__ import annotations

from itertools import combinations, count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, keep
from .components import components

BITS = 64
#: Members of one bucket that are compared within a task; larger buckets are split by more bits, without loss.
BUCKET = 2000
#: Fingerprints on which candidate counts are estimated (they steer the cost, never the result).
ESTIMATE_ROWS = 3000


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of width words; of all words if they are fewer, none of a blank text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, size = b" ".join(words), len(words)
    if size <= width:
        return np.array([xxhash.xxh64_intdigest(line, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, size) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: size - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of one text: bit j is set if it is set in over half of the shingles' XXH64."""
    return fingerprint_of(shingle_hashes(text, width, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes; zero of none."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row; null and blank texts get 0. One pass, no shuffle."""

    return by_text(docs, lambda: lambda texts: [(_signed(fingerprint(t)),) for t in texts], "fp long", "doc_id")


def _bit_counts(distinct: DataFrame) -> tuple[np.ndarray, int]:
    """How often two bits are set together, over all fingerprints; 4,096 sums reach the driver, whatever the input."""

    def run(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        if n:
            i, j = np.divmod(np.arange(BITS * BITS), BITS)
            yield pd.DataFrame({"i": np.append(i, -1), "j": np.append(j, -1), "c": np.append(total.ravel(), n)})

    got = distinct.select("fp").mapInPandas(run, "i long, j long, c double").groupBy("i", "j").agg(F.sum("c").alias("c")).toPandas()
    together = np.zeros((BITS, BITS))
    inner = got[got.i >= 0]
    together[inner.i.astype(int), inner.j.astype(int)] = inner.c
    return together, int(got.c[got.i < 0].sum())


def group_bits(together: np.ndarray, n: int, groups: int) -> list[list[int]]:
    """Greedy groups of about equal size, each grown by the bit most correlated with it so far."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    free, out = set(range(BITS)), []
    for g in range(groups):
        size = len(free) // (groups - g)
        left = sorted(free)
        first = left[int(np.argmax(corr[np.ix_(left, left)].sum(axis=1)))]
        own = [first]
        free.discard(first)
        while len(own) < size:
            left = sorted(free)
            best = left[int(np.argmax(corr[np.ix_(left, own)].mean(axis=1)))]
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def close_pairs(sample: np.ndarray, masks: list[int], most: int, rows: int = 64) -> np.ndarray:
    """By mask and number of bits from 0 to most: pairs of the sample that differ in so many bits of the mask.

    Some rows at a time meet all others, so the driver never holds all pairs.
    """
    out, place = np.zeros((len(masks), most + 1), np.int64), np.arange(len(sample))
    for k in range(0, len(sample), rows):
        diff = (sample[k : k + rows, None] ^ sample)[place[k : k + rows, None] < place]
        for own, mask in zip(out, masks, strict=True):
            own += np.bincount(np.minimum(np.bitwise_count(diff & np.uint64(mask)), most + 1), minlength=most + 2)[:-1]
    return out


def allot(groups: list[list[int]], sample: np.ndarray, n: int, distance: int) -> tuple[float, list[int]]:
    """Credits (threshold + 1) for each group, by dynamic programming: least probes plus estimated candidates."""
    close = close_pairs(sample, [mask_of(bits) for bits in groups], distance)
    scale = n * (n - 1) / 2 / max(len(sample) * (len(sample) - 1) // 2, 1)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, pairs in zip(groups, close, strict=True):
        cost, probes = [0.0], 0.0
        for credit in range(1, distance + 2):
            probes = float(len(list(combinations(bits, credit - 1))))
            cost.append(20 * probes * n + float(pairs[:credit].sum()) * scale)
        best = {
            total: min(((was + cost[total - used], [*given, total - used]) for used, (was, given) in best.items() if used <= total), key=lambda x: x[0])
            for total in range(distance + 2)
        }
    return best[distance + 1]


def plan(distinct: DataFrame, distance: int) -> list[int]:
    """Masks of the bits on which a bucket's members agree; every pair within distance shares a bucket of some mask."""
    together, n = _bit_counts(distinct)
    sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(ESTIMATE_ROWS).toPandas()["fp"].to_numpy().view(np.uint64)
    options = []
    for m in range(1, distance + 4):
        groups = group_bits(together, n, m)
        options.append((*allot(groups, sample, n, distance), m, groups))
    _, credits, _, groups = min(options, key=lambda x: (x[0], x[2]))
    return [mask_of(set(bits) - set(free)) for bits, credit in zip(groups, credits, strict=True) if credit for free in combinations(bits, credit - 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fp: np.ndarray, node: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what links directly within one bucket: a spanning forest, so they number less than its members."""
    left, a, b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= distance
            if near.any():
                found = left[near]
                a.append(np.full(len(found), node[x]))
                b.append(node[found])
                queue.extend(found.tolist())
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _bucket_links(entries: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) from entries (path, val, fp, node): buckets are runs of sorted partitions, each of bounded size."""

    def run(batches):
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            path, val = b["path"].to_numpy(), b["val"].to_numpy()
            last = (path != path[-1]) | (val != val[-1]) if len(b) else np.zeros(0, bool)
            rest = b[~last]
            yield from links(b[last])
        if rest is not None:
            yield from links(rest)

    def links(b):
        if len(b) < 2:
            return
        path, val, node = b["path"].to_numpy(), b["val"].to_numpy(), b["node"].to_numpy()
        fp = b["fp"].to_numpy().view(np.uint64)
        new = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (val[1:] != val[:-1])))
        sizes = np.diff(np.append(new, len(b)))
        run_of = np.repeat(np.arange(len(new)), sizes)
        small = sizes[run_of] <= 16
        out = []
        for lag in range(1, min(16, int(sizes.max()))):
            hit = np.flatnonzero(small[lag:] & (run_of[lag:] == run_of[:-lag]) & (np.bitwise_count(fp[lag:] ^ fp[:-lag]) <= distance))
            out.append((node[hit], node[hit + lag]))
        for at in np.flatnonzero(sizes > 16):
            s = slice(new[at], new[at] + sizes[at])
            out.append(forest(fp[s], node[s], distance))
        a, c = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2
        if len(a):
            yield pd.DataFrame({"a": a, "b": c})

    return entries.repartition("path", "val").sortWithinPartitions("path", "val", "node").mapInPandas(run, "a long, b long")


def _entries(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """A row for each (path, mask): members of a bucket agree on the bits of its mask."""
    cut = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.lit(_signed(m)).alias("used")) for p, m in cuts]))
    return rows.select("fp", "node", cut.alias("c")).select(F.col("c.path").cast("long").alias("path"), F.col("fp").bitwiseAND(F.col("c.used")).alias("val"), "fp", "node")


def links(distinct: DataFrame, distance: int, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between nodes of distinct(fp, node) whose fingerprints differ in at most distance bits.

    Not all pairs: a spanning forest of each bucket, which keeps every connection. Buckets above the bound are dealt
    anew by the bits that are still free, in distance + 1 groups of which one must agree, until every one is within it.
    """
    ids = count(1)
    cuts = {next(ids): m for m in plan(distinct, distance)}
    entries, found = _entries(distinct, list(cuts.items())), None
    while True:
        hot = keep(entries.groupBy("path", "val").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("path", "val"))
        paths = [r.path for r in hot.select("path").distinct().collect()]  # ids of masks: few
        cool = entries if not paths else entries.join(hot, ["path", "val"], "left_anti")
        got = keep(_bucket_links(cool, distance))
        found = got if found is None else found.unionByName(got)
        if not paths:
            return found
        hotter, deeper = entries.join(hot, ["path", "val"], "left_semi"), []
        following: dict[int, int] = {}
        for path in paths:
            free = [b for b in range(BITS) if not cuts[path] >> b & 1]
            split = [(next(ids), cuts[path] | mask_of(free[g :: distance + 1])) for g in range(distance + 1)]
            following |= dict(split)
            deeper.append(_entries(hotter.where(F.col("path") == path), split))
        cuts, entries = following, deeper[0]
        for d in deeper[1:]:
            entries = entries.unionByName(d)
        entries = keep(entries)


def near_duplicates(docs: DataFrame, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id reachable over links of at most distance bits.

    Null and blank texts have fingerprint zero and link like any other. Equal fingerprints are one node before the
    search (combined on the map side), so copies cost nothing more; rows that repeat a doc_id are kept. A null doc_id
    can't be a component's name; its row gets that of the others. An empty table gives no rows. Other columns are not read.
    """
    fps = keep(fingerprints(docs))
    distinct = keep(fps.groupBy("fp").agg(F.min("doc_id").cast("long").alias("node")).where("node is not null"))
    roots = components(links(distinct, distance))
    named = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
