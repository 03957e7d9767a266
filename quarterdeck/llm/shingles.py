"""Near copies by Jaccard similarity of word shingles: prefix filtering, then exact comparison of the sets.

Under one order of all shingles, two sets of similarity t or more share a shingle among the first
|x| - ceil(t |x|) + 1 of each. The order puts shingles that are common in a sample last, so that they seldom are in a
prefix; it steers the cost, never the result. Every set has a bitmap in which each member turns one bit over: two bitmaps
differ in no more bits than their sets in members, so most pairs are ruled out before any set is fetched. A bitmap has
at least a bit for each member, so it tells long texts apart too; its length is a power of two, and a longer one is
folded onto a shorter. SimHash comes first: sets whose fingerprints are within a few bits are found by op4's search and
checked like all others; prefixes find what fingerprints of that distance miss.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import by_text, keep, settled
from .components import components
from .simhash import _signed, shingle_hashes

SIMILARITY = 0.8
WIDTH = 5
#: Sets on which common shingles are counted, about, and the most of these that are put last.
ORDER_ROWS = 10_000
ORDER_SHINGLES = 50_000
EPS = 1e-9
#: Bits in which the fingerprints of near copies may differ, as in op4.
DISTANCE = 2
#: Least longs of a bitmap, a power of two.
BITMAP = 8
#: Members of a star whose pairs are joined; larger ones are compared by bitmap in blocks of about BLOCK members,
#: or fewer where bitmaps have more than WEIGHT longs.
COOL, BLOCK, WEIGHT = 64, 2000, 16


def shingle_set(text: str | None, width: int = WIDTH) -> list[int]:
    """The distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, a blank one none."""
    return np.unique(shingle_hashes(text, width).view(np.int64)).tolist()


def similar(shared, a, b, similarity: float):
    """If sets of a and b members that share so many are of the similarity."""
    return shared >= similarity * (a + b - shared) - EPS


def _named(s: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(s.tobytes()))


def bitmap(s: np.ndarray) -> list[int]:
    """Bits by the hashes of a set's members, each turned over once for each member; one bit a member or more."""
    size = 64 * max(BITMAP, 1 << (max(len(s), 1) - 1 >> 6).bit_length())
    bits = np.bincount((s.view(np.uint64) >> np.uint64(20)).astype(np.int64) % size, minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def folded(bits: np.ndarray, longs: int) -> np.ndarray:
    """The bitmaps that the same sets (the last axis is one's longs) have at a shorter length."""
    while bits.shape[-1] > longs:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def may_be_similar(a: Column, b: Column, x: Column, y: Column, similarity: float) -> Column:
    """If sets of a and b members with bitmaps x and y can be of the similarity: never false where they are.

    The longer bitmap is folded once; where that is not enough, sizes more than twice apart say nothing here.
    """
    xor = lambda p, q: p.bitwiseXOR(q)
    longs = F.least(F.size(x), F.size(y))
    fold = lambda v: F.when(F.size(v) > longs, F.zip_with(F.slice(v, F.lit(1), longs), F.slice(v, longs + 1, longs), xor)).otherwise(v)
    apart = F.aggregate(F.zip_with(fold(x), fold(y), xor), F.lit(0), lambda s, v: s + F.bit_count(v))
    return (F.greatest(F.size(x), F.size(y)) > 2 * longs) | (apart <= (1 - similarity) / (1 + similarity) * (a + b) + EPS)


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in two texts or more of a bounded sample, in order, and their counts."""
    n = docs.count()
    some = docs if n <= ORDER_ROWS else docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1e6 * ORDER_ROWS / n))
    sets = by_text(some, lambda: lambda texts: [(shingle_set(t, width),) for t in texts], "s array<long>", "doc_id")
    counts = sets.select(F.explode("s").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    got = counts.orderBy(F.desc("n"), "g").limit(ORDER_SHINGLES).toPandas().sort_values("g")
    return got["g"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def _prefixes(docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """(doc_id, sid, size, p, bits, fp) for every row: a hash that names the set, its size, its prefix's shingles, its bitmap, its SimHash."""
    held = docs.sparkSession.sparkContext.broadcast(_common(docs, width))  # at most ORDER_SHINGLES

    def one(text):
        keys, n = held.value
        s = np.array(shingle_set(text, width), dtype=np.int64)
        at = np.minimum(np.searchsorted(keys, s), max(len(keys) - 1, 0))
        count = np.where(keys[at] == s, n[at], 0) if len(keys) else np.zeros(len(s), np.int64)
        first = s[np.lexsort((s, count))[: len(s) - math.ceil(similarity * len(s) - EPS) + 1]]
        return _named(s), len(s), first.tolist(), bitmap(s), _signed(simhash.fingerprint_of(s.view(np.uint64)))

    return by_text(docs, lambda: lambda texts: [one(t) for t in texts], "sid long, size int, p array<long>, bits array<long>, fp long", "doc_id")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, repeated: bool) -> DataFrame:
    """(sid, s): the sets of wanted(sid, least), from the texts of those ids alone; repeated: if rows may repeat an id."""
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def make():
        return lambda texts: [(_named(np.array(s, dtype=np.int64)), s) for s in (shingle_set(t, width) for t in texts)]

    sets = by_text(texts, make, "sid long, s array<long>", "doc_id").select("sid", "s")
    return sets.dropDuplicates(["sid"]) if repeated else sets


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are of the similarity."""
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("s").alias("y")), "b")
    return both.where(similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), similarity)).select("a", "b")


def _hot_pairs(hot: DataFrame, similarity: float, nearest: bool) -> DataFrame:
    """Pairs (a, b) of hot(to, weight, sid, size, root, bits, stars) within a star, of different roots, that may be of the similarity.

    A star's members are dealt into blocks by their bitmaps' lengths, and each two blocks meet in a task of bounded
    size; only pairs that sizes and bitmaps let through come out of it, each from the least star (of those in the
    column stars) that has both. With nearest, a member has no more than one pair in a task, that of the most alike bitmaps.
    """
    blocks = F.ceil(F.col("weight") / (BLOCK * WEIGHT)).cast("int")
    own = hot.withColumn("block", F.pmod(F.xxhash64("sid", F.lit(5)), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keyed = own.select("to", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "sid", "size", "root", "bits", "stars")

    def run(pdf):
        star, lo, hi = (int(pdf[c].iloc[0]) for c in ("to", "lo", "hi"))
        left = pdf[pdf["block"] == lo]
        right = left if lo == hi else pdf[pdf["block"] == hi]
        longs, out = right["bits"].map(len), []
        for k in sorted(set(longs)):
            there = right[longs == k]
            bits = {k: np.stack(there["bits"].to_numpy()).view(np.uint64)}
            sid, size, root = (there[c].to_numpy() for c in ("sid", "size", "root"))
            before = [{x for x in xs if x < star} for xs in there["stars"]]
            for a, n, r, own_bits, stars in zip(left["sid"], left["size"], left["root"], left["bits"], left["stars"], strict=True):
                ok = (root != r) & (np.minimum(size, n) >= similarity * np.maximum(size, n) - EPS)
                at = np.flatnonzero(ok & (sid > a) if lo == hi else ok)
                if not len(at):
                    continue
                short = min(k, len(own_bits))
                if short not in bits:
                    bits[short] = folded(bits[k], short)
                mine = folded(np.asarray(own_bits).view(np.uint64), short)
                most = (1 - similarity) / (1 + similarity) * (size[at] + n) + EPS
                bits_apart = np.concatenate([np.bitwise_count(bits[short][p] ^ mine).sum(axis=1) for p in _parts(at)])
                let = bits_apart <= most
                if nearest:
                    let &= np.arange(len(at)) == np.argmin(bits_apart / most)
                to = sid[[i for i in at[let] if nearest or before[i].isdisjoint(stars)]]
                out.append(np.column_stack([np.minimum(to, a), np.maximum(to, a)]))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])

    return keyed.groupBy("to", "lo", "hi").applyInPandas(run, "a long, b long")


def _parts(at: np.ndarray, rows: int = 256):
    """Rows to compare, some at a time, so that no copy of a whole block's bitmaps is made."""
    return (at[i : i + rows] for i in range(0, len(at), rows))


def fingerprint_pairs(once: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) of once(sid, fp) by SimHash: each set with the least one of its fingerprint, and those within distance bits."""
    nodes = keep(once.groupBy("fp").agg(F.min("sid").alias("node")))
    equal = once.select("sid", "fp").join(nodes, "fp").where("sid <> node").select(F.col("node").alias("a"), F.col("sid").alias("b"))
    return keep(equal.unionByName(simhash.links(nodes, distance).select("a", "b")).where("a <> b").distinct())


def links(docs: DataFrame, rows: DataFrame, names: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """Links (a, b) between sids that keep every connection of sets of the similarity, not all pairs.

    rows(doc_id, sid, size, p, bits, fp) may repeat a set; names(sid, least) has a row's id for each. Sets whose SimHash
    fingerprints are equal or within DISTANCE bits (by simhash.links, op4's search) are found first, and checked. Sets of
    the similarity may differ in some ten bits, so those that fingerprints miss follow. Members of a bucket are compared with one of the smallest first, as a set with little besides what a bucket shares is like most of them.
    All members of the buckets of one such set are its star: two sets of one bucket are in one star, however many
    buckets they share. In large stars each member's nearest by bitmap follows. Then all pairs of a star that these
    links leave apart, in large ones only those that their bitmaps let through.
    """
    once = keep(rows.where("doc_id is not null").dropDuplicates(["sid"]).select("sid", "size", "p", "bits", "fp"))
    repeated = not rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    entries = once.select("sid", "size", F.explode("p").alias("g"))
    order = F.shiftleft(F.col("size").cast("long"), 32) + F.col("sid").bitwiseAND(F.lit((1 << 32) - 1))  # ties alike in all buckets
    shared = entries.groupBy("g").agg(F.count("*").alias("members"), F.min_by("sid", order).alias("to")).where("members > 1").select("g", "to")
    stars = keep(entries.join(shared, "g").select("to", "sid", "size").distinct())
    fits = lambda a, b: F.least(a, b) >= similarity * F.greatest(a, b) - EPS
    side = lambda s: once.select(F.col("sid").alias(s), F.col("size").alias(f"{s}_size"), F.col("bits").alias(f"{s}_bits"))

    def near(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        both = both.where(fits(F.col("a_size"), F.col("b_size")))
        return keep(both.where(may_be_similar(F.col("a_size"), F.col("b_size"), F.col("a_bits"), F.col("b_bits"), similarity)).select("a", "b"))

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
        return settled(lambda: _verified(pairs, keep(_sets(docs, keep(wanted.join(names, "sid")), width, repeated)), similarity))

    tried = stars.where("sid <> to").select(F.col("to").alias("a"), F.col("sid").alias("b"))
    alike = fingerprint_pairs(once)
    tried = tried.unionByName(alike).distinct()
    first = near(tried)
    found = verified(first)

    def opened() -> DataFrame:
        """The stars' members (to, sid, size, root, n) where not all have one root yet."""
        placed = stars.join(settled(lambda: components(found)).withColumnRenamed("node", "sid"), "sid", "left")
        placed = keep(placed.select("to", "sid", "size", F.coalesce("root", "sid").alias("root")))
        several = placed.groupBy("to").agg(F.count("*").alias("n"), F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("to", "n")
        return keep(placed.join(several, "to"))

    def hot_pairs(nearest: bool) -> DataFrame:
        hot = open_.where(F.col("n") > COOL)
        hot = hot.join(hot.groupBy("sid").agg(F.collect_set("to").alias("stars")), "sid").join(once.select("sid", "bits"), "sid")
        hot = hot.join(hot.groupBy("to").agg(F.sum(F.greatest(F.size("bits"), F.lit(WEIGHT))).alias("weight")), "to")
        return _hot_pairs(hot, similarity, nearest).distinct()

    open_ = opened()
    if not open_.where(F.col("n") > COOL).isEmpty():
        nearest = keep(hot_pairs(True))
        found = keep(found.unionByName(verified(nearest)))
        tried = tried.unionByName(nearest)
        open_ = opened()
    cool = open_.where(F.col("n") <= COOL)
    x, y = (cool.select("to", *[F.col(c).alias(f"{c}_{side}") for c in ("sid", "size", "root")]) for side in "xy")
    apart = x.join(y, "to").where("sid_x < sid_y and root_x <> root_y").where(fits(F.col("size_x"), F.col("size_y")))
    pairs = near(apart.select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b")).distinct())
    pairs = pairs.unionByName(hot_pairs(False)).distinct()
    rest = keep(pairs.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    return found if rest.isEmpty() else found.unionByName(verified(rest))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable over pairs of texts of at least the similarity.

    Equal sets, named by a 64-bit hash, are one node; so are blank and null texts. Sets without any doc_id link with
    nothing, as a null can't be a component's name.
    """
    rows = keep(_prefixes(docs, similarity, width))
    names = keep(rows.groupBy("sid").agg(F.min("doc_id").cast("long").alias("least")).where("least is not null"))
    edges = links(docs, rows, names, similarity, width)
    ids = names.select("sid", "least")
    joined = edges.join(ids.select(F.col("sid").alias("a"), F.col("least").alias("p")), "a").join(ids.select(F.col("sid").alias("b"), F.col("least").alias("q")), "b")
    roots = components(joined.select(F.col("p").alias("a"), F.col("q").alias("b")))
    named = names.join(roots, names["least"] == roots["node"], "left").select("sid", F.coalesce("root", "least").alias("component_id"))
    return rows.select("doc_id", "sid").join(named, "sid", "left").select("doc_id", "component_id")
