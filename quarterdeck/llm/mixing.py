"""Mixing sources to target weights by Pareto order sampling.

Targets are words per source. A document of expected copies m gets floor(m) certain whole copies; the fraction is its
inclusion probability p, unequal within a source. Documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and taken from the smallest on until the source's remaining words are reached.

Random numbers come from a hash of id and text, so reruns and other partitionings agree; rows that repeat both are
numbered and drawn apart. No source is gathered or sorted as a whole: ranks are cut by two levels of histograms, and
only the last bucket of a source is looked at row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, unit

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Expected copies grow with this power of a document's length class (a power of two): longer texts are taken sooner.
TILT = 0.25
BUCKETS = 4096
SEED = 20
#: Rows that are numbered in one group.
RUN = 1 << 13


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drawn(docs: DataFrame, text_hash: Column | None = None) -> DataFrame:
    """docs(doc_id, text or its hash, ...) with draw, a hash by which each row's random number is made.

    It is a hash of id and text. Rows that repeat both are numbered, so that they are drawn apart: those that differ in
    another column, as their source, by a hash of it; the rest are alike, so it doesn't matter which of them gets which
    number, in whatever order they stand. They are numbered by runs of bounded length, and the runs put one behind the
    other, so no group of copies meets in a task.
    """
    mark = F.xxhash64("text") if text_hash is None else text_hash
    rows = docs.withColumn("draw", F.xxhash64(F.col("doc_id"), mark)).withColumn("kind", F.xxhash64(*[F.col(c) for c in docs.columns if c != "text"], mark))
    again = keep(rows.groupBy("draw").agg(F.count("*").alias("times")).where("times > 1").select("draw"))
    if again.isEmpty():
        return rows.drop("kind")
    rows = keep(rows.withColumn("at", F.monotonically_increasing_id()))
    place = rows.select("draw", "kind", "at").join(again, "draw", "left_semi").withColumn("run", F.floor(F.col("at") / RUN))
    runs = keep(place.groupBy("kind", "run").agg(F.count("*").alias("times")))
    before = F.coalesce(F.sum("times").over(Window.partitionBy("kind").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("kind", "run").orderBy("at"))
    numbered = place.withColumn("own", own).join(runs.select("kind", "run", before.alias("before")), ["kind", "run"])
    new = numbered.select("at", F.xxhash64("draw", "kind", F.col("before") + F.col("own")).alias("new"))
    return keep(rows.join(new, "at", "left").withColumn("draw", F.coalesce("new", "draw")).drop("at", "new", "kind"))


def _ordered(sources: DataFrame) -> DataFrame:
    """sources with their rank by code point, null last: a range sort and counts by partition, so no task sees them all."""
    spread = keep(
        sources.withColumn("is_null", F.col("source").isNull()).repartitionByRange("is_null", "source").withColumn("pid", F.spark_partition_id())
    )
    n = spread.groupBy("pid").agg(F.count("*").alias("n"))  # a row for each partition
    before = n.withColumn("before", F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("pid").orderBy("is_null", "source"))
    return spread.withColumn("own", own).join(before, "pid").withColumn("rank", F.col("own") + F.coalesce("before", F.lit(0)) - 1).drop("own", "before", "n", "pid", "is_null")


def targets(sources: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """sources(source, source_size) with target: shares of all words by weight, none above most times its source.

    What is above is shared again by weight among the others until none is above. Sources without words get zero.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    rows = keep(_ordered(sources).select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words by unit of weight among those below their cap
    while True:
        below = F.col("cap") > level * F.col("w")
        left = rows.agg(F.sum(F.when(below, F.col("w"))), F.sum(F.when(~below, F.col("cap")))).first()
        following = (total - (left[1] or 0.0)) / left[0] if left[0] else float("inf")
        if following <= level:
            break
        level = following
        if level == float("inf"):
            break
    share = F.col("cap") if level == float("inf") else F.least("cap", F.lit(level) * F.col("w"))
    return rows.select("source", "source_size", share.alias("target"))


def _by_source(df: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """df with what params says of its source; null is a source like any other."""
    return df.join(params.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), how).drop("of")


def _length_class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int")


def _rates(sizes: DataFrame, goals: DataFrame, most: float, tilt: float) -> DataFrame:
    """goals with rate: expected copies of a document are least(most, rate * 2 ** (tilt * class)), to sum to the target.

    Solved on the length classes (at most 63 rows a source): the longest k classes stand at the most.
    """
    x = F.pow(F.lit(2.0), F.lit(tilt) * F.col("cls"))
    classes = sizes.where("size > 0").groupBy("source", _length_class(F.col("size")).alias("cls")).agg(F.sum("size").alias("s"))
    longer = Window.partitionBy("source").orderBy(F.desc("cls")).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("source").orderBy(F.desc("cls")).rowsBetween(0, Window.unboundedFollowing)
    tried = (
        _by_source(classes, goals).withColumn("x", x).withColumn("at_most", F.coalesce(F.sum("s").over(longer), F.lit(0))).withColumn("moving", F.sum(F.col("s") * F.col("x")).over(rest))
        .withColumn("rate", (F.col("target") - float(most) * F.col("at_most")) / F.col("moving"))
        .where(F.col("rate") * F.col("x") <= most * (1 + 1e-12))
    )
    best = tried.groupBy("source").agg(F.max("rate").alias("rate"))
    return _by_source(goals, best, "left").withColumn("rate", F.coalesce("rate", F.lit(float("inf"))))


def _expected(most: float, tilt: float) -> Column:
    m = F.least(F.lit(float(most)), F.col("rate") * F.pow(F.lit(2.0), F.lit(tilt) * _length_class(F.col("size"))))
    near = F.round(m)
    return F.when(F.abs(m - near) < 1e-9, near).otherwise(m)


def _rank(p: Column, u: Column) -> Column:
    """Random odds over inclusion odds q, as q / (1 + q): the same order within (0, 1)."""
    return u * (1 - p) / (u * (1 - p) + p * (1 - u))


def _with_ranks(df: DataFrame, most: float, tilt: float, seed: int) -> DataFrame:
    """df(draw, size, rate) with sure (whole copies) and z (rank among those with a fraction, else null)."""
    p = F.col("m") - F.floor("m")
    return df.withColumn("m", _expected(most, tilt)).withColumn("sure", F.floor("m").cast("long")).withColumn(
        "z", F.when((p > 0) & (F.col("size") > 0), _rank(p, unit(F.col("draw"), F.lit(seed))))
    ).drop("m")


def _boundary(rows: DataFrame, cell: Column) -> DataFrame:
    """For rows(source, z, size, need): the cell in which a source's cumulated words reach its need, and its need there."""
    cells = rows.groupBy("source", "need", cell.alias("cell")).agg(F.sum("size").alias("s"))
    up = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("upto", F.sum("s").over(up))
    hit = run.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("s") < F.col("need")))
    return hit.select("source", "cell", (F.col("need") - F.col("upto") + F.col("s")).alias("need"))


def parameters(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, tilt: float = TILT, seed: int = SEED) -> DataFrame:
    """(source, source_size, target, rate, cut): all that decides a document's copies, a row for each source.

    docs(draw, source, size). A document takes its whole copies, and one more where its rank is at most cut.
    """
    sizes = keep(docs.select("draw", "source", "size"))
    goals = keep(_rates(sizes, targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), most, tilt))
    ranked = keep(_with_ranks(_by_source(sizes, goals), most, tilt, seed).select("source", "size", "sure", "z", "target"))
    sure = ranked.groupBy("source", "target").agg(F.sum(F.col("sure") * F.col("size")).alias("taken"))
    need = sure.select("source", (F.col("target") - F.col("taken")).alias("need")).where("need > 0.5")
    rows = _by_source(ranked.where("z is not null").select("source", "z", "size"), need)
    coarse = F.floor(F.col("z") * BUCKETS)
    inner = _by_source(rows.drop("need"), keep(_boundary(rows, coarse))).where(coarse == F.col("cell")).drop("cell")
    fine = F.floor((F.col("z") * BUCKETS - coarse) * BUCKETS)
    last = _by_source(inner.drop("need"), _boundary(inner, fine)).where(fine == F.col("cell"))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("z", "size")) - F.col("size")
    chosen = last.withColumn("ok", before + F.col("size") / 2 <= F.col("need"))  # the nearer side of the need
    edge = (coarse + F.col("cell") / BUCKETS) / BUCKETS
    cuts = chosen.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("ok"), F.col("z"))), F.min(edge) - 1e-15).alias("cut"))
    # a source whose every fraction is needed has no boundary: all of it is taken
    taken = _by_source(need.select("source"), cuts, "left").select("source", F.coalesce("cut", F.lit(2.0)).alias("cut"))
    return keep(_by_source(goals, taken, "left").withColumn("cut", F.coalesce("cut", F.lit(-1.0))))


def copies(docs: DataFrame, params: DataFrame, most: int = MOST_COPIES, tilt: float = TILT, seed: int = SEED) -> DataFrame:
    """docs(draw, source, size, ...) with source_size, target and copies; one join with a row for each source."""
    both = _with_ranks(_by_source(docs, params), most, tilt, seed)
    times = F.when(F.col("size") > 0, F.col("sure") + F.when(F.col("z") <= F.col("cut"), 1).otherwise(0)).otherwise(F.lit(0))
    return both.withColumn("copies", times.cast("long")).drop("sure", "z", "cut", "rate", "draw")


def mix(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    Null and blank texts have size 0 and take nothing; a null source is a source of its own, last in order. Rows that
    repeat each are documents of their own, and so are those without an id, and those that repeat id and text in another
    source; the order of rows doesn't matter. An empty table gives no rows. Other columns
    are not read.
    """
    mine = docs.select("doc_id", "source", "text")
    sized = drawn(keep(mine.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))), F.col("mark"))
    return copies(sized, parameters(sized, **how)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
