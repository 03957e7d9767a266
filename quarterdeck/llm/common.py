"""What the operators share: where intermediate tables go, and the fold of a row."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

_own: dict[str, str] = {}
#: Tables kept so far within each settled() that is open.
_on_the_way: list[list[str]] = []
#: Spark deletes a query's shuffle files at its end; what keep() has written doesn't need them.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quarterdeck-"))


def keep(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors, gives Spark the true size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    if _on_the_way:
        _on_the_way[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """keep(make()), after which the tables that were kept on the way to it are deleted."""
    _on_the_way.append([])
    try:
        made = make()
    finally:
        passed = _on_the_way.pop()
    out = keep(made)
    spark = made.sparkSession
    for path in passed:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local(df: DataFrame):
    """A bounded result as a pandas table, by Arrow: without a Python object for each row."""
    return df.toArrow().to_pandas()


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def unit(*cols: Column) -> Column:
    """A number in (0, 1) that depends on the values alone, so reruns and other partitionings agree."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)


#: Cells of each level of the histogram of a sample, and the share of the characters that a text may hold before others come first.
CELLS, LARGE = 4096, 20


def place(mark: str, size: str, chars: int) -> Column:
    """Where in (0, 1) a text stands in the order of a sample: by the hash in mark; texts of over a LARGEth of chars come last."""
    return (unit(F.col(mark)) + (F.col(size) > chars // LARGE).cast("int")) / 2


def cuts(marks: DataFrame, by: str, rows: int, chars: int) -> DataFrame:
    """(by, cut): marks(by, place, size) under the cut are about rows texts of each group, or about chars characters.

    Every group gets one text at least. No group is sorted: two levels of histograms, of CELLS rows a group at most.
    """

    def edge(cells: DataFrame, taken: DataFrame | None) -> DataFrame:
        """(by, cell, n, size): the first cell that doesn't fit, and what fits before it."""
        upto = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        run = cells.withColumn("un", F.sum("n").over(upto)).withColumn("us", F.sum("size").over(upto))
        had = (F.lit(0), F.lit(0))
        if taken is not None:
            run, had = run.join(taken.select(by, F.col("n").alias("hn"), F.col("size").alias("hs")), by), (F.col("hn"), F.col("hs"))
        over = run.where((F.col("un") + had[0] > rows) | (F.col("us") + had[1] > chars))
        return over.groupBy(by).agg(F.min_by(F.struct("cell", (F.col("un") - F.col("n")).alias("n"), (F.col("us") - F.col("size")).alias("size")), "cell").alias("e")).select(by, "e.*")

    coarse = F.floor(F.col("place") * CELLS)
    sums = F.count("*").alias("n"), F.sum("size").alias("size")
    first = keep(edge(marks.groupBy(by, coarse.alias("cell")).agg(*sums), None))
    fine = F.floor((F.col("place") * CELLS - coarse) * CELLS)
    inner = marks.join(first.select(by, F.col("cell").alias("outer")), by).where(coarse == F.col("outer"))
    second = edge(inner.groupBy(by, fine.alias("cell")).agg(*sums), first)
    least = marks.groupBy(by).agg(F.min("place").alias("least"))
    both = least.join(first.select(by, F.col("cell").alias("outer")), by, "left").join(second.select(by, F.col("cell").alias("within")), by, "left")
    cut = F.when(F.col("outer").isNull(), F.lit(2.0)).otherwise(F.greatest((F.col("outer") + F.coalesce("within", F.lit(CELLS)) / CELLS) / CELLS, F.col("least") + 1e-15))
    return keep(both.select(by, cut.alias("cut")))


def sampled(known: DataFrame, by: str, rows: int, chars: int) -> DataFrame:
    """(by, text): distinct whole texts of each group of known(by, text), chosen by cuts(); how often one repeats doesn't count."""
    known = known.where(F.col(by).isNotNull() & F.col("text").isNotNull()).select(by, "text", F.xxhash64("text", F.lit(11)).alias("mark"), F.length("text").cast("long").alias("size"))
    known = known.withColumn("place", place("mark", "size", chars))
    marks = keep(known.groupBy(by, "mark", "place").agg(F.max("size").alias("size")))
    chosen = known.join(cuts(marks, by, rows, chars), by).where(F.col("place") < F.col("cut"))
    return chosen.groupBy(by, "mark").agg(F.min("text").alias("text")).select(by, "text")


def by_text(docs: DataFrame, make: Callable[[], Callable[[list], list]], fields: str, *kept: str) -> DataFrame:
    """The kept columns of docs, untouched, and the given fields, worked out from the whole texts of a batch.

    make() is called once in a task and returns a function from a list of texts to a list of rows.
    """
    added = _parse_datatype_string(fields)
    schema = StructType([*docs.select(*kept).schema.fields, *added.fields])

    def run(batches):
        work, kinds = make(), to_arrow_schema(added)
        for b in batches:
            rows = work(b.column(at).to_pylist())
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(added.fields)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], *[pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)]], names=[f.name for f in schema.fields]
            )

    at = kept.index("text") if "text" in kept else len(kept)
    return docs.select(*kept, *[F.col("text").alias("text to read")][: at == len(kept)]).mapInArrow(run, schema)
