"""Documents to packed training sequences: quality, near-duplicates, secrets, source mix, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and is the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterdeck.llm import mixing, nbsvm, packing, secrets, shingles
from quarterdeck.llm.common import fold, keep, settled, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't take for label 0. The labels of the held-out third aren't learned from.

    Null and empty texts have no features and are judged by the bias alone; rows that repeat are judged alike. Without
    labels of both classes nothing is known against a document of the one class, and all are kept or none. An empty
    table gives no rows; columns besides those of documents are left out, whatever their names. So in all stages.
    """
    labels = table(spark, sf_dir, "labels")
    model = nbsvm.learn(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return nbsvm.score(docs, model, *COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component. The others are named by id; texts aren't shuffled for few of them.

    Components are of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; blank and null
    texts are one such set. Rows that repeat an id are one document, whatever their texts: that of the least text hash
    stays. Rows without an id can't be named and stay.
    """
    found = settled(lambda: shingles.near_copies(docs))
    others = found.where("doc_id <> component_id").select("doc_id").distinct()
    left = docs.select(*COLUMNS).join(others, "doc_id", "left_anti")
    again = keep(found.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id"))
    if again.isEmpty():
        return left
    order = F.struct(F.xxhash64("text"), *[F.xxhash64(c) for c in COLUMNS])
    least = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*COLUMNS), order).alias("row")).select("row.*")
    return left.join(again, "doc_id", "left_anti").unionByName(least)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; every secret found is masked, and n_chars is the length of what is left.

    Null and empty texts stay as they are, with a null and a zero length. Rows that repeat are masked alike.
    """
    mine = docs.select(*COLUMNS)
    return secrets.redact(mine, secrets.learn(mine)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to three times, or not at all.

    Null and blank texts have no words and are never taken. A null source is one like any other. Rows that repeat, and
    rows without an id, are drawn each for itself.
    """
    sized = mixing.drawn(docs.select(*COLUMNS, mixing.words(F.col("text")).alias("size")))
    taken = mixing.copies(sized, mixing.parameters(sized))
    return taken.where("copies > 0").select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in their sequences; null and empty texts are the end id alone, repeated rows are packed each."""
    return packing.best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix", mix), ("pack", pack)]

#: No stage can be put in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
