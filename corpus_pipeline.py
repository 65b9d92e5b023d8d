"""The corpus pipeline: toxicity, exact copies, near copies, mixing, packing. Each stage's output is written and read again.

Every stage reads all that the one before kept. A decision names a row by its doc_id and a hash of its text, so rows that
share an id but not their text have a fate of their own, and rows without an id have one too. Of rows that repeat both
id and text, the deduplicating stages keep one. Null texts are empty; empty texts are exact copies of each other, and
near copies of nothing. Other columns are kept as they are, whatever they are called. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import LOWER, UPPER, persisted, remainder, scratch, table, text_or_empty
from sedimenta.llm.exact_dedup import exact_duplicates
from sedimenta.llm.mixing import mixed
from sedimenta.llm.packing import packed
from sedimenta.llm.parity_join import near_duplicates, text_hash
from sedimenta.llm.toxicity import fit, with_scores

BROADCAST_ROWS = 500_000


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs do not have."""
    while name in docs.columns:
        name += "_"
    return name


def staying(docs: DataFrame, key: Column, decided: DataFrame) -> DataFrame:
    """The docs that stay, each once. key: names a row's text. decided: doc_id, text (that key), stays, a row per row of docs.

    What goes is broadcast if its rows are few, else joined by shuffle.
    """
    counted = decided.groupBy("doc_id", "text").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    name, i, t = (fresh(docs, n) for n in ("__key", "__id", "__text"))
    odd = persisted(counted.filter("NOT stays OR n > 1").select(F.col("doc_id").alias(i), F.col("text").alias(t), "stays"), "odd")
    few = odd.count() <= BROADCAST_ROWS
    keyed = docs.withColumn(name, key)

    def met(rows: DataFrame, how: str) -> DataFrame:
        return keyed.join(F.broadcast(rows) if few else rows, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(name) == F.col(t)), how)

    repeated = odd.filter("stays").drop("stays")
    once = met(odd.drop("stays"), "left_anti")
    if not repeated.isEmpty():
        once = once.unionByName(met(repeated, "left_semi").dropDuplicates(["doc_id", name]))
    return once.drop(name)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), remainder(F.col("doc_id"), 5) != 0)
    name = fresh(docs, "__score")
    return with_scores(docs, model, name).filter(F.col(name) < 0.5).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = exact_duplicates(docs.select("doc_id", "text"))
    key = F.sha2(F.translate(text_or_empty(), UPPER, LOWER).cast("binary"), 256)
    return staying(docs, key, found.select("doc_id", F.col("text_sha256").alias("text"), F.col("kept").alias("stays")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"))
    return staying(docs, text_hash(), found.select("doc_id", F.col("text_hash").alias("text"), "stays"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs.select("doc_id", "text"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Compression, tokenization and keyed hashes have no SQL form; tests compare the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's own tables are deleted once its output is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = persisted(stage(spark, docs, sf_dir), f"stage-{name}", stays=True)
    return docs
