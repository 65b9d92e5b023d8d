"""op3: a toxicity score for every document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import remainder, table
from sedimenta.llm.toxicity import fit, scored


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels").select("doc_id", "toxic"), remainder(F.col("doc_id"), 5) != 0)
    return scored(documents, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Compression has no SQL form; tests measure held-out accuracy.
QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
