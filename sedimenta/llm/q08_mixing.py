"""op8: a mix of all documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import table
from sedimenta.llm.mixing import sized, with_copies


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return with_copies(rows).select("doc_id", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


#: `taken` depends on Spark's xxhash64 and has no SQL form; tests compare targets with a brute-force version.
QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
