"""op1: the log probability of every document under a context-tree model of the training documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import remainder, table
from sedimenta.llm.context_tree import scored


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 7) == 2
    bits = F.when(F.col("n_bytes") > 0, -F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes"))
    return scored(documents, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))


#: The tree has no SQL form; tests compare with a brute-force tree, and the base with plain counts.
QUERIES = {"op1_context_tree": op1_context_tree}
ORACLES: dict[str, str] = {}
