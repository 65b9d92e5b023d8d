"""op5: all documents packed into sequences of 2048 tokens."""

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.common import table
from sedimenta.llm.packing import packed


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Tokenization has no SQL form; tests compare with the tokenizer on whole texts and with a bound on the bins.
QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLES: dict[str, str] = {}
