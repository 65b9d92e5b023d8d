"""op9: every document with its personal data replaced."""

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.common import table
from sedimenta.llm.surrogates import with_surrogates

KEY = "sedimenta-op9"


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)


#: Keyed surrogates have no plain SQL form; tests hold texts, distinctness and coreference against a brute-force search.
QUERIES = {"op9_surrogates": op9_surrogates}
ORACLES: dict[str, str] = {}
