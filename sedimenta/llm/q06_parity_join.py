"""op6: links between all documents' sets of 5-word shingles."""

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.common import table
from sedimenta.llm.parity_join import near_duplicates


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs of whole tables are too slow in SQL; tests compare with all pairs of a small table.
QUERIES = {"op6_parity_join": op6_parity_join}
ORACLES: dict[str, str] = {}
