"""op2: exact copies among all documents."""

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.common import LOWER, UPPER, table
from sedimenta.llm.exact_dedup import exact_duplicates


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {"op2_exact_dedup": ORACLE}
