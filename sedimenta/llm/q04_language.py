"""op4: the language of every page."""

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm.common import table
from sedimenta.llm.language import languages_of


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages_of(table(spark, sf_dir, "pages").select("page_id", "url", "html"), table(spark, sf_dir, "documents").select("lang", "text"))


#: Hashed trigrams have no SQL form; tests measure accuracy and compare the fusion with a brute-force version.
QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
