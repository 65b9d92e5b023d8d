"""Cutting lineage in the folder that driver and executors share."""

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may do without and gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="sedimenta-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with consecutive numbers from 1 in the order of the columns: ranges are numbered side by side, no task sorts all."""
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__inside", inside).join(F.broadcast(counts), "__part").withColumn(name, F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")
