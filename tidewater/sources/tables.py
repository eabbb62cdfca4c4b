"""Reading tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A scan is split by row groups, which are seldom larger.
ROW_GROUP = 128 << 20


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose rows reach all cores. One with fewer files and row groups than cores is dealt out anew, which
    only small tables are; a larger one is scanned as it lies. Column pruning and filters still reach the scan."""
    df = spark.read.parquet(path)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = spark.sparkContext.defaultParallelism
    if size // ROW_GROUP >= cores or len(df.inputFiles()) >= cores:  # files are listed for small tables alone
        return df
    return df.repartition(cores)
