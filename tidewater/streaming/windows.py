"""Declarative streaming operators: tumbling, sliding and session windows, dedup, as streaming frames or run to their end."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewater.sources.shared import fresh_path

BATCH = "_batch"


def events_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A table's files as a stream, ts as a timestamp with zone, which watermarks need. Works for a file and for a folder."""
    schema = spark.read.parquet(path).schema
    name = path.rstrip("/").rsplit("/", 1)[-1]
    folder = path.rstrip("/").rsplit("/", 1)[0]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet")
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_file = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs_path).isFile()
    out = stream.option("pathGlobFilter", name).parquet(folder) if is_file else stream.parquet(path)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_end(df: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Start a streaming frame, let it take all that is there, and give what it has written: each batch is a table in the shared
    folder, written again if the batch is, and so are the query's checkpoints. keys: of an update stream, the latest row of each."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "stream")
    spark.createDataFrame([], df.schema).write.parquet(f"{path}/out/{BATCH}=-1")

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{BATCH}={n}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(StructType([*df.schema, StructField(BATCH, LongType())])).parquet(f"{path}/out")
    if mode == "complete":
        out = out.join(F.broadcast(out.agg(F.max(BATCH).alias("_last"))), F.col(BATCH) == F.col("_last")).drop("_last")
    if keys:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(BATCH)))
        out = out.withColumn("_n", nth).where("_n = 1").drop("_n")
    return out.drop(BATCH)


class Bounded:
    """A subscriber's queue of at most `size` messages: what comes while it is full is dropped, and counted."""

    def __init__(self, size: int = 200):
        self.held, self.size, self.dropped = deque(), size, 0

    def put(self, messages: list) -> None:
        room = max(0, self.size - len(self.held))
        self.held.extend(messages[:room])
        self.dropped += len(messages) - min(room, len(messages))

    def take(self) -> list:
        out = list(self.held)
        self.held.clear()
        return out


def publish(df: DataFrame, subscribers: list[Bounded], checkpoint: str, order: str):
    """A streaming frame's changed rows to each subscriber, as JSON, in order; each batch brings a queue's size of them at most to
    the driver, as no more could be held."""

    def send(batch: DataFrame, n: int) -> None:
        for q in subscribers:
            found = batch.orderBy(order).limit(q.size + 1).toJSON().collect()
            q.put(found)

    return df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(send).start()


def tumbling(stream: DataFrame, size: str, late: str, by: list[str]) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding(stream: DataFrame, size: str, step: str, late: str, by: list[str]) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size, step), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, gap: str, late: str, by: list[str]) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *by).agg(F.count(F.lit(1)).alias("n"))


def first_of(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Rows whose keys haven't been seen within the watermark: a re-publish of the same text passes once."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def progress(query) -> dict:
    """Figures of a running query: batches, rows, and input seconds for each second of work."""
    done = query.recentProgress
    rows = sum(p["numInputRows"] for p in done)
    ms = sum(p["durationMs"].get("triggerExecution", 0) for p in done)
    return {"batches": len(done), "rows": rows, "seconds": ms / 1000, "rows_per_second": rows / max(ms / 1000, 1e-9)}
