"""Shared pieces of the training-data operators: the shared folder, written tables, folds and text rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.shared import delete, fresh_path

#: ASCII white space, the only separator of words for most operators.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, tag: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder, in folders by some columns, and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.partitionBy(*by).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables that written() made, from the since-th on. Only for results that have been read to their end."""
    for session, path in _written[since:]:
        delete(session, path)
    del _written[since:]


def mark() -> int:
    return len(_written)


def last_written() -> str:
    """The path of the latest table that written() made."""
    return _written[-1][1]


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bits of a bitmap of keys, which bounds what is broadcast to 4 MB and its index, whatever the number of keys.
BITS = 1 << 25


def bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """One bit for the hash of each key, in pieces of 4 KB, as a written table."""
    at = F.pmod(F.xxhash64(key), F.lit(BITS))
    return written(keys.select(F.shiftright(at, 15).cast("int").alias("_piece"), at.bitwiseAND(32767).alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "bitmap")


def marked(df: DataFrame, key: Column, bits: DataFrame, name: str = "_hit") -> DataFrame:
    """df with whether the bit of its key is set: true for all keys of the bitmap, and for few others while it is sparse."""
    at = F.pmod(F.xxhash64(key), F.lit(BITS))
    df = df.withColumn("_piece", F.shiftright(at, 15).cast("int")).withColumn("_bit", at.bitwiseAND(32767).cast("int")).join(F.broadcast(bits), "_piece", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3) + 1, F.lit(1))), 16, 10).cast("int")
    return df.withColumn(name, F.coalesce(F.call_function("getbit", byte, F.col("_bit").bitwiseAND(7)) == 1, F.lit(False))).drop("_piece", "_bit", "_bits")


_built: dict[str, object] = {}


def built(key: str, make):
    """What make() gives, made once in a Python worker for each key. The latest alone is held."""
    if key not in _built:
        _built.clear()
        _built[key] = make()
    return _built[key]


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of so many rows at most, as texts can be long. A setting below Spark's own 10000 is left as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) >= 10000:
        spark.conf.set(key, rows)


def token() -> str:
    return uuid.uuid4().hex
