"""Sharding by sampled splitters, law `bytes`. DataFrame functions only.

Records are ordered by a 52-bit hash of their text, so that equal texts stand together. A sample drawn in proportion to
size gives quantile boundaries, which cut the keys into RANGES ranges. Keys that alone hold more than 1/64 of a shard
(large groups of equal texts) are cut by row, whatever their ids, and other ranges over that size by key; whole units then fill
the shards in key order. So shards are near equal in bytes, and equal texts share a shard unless their group is that large.

A null text has no bytes and counts as empty; its crc is that of the empty text. Null and repeated ids are placed like others, as
hot groups are cut by the rows' numbers in a written table; null ids come first in their unit. Repeated rows are all placed. Texts of any length are sized whole; one that is larger than a shard makes
its shard as much larger. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import written

RANGES, SAMPLE, FINE = 4096, 1 << 16, 64


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most key, by binary search in a folded expression."""
    if not bounds:
        return F.lit(0)
    at, steps = F.lit(bounds), [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda acc, s: acc + F.when(F.get(at, acc + s - 1) <= key, s).otherwise(0))


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot for each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("bigint").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.shiftrightunsigned(F.xxhash64(text), 12).alias("_key")
        ),
        "shard-rows",
    )
    total = rows.agg(F.sum("_size")).first()[0] or 0
    full = total / shards
    chance = F.pmod(F.xxhash64("_row", "_id", "_key", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    copies = F.floor(chance + F.col("_size") * (SAMPLE / max(total, 1))).cast("bigint")
    # About SAMPLE keys, which bounds the array.
    sample = rows.select("_key", copies.alias("_w")).where("_w > 0").select(F.explode(F.array_repeat("_key", F.col("_w").cast("int"))).alias("_key"))
    keys = sample.agg(F.sort_array(F.collect_list("_key")).alias("_k"))
    nth = F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda i: F.element_at("_k", F.ceil(i * F.size("_k") / RANGES).cast("int")))
    bounds = (keys.where(F.size("_k") > 0).select(F.array_sort(F.array_distinct(nth))).first() or [[]])[0]
    # Less than shards * FINE keys, and ranges, can each hold more than full / FINE bytes: that bounds what is broadcast.
    heavy, parts = F.col("_s") > full / FINE, F.ceil(F.col("_s") * (2 * FINE) / int(full + 1)).cast("bigint")
    hot = written(rows.groupBy("_key").agg(F.sum("_size").alias("_s")).where(heavy).select("_key", parts.alias("_parts")), "shard-keys")
    placed = rows.join(F.broadcast(hot), "_key", "left").withColumn("_range", range_of(F.col("_key"), bounds))
    over = written(placed.where("_parts is null").groupBy("_range").agg(F.sum("_size").alias("_s")).where(heavy).select("_range", parts.alias("_cuts")), "shard-ranges")
    own = F.when(F.col("_parts").isNotNull(), F.col("_key")).otherwise(F.lit(-1))
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("_row", "_id"), F.col("_parts"))).when(F.col("_cuts").isNotNull(), F.pmod(F.xxhash64("_key"), F.col("_cuts"))).otherwise(F.lit(0))
    unit = ["_range", "_own", "_part"]
    units = placed.join(F.broadcast(over), "_range", "left").select("_id", "_size", "_crc", "_key", "_range", own.alias("_own"), part.alias("_part"))
    # At most RANGES units and 2 * FINE more for each shard and way of cutting.
    sums = units.groupBy(*unit).agg(F.sum("_size").alias("_s"), F.count(F.lit(1)).alias("_m"))
    ahead = lambda c, by: F.coalesce(F.sum(c).over(Window.partitionBy(*by).orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_shard", F.least(F.lit(shards - 1), F.floor((ahead("_s", []) + F.col("_s") / 2) / max(full, 1e-9))).cast("int"))
    plan = written(sums.withColumn("_first", ahead("_m", ["_shard"])).drop("_s", "_m"), "shard-units")
    # The records themselves are dealt out by ranges, within which they are numbered.
    dealt = units.repartitionByRange(*unit)
    return (
        dealt.withColumn("_n", F.row_number().over(Window.partitionBy(*unit).orderBy("_id", "_key")))
        .join(F.broadcast(plan), unit)
        .select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), (F.col("_first") + F.col("_n") - 1).cast("bigint").alias("slot"))
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
