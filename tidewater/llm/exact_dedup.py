"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

Rows: equal texts are those identical after each run of ASCII white space becomes one space; null counts as empty.
Of equal texts the smallest id stays. Rows that repeat an id and its text are one document: each is `kept` if its id is
the one that stays, and each counts in group_size. A null id never is the smallest unless all ids of a group are null;
such a group has keep_id null and kept null -> false. Texts of any length are read whole. An empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import WS, bitmap, marked, written

#: Characters of the normalised text that the second key hashes.
PREFIX = 128


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """id, keep_id, group_size, kept, full_hash for each row.

    Three scans, each of less: of all texts the length; of those whose length isn't alone, the hash of the prefix; of those
    whose length and prefix hash aren't alone, the full hash, by which alone they are grouped. Survivors are marked in bitmaps
    of a fixed size (which let others through as they fill up, and never lose one), so texts are never shuffled. full_hash is
    null for rows that didn't survive, unless digest_all asks for all.
    """
    base = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_t")).withColumn("_len", F.octet_length("_t"))
    lengths = bitmap(base.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), F.col("_len"))
    hashed = marked(base, F.col("_len"), lengths, "_shared").withColumn("_prefix", F.when(F.col("_shared"), F.xxhash64(F.substring("_t", 1, PREFIX))))
    both = F.struct("_len", "_prefix")
    prefixes = bitmap(hashed.where("_shared").groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), both)
    survivors = marked(hashed, both, prefixes).withColumn("_hit", F.col("_hit") & F.col("_shared"))
    full = F.sha2(F.col("_t").cast("binary"), 256)
    rows = written(survivors.select("_id", "_hit", (full if digest_all else F.when(F.col("_hit"), full)).alias("_full")), "exact-rows")
    groups = written(
        rows.where("_hit").groupBy(F.col("_full").alias("_g")).agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1"), "exact-groups"
    )
    # Both sides are plain exchanges, so that adaptive execution can split the rows of a hot group.
    out = rows.join(groups, F.col("_hit") & (F.col("_full") == F.col("_g")), "left")
    keep = F.when(F.col("_g").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(keep == F.col("_id"), F.lit(False)).alias("kept"), F.col("_full").alias("full_hash"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The query's digest is of every text; groups are the survivors' alone."""
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest_all=True)
    return out.withColumnRenamed("full_hash", "text_sha256")


OP6_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.n) AS text_sha256
FROM t JOIN g ON t.n = g.n
"""
