"""The corpus pipeline: five operators over documents, each on what the one before has kept.

Null, empty and repeated rows: language ID drops texts that are null, have no letter or no sure language; near-dedup keeps one row of repeated
rows; every other row goes through all stages. Empty tables give an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, bitmap, mark, marked, release, written
from tidewater.llm.decontamination import decontaminate
from tidewater.llm.language_id import UND, identify
from tidewater.llm.mixing import last_taken, mix, queued
from tidewater.llm.near_dedup import near_dedup
from tidewater.llm.sharding import shard_by_bytes
from tidewater.sources.shared import delete, fresh_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Mean probability that a document's language must have over its bytes.
SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, by at least SURE of the probability; lang becomes the predicted one."""
    out = identify(docs, keep=COLUMNS).where((F.col("lang_pred") != UND) & (F.col("score") >= SURE))
    return out.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by shingles of five words, that of the smallest doc_id, once. Rows with a
    null doc_id stay.

    Only documents whose id shares a bit of a bounded bitmap with a dropped or repeated id are joined; the rest pass by."""
    out = near_dedup(docs, size=5).where("doc_id is not null")
    act = out.groupBy("doc_id").agg(F.min("kept").alias("_kept"), F.count(F.lit(1)).alias("_n")).where("not _kept or _n > 1")
    act = written(act, "pipeline-near")
    docs = marked(docs.select(*COLUMNS), F.col("doc_id"), bitmap(act, F.col("doc_id")))
    bound = docs.where("_hit").join(act, "doc_id", "left")
    repeated = bound.where("_kept").dropDuplicates(["doc_id"])
    return docs.where("not _hit").select(*COLUMNS).union(bound.where("_n is null").select(*COLUMNS)).union(repeated.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS).where("not contaminated").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document once for each copy of it that is taken whole or by half at least. Documents without words aren't
    taken. Rows that are alike in id, text and source are taken alike.

    The mix gives a place in each source's queue; texts are held against it where they are scanned, and not moved unless the
    table of sources is too large for Spark to broadcast."""
    last = written(last_taken(mix(docs)), "pipeline-mix")
    rows = docs.where(F.rlike("text", F.lit(WORD))).select(*COLUMNS, F.struct(*queued(docs)).alias("_at"))
    rows = rows.join(last, F.col("source").eqNullSafe(F.col("_source")))
    place = lambda k: F.struct(k.alias("copy"), "_at._h", "_at.doc_id", "_at._x")
    taken = F.filter(F.lit(list(range(2))), lambda k: place(k) <= F.col("_last"))
    return rows.select(*COLUMNS, F.explode(taken).alias("_copy")).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document of the mix."""
    return shard_by_bytes(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Language ID and near-dedup can't be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage is written to the shared folder and read again; then what it read and what its operator wrote is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        since, path = mark(), fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        release(spark, since)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
