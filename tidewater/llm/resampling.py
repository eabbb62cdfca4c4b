"""Importance resampling towards a target distribution, by hashed runs of words.

Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII; features are all runs of 1 to RUNS
consecutive words, joined by a space, and a feature's bucket is its crc32 modulo BUCKETS. A document is scanned once: a ring
keeps the running CRC states of the features begun at the last words, each word goes on with them by a space and itself, and the
states are the features' hashes. The scan writes each document's buckets, packed; what comes after reads these alone.

A bucket's gain is the log ratio of its smoothed shares in target and source, in thousandths, floored. A document's weight is the
floored mean of its features' gains, and its score the weight and Gumbel noise of its id, so that the highest scores are
a draw in proportion to the exponential weights. Ranks come from ranges of the order of scores, each numbered on its own.

Counts are of all documents and target texts; BUCKETS of them are brought together and broadcast. Null texts have no words, a weight of
0 and are never drawn. A null id draws its noise as the empty text and comes before others of the same score. Repeated rows are each
counted, scored and ranked; rows of like score and id are ranked by features, then in the order in which they were written. Texts of
any length are scanned whole. An empty table gives an empty result, an empty target a uniform one. Other columns are ignored.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, written
from tidewater.llm.decontamination import words
from tidewater.llm.hashing import chunks
from tidewater.llm.mixing import running
from tidewater.sources.tables import read_spread

RUNS, BUCKETS, LEAST_WORDS, SHARE = 2, 10_000, 20, 25


def hashes(text: bytes, runs: int) -> tuple[int, list[int]]:
    """The number of words, and the crc32 of each feature."""
    ring: list[int] = []
    out: list[int] = []
    split = words(text)
    for w in split:
        longer = b" " + w
        ring = [crc32(longer, state) for state in ring[len(ring) + 1 - runs if len(ring) >= runs else 0 :]] if runs > 1 else []
        ring.append(crc32(w))
        out += ring
    return len(split), out


def bucketed(texts: DataFrame, id_col: str | None, text_col: str, runs: int, buckets: int) -> DataFrame:
    """_id, _words, _features, _buckets for each row: the buckets sorted, as packed differences."""
    bounded_batches(texts.sparkSession)
    base = texts.select((F.col(id_col) if id_col else F.lit(0)).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            found = [t.as_py() for t in pc.fill_null(batch.column("_text").cast(pa.large_binary()), b"")]
            for i, j in chunks(found):
                many, features, packed = [], [], []
                for t in found[i:j]:
                    n, h = hashes(t, runs)
                    at = np.sort(np.array(h, "u4") % np.uint32(buckets))
                    many.append(n)
                    features.append(len(h))
                    packed.append(squeeze(np.diff(at, prepend=np.uint32(0)).tobytes()) if len(h) else b"")
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(many, pa.int64()), pa.array(features, pa.int64()), pa.array(packed, pa.binary())], ["_id", "_words", "_features", "_buckets"])

    return base.mapInArrow(run, f"_id {kind}, _words bigint, _features bigint, _buckets binary")


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u4")) if data else np.zeros(0, "i8")


def totals(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features each bucket has over all rows: a partial sum for each task, then at most a row for each bucket."""

    def run(batches):
        n = np.zeros(buckets, "i8")
        for batch in batches:
            for data in batch.column("_buckets"):
                n += np.bincount(unpacked(data.as_py()).astype("i8"), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, "i8")
    for r in found.select("_buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the source)) of each bucket."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], "i8")


def noise(id_col: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", runs: int = RUNS, buckets: int = BUCKETS, least: int = LEAST_WORDS, share: int = SHARE, seed: int = 7) -> DataFrame:
    """id, n_words, n_features, weight, score, rank for each row: of the N rows of at least `least` words the floor(share * N / 100)
    of highest score have a rank, from 1."""
    spark = docs.sparkSession
    found = written(bucketed(docs, id_col, text_col, runs, buckets).withColumn("_row", F.monotonically_increasing_id()), "resample-buckets")
    wanted = bucketed(target, None, target_text, runs, buckets)
    shared = spark.sparkContext.broadcast(gains(totals(found, buckets), totals(wanted, buckets)))
    kind = found.schema["_id"].dataType.simpleString()

    def run(batches):
        gain = shared.value
        for batch in batches:
            weight = [int(gain[unpacked(data.as_py()).astype("i8")].sum()) // max(n, 1) for n, data in zip(batch.column("_features").to_pylist(), batch.column("_buckets"), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_words", "_features", "_row")), pa.array(weight, pa.int64())], ["_id", "_words", "_features", "_row", "weight"])

    scored = found.select("_id", "_words", "_features", "_row", "_buckets").mapInArrow(run, f"_id {kind}, _words bigint, _features bigint, _row bigint, weight bigint")
    scored = written(scored.withColumn("score", F.col("weight") + noise(F.col("_id"), seed)), "resample-scores")
    enough = scored.where(F.col("_words") >= least)
    n = enough.count()
    order = ["_down", "_id", "_features", "_row"]
    ranked = running(enough.withColumn("_down", -F.col("score")).withColumn("_one", F.lit(1).cast("bigint")), n, [], order, "_one", "_ahead")
    drawn = F.when(F.col("_ahead") < F.lit(share * n // 100), F.col("_ahead") + 1)
    out = ranked.select(*scored.columns, drawn.cast("bigint").alias("rank")).union(scored.where(F.col("_words") < least).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(F.col("_id").alias(id_col), F.col("_words").alias("n_words"), F.col("_features").alias("n_features"), "weight", "score", "rank")


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    out = resample(read_spread(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# crc32 by the byte, from its table; the table is made from the polynomial.
OP11_SQL = r"""
WITH RECURSIVE c0 AS (SELECT range AS k, range AS v, 0 AS step FROM range(256)
  UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM c0 WHERE step < 8),
tab AS (SELECT k, v FROM c0 WHERE step = 8),
txt AS (SELECT 0 AS side, row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
w AS (SELECT side, r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM txt),
f AS (SELECT side, r, unnest(w) AS f FROM w UNION ALL SELECT side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
d AS (SELECT f, row_number() OVER () AS j, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
run AS (SELECT j, 0 AS done, 4294967295::BIGINT AS v, h FROM d
  UNION ALL SELECT j, done + 1, xor(run.v >> 8, tab.v), h FROM run JOIN tab ON tab.k = xor(run.v & 255, ('0x' || substr(h, 2 * done + 1, 2))::BIGINT) WHERE 2 * done < len(h)),
b AS (SELECT d.f, xor(run.v, 4294967295) % 10000 AS bucket FROM run JOIN d USING (j) WHERE 2 * done = len(run.h)),
fb AS (SELECT side, r, bucket FROM f JOIN b USING (f)),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM fb GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS sa, coalesce(sum(t), 0) AS ta FROM n),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sa + 10000)::DOUBLE / ((s + 1)::DOUBLE * (ta + 10000)::DOUBLE)))::BIGINT AS gain FROM n, a),
p AS (SELECT r, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM fb JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
q AS (SELECT w.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(w.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN p ON w.r = p.r WHERE side = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS o, count(*) FILTER (words >= 20) OVER () AS many FROM q)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN words >= 20 AND o <= 25 * many // 100 THEN o END::BIGINT AS rank FROM k
"""
