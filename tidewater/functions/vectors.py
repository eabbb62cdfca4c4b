"""Vector scalars over arrays. Sides are cast to double before the product."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unlike lengths and zero norms."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def usable(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector has numbers only, as many as most vectors of the table have."""
    width = df.where(F.size(vec) > 0).groupBy(F.size(vec).alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").select(F.col("n").alias("_width")).limit(1)
    return df.join(F.broadcast(width), F.size(vec) == F.col("_width")).where(~F.exists(vec, lambda x: x.isNull() | F.isnan(x))).drop("_width")


def block_join(left: DataFrame, right: DataFrame, key: tuple[str, str], blocks: tuple[int, int], run, schema: str) -> DataFrame:
    """run(left rows, right rows), Arrow tables in and out, for every block of one side with every block of the other, wherever in
    the cluster. Each row goes to as many tasks as the other side has blocks."""
    n, m = blocks
    at = lambda k, parts: F.pmod(F.xxhash64(k), F.lit(parts)).cast("int")
    a = left.withColumn("_i", at(key[0], n)).withColumn("_j", F.explode(F.lit(list(range(m)))))
    b = right.withColumn("_j", at(key[1], m)).withColumn("_i", F.explode(F.lit(list(range(n)))))
    return a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInArrow(run, schema)


def matrix(column) -> np.ndarray:
    """Vectors of one length, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def truncated(a: Column, width: int) -> Column:
    """The first numbers of a vector, at length 1 again."""
    cut = F.slice(a, 1, width)
    held = F.array(F.struct(cut.alias("v"), F.greatest(norm(cut), F.lit(1e-9)).alias("n")))  # so that the norm is taken once
    return F.get(F.transform(held, lambda s: F.transform(s["v"], lambda x: x.cast("double") / s["n"])), 0)


def hash_embed(df: DataFrame, keys: list[str], text_col: str, width: int = 64, prefix: str = "") -> DataFrame:
    """Default embedder: keys and `embedding`, signed feature hashing of lower-cased tokens at length 1; zeros for no tokens.
    prefix: what a model wants ahead of a query, and of queries alone."""
    base = df.select(*keys, F.lower(F.concat(F.lit(prefix), F.coalesce(F.col(text_col), F.lit("")))).alias("_t"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "_t")
    token = re.compile(r"[^\W_]+")

    def run(batches):
        for batch in batches:
            words = [token.findall(t) for t in batch.column("_t").to_pylist()]
            hashes = {w: zlib.crc32(w.encode()) for ws in words for w in ws}
            h = np.array([hashes[w] for ws in words for w in ws], "i8")
            row = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
            out = np.bincount(row * width + h % width, np.where(h >> 31, 1.0, -1.0), batch.num_rows * width).reshape(-1, width)
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), vec], [*keys, "embedding"])

    return base.mapInArrow(run, f"{kinds}, embedding array<double>")
