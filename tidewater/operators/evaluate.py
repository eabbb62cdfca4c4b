"""Evaluation: hits at k, contamination across corpora, coverage, fragmentation, score spread, trace figures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import char_jaccard, norm_key
from tidewater.streaming.fold import common
from tidewater.streaming.fold import similarity as text_similarity


def hit_at(hits: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Share of queries whose true file is among the first k. hits: query_id, path, rank0; truth: query_id, path."""
    best = truth.alias("t").join(hits.alias("h"), (F.col("t.query_id") == F.col("h.query_id")) & (F.col("t.path") == F.col("h.path")), "left").groupBy("t.query_id").agg(F.min("h.rank0").alias("r"))
    return best.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(F.when(F.col("r") < k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}") for k in ks])


def contamination(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """By query: whether the first hit, any and all of the first three are of the query's own corpus."""
    own = hits.join(truth.select("query_id", F.col("kb").alias("_own")), "query_id").withColumn("ok", F.col("kb") == F.col("_own"))
    return own.groupBy("query_id").agg(F.bool_or((F.col("rank") == 1) & F.col("ok")).alias("top1"), F.bool_or((F.col("rank") <= 3) & F.col("ok")).alias("in_top3"), F.bool_and((F.col("rank") > 3) | F.col("ok")).alias("clean"))


def coverage(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, dates array of each side -> full, partial or none."""
    both = wanted.alias("w").join(found.alias("f"), "query_id", "left")
    n = F.size(F.array_intersect("w.dates", F.coalesce("f.dates", F.array().cast("array<string>"))))
    return both.select("query_id", n.cast("bigint").alias("n"), F.when(n == F.size("w.dates"), "full").when(n > 0, "partial").otherwise("none").alias("coverage"))


def adjacent_overlap(rows: DataFrame, by: list[str], order: list[str], share: float = 0.3) -> DataFrame:
    """Neighbours that overlap by more than `share` of the shorter one, with the similarity of their characters."""
    w = Window.partitionBy(*by).orderBy(*order)
    prev = lambda c: F.lag(c).over(w)
    part = (F.least("end", prev("end")) - F.greatest("start", prev("start"))) / F.greatest(F.least(F.col("end") - F.col("start"), prev("end") - prev("start")), F.lit(1e-9))
    part = F.when(prev("start").isNotNull(), part)  # least and greatest skip nulls
    return rows.withColumn("overlap", part).withColumn("similar", char_jaccard(F.col("text"), prev("text"))).where(F.col("overlap") > share)


def score_spread(hits: DataFrame) -> DataFrame:
    """By query the best right and the best wrong score; then ties, wins and the median gap. hits: query_id, score, right."""
    per = hits.groupBy("query_id").agg(F.max(F.when(F.col("right"), F.col("score"))).alias("good"), F.max(F.when(~F.col("right"), F.col("score"))).alias("bad"))
    gap = F.col("good") - F.col("bad")
    return per.agg(F.count(gap).alias("queries"), F.count(F.when(gap == 0, 1)).alias("ties"), F.count(F.when(gap > 0, 1)).alias("wins"), F.round(F.median(gap), 6).alias("median_gap"))


def branches(trace: DataFrame) -> DataFrame:
    """By branch: rows, least, middle (n // 2), 90th (int(0.9 n)) and largest gap of the sorted ones."""
    w = Window.partitionBy("branch")
    rank = F.row_number().over(w.orderBy("gap")) - 1
    n = F.count(F.lit(1)).over(w)
    at = trace.withColumn("_k", rank).withColumn("_n", n)
    pick = lambda e: F.max(F.when(F.col("_k") == e, F.col("gap")))
    return at.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("low"), pick(F.floor(F.col("_n") / 2)).alias("p50"), pick(F.floor(F.col("_n") * 0.9)).alias("p90"), F.max("gap").alias("high"))


def orphans(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Index rows whose chunk is gone, counted."""
    return index.join(chunks.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def own_first(free: DataFrame, filtered: DataFrame, separate: DataFrame, truth: DataFrame) -> DataFrame:
    """How often the first hit is the query's own corpus: in a mixed index, in it with a filter, and in an index of its own.
    Each: query_id, kb, rank; truth: query_id, kb."""
    out = truth.select("query_id", F.col("kb").alias("_own"))
    for name, hits in (("free", free), ("filtered", filtered), ("separate", separate)):
        first = hits.where("rank = 1").select("query_id", F.col("kb").alias(f"_{name}"))
        out = out.join(first, "query_id", "left")
    own = lambda n: F.count(F.when(F.col(f"_{n}") == F.col("_own"), 1)).alias(n)
    return out.agg(F.count(F.lit(1)).alias("queries"), own("free"), own("filtered"), own("separate"))


def with_prior(hits: DataFrame, public: str, prior: float, k: int = 3, constant: int = 60) -> DataFrame:
    """Fuse corpora by rank, with a bonus for every hit that isn't the public corpus's. hits: query_id, kb, title, rank (from 1)."""
    part = 1.0 / (constant + F.col("rank")) + F.when(F.col("kb") != public, F.lit(prior)).otherwise(0.0)
    fused = hits.groupBy("query_id", "kb", "title").agg(F.round(F.sum(part), 9).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "kb", "title"))
    return fused.withColumn("rank", nth.cast("bigint")).where(F.col("rank") <= k)


def split_against_mixed(split: DataFrame, mixed: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """Hits at k of two ways to hold the corpora, side by side."""
    a, b = hit_at(split, truth, ks), hit_at(mixed, truth, ks)
    return a.select("queries", *[F.col(f"hit_{k}").alias(f"split_{k}") for k in ks]).crossJoin(F.broadcast(b.select(*[F.col(f"hit_{k}").alias(f"mixed_{k}") for k in ks])))


def answers(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Whether the first hit of a question is the document that answers it. truth: query_id, path."""
    first = hits.where("rank0 = 0").select("query_id", F.col("path").alias("found"))
    return truth.join(first, "query_id", "left").select("query_id", "path", "found", F.coalesce(F.col("path") == F.col("found"), F.lit(False)).alias("right"))


def retention(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, want, got -> the share of want's characters, marks aside, that are a common subsequence with got."""

    @F.pandas_udf("double")
    def share(want: pd.Series, got: pd.Series) -> pd.Series:
        return pd.Series([common(w, g) / len(w) if w else 0.0 for w, g in zip(want, got, strict=True)], dtype="float64")

    return pairs.select(*keys, share(norm_key(F.col("want")), norm_key(F.col("got"))).alias("kept"))


def similarity(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b -> 1 where one holds the other, else the common subsequence over the shorter one."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([text_similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")

    return pairs.select(*keys, alike("a", "b").alias("similar"))


def error_parts(reference: str, heard: str) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a shortest edit, with as many substitutions as it can have.

    One number holds the edits and, as a rebate, the substitutions; a row of the table is a running minimum. Deletions less
    insertions is the difference of the lengths."""
    n, m = len(reference), len(heard)
    one = n + m + 1
    x, y = (np.array([ord(c) for c in t], "i8") for t in (reference, heard))
    ahead = np.arange(m + 1) * one
    row = ahead
    for c in x:
        best = row + one
        best[1:] = np.minimum(best[1:], row[:-1] + (one - 1) * (y != c))
        row = np.minimum.accumulate(best - ahead) + ahead
    edits = -(-int(row[-1]) // one)
    swapped = edits * one - int(row[-1])
    moved = edits - swapped
    return swapped, (moved + n - m) // 2, (moved - n + m) // 2


def error_rates(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reference, heard -> cer, substitutions, deletions, insertions, marks and white space aside; an empty reference has no
    errors."""

    @F.pandas_udf("struct<substitutions: bigint, deletions: bigint, insertions: bigint>")
    def parts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([error_parts(x, y) if x else (0, 0, 0) for x, y in zip(a, b, strict=True)], columns=["substitutions", "deletions", "insertions"])

    a, b = norm_key(F.col("reference")), norm_key(F.col("heard"))
    rows = pairs.select(*keys, F.length(a).alias("_n"), parts(a, b).alias("p"))
    return rows.select(*keys, ((F.col("p.substitutions") + F.col("p.deletions") + F.col("p.insertions")) / F.greatest(F.lit(1), F.col("_n"))).alias("cer"), "p.*")
