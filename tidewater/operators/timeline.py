"""Interval and session operators over rows in time, in batch. The streaming forms are in tidewater.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of the intervals of each key; those that touch are merged. Gaps and islands in one shuffle on the key."""
    w = Window.partitionBy(*by).orderBy(start, end)
    high = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(F.col(start) > F.col("_high"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_high", high).withColumn("_isle", isle).groupBy(*by, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_isle")


def coverage_mask(rows: DataFrame, by: list[str], upto: Column, margin: float = 2.0, most: int = 400) -> DataFrame:
    """Time that settled rows have taken: those that end after `upto` less a margin, merged; the last `most` of each key."""
    taken = merge_intervals(rows.where(~F.col("open") & (F.col("end") > upto - margin)), by)
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("start")))
    return taken.withColumn("_n", nth).where(F.col("_n") <= most).drop("_n")


def clip(spans: DataFrame, mask: DataFrame, by: list[str], key: str, least: float = 0.2) -> DataFrame:
    """End each span at the first interval of the mask that begins inside it; drop it if `least` or less remains.

    The first start after a span's own is an as-of lookup: one sort of both sides, no range join."""
    starts = mask.select(*by, F.col("start").alias("_t"), F.lit(None).cast("bigint").alias("_k"), F.col("start").alias("_from"), F.lit(None).cast("double").alias("_end"))
    both = spans.select(*by, F.col("start").alias("_t"), F.col(key).cast("bigint").alias("_k"), F.lit(None).cast("double").alias("_from"), F.col("end").alias("_end")).unionByName(starts)
    ahead = Window.partitionBy(*by).orderBy(F.col("_t").desc(), F.col("_k").isNull().cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_near", F.last("_from", True).over(ahead)).where("_k is not null")
    limit = F.when(F.col("_near") < F.col("_end"), F.col("_near")).otherwise(F.col("_end"))
    return near.select(*by, F.col("_k").alias(key), F.col("_t").alias("start"), limit.alias("end")).where(F.col("end") - F.col("start") > least)


def sessions(df: DataFrame, by: list[str], time: Column, gap: float) -> DataFrame:
    """Number the runs of rows whose gaps are under `gap` seconds, from 0."""
    w = Window.partitionBy(*by).orderBy("_t", *[c for c in df.columns if c.endswith("_id") and c not in by][:1])
    new = F.when(F.col("_t") - F.lag("_t").over(w) < gap, 0).otherwise(1)
    return df.withColumn("_t", time).withColumn("_new", new).withColumn("session", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("bigint")).drop("_new", "_t")


def endpoints(df: DataFrame, by: list[str], time: Column, complete: Column, silence: float = 2.6, short: float = 1.2, longest: float = 26.0) -> DataFrame:
    """Close an utterance at `silence` seconds, or at `short` ones where the text looks finished; then cut those over
    `longest` into pieces of that length, counted from their start."""
    w = Window.partitionBy(*by).orderBy("_t", *[c for c in df.columns if c.endswith("_id") and c not in by][:1])
    gap = F.col("_t") - F.lag("_t").over(w)
    new = F.when(gap.isNull() | (gap >= silence) | ((gap >= short) & F.lag("_done").over(w)), 1).otherwise(0)
    rows = df.withColumn("_t", time).withColumn("_done", complete).withColumn("_new", new).withColumn("_u", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    begin = F.min("_t").over(Window.partitionBy(*by, "_u"))
    return rows.withColumn("piece", F.floor((F.col("_t") - begin) / longest)).withColumn("utterance", F.col("_u").cast("bigint")).drop("_t", "_done", "_new", "_u")


def latest(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key: what a changelog of upserts stands for."""
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(v) for v in version]))
    return df.withColumn("_n", nth).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, fresh: DataFrame, by: list[str], near: float = 0.05) -> DataFrame:
    """Rows by idx: the newest (rev) of each stays. A fresh row without an idx (below 0) is a stored one of the same text that
    begins within `near` seconds, or comes after all others."""
    blind = fresh.where("idx < 0").withColumn("_id", F.monotonically_increasing_id())
    on = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in (*by, "text")] + [F.abs(F.col("f.start") - F.col("s.start")) < near]
    met = blind.alias("f").join(stored.alias("s"), on).groupBy("f._id").agg(F.min("s.idx").alias("_idx"))
    placed = blind.join(met, "_id", "left")
    high = stored.select(*by, "idx").union(fresh.where("idx >= 0").select(*by, "idx")).groupBy(*by).agg(F.max("idx").alias("_high"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_idx").isNotNull().cast("int"), "start", "_id"))
    placed = placed.join(high, by, "left").withColumn("idx", F.coalesce("_idx", F.coalesce("_high", F.lit(-1)) + nth).cast(stored.schema["idx"].dataType))
    every = stored.unionByName(fresh.where("idx >= 0")).unionByName(placed.select(*stored.columns))
    return latest(every, [*by, "idx"], ["rev"])


def republished(rows: DataFrame, by: list[str]) -> DataFrame:
    """What a re-publish asks for, by idx in order of rev: analysis where the text is new, a refresh where only the speaker is."""
    w = Window.partitionBy(*by, "idx").orderBy("rev")
    same = F.col("text").eqNullSafe(F.lag("text").over(w)) & F.lag("rev").over(w).isNotNull()
    spoke = (F.coalesce("spk", F.lit("")) != "") & ~F.col("spk").eqNullSafe(F.lag("spk").over(w))
    return rows.withColumn("action", F.when(~same, "analyse").when(spoke, "refresh").otherwise("none"))


def rebased(rows: DataFrame, by: list[str], base: int = 0, offset: float = 0.0) -> DataFrame:
    """A source's own idx, in the order in which each is first met (`at`), as numbers from base on; times later by an offset."""
    first = rows.groupBy(*by, "idx").agg(F.min("at").alias("_at"))
    seed = first.withColumn("_new", F.row_number().over(Window.partitionBy(*by).orderBy("_at", "idx")) - 1 + base).drop("_at")
    return rows.join(seed, [*by, "idx"]).withColumn("idx", F.col("_new").cast("bigint")).withColumn("start", F.col("start") + offset).withColumn("end", F.col("end") + offset).drop("_new")


def throttled(rows: DataFrame, by: list[str], seconds: float, chars: int) -> DataFrame:
    """Which rows (t, n: characters so far) of a live text trigger a pass: the first, and each that comes `seconds` after the last
    that did, or `chars` longer. Sequential within a key, by a fold over its rows."""
    step = lambda acc, r: F.when(
        acc["t"].isNull() | (r["t"] - acc["t"] >= seconds) | (r["n"] - acc["n"] >= chars),
        F.struct(r["t"].alias("t"), r["n"].alias("n"), F.concat(acc["hits"], F.array(r["t"])).alias("hits")),
    ).otherwise(acc)
    zero = F.struct(F.lit(None).cast("double").alias("t"), F.lit(0).cast("bigint").alias("n"), F.array().cast("array<double>").alias("hits"))
    each = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("t").cast("double").alias("t"), F.col("n").cast("bigint").alias("n")))).alias("_r"))
    return each.select(*by, F.explode(F.aggregate("_r", zero, step, lambda acc: acc["hits"])).alias("t"))


#: Parameters of the second recogniser's end points, for endpoints().
FRAMES = {"silence": 1.2, "short": 1.2, "longest": 20.0}


def settled(df: DataFrame, now: Column, after: float = 5.0, most: int = 4, tries: int = 3) -> DataFrame:
    """Rows unchanged for `after` seconds, not yet analysed and tried fewer than `tries` times; the oldest `most`."""
    ready = df.where((now - F.col("changed_at") >= after) & ~F.col("analysed") & (F.col("tries") < tries))
    return ready.orderBy("changed_at", "idx").limit(most)


def since(df: DataFrame, idx: int, revision: str = "revision") -> tuple[DataFrame, DataFrame]:
    """Rows from idx on, and the highest revision: where that has moved, a reader pulls all again."""
    return df.where(F.col("idx") >= idx), df.agg(F.max(revision).alias("history_rev"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_key: str, right_key: str, time: str = "t") -> DataFrame:
    """For each left row the right row of its key nearest in time, the earlier on ties, then the smaller key.

    Both sides are sorted once: the last right row at or before, and the first one at or after."""
    a = left.select(*by, F.col(time).alias("_t"), F.col(left_key).cast("bigint").alias("_l"), F.lit(None).cast("bigint").alias("_r"))
    b = right.select(*by, F.col(time).alias("_t"), F.lit(None).cast("bigint").alias("_l"), F.col(right_key).cast("bigint").alias("_r"))
    both = a.unionByName(b).withColumn("_p", F.when(F.col("_r").isNotNull(), F.struct("_t", "_r")))
    up = Window.partitionBy(*by).orderBy(F.col("_t"), F.col("_l").isNotNull().cast("int"), F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by).orderBy(F.col("_t").desc(), F.col("_l").isNotNull().cast("int"), F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("_b", F.last("_p", True).over(up)).withColumn("_a", F.last("_p", True).over(down)).where("_l is not null")
    back, ahead = F.col("_t") - F.col("_b._t"), F.col("_a._t") - F.col("_t")
    pick = F.when(F.col("_a").isNull() | (back <= ahead), F.col("_b")).otherwise(F.col("_a"))
    pick = F.when(F.col("_b").isNull(), F.col("_a")).otherwise(pick)
    return rows.select(*by, F.col("_l").alias(left_key), pick["_r"].alias(right_key), F.abs(pick["_t"] - F.col("_t")).alias("away"))


def neighbour_bounds(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """How far a row may borrow: the latest end at or before its start, and the earliest start at or after its end."""
    a = df.select(*by, F.col("start").alias("_t"), F.col(key).alias("_k"), F.lit(None).cast("double").alias("_v"))
    ends = df.select(*by, F.col("end").alias("_t"), F.lit(None).cast("bigint").alias("_k"), F.col("end").alias("_v"))
    back = Window.partitionBy(*by).orderBy("_t", F.col("_k").isNotNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    low = a.unionByName(ends).withColumn("low", F.max("_v").over(back)).where("_k is not null").select(*by, F.col("_k").alias(key), "low")
    c = df.select(*by, F.col("end").alias("_t"), F.col(key).alias("_k"), F.lit(None).cast("double").alias("_v"))
    begins = df.select(*by, F.col("start").alias("_t"), F.lit(None).cast("bigint").alias("_k"), F.col("start").alias("_v"))
    fore = Window.partitionBy(*by).orderBy(F.col("_t").desc(), F.col("_k").isNotNull().cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    high = c.unionByName(begins).withColumn("high", F.min("_v").over(fore)).where("_k is not null").select(*by, F.col("_k").alias(key), "high")
    return low.join(high, [*by, key])


def apportion(df: DataFrame, by: list[str], order: str, text: str = "text", start: str = "start", end: str = "end") -> DataFrame:
    """Share an utterance's time among its paragraphs by their share of characters."""
    w = Window.partitionBy(*by).orderBy(order)
    total = F.sum(F.length(text)).over(Window.partitionBy(*by))
    upto = F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    span = F.col(end) - F.col(start)
    return df.withColumn("p_start", F.col(start) + span * (upto - F.length(text)) / total).withColumn("p_end", F.col(start) + span * upto / total)


def flat_time(pair: Column) -> Column:
    """Milliseconds [s, e] -> struct(start, end) in seconds; 0 for what isn't a pair."""
    at = lambda i: F.when(F.size(pair) == 2, F.get(pair, i) / 1000.0).otherwise(0.0)
    return F.struct(at(0).alias("start"), at(1).alias("end"))


def span_time(stamps: Column) -> Column:
    """Milliseconds [[s, e], ...] -> struct(start, end) in seconds: first start, last end; 0 for none."""
    ok = F.size(stamps) > 0
    first, last = F.get(F.get(stamps, 0), 0), F.get(F.element_at(F.when(ok, stamps), -1), 1)
    return F.struct(F.when(ok, first / 1000.0).otherwise(0.0).alias("start"), F.when(ok, last / 1000.0).otherwise(0.0).alias("end"))


def recognised(results: DataFrame) -> DataFrame:
    """Recogniser results (id, text, sentences array<struct<text, timestamp, spk>>) -> span rows; the whole text where there
    are no sentences; blank ones dropped, a null speaker is empty."""
    rows = results.select("id", F.col("text").alias("_whole"), F.posexplode_outer("sentences").alias("pos", "s"))
    time = span_time(F.col("s.timestamp"))
    out = rows.select("id", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("s.text", "_whole").alias("text"), time["start"].alias("start"), time["end"].alias("end"), F.coalesce("s.spk", F.lit("")).alias("spk"))
    return out.where(F.trim("text") != "")
