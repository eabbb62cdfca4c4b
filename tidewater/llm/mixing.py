"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, served twice at most. What the queue sends at a time, a packet, is a
document, or an equal piece of one that is longer than 1 / PIECES of its source's target. A packet's virtual finish time is the
number of its source's words up to its end, divided by the source's target; the mix is the packets in global order of finish
times, cut where the words so far reach the budget, which is the sum of the targets. So each source gets its target but for
about a packet, and a document is taken whole, in part (up to a packet, or to the budget within one) or not at all.

The global order is a range sort: rows are dealt into ranges of the order, words are summed by range, and running sums are taken
within each, so that no task holds more than a range. `taken` comes from that order alone.

Null text: no words, never taken. Null source: a source of its own, last in order. Null ids are shuffled as the empty
text; ties are broken by id, hash of the text and row. Repeated rows are separate documents. Texts of any length are counted
whole. An empty table gives an empty result. Columns other than doc_id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, written

#: Packets that a source's target is sent in at least, where its documents are long, and rows of a range of an order.
PIECES, RANGE = 4096, 500_000


def shuffled(id_col: Column, seed: str) -> Column:
    """48 bits of md5(seed:id)."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...], budget: float, most: float) -> DataFrame:
    """source, source_size, n -> target: budget shared by weight, each at most `most` times its size.

    The level at which all that is not capped meets its share is found from running sums in order of size per weight.
    This orders the table of sources, one row each, in one task."""
    w = F.get(F.lit(list(weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    t = sources.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("_level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget)) - before) / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.max(F.when(F.col("_cap") / F.col("_w") > F.col("_level"), F.col("_level"))).over(Window.partitionBy())
    return t.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))).drop("_w", "_cap", "_level")


def running(df: DataFrame, rows: int, by: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Running sum of amount ahead of each row, within `by` and in order of `order`, of a table of so many rows. The order is
    dealt into ranges, each summed on its own; a table has at most a row for each range and group that begins in it."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE))
    df = written(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("_range", *by).agg(F.sum(amount).alias("_sum"))
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("_before", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum"), "mix-sums")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("_range", *by)]
    df = df.withColumn("_in", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return df.alias("l").join(sums.alias("r"), same).select("l.*", (F.col("_in") + F.col("_before")).alias(name)).drop("_in", "_range")


def queued(docs: DataFrame, seed: str = "mix") -> list[Column]:
    """The place of a document in its source's queue: 48 hash bits of the id, the id, and a hash of the text."""
    return [shuffled(F.col("doc_id"), seed).alias("_h"), F.col("doc_id"), F.xxhash64("text").alias("_x")]


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """The queues' packets in the order of the mix: doc_id, source, size, source_size, target, copy (from 0), packet, words,
    finish (virtual time), taken, offset (words of the mix ahead of it), and the document's place: _h, _x, _row. Packets of
    which nothing is taken are left out, but for the first of each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = written(docs.select(*queued(docs, seed), "source", size.alias("size"), F.monotonically_increasing_id().alias("_row")), "mix-rows")
    shares = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")), weights, budget, most), "mix-targets")
    piece = F.greatest(F.lit(1), F.ceil(F.col("target") / PIECES)).cast("bigint")
    shares = shares.withColumn("_piece", piece)
    # A source's documents are cut into a packet each, and one more for each piece that its words make: ranges of the order of
    # packets are sized by that, as small sources have many packets a document.
    packets = F.coalesce(F.sum(F.col("_docs") + F.col("source_size") / F.col("_piece")), F.lit(0)).cast("bigint")
    documents, words, most_packets = shares.agg(F.coalesce(F.sum("_docs"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0)), packets).first()
    total = floor(words * min(budget, most) + 0.5)  # what the targets sum to, as a whole number
    ahead = running(rows, documents, ["source"], ["_h", "doc_id", "_x", "_row"], "size", "_ahead")
    # A row for each source on the right; a hot source's rows are split by adaptive execution.
    ahead = ahead.alias("l").join(shares.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source"))).select("l.*", "r.source_size", "r.target", "r._piece")
    copies = ahead.withColumn("copy", F.explode(F.lit(list(range(most)))))
    packets = copies.withColumn("packet", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("size") / F.col("_piece")) - 1))))
    begin = F.col("packet") * F.col("_piece")
    packets = packets.withColumn("words", F.least(F.col("_piece"), F.col("size") - begin))
    end = F.col("_ahead") + F.col("copy") * F.col("source_size") + begin + F.col("words")
    packets = packets.withColumn("finish", F.when(F.col("target") > 0, end / F.col("target")).otherwise(F.lit(0.0))).drop("_piece", "_ahead")
    sent = running(packets, most * most_packets, [], ["finish", "_h", "doc_id", "_x", "_row", "copy", "packet"], "words", "offset")
    sent = sent.withColumn("taken", F.greatest(F.lit(0), F.least("words", F.lit(total) - F.col("offset"))).cast("bigint"))
    return sent.where("taken > 0 or (copy = 0 and packet = 0)")


def last_taken(packets: DataFrame) -> DataFrame:
    """_source, _last: place (copy, _h, doc_id, _x) of the last document of each source that is taken whole or by half at
    least. The cut goes through each queue at one place, so this row says which documents are taken, and how often."""
    copies = packets.groupBy("source", "copy", "_h", "doc_id", "_x", "_row").agg(F.sum("taken").alias("taken"), F.first("size").alias("size"))
    place = F.struct("copy", "_h", "doc_id", "_x")
    return copies.where("taken > 0 and 2 * taken >= size").groupBy(F.col("source").alias("_source")).agg(F.max(place).alias("_last"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    per = out.groupBy("_row", "doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken"))
    return per.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM l WHERE cap / w > level) * w, cap)) AS target FROM l),
a AS (SELECT d.*, t.source_size, t.target, greatest(1, CAST(ceil(t.target / 4096) AS BIGINT)) AS piece,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil(size / piece) AS BIGINT)))) AS packet FROM a),
p AS (SELECT *, unnest([0, 1]) AS copy, least(piece, size - packet * piece) AS words FROM k),
f AS (SELECT *, CASE WHEN target > 0 THEN CAST(ahead + copy * source_size + packet * piece + words AS DOUBLE) / target ELSE 0.0 END AS finish FROM p),
o AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, h, doc_id, copy, packet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it FROM f)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(0, least(words, (SELECT CAST(floor(sum(source_size) * 1.5::DOUBLE + 0.5) AS BIGINT) FROM t) - before_it))) AS BIGINT) AS taken
FROM o GROUP BY doc_id, size, source_size, target
"""
