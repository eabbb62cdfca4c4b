"""Hard negatives for contrastive training, by a full sort of each anchor's scores.

A row's score is the integer inner product of its quantised vector with the anchor's; higher scores come first, ties by
smaller id. An anchor's positives are its first rows of its own label. For each positive, the rows of other labels
are taken in that order from the highest whose score is at most HIGH / 100 of the positive's, while it is at least LOW / 100.

Anchors are a set of queries against all rows, worked on in cells: a group of anchors, of GROUP bytes at most, against a group of
rows. A cell reads its rows in batches. For each anchor it sorts the scores of a batch by score and id, as one packed key, in which
rows that can't be taken sort last; finds each positive's upper limit by binary search; reads the first entries from there; and
keeps the best so far. So a cell hands on a few rows for each anchor, and the best of these over all cells are the result. Positives
come first, in cells of one label; a hot label has as many cells as others together. Nothing but counts goes to the driver.

Rows with a null label, id or vector, or with a null, infinite or missing component, take no part. A shorter vector counts as
ended by zeros. Products are summed exactly whatever the size of components; a score beyond 64 bits counts as the largest
or smallest number of 64 bits. Repeated rows each take part, and each repeated anchor has its rows; rows of the anchor's
own id are never its positives. An empty table, or one without anchors, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import written

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Bytes of a group of anchors, pairs of a cell that is worth a task, and scores that are sorted at a time.
GROUP, PAIRS, SORTED = 1 << 25, 1 << 24, 1 << 22
#: Rows of a batch are numbered in the lowest bits of a key.
BITS = 14
LEAST = -(1 << 63)


def prepared(rows: DataFrame, anchor: Column, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """_row, _id, _label, _v (whole numbers) and _anchor of the rows that take part."""
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: F.coalesce(F.isnan(x) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    rows = rows.where(v.isNotNull() & F.col(id_col).isNotNull()).where(~odd)
    out = rows.select(F.col(id_col).alias("_id"), label.cast("bigint").alias("_label"), F.transform(v, lambda x: F.floor(F.lit(SCALE) * x.cast("double"))).alias("_v"), anchor.alias("_anchor"))
    return out.where("_label is not null").withColumn("_row", F.monotonically_increasing_id())


def products(x: np.ndarray, y: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers: of 64 bits where sums stay exact in doubles, else of any size."""
    return (x @ y.T).astype("i8") if exact else x @ y.T


def matrix(lists: pa.Array, width: int, exact: bool) -> np.ndarray:
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(at), width), "f8")
    if not exact:
        out = out.astype("i8").astype(object)
        flat = flat.astype(object)
    row = np.repeat(np.arange(len(at)), at)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(at) - at, at)] = flat
    return out


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k along the last axis, by score downwards and id; of scores LEAST there is nothing."""
    order = np.lexsort((ids, ~score))[..., :k]
    return np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)


class Keys:
    """Scores of some anchors against a batch of rows, each anchor's sorted upwards by score, then downwards by id."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray, allowed: np.ndarray, exact: bool):
        down = np.argsort(~ids, kind="stable")  # from the largest id, so that the smallest has the largest key
        self.ids = ids[down]
        keys = products(x, y[down], exact) * (1 << BITS) + np.arange(len(ids))
        self.none = LEAST if exact else -(1 << 2000)
        keys[~allowed[:, down]] = self.none
        keys.sort(axis=1)
        self.keys = keys

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id at places of each anchor's order; of places below 0 and of rows not allowed LEAST."""
        shape = place.shape
        flat = place.reshape(len(self.keys), -1)
        key = np.take_along_axis(self.keys, np.maximum(flat, 0), 1)
        there = (flat >= 0) & (key != self.none)
        score = np.where(there, np.clip(key >> BITS, LEAST + 1, (1 << 63) - 1), LEAST).astype("i8")
        return score.reshape(shape), np.where(there, self.ids[(key & ((1 << BITS) - 1)).astype("i8") % len(self.ids)], 0).reshape(shape)

    def upto(self, most: np.ndarray) -> np.ndarray:
        """For each anchor and limit, how many keys have a score of at most the limit."""
        return np.array([[np.searchsorted(k, (int(m) + 1) << BITS) if abs(int(m)) < 1 << 48 or k.dtype == object else len(k) * (m > 0) for m in row] for k, row in zip(self.keys, most, strict=True)], "i8").reshape(most.shape)


def in_cells(anchors: DataFrame, rows: DataFrame, groups: DataFrame, by: list[str], work: Callable, schema: str) -> DataFrame:
    """work(anchors, blocks of rows) for each cell. groups: for each value of `by` the numbers of groups of anchors (_gi) and rows
    (_gj). anchors: _row, _id, _label, _v and _p; a row goes to all anchor groups, an anchor to all row groups."""
    deal = lambda n, seed: F.pmod(F.xxhash64("_row", F.lit(seed)), n)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    bound = lambda df: df.join(groups, by) if by else df.join(F.broadcast(groups))  # noqa: E731  one row, where there is nothing to join by
    left = bound(anchors).withColumn("_j", all_of(F.col("_gj"))).withColumn("_i", deal(F.col("_gi"), 1)).withColumn("_side", F.lit(0))
    right = bound(rows).withColumn("_i", all_of(F.col("_gi"))).withColumn("_j", deal(F.col("_gj"), 2)).withColumn("_side", F.lit(1)).withColumn("_p", F.lit(None).cast("array<bigint>"))
    cell = [*by, "_i", "_j"]
    both = left.unionByName(right, allowMissingColumns=True).select(*dict.fromkeys([*cell, "_side", "_row", "_id", "_label", "_v", "_p"]))

    def run(batches):
        now, held, state = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in [*cell, "_side"]])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                at, side = tuple(keys[:-1, i].tolist()), keys[-1, i]
                if at != now:
                    if state:
                        yield state.out()
                    now, held, state = at, [], None
                if side == 0:
                    held.append(batch.slice(i, j - i))
                    continue
                if held:
                    state, held = work(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), []
                for k in range(i, j, 1 << (BITS - 1)) if state else ():
                    state.add(batch.slice(k, min(1 << (BITS - 1), j - k)))
        if state:
            yield state.out()

    return both.repartition(*cell).sortWithinPartitions(*cell, "_side").mapInArrow(run, schema)


class Found:
    """The best so far of a cell's anchors."""

    def __init__(self, anchors: pa.RecordBatch, width: int, exact: bool):
        self.width, self.exact, self.row = width, exact, anchors.column("_row")
        self.ids, self.label = (anchors.column(c).to_numpy() for c in ("_id", "_label"))
        self.x = matrix(anchors.column("_v"), width, exact)

    def blocks(self, rows: pa.RecordBatch, allowed: Callable):
        """Keys of some anchors at a time, with their slice."""
        ids, label, y = rows.column("_id").to_numpy(), rows.column("_label").to_numpy(), matrix(rows.column("_v"), self.width, self.exact)
        step = max(1, SORTED // len(ids))
        for i in range(0, len(self.ids), step):
            some = slice(i, i + step)
            yield some, Keys(self.x[some], y, ids, allowed(self.ids[some, None], self.label[some, None], ids, label), self.exact)


class Positives(Found):
    schema = "_row bigint, score bigint, id bigint"

    def __init__(self, anchors: pa.RecordBatch, width: int, exact: bool, k: int):
        super().__init__(anchors, width, exact)
        self.score, self.id = np.full((len(self.ids), k), LEAST), np.zeros((len(self.ids), k), "i8")

    def add(self, rows: pa.RecordBatch) -> None:
        k = self.score.shape[1]
        for some, keys in self.blocks(rows, lambda a, la, b, lb: (la == lb) & (a != b)):
            score, ids = keys.at(np.broadcast_to(rows.num_rows - 1 - np.arange(k), (len(keys.keys), k)))
            self.score[some], self.id[some] = best(np.concatenate([self.score[some], score], 1), np.concatenate([self.id[some], ids], 1), k)

    def out(self) -> pa.RecordBatch:
        a, k = np.nonzero(self.score != LEAST)
        return pa.RecordBatch.from_arrays([self.row.take(pa.array(a)), pa.array(self.score[a, k]), pa.array(self.id[a, k])], ["_row", "score", "id"])


class Negatives(Found):
    schema = "_row bigint, at int, score bigint, id bigint"

    def __init__(self, anchors: pa.RecordBatch, width: int, exact: bool, k: int, low: int, high: int):
        super().__init__(anchors, width, exact)
        given = anchors.column("_p").to_pylist()
        most = max(map(len, given))
        # A positive that isn't there has an empty range.
        self.low = np.array([[-(-low * p // 100) for p in row] + [1] * (most - len(row)) for row in given], object)
        self.high = np.array([[high * p // 100 for p in row] + [0] * (most - len(row)) for row in given], object)
        shape = (len(given), most, k)
        self.score, self.id = np.full(shape, LEAST), np.zeros(shape, "i8")

    def add(self, rows: pa.RecordBatch) -> None:
        k = self.score.shape[2]
        for some, keys in self.blocks(rows, lambda a, la, b, lb: la != lb):
            score, ids = keys.at(keys.upto(self.high[some])[:, :, None] - 1 - np.arange(k))
            score = np.where(score >= self.low[some, :, None].astype("f8"), score, LEAST) if not self.exact else np.where(score >= self.low[some, :, None].astype("i8"), score, LEAST)
            self.score[some], self.id[some] = best(np.concatenate([self.score[some], score], 2), np.concatenate([self.id[some], ids], 2), k)

    def out(self) -> pa.RecordBatch:
        a, p, k = np.nonzero(self.score != LEAST)
        return pa.RecordBatch.from_arrays([self.row.take(pa.array(a)), pa.array(p, pa.int32()), pa.array(self.score[a, p, k]), pa.array(self.id[a, p, k])], ["_row", "at", "score", "id"])


def first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k rows of each group as _n (from 1); groups are limited before they are shuffled."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("_n") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchor says which rows are anchors, and label which
    label a row has."""
    rows = written(prepared(rows, anchor, label, id_col, vector_col), "negatives-rows")
    largest = F.max(F.coalesce(F.array_max(F.transform("_v", lambda x: F.abs(x.cast("double")))), F.lit(0.0)))
    n, m, width, most = rows.agg(F.count(F.lit(1)), F.count_if("_anchor"), F.coalesce(F.max(F.size("_v")), F.lit(0)), F.coalesce(largest, F.lit(0.0))).first()
    exact = width * most * most < 1 << (62 - BITS)
    group = max(256, GROUP // (8 * max(width, 1)))
    of_anchors = lambda c: F.greatest(F.ceil(c / group), F.lit(1)).cast("bigint")
    of_rows = lambda c, a: F.greatest(F.ceil(c / F.greatest(F.least(a, F.lit(group)), F.lit(PAIRS) / F.greatest(a, F.lit(1)))), F.lit(1)).cast("bigint")
    anchors = rows.where("_anchor")
    labels = rows.groupBy("_label").agg(F.count(F.lit(1)).alias("_m"), F.count_if("_anchor").alias("_a")).where("_a > 0")
    labels = written(labels.select("_label", of_anchors(F.col("_a")).alias("_gi"), of_rows(F.col("_m"), F.col("_a")).alias("_gj")), "negatives-labels")
    found = in_cells(anchors, rows, labels, ["_label"], lambda a: Positives(a, width, exact, positives), Positives.schema) if m else None
    if found is None:
        return rows.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    found = written(first(found, ["_row"], positives), "negatives-positives")
    lists = found.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_n", "score", "id"))).alias("_s"))
    anchors = written(anchors.join(lists, "_row").withColumn("_p", F.transform("_s", lambda s: s["score"])), "negatives-anchors")
    one = rows.sparkSession.range(1).select(of_anchors(F.lit(m)).alias("_gi"), of_rows(F.lit(n), F.lit(m)).alias("_gj"))
    got = in_cells(anchors.drop("_s", "_anchor"), rows, one, [], lambda a: Negatives(a, width, exact, negatives, low, high), Negatives.schema)
    got = first(got, ["_row", "at"], negatives).join(anchors.select("_row", F.col("_id").alias("anchor_id"), "_s"), "_row")
    of = F.get("_s", F.col("at"))
    return got.select("anchor_id", of["id"].alias("positive_id"), F.col("_n").alias("rank"), F.col("id").alias("negative_id"), of["score"].alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


OP12_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM r AS a, r WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND anchor_id <> id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
