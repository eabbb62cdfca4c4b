"""Quality by Bradley-Terry ranking: scores learnt from preference pairs, threshold by score quantile.

A pair is a labelled good and a labelled bad document; the model's weights minimise the logistic loss on the difference of
their features, so that only the order of scores is learnt. The cut is the quantile of the training scores at the share of
bad labels, and is mapped to THRESHOLD of the published score, which lies in 0 to 1.

Null and empty texts have features of their own (no words) and a score. Null labels and labels whose document is absent are
left out; a document with several labels counts by their mean, a null id has no label and is scored. Without both kinds of
label every score is 0.5. Texts alike in all features have the same score; a text of any length is read whole. Repeated rows each
get a row; empty tables give an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, fold, written
from tidewater.sources.tables import read_spread

#: Labelled rows that the model is fitted on at most, and pairs drawn from them.
LABELLED, PAIRS = 20_000, 60_000
THRESHOLD = 0.3

# Kinds of bytes: capitals, digits, spaces, line ends, marks within and at the end of sentences, quotes and brackets, all other
# ASCII signs; then lower-case letters and control bytes, and bytes beyond ASCII.
_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b",;:-", b".!?", b"'\"()[]{}<>`", b"#$%&*+/=@\\^_|~"]
_MAP = np.full(256, len(_GROUPS), "i8")
for _i, _g in enumerate(_GROUPS):
    _MAP[list(_g)] = _i
_MAP[128:] = len(_GROUPS) + 1


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_UPPER, _DIGIT = (np.isin(np.arange(256), list(g)) for g in (_GROUPS[0], _GROUPS[1]))
_SIGN = np.isin(np.arange(256), list(b"".join(_GROUPS[4:])))


def features(text: bytes) -> np.ndarray:
    """What the score depends on: sizes, kinds of bytes, how words begin and end, and repetition of words and lines."""
    n, at = len(text), np.frombuffer(text, "u1")
    raw = np.bincount(at, minlength=256) if n else np.zeros(256)
    kinds = np.bincount(_MAP, weights=raw, minlength=len(_GROUPS) + 2) / max(n, 1)
    w = text.split()
    m = max(len(w), 1)
    inside = np.concatenate([[False], ~_SPACE[at], [False]])
    begin, end = at[(inside[1:-1] & ~inside[:-2])], at[(inside[1:-1] & ~inside[2:])]
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = raw[raw > 0] / max(n, 1)
    more = [
        np.log1p(n), np.log1p(len(w)), (n - raw[32] - raw[10]) / m / 10, len(set(w)) / m, sum(map(bytes.__eq__, w, w[1:])) / m,
        1 - len(set(lines)) / max(len(lines), 1), _SIGN[end].sum() / m, _UPPER[begin].sum() / m, _DIGIT[begin].sum() / m,
        np.log1p(max(map(len, w), default=0)), -(p * np.log(p)).sum(), np.log1p(len(w) / max(len(lines), 1)), float(not w),
    ]
    return np.concatenate([kinds, np.sqrt(kinds), more])


WIDTH = len(features(b""))


def feature_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = base.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            f = [features(x.as_py()) for x in pc.fill_null(batch.column("_text").cast(pa.large_binary()), b"")]
            flat = pa.array(np.concatenate(f) if f else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * WIDTH, pa.int32()), flat)], [id_col, "_f"])

    return base.mapInArrow(run, f"`{id_col}` {kind}, _f array<double>")


def bradley_terry(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Weights by Newton's method on pairs (good row, bad row) drawn alike from all rows."""
    draw = np.random.default_rng(seed)
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    d = x[draw.choice(a, pairs)] - x[draw.choice(b, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance of the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def steepness(s: np.ndarray, good: np.ndarray) -> float:
    """Slope of the chance of a good label over the score."""
    a, b, z = 1.0, 0.0, np.stack([s, np.ones_like(s)])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(-(a * s + b), -30, 30)))
        step = np.linalg.solve(z * (p * (1 - p) + 1e-6) @ z.T + 1e-3 * np.eye(2), z @ (good - p) - 1e-3 * np.array([a, b]))
        a, b = np.array([a, b]) + np.clip(step, -1, 1)
    return max(a, 0.05)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, labelled: int = LABELLED) -> DataFrame:
    """id, held_out, score, predicted for each row. Only labels outside fold 0 of crc32(id) are learnt from."""
    bounded_batches(docs.sparkSession)
    table = written(feature_table(docs, id_col, text_col), "quality-features")
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.avg(F.col(label_col).cast("double")).alias("_y"))
    marks = written(marks.where(fold(F.col(id_col), folds) != 0), "quality-labels")
    share = min(1.0, labelled / max(marks.count(), 1))
    draw = F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1 << 30))
    chosen = marks.where(draw < share * (1 << 30))
    rows = table.join(chosen, id_col).select("_f", "_y", draw.alias("_draw")).orderBy("_draw", "_y", "_f").limit(2 * labelled).select("_f", "_y").toPandas()
    good = rows["_y"].to_numpy("f8") >= 0.5
    held = (fold(F.col(id_col), folds) == 0).alias("held_out")
    if good.all() or not good.any():
        return table.select(id_col, held, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    x = np.stack(rows["_f"].to_numpy())
    mean, spread = x.mean(0), x.std(0) + 1e-9
    w = bradley_terry((x - mean) / spread, good)
    s = (x - mean) / spread @ w
    cut = float(np.quantile(s, 1 - good.mean()))
    slope = steepness(s, good)
    weight = slope * w / spread
    bias = float(-(weight @ mean) - slope * cut + np.log(THRESHOLD / (1 - THRESHOLD)))
    raw = F.aggregate(F.zip_with("_f", F.lit([float(v) for v in weight]), lambda a, b: a * b), F.lit(bias), lambda acc, v: acc + v)
    score = 1 / (1 + F.exp(-raw))
    return table.select(id_col, held, score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(read_spread(spark, f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
