"""Voice identity over vectors: nearest person with margin, enrolment, online and agglomerative clustering, binding."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.vectors import block_join, matrix, usable
from tidewater.operators.timeline import neighbour_bounds

MERGE, SCORE, MARGIN, SAME, KEEP = 0.55, 0.60, 0.10, 0.92, 8
#: Numbers of a block of vectors.
NUMBERS = 1 << 22
#: Rows of a block of a person, and of the parts of blocks that are compared at once.
ROWS, TILE = 16384, 1024


def match(queries: DataFrame, prints: DataFrame, least: float = SCORE, margin: float = MARGIN) -> DataFrame:
    """queries (query_id, emb), prints (person, emb) -> query_id, person, score, second, ok.

    Per person the largest cosine, floored at 0; the best person, and the margin to the second. Ties go to the larger name.
    Vectors that are null, odd or hold nulls take no part, and a query of one has no row; without prints there are none. Blocks of
    queries meet blocks of prints in the cluster; of each pair the two best persons go on, which hold the two best of all."""
    asked, known = usable(queries.select("query_id", "emb"), "emb"), usable(prints.select("person", F.col("emb").alias("print")).where("person is not null"), "print")
    size = lambda df, c: -(-int(df.agg(F.sum(F.size(c))).first()[0] or 0) // NUMBERS)
    blocks = max(size(asked, "emb"), queries.sparkSession.sparkContext.defaultParallelism), max(size(known, "print"), 1)

    def pair(some: pa.Table, of: pa.Table) -> pa.Table:
        x, y = unit(matrix(some["emb"])), unit(matrix(of["print"]))
        people, which = np.unique(np.array(of["person"].to_pylist(), object).astype(str), return_inverse=True)
        out: dict[str, list] = {"query_id": [], "person": [], "score": []}
        if len(x) and len(y) and x.shape[1] == y.shape[1]:
            order = np.argsort(which, kind="stable")
            first = np.searchsorted(which[order], np.arange(len(people)))
            best = np.maximum(np.round(np.maximum.reduceat((x @ y.T)[:, order], first, axis=1), 9), 0)
            for q, b in zip(some["query_id"].to_pylist(), best, strict=True):
                for k in np.lexsort((people, b))[::-1][:2]:
                    for c, v in zip(out, (q, people[k], b[k]), strict=True):
                        out[c].append(v)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "person": pa.array(out["person"], pa.string()), "score": pa.array(out["score"], pa.float64())})

    pairs = block_join(asked.withColumn("query_id", F.col("query_id").cast("bigint")), known, ("query_id", "print"), blocks, pair, "query_id bigint, person string, score double")
    best = pairs.groupBy("query_id", "person").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("person"))
    two = best.withColumn("n", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("n = 1").drop("n")
    return two.withColumn("ok", (F.col("score") >= least) & (F.col("score") - F.col("second") >= margin))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def suggestions(matched: DataFrame, bound: DataFrame, denied: DataFrame, least: float = 0.55) -> DataFrame:
    """Names to suggest for clusters that are neither bound nor denied that name."""
    return matched.where(F.col("score") >= least).join(bound.select("query_id"), "query_id", "left_anti").join(denied.select("query_id", "person"), ["query_id", "person"], "left_anti")


def enroll(rows: DataFrame, same: float = SAME, keep: int = KEEP, meetings: int = 12) -> DataFrame:
    """rows (person, seq, meeting, emb) in order of seq -> person, embs, count, meetings. A vector too like a stored one is
    not stored but counts; the newest `keep` stay. State is that of one person at a time, `keep` vectors."""
    schema = "person string, count bigint, kept array<bigint>, meetings array<string>"

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        held: list[tuple[int, np.ndarray]] = []
        met: list[str] = []
        f = f.sort_values("seq")
        for seq, meeting, emb in zip(f["seq"], f["meeting"], f["emb"], strict=True):
            v = unit(np.asarray(emb, "f8"))
            if not any(float(v @ u) > same for _, u in held):
                held = [*held, (int(seq), v)][-keep:]
            met = [*(m for m in met if m != meeting), meeting][-meetings:]
        return pd.DataFrame([(f["person"].iloc[0], len(f), [s for s, _ in held], met)], columns=["person", "count", "kept", "meetings"])

    return usable(rows, "emb").groupBy("person").applyInPandas(fold, schema)


def near_duplicates(rows: DataFrame, same: float = SAME, id_col: str = "vec_id", by: str = "label", vec: str = "embedding") -> DataFrame:
    """Rows of a person that are too like an earlier one of that person, by id. Rows without id or person take no part.

    A person of many rows is cut into blocks of ROWS, and every two of them meet in a task of their own: pairs grow with the square of a
    person's rows, a task doesn't."""
    part = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(by).cast("bigint").alias("p"), F.col(vec).alias("v")).where("id is not null and p is not null")
    part = usable(part, "v")
    large = part.groupBy("p").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > ROWS)  # one person for ROWS rows at most
    cut = part.join(F.broadcast(large), "p", "left").withColumn("_n", F.coalesce(F.ceil(F.col("_c") / ROWS), F.lit(1)).cast("int")).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    met = lambda own, other, a, b: cut.select(*(F.col(c).alias(c) for c in ("id", "p", "v")), F.col("_b").alias(own), F.explode(F.sequence(a, b)).alias(other))
    first, second = met("_i", "_j", F.col("_b"), F.col("_n") - 1), met("_j", "_i", F.lit(0), F.col("_b"))

    def pair(some: pa.Table, of: pa.Table) -> pa.Table:
        """Of one block with another (or itself), the later rows of the pairs that are too alike."""
        a, b = some["id"].to_numpy(), of["id"].to_numpy()
        x, y = unit(matrix(some["v"])), unit(matrix(of["v"]))
        hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        for i in range(0, len(a), TILE):
            for j in range(0, len(b), TILE):
                near = np.round(x[i : i + TILE] @ y[j : j + TILE].T, 9) > same
                later = a[i : i + TILE, None] > b[None, j : j + TILE]
                hit_a[i : i + TILE] |= (near & later).any(1)
                hit_b[j : j + TILE] |= (near & (a[i : i + TILE, None] < b[None, j : j + TILE])).any(0)
        ids = np.unique(np.concatenate([a[hit_a], b[hit_b]]))
        p = some["p"][0].as_py() if len(a) and len(b) else 0
        return pa.table({"id": pa.array(ids, pa.int64()), "p": pa.array(np.full(len(ids), p), pa.int64())})

    keys = ("p", "_i", "_j")
    hits = first.groupBy(*keys).cogroup(second.groupBy(*keys)).applyInArrow(pair, "id bigint, p bigint")
    return hits.distinct().select(F.col("id").alias(id_col), F.col("p").alias(by))


def assign(vectors: np.ndarray, merge: float = MERGE) -> list[int]:
    """Online clusters: the nearest centroid at `merge` or more takes the vector (0.8 old, 0.2 new), else a new one opens."""
    centroids: list[np.ndarray] = []
    out = []
    for v in vectors:
        dots = [float(c @ v) for c in centroids]
        best = int(np.argmax(dots)) if dots and max(dots) > 0 else -1
        if best >= 0 and dots[best] >= merge:
            centroids[best] = 0.8 * centroids[best] + 0.2 * v
        else:
            centroids.append(np.array(v, "f8"))
            best = len(centroids) - 1
        out.append(best)
    return out


def average_linkage(x: np.ndarray) -> tuple[list[tuple[int, int, float]], int]:
    """Merges (a, b, distance) of average linkage on 1 - cosine; a cluster is known by its smallest row. Chains of nearest
    neighbours end in pairs that are each other's nearest, which merge at once: time goes with the square of the rows."""
    u = unit(np.asarray(x, "f8"))
    n = len(u)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        near = int(np.argmin(d[chain[-1]]))
        if len(chain) > 1 and d[chain[-1], chain[-2]] <= d[chain[-1], near]:
            b, a = chain.pop(), chain.pop()
            a, b = min(a, b), max(a, b)
            merges.append((a, b, float(d[a, b])))
            row = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[a], d[:, a] = row, row
            d[a, a] = np.inf
            d[b], d[:, b] = np.inf, np.inf
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(near)
    return merges, n


def refit(x: np.ndarray, low: float = 0.20, high: float = 0.45, gap: float = 0.10) -> list[int]:
    """Cut average linkage at its largest gap, kept within low and high; where no gap reaches `gap`, at high. Fewer than
    three rows are one cluster."""
    n = len(x)
    if n < 3:
        return [0] * n
    merges, _ = average_linkage(x)
    heights = sorted(m[2] for m in merges)
    gaps = [(b - a, (a + b) / 2) for a, b in zip(heights, heights[1:], strict=False)]
    wide, at = max(gaps, default=(0.0, high))
    cut = min(max(at, low), high) if wide >= gap else high
    parent = list(range(n))
    for a, b, h in merges:
        if h <= cut:
            parent[b] = a

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    order: dict[int, int] = {}
    return [order.setdefault(root(i), len(order)) for i in range(n)]


def inherit_labels(old: list[str], new: list[int]) -> list[str]:
    """Names for new clusters: the largest takes the old label with most votes that is still free, and so on."""
    free, names = set(), {}
    sizes = pd.Series(new).value_counts()
    for c in sorted(sizes.index, key=lambda c: (-sizes[c], c)):
        votes = pd.Series([o for o, k in zip(old, new, strict=True) if k == c and o]).value_counts()
        pick = next((v for v in sorted(votes.index, key=lambda v: (-votes[v], v)) if v not in free), None)
        k = 1
        while pick is None:
            pick, k = (f"speaker-{k}" if f"speaker-{k}" not in free and f"speaker-{k}" not in old else None), k + 1
        free.add(pick)
        names[c] = pick
    return [names[c] for c in new]


def cluster(rows: DataFrame, by: str, id_col: str, vec: str, online: bool = False) -> DataFrame:
    """by, id, cluster: speakers of each session, in order of id. A session is one meeting; it is clustered as a whole, so that its
    vectors are in one task. Rows without a usable vector have a null cluster."""
    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        x = np.stack([np.asarray(v, "f8") for v in f["v"]])
        return pd.DataFrame({"k": f["k"], "id": f["id"], "cluster": assign(unit(x)) if online else refit(x)})

    part = rows.select(F.col(by).cast("bigint").alias("k"), F.col(id_col).cast("bigint").alias("id"), F.col(vec).alias("v"))
    done = usable(part, "v").groupBy("k").applyInPandas(fold, "k bigint, id bigint, cluster bigint")
    return part.select("k", "id").join(done, ["k", "id"], "left").select(F.col("k").alias(by), F.col("id").alias(id_col), "cluster")


def active_speaker(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows too short for a vector take the last speaker before them."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("spk", F.coalesce("spk", F.last("spk", True).over(w), F.lit("")))


def weak(borrowed: Column, used: Column) -> Column:
    return (borrowed > 1.2) | (used < 1.8)


def window_mean(rows: DataFrame, by: list[str], vec: str = "emb") -> DataFrame:
    """Mean of the window vectors of each row, at length 1, number by number."""
    parts = rows.select(*by, F.posexplode(vec).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    whole = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_v"), F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("_n"))
    return whole.select(*by, F.transform("_v", lambda s: s["_m"]).alias("_u"), "_n").select(*by, F.zip_with("_u", F.array_repeat("_n", F.size("_u")), lambda a, n: a / F.greatest(n, F.lit(1e-9))).alias(vec))


# Fixed values, in seconds: what a span is padded by, should have, may borrow on a side, and must have for a vector.
PAD, LEAST_SPAN, BORROW, SHORTEST = 0.35, 2.0, 1.0, 1.2


def span_reach(spans: DataFrame, by: list[str], key: str, pad: float = PAD, least: float = LEAST_SPAN, most: float = BORROW) -> DataFrame:
    """by, key, low, high, borrowed: the time whose vectors may stand for a span (start, end). A padded span shorter than `least` borrows
    from both sides, half from before first, then what is lacking from after, then from before again; never beyond the neighbours'
    bounds, nor more than `most` on a side. Spans without a start or end take no part."""
    rows = spans.where("start is not null and end is not null").select(*by, key, "start", "end")
    rows = rows.join(neighbour_bounds(rows, by, key), [*by, key])
    a, b = F.col("start") - pad, F.col("end") + pad
    room_low = F.greatest(F.lit(0.0), a - F.greatest(F.coalesce("low", a - most), a - most))
    room_high = F.greatest(F.lit(0.0), F.least(F.coalesce("high", b + most), b + most) - b)
    need = F.greatest(F.lit(0.0), least - (b - a))
    rows = rows.select(*by, key, a.alias("_a"), b.alias("_b"), room_low.alias("_rl"), room_high.alias("_rh"), need.alias("_need"))
    rows = rows.withColumn("_l", F.least(F.col("_need") / 2, "_rl"))
    rows = rows.withColumn("_h", F.least(F.col("_need") - F.col("_l"), F.col("_rh")))
    rows = rows.withColumn("_l", F.col("_l") + F.least(F.col("_need") - F.col("_l") - F.col("_h"), F.col("_rl") - F.col("_l")))
    return rows.select(*by, key, (F.col("_a") - F.col("_l")).alias("low"), (F.col("_b") + F.col("_h")).alias("high"), (F.col("_l") + F.col("_h")).alias("borrowed"))


def span_vectors(spans: DataFrame, windows: DataFrame, by: list[str], key: str, cell: float = LEAST_SPAN, vec: str = "emb", **reach: float) -> DataFrame:
    """by, key, emb, n_win, borrowed: the mean, at length 1, of the windows (start, end, emb) that lie within a span's reach.

    Windows meet spans by the cell of a grid in which they begin, so the join is on equal keys and a long span has as many rows as
    it has cells; the mean is of each number. Spans without a window, or with less than SHORTEST in all, have no row. Windows with null times or vectors take no part."""
    reached = span_reach(spans, by, key, **reach)
    slot = lambda c: F.floor(c / cell).cast("bigint")
    a = reached.withColumn("_cell", F.explode(F.sequence(slot(F.col("low")), slot(F.col("high")))))
    b = windows.where(f"start is not null and end is not null and {vec} is not null").select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"), F.col(vec).alias("_v"), slot(F.col("start")).alias("_cell"))
    met = a.where(F.col("high") - F.col("low") >= SHORTEST).join(b, [*by, "_cell"]).where("_s >= low - 1e-9 and _e <= high + 1e-9")
    counted = met.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n_win"), F.first("borrowed").alias("borrowed"))
    return window_mean(met.select(*by, key, F.col("_v").alias(vec)), [*by, key], vec).join(counted, [*by, key])


def bind(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Give every row of a bound cluster its name: names (spk, name)."""
    return rows.join(names.select("spk", F.col("name").alias("_name")), "spk", "left").withColumn("speaker", F.coalesce("_name", "speaker")).drop("_name")


def commands(state: DataFrame, log: DataFrame) -> DataFrame:
    """Names of clusters (spk, value, denied, rev) after a log of commands (seq, op, spk, value): rename and reassign give a cluster a
    value, which no other keeps; unbind takes it away; deny rules a value out, and doesn't count as a revision."""
    first = state.select("spk", F.lit(-1).cast("bigint").alias("seq"), F.lit("rename").alias("op"), "value").where("value != ''")
    all_ = first.unionByName(log.select("spk", F.col("seq").cast("bigint").alias("seq"), "op", "value"))
    named = all_.where(F.col("op").isin("rename", "reassign", "unbind"))
    last = named.withColumn("_n", F.row_number().over(Window.partitionBy("spk").orderBy(F.desc("seq")))).where("_n = 1")
    owner = last.where("op != 'unbind'").withColumn("_o", F.row_number().over(Window.partitionBy("value").orderBy(F.desc("seq"), "spk"))).where("_o = 1").select("spk", "value")
    denied = all_.where("op = 'deny'").groupBy("spk").agg(F.array_sort(F.collect_set("value")).alias("denied"))
    rev = log.where("op != 'deny'").groupBy("spk").agg(F.count(F.lit(1)).alias("rev"))
    every = all_.select("spk").distinct()
    return every.join(owner, "spk", "left").join(denied, "spk", "left").join(rev, "spk", "left").select("spk", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("denied", F.array().cast("array<string>")).alias("denied"), F.coalesce("rev", F.lit(0)).alias("rev"))


def changed_labels(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose cluster a refit has changed: what has to be sent again."""
    return after.alias("a").join(before.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]).where(~F.col("a.spk").eqNullSafe(F.col("b.spk"))).select("a.*")


def to_enroll(rows: DataFrame, most: int = KEEP, seconds: float = 24.0) -> DataFrame:
    """Each cluster's longest rows whose vector isn't weak: up to `most`, stopping once `seconds` are reached."""
    w = Window.partitionBy("spk").orderBy(F.desc("duration"), "idx")
    ranked = rows.where("not emb_weak").withColumn("nth", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("duration").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return ranked.where((F.col("nth") <= most) & (F.col("before") < seconds)).drop("before")


def resolve_names(rows: DataFrame, voice_names: DataFrame, participants: DataFrame) -> DataFrame:
    """A cluster's value is a participant's id, or a name: the participant's name by id, else the literal."""
    return rows.join(voice_names.select("spk", "value"), "spk", "left").join(participants.select(F.col("id").alias("value"), F.col("name").alias("_by_id")), "value", "left").withColumn("speaker", F.coalesce("_by_id", "value", F.lit(""))).drop("_by_id", "value")
