"""Near-dedup by min-max hashing: each permutation of the shingles gives two values of a signature, its minimum and its maximum.

Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct SHINGLE-word shingles, or its
one whole sequence where it has fewer words. Documents are linked where their sets' Jaccard similarity is at least
80 / 100; signatures in bands of ROWS values find candidates (a pair at 0.8 is missed with probability 3e-6), and links are
confirmed on full sets, made from the texts. Components of links are the groups; the smallest id of each stays.

How hot groups stay linear. Documents with the same words in the same order are one node, known by a 128-bit digest; all other
equality, of words, shingles and sets, is decided on the words. In each bucket of a band only the pairs of the smallest
node with the others are confirmed; where the components found so far leave a bucket with several, those pairs
across components are confirmed that the triangle inequality of Jaccard distance, the sizes of the sets and one bit of each
value of the signatures leave open. So links between different components are kept, and pairs within the component of a
bucket's smallest node are never formed. Nothing but counts comes to the driver.

Null and empty texts have no shingles and are linked with nothing. A row whose id is null is never linked and has a null
component. Rows are linked by their own texts: repeated rows, and rows of one id with other texts, each get a row with the component
of their text, kept where their id is the component's. An empty table gives an empty result.
Other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bitmap, bounded_batches, marked, written
from tidewater.llm.hashing import LOWER, Coded, P, Vocabulary, chunks, mixed
from tidewater.sources.tables import read_spread

SHINGLE, PERMUTATIONS, ROWS = 2, 80, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Bits of the signatures that must agree, of 2 * PERMUTATIONS, for a pair in a bucket of several components to be confirmed.
#: At a similarity of 0.8 nine in ten agree, 144, with a deviation of 3.8: under 124 do with probability 1e-6.
WORDS64, AGREE = -(-2 * PERMUTATIONS // 64), 124
#: Rows of a bucket up to which its pairs are joined; larger buckets are worked on in blocks of some BLOCK rows.
SMALL, BLOCK = 16, 128
#: Rows of a batch that are Python objects at once.
SLICE = 512

_draw = np.random.default_rng(20)
_A = _draw.integers(0, 1 << 31, PERMUTATIONS, dtype="u4") * np.uint32(2) + np.uint32(1)
_B = _draw.integers(0, 1 << 32, PERMUTATIONS, dtype="u4")


def shingle_sets(coded: Coded, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, and the number of them. Shingles are told apart by their words."""
    ids, words = coded.ids, coded.words
    k = np.minimum(size, words)
    many = np.where(words > 0, words - k + 1, 0)
    doc = np.repeat(np.arange(len(words)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(words) - words, many)
    if not len(at):
        return np.zeros(0, "u8"), many
    code, short = ids[at], k[doc]
    g = mixed(short.astype("u8") * np.uint64(P) + coded.hashes[code])
    for i in range(1, size):
        nth = ids[np.minimum(at + i, len(ids) - 1)]
        g = np.where(i < short, mixed(g * np.uint64(P) + coded.hashes[nth]), g)
        code = np.unique(code * len(coded.hashes) + nth, return_inverse=True)[1]  # ranks, so that products stay small
    _, first, many = np.unique(doc * (int(code.max()) + 1) + code, return_index=True, return_counts=True)
    return g[first], np.bincount(doc[first], minlength=len(words))


def signatures(g: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, of non-empty sets: (set, 2 * PERMUTATIONS)."""
    x, first = (g >> np.uint64(19)).astype("u4"), np.cumsum(many) - many
    out = np.empty((2 * PERMUTATIONS, len(many)), "u4")
    v = np.empty_like(x)
    for k in range(PERMUTATIONS):
        np.multiply(x, _A[k], out=v)
        v += _B[k]
        np.minimum.reduceat(v, first, out=out[k])
        np.maximum.reduceat(v, first, out=out[PERMUTATIONS + k])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(set, band): one 64-bit key for the ROWS values of a band and its number."""
    v = sig.reshape(BANDS, ROWS, -1).astype("u8")
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype="u8")[:, None], (BANDS, sig.shape[1]))
    for r in range(ROWS):
        key = mixed(key * np.uint64(P) + v[:, r])
    return key.T


def sketches(sig: np.ndarray) -> np.ndarray:
    """(set, WORDS64): one bit of each value of the signature, packed."""
    bits = ((sig * np.uint32(2654435761)) >> np.uint32(31)).astype("u1")
    packed = np.packbits(np.concatenate([bits, np.zeros((64 * WORDS64 - len(bits), bits.shape[1]), "u1")]).T, axis=1)
    return np.ascontiguousarray(packed).view("i8")


def sign(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, a hash of the text, n_shingles, a 128-bit digest of the words in their order, the band keys and the bits of the signature."""
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()

    def run(batches):
        vocabulary = Vocabulary()
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            texts = [t.as_py() for t in pc.fill_null(batch.column("_text").cast(pa.large_binary()), b"")]
            for i, j in chunks(texts):
                vocabulary, coded = Coded.of(texts[i:j], vocabulary)
                g, many = shingle_sets(coded, size)
                full = np.flatnonzero(many)
                at, flat, bits = np.zeros(j - i, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8")
                if len(full):
                    sig = signatures(g, many[full])
                    flat, bits = band_keys(sig).reshape(-1).view("i8"), sketches(sig).reshape(-1)
                    at[full] = BANDS
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at)]), pa.int32()), pa.array(flat, pa.int64()))
                small = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at // BANDS * WORDS64)]), pa.int32()), pa.array(bits, pa.int64()))
                own = [batch.column(c).slice(i, j - i) for c in ("_id", "_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(many, pa.int64()), pa.array(coded.digests, pa.binary()), lists, small], ["_id", "_hash", "_n", "_same", "_bands", "_bits"])

    return base.mapInArrow(run, f"_id {kind}, _hash bigint, _n bigint, _same binary, _bands array<bigint>, _bits array<bigint>")


def shingles(text: str | None, size: int) -> set:
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def texts_of(nodes: DataFrame, at: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_i, _t for distinct nodes (_i). at: where a node's text is, by id and hash of the text, as rows of one id can have other texts.
    Only texts that share a bit of a bounded bitmap with one of them are moved."""
    wanted = written(nodes.join(at, "_i"), "near-ids")
    text, key = F.col(text_col).cast("string"), F.xxhash64("_id", "_hash")
    base = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), F.xxhash64(text).alias("_hash"))
    base = marked(base, key, bitmap(wanted, key)).where("_hit").drop("_hit")
    return written(base.join(wanted, ["_id", "_hash"]).select("_i", "_t").dropDuplicates(["_i"]), "near-texts")


def confirmed(pairs: DataFrame, at: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, share: int) -> DataFrame:
    """pairs of nodes (_x, _y) -> _x, _y, linked, distance, on full sets."""
    texts = texts_of(pairs.select(F.col("_x").alias("_i")).union(pairs.select("_y")).distinct(), at, docs, id_col, text_col)
    both = pairs.join(texts.select(F.col("_i").alias("_x"), F.col("_t").alias("_tx")), "_x")
    both = written(both, "near-half").join(texts.select(F.col("_i").alias("_y"), F.col("_t").alias("_ty")), "_y").select("_x", "_y", "_tx", "_ty")
    kind = both.schema["_x"].dataType.simpleString()

    def run(batches):
        last, held = None, set()
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            linked, distance = [], []
            for tx, ty in zip(batch.column("_tx").to_pylist(), batch.column("_ty").to_pylist(), strict=True):
                if ty != last:
                    last, held = ty, shingles(ty, size)
                x = shingles(tx, size)
                common = len(x & held)
                union = len(x) + len(held) - common
                linked.append(union > 0 and 100 * common >= share * union)
                distance.append(1 - common / max(union, 1))
            yield pa.RecordBatch.from_arrays([batch.column("_x"), batch.column("_y"), pa.array(linked, pa.bool_()), pa.array(distance, pa.float64())], ["_x", "_y", "linked", "distance"])

    return both.mapInArrow(run, f"_x {kind}, _y {kind}, linked boolean, distance double")


def linked_blocks(members: DataFrame, size: int, share: int) -> DataFrame:
    """Links between components within large buckets, a block of some BLOCK rows against another at a time.

    members: _key, _x, _label, _main, distance, _size, _bits, _bands, _t, _outside (how many of the bucket's rows aren't in its
    head's component), _all (how many rows it has). Each row goes to as many block pairs as the other side has blocks;
    pairs are formed in a task's memory only, each in the first band that both share, and of the links those are handed on
    that join components within the block pair."""
    i, j = F.ceil(F.col("_outside") / BLOCK), F.ceil(F.col("_all") / BLOCK)
    at = lambda seed, n: F.pmod(F.xxhash64("_x", F.lit(seed)), n)
    left = members.where("_label != _main").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), j - 1))).withColumn("_i", at(1, i)).withColumn("_side", F.lit(0))
    right = members.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), i - 1))).withColumn("_j", at(2, j)).withColumn("_side", F.lit(1))
    both = left.unionByName(right).select("_key", "_i", "_j", "_side", "_x", "_label", "_main", "distance", "_size", "_bits", "_bands", "_t")
    kind = both.schema["_x"].dataType.simpleString()
    names = both.columns
    wide, least = 1 - share / 100 + 1e-9, share / 100

    def links(rows: list[dict]) -> list[tuple]:
        a, b = [r for r in rows if not r["_side"]], [r for r in rows if r["_side"]]
        if not a or not b:
            return []
        take = lambda rows, c, t: np.array([r[c] for r in rows], t)
        ban, bbn = take(a, "_bands", "i8"), take(b, "_bands", "i8")
        band = int(np.flatnonzero(ban[0] == a[0]["_key"])[0])
        ok = (ban[:, None, :band] != bbn[None, :, :band]).all(2) if band else np.ones((len(a), len(b)), bool)
        ok &= np.abs(take(a, "distance", "f8")[:, None] - take(b, "distance", "f8")) <= wide
        n, m = take(a, "_size", "f8")[:, None], take(b, "_size", "f8")
        ok &= np.minimum(n, m) >= least * np.maximum(n, m)
        differ = np.bitwise_count(take(a, "_bits", "i8").view("u8")[:, None] ^ take(b, "_bits", "i8").view("u8")).sum(2)
        ok &= differ <= 2 * PERMUTATIONS - AGREE
        up: dict = {}

        def root(v):
            while up.get(v, v) != v:
                v = up[v]
            return v

        held: dict = {}
        sets = lambda r: held[r["_x"]] if r["_x"] in held else held.setdefault(r["_x"], shingles(r["_t"], size))
        out = []
        for p, q in sorted(zip(*np.nonzero(ok), strict=True), key=lambda t: differ[t]):  # the likeliest first
            x, y = a[p], b[q]
            if x["_label"] == y["_label"] or y["_label"] != y["_main"] and x["_x"] <= y["_x"]:
                continue
            u, v = root(x["_label"]), root(y["_label"])
            if u == v:
                continue
            s, t = sets(x), sets(y)
            common = len(s & t)
            if 100 * common >= share * (len(s) + len(t) - common):
                up[max(u, v)] = min(u, v)
                out.append((x["_x"], y["_x"]))
        return out

    def run(batches):
        now, rows = None, []
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if now is not None and r[:3] != now and rows:
                    yield from given(links(rows))
                    rows = []
                now = r[:3]
                rows.append(dict(zip(names, r, strict=True)))
        if rows:
            yield from given(links(rows))

    def given(found):
        if found:
            x, y = zip(*found, strict=True)
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"_x": x, "_y": y}), preserve_index=False)

    dealt = both.repartition("_key", "_i", "_j").sortWithinPartitions("_key", "_i", "_j")
    return dealt.mapInArrow(run, f"_x {kind}, _y {kind}")


def components(edges: DataFrame) -> DataFrame:
    """edges (_x, _y) -> _v, _label: the smallest node that each node reaches. Labels spread along edges, and from labels
    to their own labels, until none changes; each round is a written table."""
    both = written(edges.select("_x", "_y").union(edges.select("_y", "_x")).distinct(), "near-edges")
    labels = written(both.groupBy(F.col("_x").alias("_v")).agg(F.least(F.min("_y"), F.first("_x")).alias("_label")), "near-labels")
    while True:
        near = both.join(labels, both["_y"] == labels["_v"]).groupBy(F.col("_x").alias("_v")).agg(F.min("_label").alias("_near"))
        now = written(labels.join(near, "_v", "left").select("_v", F.least("_label", "_near").alias("_label"), F.col("_label").alias("_was")), "near-spread")
        jump = now.select(F.col("_v").alias("_at"), F.col("_label").alias("_to"))
        new = written(now.join(jump, now["_label"] == jump["_at"], "left").select("_v", F.coalesce("_to", "_label").alias("_label"), "_was"), "near-labels")
        labels = new.select("_v", "_label")
        if new.where("_label != _was").isEmpty():
            return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, share: int = 80) -> DataFrame:
    """id, n_shingles, component_id, kept for each row."""
    bounded_batches(docs.sparkSession)
    signed = written(sign(docs, id_col, text_col, size).withColumn("_row", F.monotonically_increasing_id()), "near-signatures")
    # A node is a row of its own number: of the rows with its words in their order the one of the smallest id.
    same = signed.where("_n > 0 and _id is not null").groupBy("_same").agg(F.min(F.struct("_id", "_row")).alias("_first"), F.count(F.lit(1)).alias("_m")).where("_m > 1")
    same = written(same.drop("_m"), "near-sets")
    rep, known = F.coalesce("_first._row", "_row"), F.col("_id").isNotNull()
    nodes = signed.join(same, "_same", "left").select(
        "_id", "_n", "_hash", F.when(known, rep).alias("_rep"), F.when(known, F.coalesce("_first._id", "_id")).alias("_low"), *(F.when(known & (F.col("_row") == rep), F.col(c)).alias(c) for c in ("_bands", "_bits"))
    )
    nodes = written(nodes, "near-nodes")
    at = nodes.where("_bands is not null").select(F.col("_rep").alias("_i"), "_id", "_hash")
    members = nodes.where("_bands is not null").select(F.explode("_bands").alias("_key"), F.col("_rep").alias("_x"))
    heads = members.groupBy("_key").agg(F.min("_x").alias("_y"), F.max("_x").alias("_z")).where("_y < _z").drop("_z")
    stars = written(members.join(written(heads, "near-heads"), "_key").where("_x != _y"), "near-stars")
    tested = written(confirmed(written(stars.select("_x", "_y").distinct(), "near-pairs"), at, docs, id_col, text_col, size, share), "near-tested")
    links = tested.where("linked").select("_x", "_y")
    labels = components(links)

    # Buckets that still hold several components. The heads' rows are at distance 0 from themselves.
    spread = stars.join(tested.drop("linked"), ["_x", "_y"]).select("_key", "_x", "distance")
    spread = spread.union(stars.select("_key", F.col("_y").alias("_x"), F.lit(0.0)).distinct())
    placed = written(spread.join(labels, spread["_x"] == labels["_v"], "left").select("_key", "_x", "distance", F.coalesce("_label", "_x").alias("_label")), "near-placed")
    open_keys = placed.groupBy("_key").agg(F.min("_label").alias("_a"), F.max("_label").alias("_b")).where("_a != _b").select("_key")
    heads = placed.where("distance = 0").select("_key", F.col("_label").alias("_main"))
    still = written(placed.where("distance > 0").join(open_keys.join(heads, "_key"), "_key"), "near-open")
    many = still.groupBy("_key").agg(F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("_label") != F.col("_main"), 1)).alias("_outside"))
    about = nodes.where("_bits is not null").select(F.col("_rep").alias("_x"), F.col("_n").alias("_size"), "_bits", "_bands")
    still = written(still.join(written(many, "near-many"), "_key"), "near-counted").join(written(about, "near-about"), "_x")
    still = written(still, "near-still")
    # Pairs of small buckets. One side holds only what isn't in the head's component.
    few = still.where(F.col("_all") <= SMALL).drop("_bands")
    a, b = few.where("_label != _main").alias("a"), few.alias("b")
    wide, least = 1 - share / 100 + 1e-9, share / 100
    differ = F.aggregate(F.zip_with("a._bits", "b._bits", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)
    near = (F.abs(F.col("a.distance") - F.col("b.distance")) <= wide) & (F.least("a._size", "b._size") >= F.greatest("a._size", "b._size") * least) & (differ <= 2 * PERMUTATIONS - AGREE)
    once = (F.col("b._label") == F.col("b._main")) | (F.col("a._x") > F.col("b._x"))
    across = a.join(b, (F.col("a._key") == F.col("b._key")) & (F.col("a._label") != F.col("b._label")) & once & near)
    across = written(across.select(F.col("a._x").alias("_x"), F.col("b._x").alias("_y")).distinct(), "near-across")
    more = confirmed(across, at, docs, id_col, text_col, size, share).where("linked").select("_x", "_y")
    large = still.where(F.col("_all") > SMALL)
    if not large.isEmpty():
        texts = texts_of(large.select(F.col("_x").alias("_i")).distinct(), at, docs, id_col, text_col)
        more = more.union(linked_blocks(large.join(texts, large["_x"] == texts["_i"]).drop("_i"), size, share))
    more = written(more.distinct(), "near-more")
    if not more.isEmpty():
        labels = components(links.union(more))
    # A component is known by the smallest id of its rows.
    ids = labels.join(at, labels["_v"] == at["_i"]).select("_v", "_label", "_id")
    least = ids.groupBy("_label").agg(F.min("_id").alias("_least"))
    found = written(ids.join(least, "_label").select("_v", "_least"), "near-components")
    out = nodes.join(found, nodes["_rep"] == found["_v"], "left").select("_id", "_n", F.coalesce("_least", "_low").alias("component_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(read_spread(spark, f"{sf_dir}/documents.parquet"))
