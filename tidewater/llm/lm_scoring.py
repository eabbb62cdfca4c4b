"""LM scoring by context-tree weighting over bytes, beside a smoothed word unigram as base.

A text is coded as its words (runs without ASCII white space, A-Z lower-cased), each followed by a space, then a line feed as
end. Each byte is eight binary choices, and each choice has a context tree over the DEPTH bytes before it. A node's estimate is
Krichevsky-Trofimov's, (n1 + 1/2) / (n0 + n1 + 1); going up from the leaves, a node's block probability is the mean of its own
and the product of its children's, which gives the weight of its own estimate against the deeper ones. A choice's probability
is that mixture along its context; where a deeper context wasn't met in training, the deepest one that was has the rest.

Counts are over all training texts, and the tree holds every context met in them. It is never in one place. A scan cuts its
texts into blocks of about BLOCK bytes, and writes each block's texts, its distinct grams with their counts and its distinct
words with theirs, all packed; grams are dealt into buckets by the TOP + 1 bytes before the byte, and words by their hash. So
rows are few and small, whatever the number of grams. A bucket meets the grams of all blocks, builds the subtrees of its
contexts and gives each block the probabilities of its own grams; only the levels up to TOP, of 65,536 contexts at most, are
brought together and broadcast. A word's count comes back to the blocks that have it in the same way, and is exact.

Null text counts as empty: one token, the end. Null ids count as the empty text for the fold. Repeated rows each get a row and,
in training folds, each count. Without training rows every byte has probability 1/256. An empty table gives an empty result.
Other columns are ignored. Texts of any length are read whole; a long one is a block of its own.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, fold, last_written, written
from tidewater.llm.hashing import LOWER, chunks, mixed
from tidewater.sources.shared import delete
from tidewater.sources.tables import read_spread

DEPTH, TOP = 6, 2
#: Bytes of text in a block and of the pieces that it is worked on in, buckets at least and at most, grams that are looked up at
#: a time, and counts whose gamma function is in a table.
BLOCK, PIECE, BUCKETS, HELD, TABLE = 3 << 23, 1 << 20, (256, 1 << 16), 1 << 16, 1 << 16
TEXTS, GRAMS, WORDS = 0, 1, 2
NODE, LOW, TOKENS, DISTINCT = 0, 1, 2, 3


def coding(text: bytes) -> bytes:
    return b" ".join([*text.translate(LOWER).split(), b"\n"])


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each coded byte the byte and the DEPTH before it, latest lowest; and the number of coded bytes of each text."""
    return grams_of([coding(t) for t in texts])


def grams_of(coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pad = b"\n" * DEPTH
    size = np.array([len(c) for c in coded], "i8")
    data = np.frombuffer(pad + pad.join(coded), "u1")
    code = data.astype("i8")
    for k in range(1, DEPTH + 1):
        code[k:] |= data[:-k].astype("i8") << (8 * k)
    real = np.ones(len(data), bool)
    begin = np.cumsum(size + DEPTH) - size - DEPTH
    real[(begin[:, None] + np.arange(DEPTH)).ravel()] = False
    return code[real], size


def turned(code: np.ndarray) -> np.ndarray:
    """Grams with the order of the bytes before the byte reversed, so that grams of like ends sort together."""
    return (((code >> 8).byteswap().view("u8") >> np.uint64(64 - 8 * DEPTH)).view("i8") << 8) | (code & 255)


def counted(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is there."""
    if not len(keys):
        return keys.astype("i8"), np.zeros(0, "i8")
    if n is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.diff(np.append(first, len(keys)))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def packed(values: np.ndarray) -> bytes:
    """Bytes of whole numbers or floats, compressed plane by plane."""
    return pa.compress(np.ascontiguousarray(values.view("u1").reshape(-1, values.itemsize).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpacked(data: bytes, kind: str) -> np.ndarray:
    """What packed() was given."""
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1")
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class Block:
    """What a scan has met of a block: its training and other grams and words with their counts in training texts."""

    def __init__(self):
        self.key, self.size, self.grams, self.words = uuid.uuid4().int >> 65, 0, [], Counter()

    def add(self, coded: list[bytes], train: np.ndarray) -> None:
        """Every gram and word is held, those of other texts with a count of 0."""
        code, size = grams_of(coded)
        self.size += len(code)
        code = (code << 1) | np.repeat(~train, size)
        code.sort()
        key = code >> 1
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, "i8")
        self.grams.append((key[first], np.add.reduceat(1 - (code & 1), first) if len(key) else key))
        if sum(len(k) for k, _ in self.grams[1:]) > len(self.grams[0][0]):
            self.merge()
        for used in (True, False):
            some = [c for c, t in zip(coded, train, strict=True) if t == used]
            if used:
                self.words.update(b" ".join(some).split())
                self.words[b""] += len(some)  # ends
            else:
                self.words.update(dict.fromkeys({b"", *b" ".join(some).split()}, 0))

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        self.grams = [counted(*(np.concatenate(x) for x in zip(*self.grams, strict=True)))]
        return self.grams[0]

    def rows(self, buckets: int):
        """(kind, bucket, keys, counts) of each bucket that has some, packed."""
        keys, n = self.merge()
        at = turned(keys)
        order = np.argsort(at)
        at, n = at[order], n[order]
        bucket = (mixed((at >> (8 * (DEPTH - TOP))).view("u8")) % np.uint64(buckets)).astype("u2")
        order = np.argsort(bucket, kind="stable")
        at, n, bucket = at[order], n[order], bucket[order]
        for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(bucket)) + 1) if len(at) else ():
            yield GRAMS, int(bucket[some[0]]), packed(np.diff(at[some], prepend=0)), packed(n[some].astype("u4"))
        dealt: dict[int, list[bytes]] = {}
        for w in self.words:
            dealt.setdefault(zlib.crc32(w) % buckets, []).append(w)
        for b, some in dealt.items():
            some.sort()
            yield WORDS, b, pa.compress(b" ".join(some), codec="zstd", asbytes=True) if some != [b""] else b"", packed(np.array([self.words[w] for w in some], "i8"))


def scanned(docs: DataFrame, buckets: int) -> DataFrame:
    """_id, _text, _train -> rows by kind. TEXTS: the coded texts of a piece of a block, with their ids, lengths and folds;
    GRAMS and WORDS: those of a block and bucket."""
    kind = docs.schema["_id"].dataType.simpleString()

    def run(batches):
        schema = None

        def row(what, block, bucket=None, ids=None, size=b"", data=b"", n=b""):
            values = [[what], [block], [bucket], [ids], [size], [data], [n]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, schema.types, strict=True)], schema=schema)

        def given(block):
            for what, bucket, keys, n in block.rows(buckets):
                yield row(what, block.key, bucket, data=keys, n=n)

        block = Block()
        for batch in batches:
            of = batch.schema.field("_id").type
            schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(of)), ("size", pa.binary()), ("data", pa.binary()), ("n", pa.binary())])
            texts = [t.as_py() for t in pc.fill_null(batch.column("_text").cast(pa.large_binary()), b"")]
            train = batch.column("_train").to_numpy(zero_copy_only=False).astype(bool)
            for i, j in chunks(texts, PIECE):
                if block.size and block.size + sum(map(len, texts[i:j])) > BLOCK:
                    yield from given(block)
                    block = Block()
                coded = [coding(t) for t in texts[i:j]]
                block.add(coded, train[i:j])
                size = np.array([len(c) for c in coded], "i8")
                yield row(TEXTS, block.key, ids=batch.column("_id").slice(i, j - i).to_pylist(), size=size.tobytes(), data=pa.compress(b"".join(coded), codec="zstd", asbytes=True))
        if block.size:
            yield from given(block)

    return docs.mapInArrow(run, f"kind int, block bigint, bucket int, ids array<{kind}>, size binary, data binary, n binary")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after nine steps up."""
    x, down = np.asarray(x, "f8"), 0.0
    for _ in range(9):
        down = down + np.log(x)
        x = x + 1
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - down


HALVES, WHOLES = log_gamma(np.arange(TABLE) + 0.5), log_gamma(np.arange(TABLE) + 1.0)


def log_gamma_of(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    """log_gamma(n + more) for counts n, small ones from their table."""
    out, large = table[np.minimum(n, TABLE - 1).astype("i8")], np.flatnonzero(n >= TABLE)
    out[large] = log_gamma(n[large] + more)
    return out


def log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma_of(n0, HALVES, 0.5) + log_gamma_of(n1, HALVES, 0.5) - np.log(np.pi) - log_gamma_of(n0 + n1, WHOLES, 1.0)


def nodes(code: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Node codes (context << 8 | bits so far with a leading 1), sorted, with the zeros and ones after them, of sorted grams
    (context << 8 | byte) and their counts."""
    context, byte = code >> 8, code & 255
    parts: list[list] = [[], [], []]
    for bit in range(8):
        at, one = (context << 8) | ((1 << bit) | (byte >> (8 - bit))), (byte >> (7 - bit)) & 1
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, "i8")
        w = n.astype("f8")
        parts[0].append(at[first])
        parts[1].append(np.add.reduceat(w * (1 - one), first) if len(at) else w)
        parts[2].append(np.add.reduceat(w * one, first) if len(at) else w)
    order = np.argsort(np.concatenate(parts[0]))
    return [np.concatenate(x)[order] for x in parts]


class Tree:
    """For each depth: sorted node codes, estimate of a 1, and own weight. top: nodes of the least depth, with their zeros, ones
    and log block probabilities."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]], first: int = 0, deep: tuple | None = None):
        """levels: for each depth from first on, all grams met (context << 8 | byte), sorted, and their counts. deep: for nodes of
        the last of them, sorted, the sum of their children's log block probabilities; without it they have no children."""
        found = [nodes(code, n) for code, n in levels]
        self.levels: list = [None] * len(found)
        below = None
        for k in range(len(found) - 1, -1, -1):
            at, n0, n1 = found[k]
            own = whole = log_block(n0, n1)
            if below is not None or deep is not None:
                if below is not None:
                    codes, _, _, inner = below
                    up = np.searchsorted(at, (((codes >> 8) & ((1 << (8 * (first + k))) - 1)) << 8) | (codes & 255))
                else:
                    up, inner = np.searchsorted(at, deep[0]), deep[1]
                whole = np.logaddexp(own, np.bincount(up, weights=inner, minlength=len(at))) - np.log(2)
                self.levels[k] = (at, ((n1 + 0.5) / (n0 + n1 + 1)).astype("f4"), np.exp(np.minimum(own - np.log(2) - whole, 0)).astype("f4"))
            else:
                self.levels[k] = (at, ((n1 + 0.5) / (n0 + n1 + 1)).astype("f4"), np.ones(len(at), "f4"))
            below = (at, n0, n1, whole)
        self.top = below

    def fresh(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte after its context, for a tree from the root on."""
        return byte_logs(self.levels, code)


def byte_logs(levels: list, code: np.ndarray) -> np.ndarray:
    """log10 probability of each gram's byte after its context, by a tree's levels from the root on."""
    out = np.zeros(len(code))
    for bit in range(8):
        s, one = (1 << bit) | ((code & 255) >> (8 - bit)), ((code >> (7 - bit)) & 1).astype(bool)
        p, rest, last, live = np.zeros(len(code)), np.ones(len(code)), np.full(len(code), 0.5), np.ones(len(code), bool)
        for d, (held, estimate, weight) in enumerate(levels):
            at = (((code >> 8) & ((1 << (8 * d)) - 1)) << 8) | s
            i = np.minimum(np.searchsorted(held, at), max(len(held) - 1, 0))
            live &= (held[i] == at) if len(held) else False
            if not live.any():
                break
            e, w = np.where(live, estimate[i], 0), np.where(live, weight[i], 0)
            p += rest * w * e
            rest *= 1 - w
            last = np.where(live, e, last)
        p = np.clip(p + rest * last, 1e-12, 1 - 1e-12)
        out += np.log10(np.where(one, p, 1 - p))
    return out


def grouped(batches, columns: tuple[str, ...]):
    """(kind, bucket), rows of columns: of batches that come sorted by kind and bucket."""
    now, held = None, []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", *columns)), strict=True):
            if now is not None and r[:2] != now:
                yield now, held
                held = []
            now = r[:2]
            held.append(r[2:])
    if held:
        yield now, held


def subtree(rows: list[tuple]) -> tuple[list[np.ndarray], np.ndarray, list, Tree]:
    """For the packed grams of all blocks in a bucket: those of each block and all of them, as turned, the grams of each depth
    from TOP + 1 on with their counts, and their tree. Grams of count 0 aren't in the tree."""
    each = [np.cumsum(unpacked(data, "i8")) for data, _ in rows]
    at, n = counted(np.concatenate(each), np.concatenate([unpacked(n, "u4") for _, n in rows]).astype("i8"))
    code, met = turned(at), n > 0
    code, n = code[met], n[met]
    levels = [counted(code & ((1 << (8 * (d + 1))) - 1), n) for d in range(TOP + 1, DEPTH + 1)]
    return each, at, levels, Tree(levels, TOP + 1)


def words_of(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b" ") if data else [b""]


def word_counts(rows: list[tuple]) -> tuple[list[list[bytes]], Counter]:
    """For the packed words of all blocks in a bucket: those of each block, and the count of each."""
    each, total = [words_of(data) for data, _ in rows], Counter()
    for words, (_, n) in zip(each, rows, strict=True):
        for w, c in zip(words, unpacked(n, "i8").tolist(), strict=True):
            total[w] += c
    return each, total


def looked_up(parts: DataFrame) -> tuple[DataFrame, int, int]:
    """kind, block, data, value, written: for each row of GRAMS the log10 probabilities of its grams, for each row of WORDS the
    counts of its words in all training texts; and the number of training tokens, all and distinct."""
    spark = parts.sparkSession
    dealt = parts.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")

    def rising(batches):
        for (kind, _), rows in grouped(batches, ("data", "n")):
            if kind == WORDS:
                total = word_counts(rows)[1]
                out = [(TOKENS, 0, float(total.total())), (DISTINCT, 0, float(sum(c > 0 for c in total.values())))]
                what, code, value = (np.array(x) for x in zip(*out, strict=True))
            else:
                _, _, levels, tree = subtree(rows)
                at, n0, n1, whole = tree.top
                up = (((at >> 8) & ((1 << (8 * TOP)) - 1)) << 8) | (at & 255)
                keys, back = np.unique(up, return_inverse=True)
                low, n = counted(levels[0][0] & ((1 << (8 * (TOP + 1))) - 1), levels[0][1])
                what, code = np.repeat([NODE, LOW], [len(keys), len(low)]), np.concatenate([keys, low])
                value = np.concatenate([np.bincount(back, weights=whole, minlength=len(keys)), n.astype("f8")])
            yield pa.RecordBatch.from_arrays([pa.array(what, pa.int32()), pa.array(code, pa.int64()), pa.array(value, pa.float64())], ["what", "code", "value"])

    # Nodes of at most 65,536 contexts: 256 grams and 255 choices each.
    got = dealt.select("kind", "bucket", "data", "n").mapInArrow(rising, "what int, code bigint, value double").groupBy("what", "code").agg(F.sum("value").alias("value")).orderBy("what", "code").toArrow()
    what, code, value = (got[c].to_numpy() for c in ("what", "code", "value"))
    low, n = code[what == LOW], value[what == LOW].astype("i8")
    levels = [counted(low & ((1 << (8 * (d + 1))) - 1), n) for d in range(TOP + 1)]
    tree = Tree(levels, 0, (code[what == NODE], value[what == NODE]))
    shared = spark.sparkContext.broadcast(tree.levels)

    def falling(batches):
        for (kind, _), rows in grouped(batches, ("block", "data", "n")):
            packs = [r[1:] for r in rows]
            if kind == WORDS:
                each, total = word_counts(packs)
                values = [packed(np.array([total[w] for w in words], "i8")) for words in each]
            else:
                each, at, _, tree = subtree(packs)
                levels, code = [*shared.value, *tree.levels], turned(at)
                logs, order = np.empty(len(at), "f4"), np.argsort(code)
                for i in range(0, len(at), HELD):
                    logs[order[i : i + HELD]] = byte_logs(levels, code[order[i : i + HELD]])
                values = [packed(logs[np.searchsorted(at, keys)]) for keys in each]
            for (block, data, _), value in zip(rows, values, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([value], pa.binary())], ["kind", "block", "data", "value"])

    out = written(dealt.select("kind", "bucket", "block", "data", "n").mapInArrow(falling, "kind int, block bigint, data binary, value binary"), "lm-values")
    shared.destroy()
    return out, int(value[what == TOKENS].sum()), int(value[what == DISTINCT].sum())


def sums(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Sum for each text; none is empty."""
    return np.add.reduceat(values, np.cumsum(many) - many) if len(many) else np.zeros(0)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for each row; fold 0 is held out."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), (fold(F.col(id_col), folds) != 0).alias("_train"))
    kind = base.schema["_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = min(BUCKETS[1], max(BUCKETS[0], total // BLOCK))
    parts = written(scanned(base, buckets), "lm-blocks", ("kind",))
    path = last_written()
    found, n, v = looked_up(parts.where(F.col("kind") != TEXTS).select("kind", "bucket", "block", "data", "n"))
    for kind_done in (GRAMS, WORDS):  # what comes after reads texts and values alone
        delete(docs.sparkSession, f"{path}/kind={kind_done}")
    denominator = n + 0.1 * (v + 1)

    def run(texts: pa.Table, values: pa.Table) -> pa.Table:
        logs, counts = [], {}
        for what, data, value in zip(values["kind"].to_pylist(), values["data"], values["value"], strict=True):
            if what == WORDS:
                counts.update(zip(words_of(data.as_py()), unpacked(value.as_py(), "i8").tolist(), strict=True))
            else:
                logs.append((turned(np.cumsum(unpacked(data.as_py(), "i8"))), unpacked(value.as_py(), "f4")))
        held, value = (np.concatenate(x) for x in zip(*logs, strict=True)) if logs else (np.zeros(0, "i8"), np.zeros(0, "f4"))
        order = np.argsort(held)
        held, value = held[order], value[order].astype("f8")
        out = []
        for ids, size, data in zip(texts["ids"].combine_chunks(), texts["size"], texts["data"], strict=True):
            size = np.frombuffer(size.as_py(), "i8")
            end = np.cumsum(size)
            coded = zstandard.ZstdDecompressor().decompress(data.as_py())
            each = [coded[b - k : b] for b, k in zip(end.tolist(), size.tolist(), strict=True)]
            code, split = grams_of(each)[0], [c.split() for c in each]
            order = np.argsort(code)
            score = np.empty(len(code))
            score[order] = value[np.searchsorted(held, code[order])]
            many = np.array([len(w) + 1 for w in split], "i8")
            c = np.array([counts[w] for words in split for w in (*words, b"")], "i8")
            cols = [ids.values, pa.array(many), pa.array(size), pa.array(sums((c > 0).astype("i8"), many)), pa.array(sums(np.log10((c + 0.1) / denominator), many)), pa.array(sums(score, size))]
            out.append(pa.RecordBatch.from_arrays(cols, ["_id", "_tokens", "_bytes", "_known", "_base", "_score"]))
        return pa.Table.from_batches(out)

    texts = parts.where(F.col("kind") == TEXTS).select("block", "ids", "size", "data")
    rows = texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, f"_id {kind}, _tokens bigint, _bytes bigint, _known bigint, _base double, _score double")
    return rows.select(
        F.col("_id").alias(id_col),
        (fold(F.col("_id"), folds) == 0).alias("held_out"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_known").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        F.col("_base").alias("base_score"),
        F.col("_score").alias("score"),
        (-F.col("_score") / F.log10(F.lit(2.0)) / F.col("_bytes")).alias("bits_per_byte"),
    )


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(read_spread(spark, f"{sf_dir}/documents.parquet"))
