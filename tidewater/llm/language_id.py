"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

Texts are cut into windows of CORE bytes, all of them read, each with CONTEXT bytes of the text on both sides. In each window one
network runs forward and one backward, so that both have read at least CONTEXT bytes before a byte that counts, or all that the
text has there; at every position of the core the two states give a probability for each language, and a document's
probabilities are the means over its positions. Gates use clip(x / 4 + 1 / 2, 0, 1) and states x / (1 + |x|), which cost less than
the usual exponentials. The network learns from ROWS rows at most, chosen by hash and shared evenly by the languages, and of each
from SPREAD stretches that lie evenly over its whole text.

Null texts and texts without a letter are `und` with score 0, and so are all where no row can be learnt from. Rows whose
lang is null are predicted, not learnt from. Ties go to the first language. Null ids and repeated rows each get a row; empty tables
give an empty result. Texts of any length are read whole. Other columns are ignored; lang is read for training rows only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import bounded_batches, built, fold, token
from tidewater.sources.tables import read_spread

CORE, CONTEXT, HIDDEN, BATCH = 96, 16, 8, 4096
STEPS = CORE + 2 * CONTEXT
#: Rows that the network is trained on at most, and the stretches of CORE characters that are taken of each.
ROWS, SPREAD = 1500, 8
#: Passes over the windows, and steps that training takes at least, where rows are few.
EPOCHS, LEAST_STEPS = 6, 200
UND = "und"

_ALPHA = np.zeros(256, bool)
_ALPHA[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True


def gate(x):
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


class Network:
    """Arrays run (direction, unit, window). Direction 1 reads each window from its end."""

    def __init__(self, labels: int, seed: int = 3):
        draw = np.random.default_rng(seed)
        self.byte = (draw.standard_normal((2, 3 * HIDDEN, 256)) * 0.3).astype("f4")
        self.state = (draw.standard_normal((2, 3 * HIDDEN, HIDDEN)) / np.sqrt(HIDDEN)).astype("f4")
        self.out = (draw.standard_normal((labels, 2 * HIDDEN)) / np.sqrt(2 * HIDDEN)).astype("f4")
        self.bias = np.zeros((labels, 1), "f4")

    def params(self):
        return [self.byte, self.state, self.out, self.bias]

    def run(self, x: np.ndarray, tape: list | None = None) -> np.ndarray:
        """x: bytes by (step, window). Gives states by (step, 2 * HIDDEN, window). tape: gets what training needs."""
        steps, n = x.shape
        h, both = np.zeros((2, HIDDEN, n), "f4"), np.empty((steps, 2 * HIDDEN, n), "f4")
        e, half, one = np.empty((2, 3 * HIDDEN, n), "f4"), np.float32(0.5), np.float32(1)
        u, a, c = np.empty_like(e), np.empty((2, HIDDEN, n), "f4"), np.empty((2, HIDDEN, n), "f4")
        for t in range(steps):
            np.take(self.byte[0], x[t], axis=1, out=e[0], mode="clip")
            np.take(self.byte[1], x[steps - 1 - t], axis=1, out=e[1], mode="clip")
            np.matmul(self.state, h, out=u)
            g = e[:, : 2 * HIDDEN]
            g += u[:, : 2 * HIDDEN]
            g *= np.float32(0.25)
            g += half
            np.maximum(g, 0, out=g)
            np.minimum(g, one, out=g)
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            np.multiply(r, u[:, 2 * HIDDEN :], out=a)
            a += e[:, 2 * HIDDEN :]
            np.abs(a, out=c)
            c += one
            np.divide(a, c, out=c)
            if tape is not None:
                tape.append((h.copy(), z.copy(), r.copy(), u[:, 2 * HIDDEN :].copy(), a.copy(), c.copy(), e[:, : 2 * HIDDEN].copy()))
            c -= h
            c *= z
            h += c
            both[t, :HIDDEN] = h[0]
            both[steps - 1 - t, HIDDEN:] = h[1]
        return both

    def label(self, both: np.ndarray) -> np.ndarray:
        """Probability of each language at every position: (step, language, window)."""
        p = np.matmul(self.out, both)
        p += self.bias
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def gradients(self, x: np.ndarray, valid: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Of the mean cross-entropy over valid positions; y: a language for each window."""
        tape: list = []
        both = self.run(x, tape)
        p = self.label(both)
        steps, n = x.shape
        m = valid / np.float32(max(valid.sum(), 1))
        loss = float(-(np.log(np.maximum(p[:, y, np.arange(n)], 1e-9)) * m).sum())
        d = p.copy()
        d[:, y, np.arange(n)] -= 1
        d *= m[:, None, :]
        g_out, g_bias = np.einsum("tln,thn->lh", d, both, optimize=True), d.sum((0, 2))[:, None]
        d_both = np.matmul(self.out.T, d)
        g_byte, g_state, d_h = np.zeros_like(self.byte), np.zeros_like(self.state), np.zeros((2, HIDDEN, n), "f4")
        d_byte = np.empty((2, 3 * HIDDEN, steps, n), "f4")
        for t in range(steps - 1, -1, -1):
            h, z, r, u, a, c, g = tape[t]
            d_h[0] += d_both[t, :HIDDEN]
            d_h[1] += d_both[steps - 1 - t, HIDDEN:]
            d_z, d_a = d_h * (c - h), d_h * z / (1 + np.abs(a)) ** 2
            inside = ((g > 0) & (g < 1)) * np.float32(0.25)
            d_e = np.concatenate([d_z, d_a * u], 1) * inside
            d_e = np.concatenate([d_e, d_a], 1)
            d_u = np.concatenate([d_e[:, : 2 * HIDDEN], d_a * r], 1)
            d_h = d_h * (1 - z) + np.matmul(self.state.transpose(0, 2, 1), d_u)
            g_state += np.matmul(d_u, h.transpose(0, 2, 1))
            d_byte[0, :, t], d_byte[1, :, steps - 1 - t] = d_e[0], d_e[1]
        # Summed by byte, over all steps at once.
        order = np.argsort(x.ravel(), kind="stable")
        met = x.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
        g_byte[:, :, met[first]] = np.add.reduceat(d_byte.reshape(2, 3 * HIDDEN, -1)[:, :, order], first, axis=2)
        return loss, [g_byte, g_state, g_out.astype("f4"), g_bias.astype("f4")]


def train(x: np.ndarray, size: np.ndarray, y: np.ndarray, labels: int, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Network:
    """x: windows by (window, step); size: bytes in each. Adam over shuffled batches."""
    net, draw = Network(labels), np.random.default_rng(seed)
    first, second, k = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    epochs = max(epochs, -(-LEAST_STEPS // -(-len(x) // batch)))
    rounds = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for i in range(0, len(x), batch):
            pick = order[i : i + batch]
            valid = counting(size[pick]).astype("f4")
            _, grads = net.gradients(np.ascontiguousarray(x[pick].T), valid, y[pick])
            k += 1
            now = rate * (1 - (k - 1) / rounds)
            for p, g, a, b in zip(net.params(), grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= now * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-6)
    return net


def counting(size: np.ndarray) -> np.ndarray:
    """(step, window): whether a position is in the core and within the text."""
    at = np.arange(STEPS)[:, None]
    return (at >= CONTEXT) & (at < CONTEXT + size)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows by (window, step), bytes in the core of each, and the number of windows of each text. Bytes outside the text
    are 0."""
    data = np.frombuffer(bytes(CONTEXT) + b"".join(t + bytes(STEPS) for t in texts), "u1")
    length = np.array([len(t) for t in texts], "i8")
    many = -(-length // CORE)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = np.repeat(np.cumsum(length + STEPS) - length - STEPS, many) + nth * CORE
    size = np.minimum(CORE, np.repeat(length, many) - nth * CORE)
    x = np.lib.stride_tricks.sliding_window_view(data, STEPS)[begin] if len(begin) else np.zeros((0, STEPS), "u1")
    return x, size, many


def probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean over all positions of each text, by (text, language); 0 for empty texts."""
    x, size, many = cut(texts)
    sums = np.zeros((len(x), len(net.bias)))
    for i in range(0, len(x), BATCH):
        both = net.run(np.ascontiguousarray(x[i : i + BATCH].T))[CONTEXT : CONTEXT + CORE]
        p = net.label(both)
        part = size[i : i + BATCH] < CORE
        if part.any():
            p[:, :, part] *= (np.arange(CORE)[:, None] < size[i : i + BATCH][part])[:, None, :]
        sums[i : i + BATCH] = p.sum(0).T
    total, filled = np.zeros((len(texts), len(net.bias))), many > 0
    if filled.any():
        total[filled] = np.add.reduceat(sums, (np.cumsum(many) - many)[filled], axis=0)
    return total / np.maximum(np.array([[len(t)] for t in texts]), 1)


def has_letter(text: bytes) -> bool:
    if _ALPHA[np.frombuffer(text, "u1")].any():
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, out: int, rows: int = ROWS) -> tuple[list[str], Network | None]:
    """The languages and the network, from rows outside fold `out` of crc32(id) modulo folds."""
    able = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(F.col(id_col), folds) != out)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    counts = {r[0]: r[1] for r in able.groupBy("_lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], None
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, rows / len(langs) / n))])
    draw = F.pmod(F.xxhash64("_id", "_text", F.lit(1)), F.lit(1 << 30))
    n = F.length("_text")
    stretch = F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda k: F.substring("_text", F.floor(k * (n - CORE) / (SPREAD - 1)).cast("int") + 1, F.lit(CORE)))
    parts = F.when(n <= SPREAD * CORE, F.array("_text")).otherwise(stretch)
    chosen = able.where(draw < F.element_at(share, F.col("_lang")) * (1 << 30)).select("_lang", parts.alias("_parts"), draw.alias("_draw"))
    got = chosen.orderBy("_draw", "_lang", F.col("_parts")[0]).limit(2 * rows).collect()
    texts = [(r._lang, t.encode()) for r in got for t in r._parts]
    x, size, many = cut([t for _, t in texts])
    y = np.repeat([langs.index(k) for k, _ in texts], many)
    return langs, train(x, size, y, len(langs)) if len(langs) > 1 and len(x) else Network(len(langs))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, out: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, keep, held_out, lang_pred, score for each row."""
    bounded_batches(docs.sparkSession)
    langs, net = learn(docs, id_col, text_col, lang_col, folds, out)
    shared, key = docs.sparkSession.sparkContext.broadcast(net), token()  # a few thousand numbers

    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in pc.fill_null(batch.column("_in").cast(pa.large_binary()), b"")]
            for i in range(0, len(texts), 512):  # bounds what is held for windows
                some = texts[i : i + 512]
                known = [bool(langs) and has_letter(t) for t in some]
                p = probabilities(built(key, lambda: shared.value), [t if k else b"" for t, k in zip(some, known, strict=True)]) if langs else np.zeros((len(some), 1))
                best = p.argmax(1)
                names = [langs[b] if k else UND for b, k in zip(best, known, strict=True)]
                score = np.where(known, p.max(1), 0.0)
                part = batch.slice(i, 512)
                cols = [*back, "held_out"]
                yield pa.RecordBatch.from_arrays([*(part.column("_in" if c == text_col else c) for c in cols), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*cols, "lang_pred", "score"])

    back = [id_col, *(c for c in keep if c != id_col)]  # a text that is kept goes to Python once
    base = docs.select(*[c for c in back if c != text_col], (fold(F.col(id_col), folds) == out).alias("held_out"), F.col(text_col).cast("string").alias("_in"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in back)
    return base.mapInArrow(run, f"{kinds}, held_out boolean, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(read_spread(spark, f"{sf_dir}/documents.parquet"))
