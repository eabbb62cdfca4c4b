"""Trained operators: held-out accuracy, gradients, and exact base figures."""

import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tidewater.llm import language_id as L
from tidewater.llm import lm_scoring as M
from tidewater.llm import quality, url_filter

SF = "/root/testdata/sf0.01"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_url_model_held_out():
    w, b = url_filter.model()
    p = lambda u: 1 / (1 + np.exp(-(w[s := url_filter.slots(*url_filter.split_url(u))].sum() / np.sqrt(len(s)) + b)))
    assert all(p(f"http://{pre}{h}.example.{t}/en/5") > 0.5 for pre in ("", "www.", "m.", "blog.") for h in ("casino-win", "free-bets", "cheap-pills", "adult-x", "spam-farm", "ads-track") for t in ("com", "net", "org"))
    assert all(p(f"http://{pre}{h}.example.{t}/de/812") < 0.5 for pre in ("", "www.", "m.", "blog.") for h in ("thther", "ththan", "tionsh", "garden", "science") for t in ("com", "net", "org"))


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_scores(docs(spark), labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean()
    assert auc > 0.97 and (got.predicted == got.quality).mean() > 0.93
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_bradley_terry_recovers_order():
    draw = np.random.default_rng(0)
    x = draw.standard_normal((2000, 3))
    y = x @ [2.0, -1.0, 0.0] + draw.logistic(size=2000) > 0
    w = quality.bradley_terry(x, y)
    assert w[0] > 1 and w[1] < -0.4 and abs(w[2]) < 0.3


def test_language_gradients():
    net, draw = L.Network(3), np.random.default_rng(1)
    x, y = draw.integers(0, 256, (9, 5)).astype("u1"), draw.integers(0, 3, 5)
    valid = (np.arange(9)[:, None] < np.array([9, 9, 4, 7, 1])).astype("f4")
    _, grads = net.gradients(x, valid, y)
    for p, g in zip(net.params(), grads, strict=True):
        for at in np.argwhere(np.abs(g) > np.abs(g).max() / 3)[:4]:
            at, e = tuple(at), 1e-2
            old = p[at]
            p[at] = old + e
            up = net.gradients(x, valid, y)[0]
            p[at] = old - e
            down = net.gradients(x, valid, y)[0]
            p[at] = old
            assert (up - down) / (2 * e) == pytest.approx(g[at], rel=0.1, abs=2e-4)


def test_language_held_out(spark):
    got = L.identify(docs(spark), keep=("lang", "n_chars")).where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97  # some texts hold lines of another language
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id)


def test_language_whole_texts():
    """A document's probabilities depend on its end as on its beginning, and not on what else is in the batch."""
    net = L.Network(2, seed=1)
    a, b = L.probabilities(net, [b"abc" * 100, b"x"]), L.probabilities(net, [b"zz" * 500, b"abc" * 100, b"", b"abc" * 99 + b"XYZ"])
    assert a[0] == pytest.approx(b[1]) and (b[2] == 0).all() and not np.allclose(b[1], b[3])


def test_lm_base_is_exact(spark):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(low)), "\0"] for r in docs(spark).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c = Counter(w for i, t in toks.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    rows = M.lm_scores(docs(spark)).collect()
    for r in rows:
        t = toks[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(0 < r.bits_per_byte < 8.5 for r in rows)


def tree_of(text: bytes, depth: int):
    levels = []
    for d in range(depth + 1):
        c = Counter()
        for i in range(len(text)):
            code = text[i]
            for k in range(1, d + 1):
                code |= (text[i - k] if i >= k else 10) << (8 * k)
            c[code] += 1
        keys = np.array(sorted(c), "i8")
        levels.append((keys, np.array([c[k] for k in keys.tolist()], "i8")))
    return M.Tree(levels)


def test_context_tree_weights_match_brute_force():
    """Block probabilities, computed by the recursion on counts of one bit's contexts, give the tree's weights."""
    text = b"abacabadabacaba" * 4
    tree = tree_of(text, 2)

    def kt(n0, n1):
        p = 1.0
        for _ in range(n0):
            p *= (sum(1 for _ in range(_)) + 0.5) / (_ + 1)
        for k in range(n1):
            p *= (k + 0.5) / (n0 + k + 1)
        return p

    def counts(context: bytes):
        n = [0, 0]
        for i in range(len(text)):
            past = (b"\n\n" + text)[i : i + 2]
            if past.endswith(context):
                n[text[i] >> 7 & 1] += 1
        return n

    def whole(context: bytes):
        own = kt(*counts(context))
        if len(context) == 2:
            return own
        inner = np.prod([whole(bytes([b]) + context) for b in range(256) if sum(counts(bytes([b]) + context))])
        return (own + inner) / 2

    nodes, _, weight = tree.levels[0]
    at = int(np.flatnonzero(nodes == 1)[0])
    assert weight[at] == pytest.approx(kt(*counts(b"")) / 2 / whole(b""), rel=1e-4)


def test_probabilities_of_a_context_sum_to_one():
    tree = tree_of(b"the cat sat on the mat " * 5, 3)
    for past in product(b"t \n", repeat=3):
        base = sum(b << (8 * (k + 1)) for k, b in enumerate(reversed(past)))
        assert (10 ** tree.fresh(np.array([base | b for b in range(256)], "i8"))).sum() == pytest.approx(1, abs=1e-6)


def test_tree_holds_every_context(spark):
    """Scores are those of one tree of all grams of the training texts, contexts met once in over 262,144 bytes included."""
    rows = [(r.doc_id, r.text) for r in docs(spark).orderBy("doc_id").limit(700).collect()]
    got = {r.doc_id: r for r in M.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    code, _ = M.grams([t.encode() for i, t in rows if not got[i].held_out])
    assert len(code) > 1 << 18
    levels = [np.unique(code & ((1 << (8 * (d + 1))) - 1), return_counts=True) for d in range(M.DEPTH + 1)]
    tree = M.Tree(levels)
    for i, t in rows:
        assert got[i].score == pytest.approx(tree.fresh(M.grams([t.encode()])[0]).sum(), rel=1e-5)


def test_six_bytes_of_context(spark):
    """The end of each word is settled by its first letter, six bytes before."""
    draw = np.random.default_rng(0)
    rows = [(i, " ".join("abbbbbx" if x else "cbbbbby" for x in draw.integers(0, 2, 400))) for i in range(40)]
    got = M.lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()
    assert got and all(r.bits_per_byte < 0.18 for r in got)
