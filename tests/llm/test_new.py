"""Importance resampling, hard negatives and sentence pieces, against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import hard_negatives as H
from tidewater.llm import resampling as R
from tidewater.llm import sentence_pieces as S

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    (1, None, "a"), (2, "", None), (3, "  \n\t", "b"), (4, "one", "c"), (5, "one", "c"), (5, "one", "c"), (None, "no id here " * 9, "d"), (None, "no id here " * 9, "d"), (None, "other text " * 30, "d"),
    (7, "Ünïcödé wörds — 漢字 ▁a " * 6, "e"), (8, "Long " * 30_000, "f"), (9, "x" * 100_000, "g"), (10, "a\x00b <s> </s> <0x0A> 𒀀", "h"),
]
KINDS = "doc_id bigint, text string, score string"


# --- resampling


def features(text: str | None, runs: int = 2) -> tuple[int, list[str]]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs: list[tuple], target: list[str | None], buckets=10_000, least=20, share=25) -> list[tuple]:
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    split = [features(t) for _, t in docs]
    s, t = (Counter(bucket(f) for fs in x for f in fs) for x in ([fs for _, fs in split], [features(x)[1] for x in target]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (t_all * 0 + s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for (i, _), (n, fs) in zip(docs, split, strict=True):
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = enough[: share * len(enough) // 100]
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in enough[len(drawn) :] + [r for r in rows if r[1] < least]], key=str)


def given_back(df):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=str)


def test_resampling_matches_brute_force(spark):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert given_back(R.resample(docs, target)) == want and sum(r[5] is not None for r in want) > 20


def test_resampling_odd_rows(spark):
    target = spark.createDataFrame([("one",), (None,), ("Here, id!",)], "text string")
    got = given_back(R.resample(spark.createDataFrame(ODD, KINDS), target, least=1, share=50))
    assert got == brute_resample([r[:2] for r in ODD], ["one", None, "Here, id!"], least=1, share=50)
    none = spark.createDataFrame([], KINDS)
    assert R.resample(none, target).count() == 0
    bare = R.resample(spark.createDataFrame(ODD, KINDS), none).collect()
    assert len(bare) == len(ODD) and {r.weight for r in bare if not r.n_features} == {0}


def test_resampling_hot_null_ids(spark):
    """A third of all rows have no id and one text: ranks have no gap and no one is lost."""
    rows = [(None, "w " * 25)] * 300 + [(i, f"w{i % 7} " * 30) for i in range(600)]
    got = R.resample(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("w1 w2",)], "text string")).collect()
    assert len(got) == 900 and sorted(r.rank for r in got if r.rank) == list(range(1, 226))


@given(st.text(alphabet="aB1é ,-", max_size=60), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_ring_hashes_all_runs(text, runs):
    n, found = R.hashes(text.encode(), runs)
    want_n, want = features(text, runs)
    assert n == want_n and Counter(found) == Counter(zlib.crc32(f.encode()) for f in want)


# --- hard negatives


def brute_negatives(rows, every=50, k=5, n=3):
    rows = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda x: max(-(1 << 63) + 1, min((1 << 63) - 1, x))
    dot = lambda a, b: clip(sum(x * y for x, y in zip(a, b, strict=False)))
    out = []
    for a, lab, v in (r for r in rows if r[0] % every == 0):
        scored = sorted((-dot(v, w), i, other) for i, other, w in rows)
        for p, pid in [(-s, i) for s, i, other in scored if other == lab and i != a][:k]:
            hard = [(i, -s) for s, i, other in scored if other != lab and 50 * p <= -100 * s <= 95 * p][:n]
            out += [(a, pid, r + 1, i, p, s) for r, (i, s) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, every=50):
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "vec_id bigint, embedding array<double>, label int, score string, _id double")
    out = H.hard_negatives(df, F.col("vec_id") % every == 0, F.col("label"))
    return sorted(tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, labels, width=6):
    draw = random.Random(seed)
    return [(i, [draw.choice([0.0, 0.25, 0.5, 1.0, -0.25]) for _ in range(width)], draw.choice(labels)) for i in range(n)]


def test_hard_negatives_match_brute_force(spark):
    rows = vectors(1, 400, [0, 0, 0, 1, 2])
    want = brute_negatives(rows, 10)
    assert mined(spark, rows, 10) == want and len(want) > 200


def test_hard_negatives_in_many_cells(spark, monkeypatch):
    """Anchors in groups, rows in cells and scores in pieces give what one cell gives: ties are everywhere."""
    monkeypatch.setattr(H, "GROUP", 1)
    monkeypatch.setattr(H, "PAIRS", 64)
    rows = vectors(2, 700, [0, 0, 0, 1, 2], 3)
    assert mined(spark, rows, 2) == brute_negatives(rows, 2)


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(3, 60, [0, 1], 4) + [
        (None, [1.0] * 4, 0), (100, None, 0), (101, [1.0, None, 0.0, 0.0], 0), (102, [nan] * 4, 1), (103, [inf, 0.0, 0.0, 0.0], 1), (104, [1.0] * 4, None), (105, [], 0), (110, [1.0], 1),
        (7, [0.5] * 4, 0), (7, [0.5] * 4, 0), (20, [1.0, 0.5, 0.25, 0.0], 1), (-10, [0.5] * 4, 1),
    ]
    assert mined(spark, rows, 10) == brute_negatives(rows, 10)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 0)]) == [] and mined(spark, [(50, [], 0), (51, [], 1)]) == []


def test_hard_negatives_of_any_size(spark):
    """Products beyond the whole numbers of a double, and scores beyond 64 bits."""
    rows = [(i, [x * 1e6 + i / 256 for x in v], lab) for i, v, lab in vectors(4, 80, [0, 1], 4)]
    assert mined(spark, rows, 10) == brute_negatives(rows, 10)
    rows = [(i, [x * 1e9 + i for x in v], lab) for i, v, lab in vectors(5, 60, [0, 1], 4)]
    assert mined(spark, rows, 20) == brute_negatives(rows, 20)


# --- sentence pieces


@pytest.fixture(scope="module")
def model():
    return S.load(PATH)


@pytest.fixture(scope="module")
def codec(model):
    return S.Codec(model)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_pieces_of_documents(spark, model, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    coded = S.encode(docs, model)
    assert {r.doc_id: r.ids for r in coded.collect()} == {i: library.encode(t) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in S.decode(coded, model).collect()} == {i: library.decode(library.encode(t)) for i, t in texts.items()}


def test_pieces_of_odd_rows(spark, model, library):
    docs = spark.createDataFrame(ODD, KINDS)
    coded = S.encode(docs, model)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in coded.collect()) == sorted((str(i), tuple(library.encode(t or ""))) for i, t, _ in ODD)
    back = S.decode(coded, model).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), library.decode(library.encode(t or ""))) for i, t, _ in ODD)
    assert S.encode(spark.createDataFrame([], KINDS), model).count() == 0
    assert S.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), model).first().text == ""


def test_op13_digests(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t in texts.items() for ids in [library.encode(t)]}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in S.op13_sentence_pieces(spark, SF).collect()} == want


PIECES = st.one_of(st.text(max_size=12), st.text(alphabet=" ▁ab\n\t.<s>é漢0", max_size=40), st.integers(1, 60).map(lambda n: " " * n))


@given(st.lists(PIECES, max_size=6).map("".join))
@settings(max_examples=300, deadline=None)
def test_encoding_is_the_librarys(codec, library, text):
    assert codec.encode(text) == library.encode(text) and codec.decode(codec.encode(text)) == library.decode(library.encode(text))


def test_joined_pieces_of_the_vocabulary(codec, library):
    draw = random.Random(4)
    for _ in range(4000):
        text = "".join(draw.choice(codec.text[259:]).replace(S.MARK, " ") for _ in range(draw.randrange(1, 8)))
        assert codec.encode(text) == library.encode(text)


@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 262), st.just(28705)), max_size=12))
@settings(max_examples=300, deadline=None)
def test_decoding_is_the_librarys(codec, library, ids):
    assert codec.decode(ids) == library.decode(ids)


def test_held_strings_are_bounded(model, monkeypatch, library):
    monkeypatch.setattr(S, "HELD", 8)
    codec = S.Codec(model)
    for i in range(200):
        text = f"word{i % 37} thing{i} \0 {'x' * 70}"
        assert codec.encode(text) == library.encode(text)
    assert len(codec.held) <= 8 + 4 and len(codec.older) <= 8 + 4 and not any(len(s) > S.SHORT for s in codec.held)


def test_other_models_are_refused(tmp_path):
    data = open(PATH, "rb").read()
    assert data.count(b"\x18\x02") and len(list(S.fields(data))) > 32_000
    with pytest.raises(ValueError):
        S.Model(data + bytes([0x0A, 5, 0x0A, 1, 0x61, 0x18, 4]))  # one more piece, user-defined
    with pytest.raises(ValueError):
        S.Model(data + bytes([0x1A, 2, 0x20, 1]))  # extra white space removed
    with pytest.raises(ValueError):
        S.Model(data + bytes([0x0A, 7, 0x0A, 5]) + "𒀀a".encode())  # with a character that is no piece
