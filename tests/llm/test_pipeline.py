"""Each stage of the pipeline against brute force on its own input, and odd rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_exact import brute_components, queue_by_hand
from tidewater.llm import decontamination as D
from tidewater.llm.language_id import identify

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs.toPandas(), spark.read.parquet(path).toPandas()))
        docs = spark.read.parquet(path)
    return dict(zip([n for n, _ in P.STAGES], out, strict=True))


def test_language(stages):
    before, after = stages["language"]
    assert list(after.columns) == list(P.COLUMNS)
    clean = {r.doc_id for r in before.itertuples() if sum(c.isalpha() for c in r.text or "") > 20}
    assert clean <= set(after.doc_id) <= {r.doc_id for r in before.itertuples() if any(c.isalpha() for c in r.text or "")}


def test_language_rejects_by_score(spark, monkeypatch):
    """What is kept are the documents with a language at SURE or more, whatever SURE is."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs).collect()}
    for sure in (P.SURE, 0.97):
        monkeypatch.setattr(P, "SURE", sure)
        got = {r.doc_id: r.lang for r in P.language(spark, docs, SF).collect()}
        assert got == {i: lang for i, (lang, score) in scores.items() if lang != "und" and score >= sure}
    assert len(got) < len(scores)


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    want, _ = brute_components(dict(zip(before.doc_id, before.text, strict=True)), size=5)
    assert sorted(after.doc_id) == sorted(set(want.values())) and list(after.columns) == list(P.COLUMNS)


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    keys = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = [x.decode("latin-1") for x in D.words(r.text.encode())]
        n = min(13, len(w))
        keys.setdefault(n, set()).update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1) if n)
    keep = []
    for r in before.itertuples():
        w = [x.decode("latin-1") for x in D.words((r.text or "").encode())]
        hit = {k for n, ks in keys.items() for i in range(len(w) - n + 1) if " ".join(w[i : i + n]) in ks for k in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            keep.append(r.doc_id)
    assert sorted(after.doc_id) == sorted(keep)


def test_mixing(stages):
    """Copies are those of which the queue, worked by hand, takes half at least; so each source is near its target."""
    before, after = stages["mixing"]
    size = {r.doc_id: len((r.text or "").split()) for r in before.itertuples()}
    taken, target = queue_by_hand([(r.doc_id, size[r.doc_id], r.source) for r in before.itertuples()])
    copies = Counter(after.doc_id)
    assert max(copies.values()) <= 2 and list(after.columns) == list(P.COLUMNS)
    assert dict(copies) == {i: n for i in size if (n := sum(2 * t >= size[i] and t > 0 for t in (min(taken[i], size[i]), taken[i] - size[i])))}
    got = Counter()
    for r in before.itertuples():
        got[r.source] += copies[r.doc_id] * size[r.doc_id]
    longest = {s: max(size[r.doc_id] for r in before.itertuples() if r.source == s) for s in got}
    assert all(abs(got[s] - target[s]) <= longest[s] for s in got)


def test_sharding(stages):
    before, after = stages["sharding"]
    assert Counter(after.doc_id) == Counter(before.doc_id)
    assert all(sorted(g) == list(range(len(g))) for _, g in after.groupby("shard").slot)


def test_odd_rows(spark):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(1, "same words here now", "en", "a", 1), (1, "same words here now", "en", "a", 1), (2, None, None, None, None), (None, "a row without id", "en", None, 2), (3, "other words stay here", "de", "b", 3)], kinds)
    near = P.near_duplicates(spark, docs, SF)
    assert sorted(str(r.doc_id) for r in near.collect()) == ["1", "2", "3", "None"]
    mixed = P.mixing(spark, docs, SF)
    assert set(mixed.columns) == set(P.COLUMNS) and mixed.where(F.col("text").isNull()).count() == 0
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
