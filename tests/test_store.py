"""The durable corpus: segments, versions, two writers, merging; and the word segmenter."""

import collections
import itertools
import json
import math
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import segmenter as G
from tidewater.functions import text as T
from tidewater.operators import search, store
from tidewater.plans import store_queries

KINDS = "path string, rel string, source string, mtime double, text string"
BODY = "words that are long enough to be worth indexing in this corpus"


def files(spark, texts: dict, mtime=1.0):
    return spark.createDataFrame([(f"/r/{p}", p, "s", mtime, t) for p, t in texts.items()], KINDS)


def embed(rows):
    return rows.select("id", F.array(F.length("text").cast("double")).alias("embedding"))


def whole(rows):
    """A file is one chunk."""
    return rows.select(F.xxhash64("path").alias("id"), "path", "source", F.lit("").alias("heading"), "text", F.lit(0).cast("bigint").alias("start"))


QUERIES = [(0, "alpha words"), (1, "beta"), (2, "gamma corpus delta"), (3, "nothing of it")]


def hits(spark, index):
    asked = spark.createDataFrame(QUERIES, "query_id bigint, query string")
    return sorted(tuple(r) for r in search.bm25(index, asked).select("query_id", "id", "score").collect())


def same_as_rebuilt(spark, snap):
    """Search over segments is search over an index built anew; figures and frequencies are equal."""
    chunks = snap.chunks()
    anew = search.build_index(chunks, "id", tokens=T.tokenizer(snap.tokenizer))
    assert hits(spark, snap.index()) == hits(spark, anew)
    table = lambda df: sorted(tuple(r) for r in df.collect())
    assert table(snap.index().terms.select("term", "df")) == table(anew.terms.select("term", "df"))
    assert snap.n == chunks.count()
    return hits(spark, anew)


@pytest.fixture
def at(tmp_path):
    return f"file://{tmp_path}/corpus"


def test_texts_and_postings_are_written_once(spark, at, tmp_path, monkeypatch):
    """A sync writes chunks and postings into its segment alone, and a search deals out only the postings of its terms."""
    monkeypatch.setattr("tidewater.sources.shared.shared_dir", lambda _: f"file://{tmp_path}/shared")
    s = store.Store.create(spark, at)
    s.sync(files(spark, {"a.md": f"alpha {BODY}", "b.md": f"beta {BODY}"}), "/r", chunk=whole)
    snap, _ = s.sync(files(spark, {"a.md": f"alpha {BODY} again", "b.md": f"beta {BODY}"}, 2.0), "/r", chunk=whole)
    assert not [p.name for p in (tmp_path / "shared").iterdir() if p.name.startswith(("chunks-", "postings-"))]
    plan = search.bm25(snap.index(), spark.createDataFrame(QUERIES, "query_id bigint, query string"))._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("RepartitionByExpression") < plan.find("LeftSemi")
    same_as_rebuilt(spark, snap)


def test_life_of_a_corpus(spark, at):
    s = store.Store.create(spark, at)
    texts = {f"{w}{i}.md": f"{w} {BODY} {i}" for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 5)} | {"short.md": "short", ".git/x.md": BODY}
    one, report = s.sync(files(spark, texts), "/r", embed, chunk=whole)
    assert {r.status: r.n for r in report.collect()} == {"added": 20, "skipped": 2, "embedded": 20} and one.version == 1 and one.vectors().count() == 20
    found = same_as_rebuilt(spark, one)
    # Nothing new: nothing is published.
    again, report = s.sync(files(spark, texts), "/r", embed, chunk=whole)
    assert again.version == 1 and {r.status: r.n for r in report.collect()} == {"unchanged": 20, "skipped": 2, "embedded": 0}
    # Four of twenty files change: rows are written for these alone.
    later = dict(texts)
    later["alpha0.md"] = f"beta beta {BODY}"
    later["new.md"] = f"alpha and gamma, {BODY}"
    del later["beta1.md"]
    mtimes = files(spark, later).withColumn("mtime", F.when(F.col("rel").isin("alpha0.md", "gamma2.md"), 2.0).otherwise(F.col("mtime")))
    two, report = s.sync(mtimes, "/r", embed, chunk=whole)
    assert {r.status: r.n for r in report.collect()} == {"added": 1, "updated": 1, "touched": 1, "removed": 1, "unchanged": 17, "skipped": 2, "embedded": 2}
    new = two.segments[-1]
    assert new.rows["chunks"] == 2 and new.rows["dead"] == 2 and new.rows["files"] == 4 and new.rows["vectors"] == 2 and new.rows["postings"] < 30
    assert same_as_rebuilt(spark, two) != found and two.vectors().count() == two.n == 20
    # The old version is still there, as it was; and a new session's object reads the same.
    assert hits(spark, s.open(1).index()) == found and hits(spark, store.Store(spark, at).open().index()) == hits(spark, two.index())
    three = s.delete(spark.createDataFrame([("/r/new.md",), ("/r/none.md",), (None,)], "path string"))
    assert three.n == 19 and "/r/new.md" not in {r.path for r in three.files().collect()}
    same_as_rebuilt(spark, three)
    # An added path after its removal, and a removed root.
    four, _ = s.sync(files(spark, later, 3.0), "/r", embed, chunk=whole)
    assert four.n == 20
    same_as_rebuilt(spark, four)
    merged = s.compact(fan=2, tier=4)
    assert len(merged.segments) < len(four.segments) and hits(spark, merged.index()) == hits(spark, four.index())
    assert merged.vectors().count() == 20 and sorted(r.path for r in merged.files().collect()) == sorted(r.path for r in four.files().collect())
    same_as_rebuilt(spark, merged)
    gone, _ = s.sync(files(spark, {}), "/r", embed, chunk=whole)
    assert gone.n == 0 and gone.tokens == 0 and hits(spark, gone.index()) == [] and gone.chunks().isEmpty()


def test_merges_keep_marks_for_older_segments(spark, at):
    """What later segments say of earlier ones outlives a merge that leaves the earlier ones out."""
    s = store.Store.create(spark, at)
    s.sync(files(spark, {f"a{i}.md": f"alpha {BODY} {i}" for i in range(12)}), "/r", chunk=whole)
    for i in range(4):
        base = s.open()
        texts = {r.path[3:]: r.text for r in base.chunks().collect()}
        texts[f"a{i}.md"] = f"beta {BODY} {i} again"
        texts.pop(f"a{11 - i}.md")
        s.sync(files(spark, texts, 2.0 + i), "/r", chunk=whole)
    before = s.open()
    due = before.segments[2:]
    merged = s.commit(before, "merge", s.merged(before, due), [x.name for x in due])
    assert len(merged.segments) == 3 and merged.segments[-1].rows["dead"] and hits(spark, merged.index()) == hits(spark, before.index()) == same_as_rebuilt(spark, merged)
    s.sync(files(spark, {"a0.md": f"gamma {BODY}"}, 9.0), "/r", chunk=whole)
    assert {r.path for r in s.open().chunks().collect()} == {"/r/a0.md"}


def test_two_writers(spark, at):
    s = store.Store.create(spark, at)
    base, _ = s.sync(files(spark, {"a.md": f"alpha {BODY}", "b.md": f"beta {BODY}"}), "/r", chunk=whole)
    gone = files(spark, {"a.md": None}).select("path", F.lit(None).cast("double").alias("mtime"), F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("string").alias("content_hash"), F.lit(True).alias("gone"))
    add = files(spark, {"c.md": f"gamma {BODY}"})
    known = store.manifest(add).withColumn("gone", F.lit(False))
    # Both begin from the same version and change other paths: neither is lost.
    s.change(base, known, whole(add), known.limit(0).select("path"), None)
    both, _ = s.change(base, gone, None, gone.select("path"), None)
    assert both.version == base.version + 2 and {r.path for r in both.chunks().collect()} == {"/r/b.md", "/r/c.md"}
    same_as_rebuilt(spark, both)
    # The same path: the later one must begin again.
    with pytest.raises(store.Conflict):
        s.change(base, gone, None, gone.select("path"), None)
    # A merge and a write from one version, in either order.
    latest = s.open()
    s.commit(latest, "merge", s.merged(latest, latest.segments), [x.name for x in latest.segments])
    d = files(spark, {"d.md": f"delta {BODY}"})
    after, _ = s.change(latest, store.manifest(d).withColumn("gone", F.lit(False)), whole(d), d.limit(0).select("path"), None)
    assert len(after.segments) == 2 and {r.path for r in after.chunks().collect()} == {"/r/b.md", "/r/c.md", "/r/d.md"}
    same_as_rebuilt(spark, after)
    with pytest.raises(store.Conflict):
        s.commit(latest, "merge", s.merged(latest, latest.segments), [x.name for x in latest.segments])


def test_sync_begins_again_after_a_conflict(spark, at):
    s = store.Store.create(spark, at)
    s.sync(files(spark, {"a.md": f"alpha {BODY}"}), "/r", chunk=whole)
    calls = []

    def meanwhile(rows):
        if not calls:
            calls.append(1)
            store.Store(spark, at).sync(files(spark, {"a.md": f"beta {BODY}"}, 2.0), "/r", chunk=whole)
        return embed(rows)

    new, _ = s.sync(files(spark, {"a.md": f"gamma {BODY}"}, 3.0), "/r", meanwhile, chunk=whole)
    assert new.version == 3 and [r.text for r in new.chunks().collect()] == [f"gamma {BODY}"]
    same_as_rebuilt(spark, new)


def test_a_failed_write_leaves_the_old_version(spark, at):
    s = store.Store.create(spark, at)
    s.sync(files(spark, {"a.md": f"alpha {BODY}"}), "/r", chunk=whole)

    def fails(rows):
        raise RuntimeError("no embedder")

    with pytest.raises(RuntimeError):
        s.sync(files(spark, {"b.md": f"beta {BODY}"}), "/r", fails, chunk=whole)
    assert s.latest() == 1 and {r.path for r in s.open().chunks().collect()} == {"/r/a.md"}
    left = s.write({"files": store.manifest(files(spark, {"x.md": BODY}))})  # a segment that no version names
    assert s.vacuum(older_s=3600) == 0 and s.vacuum(keep=1, older_s=0) == 1 and s.open().n == 1
    assert left.name not in {x.name for x in s.open().segments} and store.Store.create(spark, at).latest() == 1


def test_a_version_is_published_once(spark, at):
    assert store.publish(spark, f"{at}/log/1.json", "{}") and not store.publish(spark, f"{at}/log/1.json", json.dumps({"a": 1}))
    with pytest.raises(ValueError):
        store.Store(spark, f"{at}-none").open()
    with pytest.raises(ValueError):
        store.Store.create(spark, at + "2").sync(files(spark, {"a.md": BODY}).union(files(spark, {"a.md": BODY})), "/r")


@given(st.lists(st.integers(0, 40), max_size=60))
@settings(max_examples=80, deadline=None)
def test_tiers(sizes):
    """Merging as each segment comes keeps few segments, and the total work is a few times the rows."""
    weights, work = [], 0
    for n in sizes:
        weights.append(n)
        while due := store.to_merge(weights, 4, 8):
            assert due.stop - due.start >= 4
            work += sum(weights[due])
            weights[due] = [sum(weights[due])]
    total = sum(sizes)
    assert sum(weights) == total and len(weights) <= 4 * (2 + math.log(max(total, 1), 4)) + 3
    assert work <= total * (3 + math.log(max(total, 1), 4))


def test_another_tokenizer_and_embedder(spark, at):
    s = store.Store.create(spark, at, embedder="m@1")
    s.sync(files(spark, {"a.md": f"今天天气很好 {BODY}", "b.md": f"天气不好 {BODY}"}), "/r", embed, chunk=whole)
    tokens = G.segmenter({"今天": 4.0, "天气": 5.0, "很": 2.0, "好": 3.0, "不好": 2.0})
    new = s.healed(tokens.name)
    assert new.tokenizer == tokens.name and s.healed(tokens.name).version == new.version == s.healed().version
    same_as_rebuilt(spark, new)
    asked = spark.createDataFrame([(0, "天气"), (1, "好"), (2, "今天好")], "query_id bigint, query string")
    got = {(r.query_id, r.path) for r in search.bm25(new.index(), asked).join(new.chunks().select("id", "path"), "id").collect()}
    assert got == {(0, "/r/a.md"), (0, "/r/b.md"), (1, "/r/a.md"), (2, "/r/a.md")}
    after, _ = s.sync(files(spark, {"a.md": f"很好 {BODY}"}, 2.0), "/r", embed, chunk=whole)
    same_as_rebuilt(spark, after)
    assert s.embedded_by(embed, "m@1").version == after.version
    other = s.embedded_by(lambda rows: rows.select("id", F.array(F.lit(7.0)).alias("embedding")), "m@2")
    assert other.embedder == "m@2" and [r.embedding for r in other.vectors().collect()] == [[7.0]] and s.embedded_by(embed, "m@2").version == other.version
    with pytest.raises(ValueError):
        s.healed("no such tokenizer")


# --- segmenter


def brute_path(words: dict, run: str) -> float:
    """The least cost over all ways to cut a run."""
    lattice = G.Lattice(words)
    costs = []
    for cuts in itertools.product([False, True], repeat=len(run) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        parts = [run[a:b] for a, b in zip(at, at[1:], strict=False)]
        if all(p in lattice.cost or len(p) == 1 for p in parts):
            costs.append(sum(min(lattice.cost.get(p, math.inf), lattice.unknown if len(p) == 1 else math.inf) for p in parts))
    return min(costs)


@given(st.dictionaries(st.text(alphabet="天地人气今", min_size=1, max_size=4), st.integers(1, 50).map(float), max_size=8), st.text(alphabet="天地人气今好", min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_best_path_of_the_lattice(words, run):
    lattice = G.Lattice(words)
    path = lattice.path(run)
    assert "".join(path) == run
    assert sum(min(lattice.cost.get(p, math.inf), lattice.unknown if len(p) == 1 else math.inf) for p in path) == pytest.approx(brute_path(words, run))


def plain_path(lattice, run: str) -> list[str]:
    """The cheapest words of a run, a character after the other."""
    best, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
    cost = lattice.cost
    for end in range(1, len(run) + 1):
        for size in range(end, 0, -1):
            new = best[end - size] + cost.get(run[end - size : end], math.inf)
            if new < best[end] - 1e-12:
                best[end], back[end] = new, size
        if best[end - 1] + lattice.unknown < best[end] - 1e-12:
            best[end], back[end] = best[end - 1] + lattice.unknown, 1
    out, end = [], len(run)
    while end:
        out.append(run[end - back[end] : end])
        end -= back[end]
    return out[::-1]


@given(st.dictionaries(st.text(alphabet="天地人气今", min_size=1, max_size=5), st.integers(1, 9).map(float), max_size=12), st.lists(st.text(alphabet="天地人气今好", max_size=12), max_size=60), st.sampled_from([1, 3, 17, 1 << 19]), st.sampled_from([0, 1, 32]))
@settings(max_examples=200, deadline=None)
def test_many_runs_are_cut_as_each_alone(words, runs, block, few):
    """Whatever the size of blocks and however many stretches go side by side."""
    lattice = G.Lattice(words)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(G, "BLOCK", block)
        m.setattr(G, "FEW", few)
        assert lattice.paths(runs) == [plain_path(lattice, r) for r in runs]
        mixed = ["x1 " + " Ab".join(runs), None, *runs, ""]
        assert lattice.arrays(mixed).to_pylist() == [[w for r in G.RUNS.findall((t or "").lower()) for w in (plain_path(lattice, r) if G.HAN.match(r) else [r])] for t in mixed]


def test_words_are_followed_by_the_block():
    """A million characters take few calls, not some for each character or run."""
    draw = random.Random(3)
    words = ["".join(draw.choices("天地人气今明大小上下", k=draw.randint(2, 7))) for _ in range(3000)]
    lattice, runs = G.Lattice(dict.fromkeys(words, 2.0)), ["".join(draw.choices(words, k=40)) for _ in range(5000)]
    calls = 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        lattice.cut(runs)
    finally:
        sys.setprofile(None)
    assert calls < sum(map(len, runs)) / 8


def test_segment_words_moves_no_words(spark, tmp_path, monkeypatch):
    """Words are counted within a document's row: only the vocabulary is grouped, and no words are sorted, joined or written."""
    texts = ["Alpha beta, alpha gamma", "beta-gamma alphabeta 7", None, "", "...", "gammagamma beta", "Straße\u212aelvin \u0130x", "7", "a", "b"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plans = []
    for where in (store_queries, G):
        monkeypatch.setattr(where, "stored", lambda df, tag, kept=where.stored: plans.append(df._jdf.queryExecution().toString()) or kept(df, tag))
    got = store_queries.segment_words(spark, str(tmp_path))
    plans.append(got._jdf.queryExecution().toString())
    assert not [x for plan in plans for x in ("Window", "Join") if x in plan]
    listed = [re.findall("[a-z]+", (t or "").lower()) for t in texts]
    seen = collections.Counter(w for some in listed for w in some)
    lattice = G.Lattice({w: float(n) for w, n in seen.items() if n > 1})
    spans = lambda words: set(zip(itertools.accumulate(map(len, words)), words, strict=False))
    want = [(k, len(some), len(found := plain_path(lattice, "".join(some))), len(spans(some) & spans(found))) for k, some in enumerate(listed)]
    assert sorted(map(tuple, got.collect())) == want and {r[3] for r in want} > {0, 3}
    assert G.parts(np.array([3, 0, 9, 1, 1]), 4) == [(0, 3), (3, 5)] and G.parts(np.array([], int), 4) == [(0, 0)]
    some = pa.array(["ab c", "d", None, "", "éf", "g-h"])
    for part, runs, n in ((some, "ab c d f g h".split(), [2, 1, 0, 0, 1, 2]), (some[1:5], ["d", "f"], [1, 0, 0, 1]), (some[2:4], [], [0, 0]), (some[:0], [], [])):
        letters, sizes, counts = store_queries.letter_runs(part)
        assert (letters.tobytes().decode(), sizes.tolist(), counts.tolist()) == ("".join(runs), [len(r) for r in runs], n)


def test_large_dictionary(spark):
    """More words than a million make a dictionary, and one that is small in memory."""
    han = [chr(0x4E00 + i) for i in range(110)]
    words = spark.range(1_200_000).select(F.concat(*[F.element_at(F.lit(han), (F.floor(F.col("id") / 110**k) % 110 + 1).cast("int")) for k in range(4)]).alias("word"), F.lit(2).alias("n"))
    got = G.words_of(words)
    assert len(got) == 1_200_000
    lattice = G.Lattice(got)
    held = lattice.bits.nbytes + sum(x.nbytes for t in lattice.tables.values() for x in t)
    assert held < 60 * len(got)
    some = [w for n, w in enumerate(got) if n % 100_000 == 7]
    assert lattice.paths(some) == [[w] for w in some] and lattice.path("".join(some[:1]) + "龘" + some[1]) == [some[0], "龘", some[1]]


def test_segmenter_columns(spark):
    tokens = G.segmenter(spark.createDataFrame([("天气", 3), ("天气", 2), ("今天", 4), ("", 9), (None, 1)], "word string, n bigint"))
    rows = spark.createDataFrame([("今天天气 Fine_day 2x",), ("",), (None,), ("气今",)], "text string")
    assert [r.t for r in rows.select(tokens.tokens(F.col("text")).alias("t")).collect()] == [["今天", "天气", "fine", "day", "2x"], [], [], ["气", "今"]]
    assert tokens.name == G.segmenter({"天气": 5.0, "今天": 4.0}).name != G.segmenter({"天气": 5.0}).name and T.tokenizer(tokens.name) is not None
    assert rows.select(T.segment(F.col("text"), tokens).alias("s")).first().s == "今天 天气 fine day 2x"
    with pytest.raises(ValueError):
        T.tokenizer("none")


def test_weights_from_the_corpus(spark):
    """Words of known shares, written without spaces: weights come near the shares, and paths near the words."""
    draw = random.Random(5)
    words = {"天": 1, "天气": 6, "气": 1, "今天": 5, "好": 3, "天天": 2, "很": 2, "气今": 1}
    texts = [[draw.choices(list(words), list(words.values()))[0] for _ in range(12)] for _ in range(200)]
    df = spark.createDataFrame([("".join(t),) for t in texts] + [(None,), ("",)], "text string")
    weights = G.weighed(df, spark.createDataFrame([(w,) for w in words] + [("无",)], "word string"))
    got = {r.word: r.n for r in weights.collect()}
    assert got["无"] == 0.5 and got["天气"] > got["天天"] and set(got) == {*words, "无"}
    lattice = G.Lattice(got)
    right = sum(len(cut(lattice.path("".join(t))) & cut(t)) for t in texts)
    assert right / sum(len(cut(t)) for t in texts) > 0.9


def cut(parts: list[str]) -> set[int]:
    return set(itertools.accumulate(map(len, parts)))
