"""Operators with exact results, against brute force or SQL."""

import collections
import hashlib
import math
import random
import re
import textwrap
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import decontamination as D
from tidewater.llm import exact_dedup, license_scan, lm_scoring, mixing, near_dedup, queries, sharding, url_filter
from tidewater.llm.hashing import Coded, Vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(queries.SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert sorted(tuple(map(str, (r[c] for c in cols))) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())


def brute_components(texts: dict, share=80, size=2):
    sets = {i: near_dedup.shingles(t, size) for i, t in texts.items()}
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(texts)
    for a in range(len(ids)):
        for b in range(a):
            s, t = sets[ids[a]], sets[ids[b]]
            if s and t and 100 * len(s & t) >= share * len(s | t):
                x, y = root(ids[a]), root(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_dedup_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, sizes = brute_components({r.doc_id: r.text for r in docs.collect()})
    got = near_dedup.near_dedup(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_chains_and_large_buckets(spark, monkeypatch):
    """Near copies of near copies, whose ends aren't alike, in buckets over the limit of joined pairs."""
    draw = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for c in range(4):
        text = [f"c{c}{w}" for w in base]
        for i in range(40):
            texts[c * 1000 + i] = " ".join(text)
            text = list(text)
            text[draw.randrange(60)] = f"n{draw.random()}"
            text[draw.randrange(60)] = f"n{draw.random()}"
    texts |= {5000 + i: " ".join([f"c0{w}" for w in base[:50]] + [f"u{i}{j}" for j in range(10)]) for i in range(60)}
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    want, _ = brute_components(texts)
    got = near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def coded(texts):
    return Coded.of([t.encode() for t in texts], Vocabulary())[1]


@given(st.lists(st.text(alphabet="aB \n\té", max_size=30), max_size=8), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_shingle_counts(texts, size):
    got, many = near_dedup.shingle_sets(coded(texts), size)
    sets = [near_dedup.shingles(t, size) for t in texts]
    assert list(many) == [len(s) for s in sets] and len(got) == sum(many)
    at = [0, *many.cumsum().tolist()]
    hashes = [set(got[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    assert all((x == y) == (s == t) for x, s in zip(hashes, sets, strict=True) for y, t in zip(hashes, sets, strict=True))


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words collide under any odd base modulo 2 ** 64."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    texts = {1: f"{a} one two", 2: f"{b} one two", 3: f"{a} {b} {a} {b}", 4: f"{a} {a} {a} {a}", 5: f"{a} one  TWO"}
    want, sizes = brute_components(texts)
    got = near_dedup.near_dedup(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    assert {r.doc_id: r.n_shingles for r in got} == sizes
    lm = {r.doc_id: r for r in lm_scoring.lm_scores(spark.createDataFrame([(i, t) for i in range(1, 12) for t in [a]] + [(29, b)], "doc_id bigint, text string")).collect()}
    assert lm[29].held_out and lm[29].n_known == 1 and lm[1].n_known == 2  # the end alone


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, 90), (90, 95)]
    got = {r._v: r._label for r in near_dedup.components(spark.createDataFrame(edges, "_x bigint, _y bigint")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {90: 90, 95: 90, 100: 90}


def test_decontamination_spans(spark):
    docs = spark.createDataFrame([(1, "Intro: É one-two THREE four five six seven eight nine ten eleven twelve 13! end"), (2, "Yes, please"), (3, "one two three"), (4, " ".join(["filler"] * 100) + " yes please")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven twelve 13"), (8, "yes please"), (9, "one, two, three, four, five, six, seven, eight, nine, ten, eleven, twelve, 13, extra")], "item_id bigint, text string")
    got = {r.doc_id: r for r in D.decontaminate(docs, bench).collect()}
    assert got[1].n_hit == 13 and got[1].item_ids == ["7", "9"] and got[1].n_words == 16 and got[1].contaminated
    text = docs.where("doc_id = 1").first().text
    assert [text[s.start : s.end] for s in got[1].spans] == ["one-two THREE four five six seven eight nine ten eleven twelve 13"]
    assert got[2].contaminated and got[2].item_ids == ["8"] and not got[3].contaminated
    assert got[4].n_hit == 2 and not got[4].contaminated


def test_decontamination_builds_one_automaton(spark, monkeypatch):
    built = []
    monkeypatch.setattr(D, "Matcher", lambda items, size, of=D.Matcher: built.append(1) or of(items, size))
    items = [(str(i), D.words(f"item {i} has words that no other has {i * 7} and some more of them {i * 11} to the end".encode())) for i in range(300)]
    matcher = D.Matcher(items, 13)
    n, hit, ids = matcher.scan(b"before item 5 has words that no other has 35 and some more of them 55 to the end after")
    assert (n, list(hit), ids, built) == (20, list(range(1, 19)), {"5"}, [1])
    bench = spark.createDataFrame([(1, "x" * 100)], "item_id bigint, text string")
    monkeypatch.setattr(D, "MOST", 50)
    with pytest.raises(ValueError):
        D.decontaminate(bench.withColumnRenamed("item_id", "doc_id"), bench)


@pytest.mark.parametrize("share", [0.03, 0.05, 0.5])
def test_decontamination_share(spark, share):
    docs = spark.createDataFrame([(i, "yes please " + "w " * i) for i in range(120)], "doc_id bigint, text string")
    got = D.decontaminate(docs, spark.createDataFrame([(8, "yes please")], "item_id bigint, text string"), share=share).collect()
    assert all(r.contaminated == (200 >= round(share * 100) * r.n_words) for r in got)


def test_exact_dedup_hashes_only_survivors(spark):
    docs = spark.createDataFrame([(3, "a  b"), (1, "a\tb"), (2, "a b "), (4, "unique")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert (got[3].keep_id, got[3].group_size, got[3].kept) == (1, 2, False) and got[1].kept and got[2].group_size == 1
    assert got[4].full_hash is None and got[1].full_hash is not None
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mixing_near_targets_and_stable(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(["w"] * draw.randrange(1, 40)), "abcde"[min(4, int(draw.expovariate(1)))]) for i in range(600)] + [(900, None, "a"), (901, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs)
    per = got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"), F.max("source_size").alias("s")).collect()
    assert all(abs(r.t - r.g) <= max(2, r.g / 2000) and r.g <= 2 * r.s + 1e-9 for r in per)
    assert sum(r.g for r in per) == pytest.approx(1.5 * sum(r.s for r in per))
    order = got.where("taken > 0").orderBy("finish", "offset").collect()
    assert all(a.offset + a.taken == b.offset for a, b in zip(order, order[1:], strict=False))
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.copy, r.packet, r.taken) for r in again) == sorted((r.doc_id, r.copy, r.packet, r.taken) for r in got.collect())


def queue_by_hand(rows, weights=(3, 1, 2), pieces=4096):
    """taken of (id, words, source): packets of each source's queue in order of finish time, until the budget is spent."""
    names = sorted({r[2] for r in rows if r[2] is not None}) + [None] * any(r[2] is None for r in rows)
    total = {n: sum(r[1] for r in rows if r[2] == n) for n in names}
    target, free, left = {}, {n: weights[i % 3] for i, n in enumerate(names)}, 1.5 * sum(total.values())
    while free:
        level = left / sum(free.values())
        full = [n for n, w in free.items() if 2 * total[n] < level * w]
        for n in full or list(free):
            target[n] = 2 * total[n] if full else level * free[n]
            left -= target[n] if full else 0
            del free[n]
    packets = []
    for n in names:
        at, piece = 0, max(1, -(-target[n] // pieces))
        for copy in range(2):
            for h, i, size in sorted((int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16), i, z) for i, z, s in rows if s == n):
                sent = 0
                while sent < size:
                    words = min(piece, size - sent)
                    sent, at = sent + words, at + words
                    packets.append((at / target[n], h, i, copy, words))
    left, taken = math.floor(1.5 * sum(total.values()) + 0.5), collections.Counter()
    for _, _, i, _, words in sorted(packets):
        taken[i] += min(words, left)
        left -= min(words, left)
    return taken, target


@pytest.mark.parametrize("pieces", [7, 4096])
def test_mixing_is_the_queue_worked_by_hand(spark, monkeypatch, pieces):
    monkeypatch.setattr(mixing, "PIECES", pieces)
    draw = random.Random(6)
    rows = [(i, draw.choice([0, 1, 5, 40, 300]), draw.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(250)] + [(999, 3, "e")]
    want, target = queue_by_hand(rows, pieces=pieces)
    docs = spark.createDataFrame([(i, "w " * n, s) for i, n, s in rows], "doc_id bigint, text string, source string")
    got = mixing.mix(docs).groupBy("doc_id", "source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    assert {r.doc_id: r.t for r in got} == {i: want[i] for i, _, _ in rows}
    assert all(r.g == pytest.approx(target[r.source]) for r in got)


def test_mixing_order_is_in_the_plan(spark):
    """taken comes from running sums over ranges of finish times."""
    docs = spark.createDataFrame([(1, "a b", "s")], "doc_id bigint, text string, source string")
    plan = mixing.mix(docs).select("taken")._jdf.queryExecution().optimizedPlan().toString()
    assert "finish" in plan and "Window" in plan


def test_sharding_balanced_whole_groups(spark):
    draw = random.Random(2)
    rows = [(i, f"t{draw.randrange(3000)} " * draw.randrange(1, 60)) for i in range(4000)] + [(10_000 + i, "hot text " * 30) for i in range(2000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() / size.min() < 1.06
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    cool = got[got.doc_id < 10_000]
    assert cool.groupby("text_crc32").shard.nunique().max() == 1


def test_shards_are_ranges_of_the_key(spark):
    """Whole tables of sf0.001 and a hot text: sizes and checksums by hand, one shard a record, slots without gaps, equal texts
    together unless they are many, and shards that follow one another in the order of the key."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6 + i, "hot " * 400) for i in range(300)] + [(None, None), (None, "x")], docs.schema))
    text = {r.doc_id: r.text or "" for r in docs.where("doc_id is not null").collect()}
    got = sharding.shard_by_bytes(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and all((r.size, r.text_crc32) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode())) for r in rows if r.doc_id is not None)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(16))
    keyed = got.where("doc_id < 1000000").join(docs, "doc_id").select("shard", F.shiftrightunsigned(F.xxhash64("text"), 12).alias("k"), "text").collect()
    assert all(len({r.shard for r in keyed if r.text == t}) == 1 for t in {r.text for r in keyed})
    spans = {n: (min(r.k for r in keyed if r.shard == n), max(r.k for r in keyed if r.shard == n)) for n in {r.shard for r in keyed}}
    order = sorted(spans)
    overlaps = sum(spans[a][1] > spans[b][0] for a, b in zip(order, order[1:], strict=False))
    assert overlaps <= 4  # only ranges that were subdivided, by another hash
    again = sharding.shard_by_bytes(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_urls_by_hand(spark):
    """Every page of sf0.001: host, path, rule, and the score as a sum over the dense weights."""
    w, b = url_filter.model()
    for r in spark.read.parquet(f"{SF}/pages.parquet").join(url_filter.op1_url_filter(spark, SF), "page_id").collect():
        tail = r.url.split("://", 1)[1]
        host = re.split(r"[/?#]", tail, maxsplit=1)[0]
        path = re.split(r"[?#]", tail[len(host) :], maxsplit=1)[0]
        assert (r.host, r.path) == (host.lower(), path)
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (f".{r.host}").endswith(f".{h}") and path.startswith(p)]
        rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, None))
        grams = {(tag, t[i : i + n]) for tag, t in (("h", f"^{r.host}$"), ("p", f"^{path}$")) for n in (3, 4, 5) for i in range(len(t) - n + 1)}
        at = {zlib.crc32((tag + g).encode()) >> (32 - url_filter.BITS) for tag, g in grams}
        score = 1 / (1 + math.exp(-(sum(w[i] for i in at) / math.sqrt(max(1, len(at))) + b)))
        assert r.score == pytest.approx(score, abs=1e-4) and r.rule == rule and r.verdict == (verdict or ("block" if score >= 0.5 else "allow"))


def test_license_headers_files_inheritance(spark):
    mit = "Released under the MIT License."
    files = [("a/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/x/code.py", "# " + mit + "\nimport os\n" + "words " * 50), ("a/x/other.py", "import sys"), ("b/plain.py", "print"), ("a/b/c/deep.py", "z"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id int, path string, text string")
    got = {r.path: r for r in license_scan.scan_licenses(df).collect()}
    assert got["a/LICENSE"].found == "file" and got["a/x/code.py"].license == "MIT" and got["a/x/code.py"].found == "header" and got["a/x/code.py"].line == 0
    assert (got["a/x/other.py"].license, got["a/x/other.py"].directory) == ("Apache-2.0", "a")
    assert (got["a/b/c/deep.py"].license, got["a/b/c/deep.py"].directory) == ("GPL-3.0", "a/b") and got["b/plain.py"].found == "none"


def licences_by_hand(files, least=0.8):
    """license, found and directory of each path: every line, run and whole text against every template, df over all texts."""
    cut = lambda t: [w.decode() for w in D.words((t or "").encode())]
    df = collections.Counter(w for _, t in files for w in set(cut(t)))
    idf = lambda w: math.log((1 + len(files)) / (1 + df[w])) + 1

    def cosine(a, b):
        x, y = ({w: c * idf(w) for w, c in collections.Counter(t).items()} for t in (a, b))
        norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(w, 0) for w, v in x.items()) / norm if norm else 0.0

    def best(texts):
        scored = [(cosine(t, cut(of)), name) for name, of in license_scan.TEMPLATES for t in texts]
        return max(scored, key=lambda s: (round(s[0], 9), [-ord(c) for c in s[1]]), default=(0, None))

    own = {}
    for path, text in files:
        w = cut(text)
        runs = [w[i : i + n] for n in {len(cut(t)) for _, t in license_scan.TEMPLATES} for i in range(len(w) - n + 1)]
        whole, header = best([w]), best([cut(x) for x in (text or "").split("\n")] + runs)
        score, name = whole if whole[0] >= least else header
        own[path] = name if score >= least else None
    out = {}
    for path, _ in files:
        name, found, directory = own[path], "header", None
        is_file = path.rsplit("/", 1)[-1].split(".")[0].lower() in ("license", "licence", "copying", "notice", "unlicense")
        up = path.rsplit("/", 1)[0] if "/" in path else ""
        while name is None:
            given = [own[p] for p, _ in files if own[p] and (p.rsplit("/", 1)[0] if "/" in p else "") == up and p.rsplit("/", 1)[-1].split(".")[0] in ("LICENSE", "COPYING")]
            if given:
                name, found, directory = given[0], "inherited", up
            elif not up:
                found = "none"
                break
            else:
                up = up.rsplit("/", 1)[0] if "/" in up else ""
        out[path] = (name, "file" if own[path] and is_file else found, directory)
    return out


def test_license_scan_matches_brute_force(spark):
    draw = random.Random(4)
    prose = lambda n: " ".join(draw.choice("the a of value other word code thing software use license public notice source".split()) for _ in range(n))
    files = [("a/LICENSE", license_scan.TEMPLATES[0][1]), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("c/LICENSE.txt", prose(30)), ("c/only.txt", license_scan.TEMPLATES[3][1])]
    for i in range(60):
        name, text = draw.choice(license_scan.TEMPLATES)
        w = [x for x in text.split() if draw.random() > draw.choice([0, 0.1, 0.3])]
        body = draw.choice([" ".join(w), prose(40) + " " + " ".join(w) + " " + prose(20), prose(20) + "\n# " + "\n# ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)) + "\n" + prose(50), prose(60)])
        files.append((draw.choice(["", "a/", "a/b/", "a/b/c/", "c/", "c/d/"]) + f"f{i}.py", body))
    files += [("a/none.py", None), ("a/b/empty.py", "")]
    got = license_scan.scan_licenses(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id int, path string, text string")).collect()
    assert {r.path: (r.license, r.found, r.directory) for r in got} == licences_by_hand(files)


def test_license_query_inherits(spark, tmp_path):
    """In the query too, directories give their licence to documents that have none."""
    of = "Licensed under the Apache License, Version 2.0."
    rows = [(40, of), (41, "plain prose"), (42, "Licensed under the MIT License."), (59, None), (60, "no licence"), (61, "plain"), (-20, of), (-1, "x"), (None, "x")]
    spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.license, r.found, r.directory) for r in license_scan.op8_license_scan(spark, str(tmp_path)).collect()}
    none = (None, "none", None)
    apache = ("Apache-2.0", "inherited")
    assert got == {40: ("Apache-2.0", "file", None), 41: (*apache, "2"), 42: ("MIT", "header", None), 59: (*apache, "2"), 60: none, 61: none, -20: ("Apache-2.0", "file", None), -1: (*apache, "-1"), None: none}


def test_license_of_one_text_is_its_own(spark):
    """A text that is a licence, in a file of another name, licenses nothing else."""
    files = [(1, "s/en/1.txt", "This work is licensed under the GNU General Public License, version 3."), (2, "s/en/2.txt", "something else"), (3, "s/en/3.txt", None)]
    got = {r.doc_id: (r.license, r.found) for r in license_scan.scan_licenses(spark.createDataFrame(files, "doc_id int, path string, text string")).collect()}
    assert got == {1: ("GPL-3.0", "header"), 2: (None, "none"), 3: (None, "none")}


def test_whole_licence_files(spark):
    files = [(i, f"d{i}/LICENSE", "Copyright (c) 2020 Some Body\n\n" + "\n".join(textwrap.wrap(t, 70))) for i, (n, t) in enumerate(license_scan.TEMPLATES) if len(t) > 400]
    got = license_scan.scan_licenses(spark.createDataFrame(files, "doc_id int, path string, text string")).collect()
    assert {r.doc_id: (r.license, r.found) for r in got} == {i: (license_scan.TEMPLATES[i][0], "file") for i, _, _ in files} and len(files) == 4


def test_rules(spark):
    urls = ["http://a.COM/en/1", "https://example.com/en/7", "https://x.example.com/en/71", "http://net/de/1", "http://sub.example.net/de/88", "http://q.org/es/", "http://example.com", "no scheme", None, "http://u@h.org:80?x=/es/", "x://y://com/en/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert [got[i].rule for i in range(6)] == ["com/en/", "example.com/en/7", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/"]
    assert [got[i].verdict for i in range(6)] == ["block", "allow", "allow", "allow", "block", "block"]
    assert (got[0].host, got[0].path) == ("a.com", "/en/1") and (got[6].host, got[6].path) == ("example.com", "") and got[7].host == got[8].host == ""
    assert (got[9].host, got[9].path) == ("u@h.org:80", "") and (got[10].host, got[10].path) == ("y:", "//com/en/")


def test_all_queries_registered():
    n = collections.Counter(int(k[2:].split("_")[0]) for k in queries.QUERIES)
    assert n == collections.Counter(range(1, 11))


def test_license_headers_over_lines_and_in_prose(spark):
    text = dict(license_scan.TEMPLATES)

    def wrapped(name, width, mark):
        w = text[name].split()
        return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))

    code = "\nimport os\n" + "value = other + 1\n" * 60
    files = [("a/bsd.py", "#!/bin/python\n" + wrapped("BSD-3-Clause", 11, "# ") + code), ("b/mit.c", wrapped("MIT", 10, " * ") + code), ("c/gpl.py", wrapped("GPL-3.0", 13, "# ") + code),
             ("d/prose.txt", "some words of another kind come first " * 20 + text["MPL-2.0"] + " and then many more words of prose follow here" * 20), ("e/plain.py", code)]
    got = {r.path: r for r in license_scan.scan_licenses(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "doc_id bigint, path string, text string")).collect()}
    assert [(got[p].license, got[p].found, got[p].line) for p, _ in files] == [("BSD-3-Clause", "header", 1), ("MIT", "header", 0), ("GPL-3.0", "header", 0), ("MPL-2.0", "header", 0), (None, "none", None)]
    assert all(got[p].score > 0.99 for p, _ in files[:4])


def test_shards_of_null_and_repeated_ids(spark):
    """A third of all rows hold one text and no id, or one id: bytes stay near equal, and slots have no gap."""
    for hot in (None, 5):
        rows = [(hot, "hot text " * 30)] * 1000 + [(i, f"text {i} " * 30) for i in range(2000)]
        got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).groupBy("shard").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"), F.max("slot").alias("last")).collect()
        even = sum(r.s for r in got) / 16
        assert len(got) == 16 and all(abs(r.s - even) < 0.06 * even and r.n == r.last + 1 for r in got)


def test_mix_of_many_small_sources(spark):
    """Two hundred sources of a document each: targets are met to the word."""
    docs = spark.createDataFrame([(i, "w " * (50 + i % 60), f"s{i:03}") for i in range(200)], "doc_id bigint, text string, source string")
    got = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 200 and all(abs(r.taken - r.target) <= 2 for r in got)


def test_prose_is_ruled_out_as_no_licence():
    """English that has the words of licences, but not together, isn't looked at further; a licence within prose is."""
    prose = "the software is provided to the user or the author and any copy of this work shall be used for the purpose of a free and open source".split()
    common = {w.encode(): 900 for w in prose}
    matcher = license_scan.Matcher(common, 1000, license_scan.TEMPLATES, license_scan.LEAST)
    draw = random.Random(8)
    texts = [" ".join(draw.choices(prose, k=120)).encode() for _ in range(200)]
    assert sum(bool(matcher.may(set(D.words(t)))) for t in texts) < 10
    for name, text in license_scan.TEMPLATES:
        k = [n for n, *_ in matcher.vectors].index(name)
        assert any(matcher.vectors[i][0] == name for i in matcher.may(set(D.words(b"the user or the author " + text.encode())))), k


def test_rows_of_one_id_with_other_texts(spark):
    """Each row is linked by its own text, in whatever order rows come; what links to one of them doesn't depend on the other."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(7, a), (7, b), (2, a + " more"), (9, b + " more"), (1, "else"), (7, a), (None, a)]
    want = {(7, a): 2, (7, b): 7, (2, a + " more"): 2, (9, b + " more"): 7, (1, "else"): 1}
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        df = spark.createDataFrame([(i, t, len(t)) for i, t in order], "doc_id bigint, text string, n bigint").coalesce(1)
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_dedup(df).collect())
        assert got == sorted((str(i), len(near_dedup.shingles(t, 2)), str(want.get((i, t))), i is not None and want[i, t] == i) for i, t in rows)
