"""Operators on small fixtures: what has no SQL form, and the cases the tables don't hold."""

import io
import re
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions.vectors import cosine, truncated
from tidewater.operators import chunk, clues, evaluate, events, index, report, search, state, timeline, voice
from tidewater.sources import corpus, session_files
from tidewater.streaming import fold, windows


def chunked(spark, text, **kw):
    rows = chunk.chunks(spark.createDataFrame([(1, text)], "doc_id int, text string"), **kw).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(len(rows)))
    return [(r.heading, r.text, r.start) for r in rows]


def test_chunk_headings_tables_code(spark):
    text = "<!-- made by x -->\n# A\nintro\n## B\n|a|b|\n|1|2|\n---\n```py\n# not a heading\n```\n*note*\n# C\n" + "句子很长很长很长很长。" * 80
    got = chunked(spark, text)
    assert got[:2] == [("A", "# A\nintro", 0), ("A > B", "## B\n|a|b|\n|1|2|\n```py\n# not a heading\n```", 9)]
    long = [c for c in got if c[0] == "C"]
    assert len(long) >= 3 and all(len(c[1]) <= 450 + chunk.SHORTEST for c in long)
    assert long[1][1].startswith(long[0][1][-50:].strip()[:10]) and [c[2] for c in got] == sorted(c[2] for c in got)


def test_chunk_unclosed_fence_oversize_and_empty(spark):
    assert chunked(spark, "") == chunked(spark, None) == chunked(spark, "<!-- x -->") == []
    got = chunked(spark, "~~~\n" + "x" * 900)
    assert len(got) > 1 and chunked(spark, "~~~\n" + "x" * 900, atomic=True)[0][1].count("x") == 900
    assert chunked(spark, "~~~\n```\n# in\n~~~\n# out") == [("", "~~~\n```\n# in\n~~~", 0), ("out", "# out", 16)]


def packed_by_hand(text, budget, shortest, overlap):
    """Chunks of prose without marks of any kind: sentences to the budget, tails ahead, short ones joined."""
    units = [u + "\n" for u in re.findall(r"[^。]*。|[^。]+", text)]
    units = [piece for u in units for piece in ([u] if len(u) <= budget else [u[i : i + 200] for i in range(0, len(u), 200)])]
    groups, size = [[]], 0
    for u in units:
        if size and size + len(u) > budget:
            groups.append([])
            size = 0
        groups[-1].append(u)
        size += len(u)
    out, tail, at = [], "", 0
    for g in groups:
        now = "".join(g).strip()
        now = f"{tail}\n{now}".strip() if tail else now
        if len(now) < shortest and out:
            out[-1] = (out[-1][0] + "\n" + now, out[-1][1])
        else:
            out.append((now, at))
        at, tail = at + len(now), now[len(now) - min(overlap, len(now)) :]
    return out


@pytest.mark.parametrize("how", [(450, 120, 50), (200, 60, 20), (130, 40, 0)])
def test_chunk_packing_matches_brute_force(spark, how):
    draw = np.random.default_rng(8)
    texts = ["".join("词" * n + "。" for n in draw.integers(1, draw.choice([20, 150, 500]), draw.integers(1, 14))) for _ in range(60)]
    rows = chunk.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), **dict(zip(("target", "shortest", "overlap"), how, strict=True))).orderBy("doc_id", "seq").collect()
    for i, text in enumerate(texts):
        assert [(r.text, r.start) for r in rows if r.doc_id == i] == packed_by_hand(text, max(80, how[0] - how[2]), how[1], how[2])


def test_split_paragraphs(spark):
    text = ["一句话。" * 60 + "尾。", "很长，" * 100, "", None, "一" * 500]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in text], "t string").select(chunk.split_paragraphs(F.col("t"))).collect()]
    assert all("".join(g) == (t or "") for g, t in zip(got, text, strict=True)) and got[2] == got[3] == []
    assert all(len(p) <= 208 for g in got for p in g) and len(got[0][-1]) >= 24 and got[1][0] == "很长，" * 52 and len(got[4][0]) == 156


def found(spark, *texts, people=()):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [(r.id, r.kind, r.text, r.anchor, round(r.confidence, 2)) for r in clues.extract(df, ["id"], people=people).orderBy("id", "begin").collect()]


def test_clue_rules(spark):
    got = found(spark, "我们会在九月五号之前把材料收齐。", "已到的货我们会把说明书收齐。", "你们公司要尽快确定", "下周三验收", "请张伟来负责，2024-05-01必须交", "请技术经理来", "技术经理来", "由华东设计院王主任答复", "示例必须如此", None, "人员不能少，王主任负责")
    assert got == [
        (0, "deadline", "时间节点：九月五号之前", "九月五号之前", 0.85), (1, "commitment", "已到的货我们会把说明书收齐", "已到的货我们会把说明书收齐", 0.7), (2, "requirement", "你们公司要尽快确定", "你们公司要尽快确定", 0.7),
        (3, "deadline", "时间节点：下周三", "下周三", 0.7), (4, "person", "张伟来", "张伟来", 0.5), (4, "deadline", "时间节点：2024-05-01", "2024-05-01", 0.85), (5, "person", "请技术经理", "请技术经理", 0.7),
        (7, "org", "由华东设计院", "由华东设计院", 0.8), (10, "requirement", "人员不能少", "人员不能少", 0.65),
    ]


SF = "/root/testdata/sf0.001"


def test_clue_rules_query(spark):
    """Every event's utterance, by what its kind of event says."""
    from tidewater import registry

    got = {}
    for r in registry.QUERIES["clue_rules"](spark, SF).collect():
        got.setdefault(r.event_id, set()).add((r.kind, r.anchor))
    for e in spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type").collect():
        i = e.event_id
        if e.event_type == "click":
            want = {("deadline", f"{i % 12 + 1}月{i % 28 + 1}日之前"), ("requirement", "软件必须通过测试")}
        elif e.event_type == "error":
            want = {("requirement", "你们公司要尽快确定"), ("deadline", f"{i % 9 + 1}号"), ("person", "张伟")}
        elif e.event_type == "view":
            want = {("deadline", "下周三"), ("deadline", f"{i % 5 + 1}天内")}  # the organisation would begin in the date
        else:
            want = {("commitment", "我方负责现场布线"), ("deadline", f"2024-{i % 12 + 1}-{i % 28 + 1}")}
        assert got[i] == want, e


def test_clue_board_query(spark):
    """Turns of a conversation and role, whose words hold one another, are one clue."""
    from tidewater import registry

    marks = re.compile(T.PUNCTUATION)
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {}
    for r in rows:
        norm, groups = marks.sub("", r.text), want.setdefault((r.conv_id, r.role), [])
        same = next((g for g in groups if norm in g[0] or g[0] in norm), None)
        if same:
            groups[groups.index(same)] = max(same, (norm, r.text), key=lambda g: len(g[1]))
        else:
            groups.append((norm, r.text))
    got = {}
    for r in registry.QUERIES["clue_board"](spark, SF).collect():
        got.setdefault((r.session, r.kind), []).append((r.norm, r.text))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_clue_people_and_dedupe(spark):
    assert (0, "person", "Ann", "Ann", 0.9) in found(spark, "Ann spoke", people=("Ann",))
    got = spark.sql("select array('abc', 'ab', 'xyz', 'yz', 'q') as a").select(clues.keep_longest(F.col("a"))).first()[0]
    assert got == ["abc", "xyz", "q"]


def test_clues_of_a_model(spark):
    reply = '[{"type": "risk", "anchor": "late", "text": "may be late", "confidence": 3, "actor": "Bob", "due": "May"}, {"type": "risk", "anchor": "absent"}, {"type": "odd", "anchor": "late"}, {"type": "term", "anchor": "b"}]'
    got = clues.from_model(spark.createDataFrame([(1, "we may be late, Bob", reply)], "id int, text string, reply string"), ["id"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, "risk", "may be late", "late", 1.0, "Bob", ""), (1, "term", "b", "b", 0.6, "", "")]


def test_board_merges_what_holds_one_another(spark):
    rows = [("s", "risk", "short", 0.5, "", 1.0), ("s", "risk", "a short one", 0.9, "Bob", 2.0), ("s", "risk", "other", 0.1, "", 3.0), ("s", "term", "short", 0.2, "", 4.0)]
    df = spark.createDataFrame([(s, k, t, "", c, a, "", False, at) for s, k, t, c, a, at in rows], "session string, kind string, text string, anchor string, confidence double, actor string, due string, pinned boolean, t double")
    assert sorted((r.kind, r.text, r.confidence, r.actor, r.t) for r in clues.board(df, ["session"]).collect()) == [("risk", "a short one", 0.9, "Bob", 1.0), ("risk", "other", 0.1, "", 3.0), ("term", "short", 0.2, "", 4.0)]


def test_fuzzy_and_fixes(spark):
    texts = spark.createDataFrame([(1, "the meetink room and meating")], "id int, text string")
    found = clues.fuzzy_candidates(texts, spark.createDataFrame([("meeting",)], "target string"), ["id"])
    picked = {r.window for r in clues.pick_fixes(found, ["id"]).collect()}
    assert picked == {"meetink", "meating"}


def test_linkify():
    assert clues.linkify("Ann met Bob. Ann left `Bob`.", {"Ann": "Ann Lee", "Bob": "Bob"}) == "[[Ann Lee|Ann]] met [[Bob]]. Ann left `Bob`."
    assert clues.linkify("Ann", {"Ann": "Ann"}, own="Ann") == "Ann"


MINUTES = """---
title: 'x'
meeting_date: 2024/5/6
---
# M
参会人员：张伟、李娜
- **[甲方要求]** 软件部署调通完成。（期限：9月5日前）
- **[承诺]** 我方月底前提交报告
- **[怪]** 其他事项需要记录
- **[风险]** 短
"""
SECTIONED = """## 1. 关键决策
- 采用新的方案推进
### 小标题
- 会议日期不变更
王强说的没有标记的一行
- **李四**：负责对接现场
## 2. 行动项
- [ ] **张伟** 完成接口联调
- [x] 整理文档资料（李娜）
- 本次会议未产生明确行动项。
- 没有方框的事项（赵六）
## 3. 后续跟进
- 下周前提交报告
"""


def test_event_extraction(spark):
    free = "大家讨论了现场的安排。9月5日前完成现场布线工作！时间 地点未定。"
    m = spark.createDataFrame([("d/2024-01-02-a.md", MINUTES), ("d/2023-03-04.md", SECTIONED), ("d/free.txt", free)], "path string, text string")
    reply = '[{"type": "行动项", "content": "完成现场布线工作", "deadline": "9月5日前", "owner": "甲"}, {"type": "怪", "content": "讨论了现场的安排内容", "deadline": "9月9日"}, {"content": "会议地点 线上腾讯会议"}, {"content": "1 林浩然 甲方单位"}, {"content": "短"}]'
    out = events.extract(m, spark.createDataFrame([("d/free.txt", 0, reply), ("d/2023-03-04.md", 0, reply)], "path string, batch int, reply string"))
    rows = {r.path: [] for r in out.collect()}
    for r in out.orderBy("path", "seq").collect():
        rows[r.path].append((r.seq, r.type, r.content, r.deadline, r.owner, r.section, r.date))
    assert rows["d/2024-01-02-a.md"] == [
        (1, "甲方要求", "软件部署调通完成。", "9月5日前", "", "标注", "2024-05-06"), (2, "己方承诺", "我方月底前提交报告", "月底前", "", "标注", "2024-05-06"), (3, "其他", "其他事项需要记录", "", "", "标注", "2024-05-06"),
    ]
    date = "2023-03-04"
    assert rows["d/2023-03-04.md"] == [
        (1, "决策", "采用新的方案推进", "", "", "决策", date), (2, "决策", "会议日期不变更", "", "", "决策", date), (3, "决策", "王强说的没有标记的一行", "", "", "决策", date), (4, "决策", "负责对接现场", "", "李四", "决策", date),
        (5, "行动项", "完成接口联调", "", "张伟", "行动项", date), (6, "行动项", "整理文档资料", "", "李娜", "行动项", date), (7, "行动项", "没有方框的事项（赵六）", "", "", "行动项", date), (8, "己方承诺", "下周前提交报告", "下周前", "", "跟进", date),
    ]
    assert [r[1:5] for r in rows["d/free.txt"]] == [("行动项", "完成现场布线工作", "9月5日前", "甲"), ("其他", "讨论了现场的安排内容", "", "")]
    assert events.clauses(m.where("path = 'd/free.txt'"), 2).orderBy("batch").collect()[0].prompt.startswith("1. 大家讨论了现场的安排。\n2. 9月5日前")
    assert {(r.name, r.org) for r in events.attendees(m).collect()} == {("张伟", ""), ("李娜", "")}


def test_attendees_of_tables(spark):
    text = "参会方：甲、未定、王小明\n| 1 | 王小明 | 甲方 |\n| 2 | 李四 | 乙方 |\n"
    got = events.attendees(spark.createDataFrame([("p", text)], "path string, text string")).collect()
    assert {(r.name, r.org) for r in got} == {("王小明", ""), ("李四", "乙方")}


@pytest.mark.parametrize("name", ["客户要求", "业主确认", "确认", "承诺", "待办", "决定", "客户确认", "要求", "任务", "风险"])
def test_types(spark, name):
    want = {"客户要求": "甲方要求", "业主确认": "甲方确认", "确认": "甲方确认", "承诺": "己方承诺", "待办": "行动项", "决定": "决策", "客户确认": "甲方确认", "要求": "甲方要求", "风险": "风险"}
    assert spark.range(1).select(events.known_type(F.lit(name))).first()[0] == want.get(name, "其他")


def test_upsert_is_idempotent(spark):
    e = spark.createDataFrame([("m", "a b", 0), ("m", "a, b!", 1), ("m", "!!", 2), ("n", "c", 0)], "meeting_id string, content string, seq int")
    once = events.upsert(e.limit(0), e)
    assert sorted((r.meeting_id, r.seq) for r in once.collect()) == [("m", 0), ("n", 0)]
    assert sorted(map(tuple, events.upsert(once, e.where("meeting_id = 'm'")).collect())) == sorted(map(tuple, once.collect()))


def test_model_array(spark):
    replies = ["<think>x</think>```json\n[{\"type\": \"a\"}]\n```", "sure: [{\"type\": \"b\"},]", "broken {\"type\": \"c\"} and {\"type\": \"d\"} tail"]
    df = spark.createDataFrame([(r,) for r in replies], "r string").select(T.parse_model_array(F.col("r"), "struct<type: string>").alias("a"))
    assert [[x.type for x in r.a] for r in df.collect()] == [["a"], ["b"], ["c", "d"]]


def test_text_scalars(spark):
    row = spark.sql("select '铺线以机房为。' as a, '以机房为重点' as b").select(T.join_text(F.col("a"), F.col("b")), T.is_complete(F.col("a")), T.digits(F.lit("三点五和A二")), T.tidy_spaces(F.lit("中文 ok,好,3"))).first()
    assert row[0] == "铺线以机房为重点" and row[1] and row[2] == "3.5和A2" and row[3] == "中文ok，好,3"
    assert spark.range(1).select(T.explicit_replace(F.lit("ab b a"), [("a", "b"), ("b", "a")])).first()[0] == "ba a b"
    assert spark.range(1).select(T.tokenize_cjk(F.lit("软件ab部"))).first()[0] == ["软", "件", "ab", "部", "软件"]


@pytest.mark.parametrize(("said", "want"), [("二点五", "2.5"), ("十二点五倍", "12.5倍"), ("pad九和小米十八fold", "pad9和小米18fold"), ("十核芯片", "10核芯片"), ("十八号", "十八号"), ("二十三k", "23k"), ("两点零五", "2.5"), ("十点", "十点"), ("一八K", "18K")])
def test_spoken_numbers(spark, said, want):
    assert spark.range(1).select(T.digits(F.lit(said))).first()[0] == want


def test_tidy(spark):
    cases = {"pad 9 好": "pad9好", "用 DeepSeek harness 写": "用DeepSeek harness写", "好.对": "好。对", "v1.0好": "v1.0好", "中文:3": "中文:3", "harness,让他们": "harness，让他们"}
    rows = spark.createDataFrame(list(cases.items()), "t string, w string").select(T.tidy_spaces(F.col("t")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in rows), rows


def test_outline_rules():
    items = corpus.parse_outline(["会议议程", "一、上午九点半 签到（主持人：林浩然）", "第二项 遗留问题跟进 @李雷", "备注：提前准备", "# 下半场", "铺线进度，", "以及材料", "软件联调", "  缩进的说明", "- 14:00-15:30 审定方案", "———"])
    got = [(i["topic"], i["slot"], i["speaker"], i["kind"], i["detail"]) for i in items]
    assert got == [
        ("签到", "上午九点半", "林浩然", "topic", "提前准备"), ("遗留问题跟进", "", "李雷", "followup", ""), ("铺线进度，", "", "", "topic", "以及材料 软件联调 缩进的说明"), ("审定方案", "14:00-15:30", "", "confirm", ""),
    ]


def test_wav_round_trip(spark):
    data = corpus.wav_bytes([0.0, 0.5, -2.0, 1.0])
    row = corpus.wav(spark.createDataFrame([("a", bytearray(data))], "path string, content binary")).first()
    assert row.samples == pytest.approx([0, 0.5, -1, 1], abs=1e-4)


def test_keywords_grounding(spark):
    df = spark.sql("select array('ab', 'abc', 'zz', 'c d', 'b', '') as w, 'abc d ab' as t").select(clues.grounded(F.col("w"), F.col("t")), clues.grounded(F.col("w"), F.col("t"), 1))
    assert df.first()[0] == ["abc", "c d"] and df.first()[1] == ["abc"]


def test_hotword_correction(spark):
    texts = spark.createDataFrame([(1, "the meetink room"), (2, "no change")], "id int, text string")
    near = clues.sounding(clues.fuzzy_candidates(texts, spark.createDataFrame([("meeting",), ("qeetink",)], "target string"), ["id"]), least=0.7)
    fixes = clues.pick_fixes(near, ["id"])
    assert {r.id: r.text for r in clues.corrected(texts, fixes, ["id"]).collect()} == {1: "the meeting room", 2: "no change"}


def test_edited_clues(spark):
    rows = spark.createDataFrame([(1, "risk", "a", False, "s"), (2, "risk", "b", False, "s"), (3, "term", "c", False, "t")], "id int, kind string, text string, pinned boolean, seg_id string")
    log = spark.createDataFrame([(1, "update", 1, "odd", None, True), (2, "update", 1, None, "A", None), (3, "remove", 2, None, None, None)], "seq int, op string, id int, kind string, text string, pinned boolean")
    assert sorted((r.id, r.kind, r.text, r.pinned) for r in clues.edited(rows, log).collect()) == [(1, "term", "A", True), (3, "term", "c", False)]
    assert clues.for_segment(rows, "t").count() == 1


def test_linked_notes(spark):
    notes = spark.createDataFrame([("n1", "Ann met Bob Lee. Ann left `Bob Lee`."), ("Ann", "Ann alone"), ("n3", None)], "note string, text string")
    names = spark.createDataFrame([("Ann", "Ann"), ("Bob Lee", "Robert"), ("Zed", "Zed")], "name string, entity string")
    assert {r.note: r.text for r in clues.linked(notes, names).collect()} == {"n1": "[[Ann]] met [[Robert|Bob Lee]]. Ann left `Bob Lee`.", "Ann": "Ann alone", "n3": None}


def test_masks_upserts_and_throttles(spark):
    rows = spark.createDataFrame([("s", 0.0, 5.0, False), ("s", 4.0, 8.0, False), ("s", 20.0, 24.0, False), ("s", 30.0, 31.0, True)], "k string, start double, end double, open boolean")
    assert [(r.start, r.end) for r in timeline.coverage_mask(rows, ["k"], F.lit(9.5)).orderBy("start").collect()] == [(4.0, 8.0), (20.0, 24.0)]
    assert [(r.start, r.end) for r in timeline.coverage_mask(rows, ["k"], F.lit(0.0), most=1).collect()] == [(20.0, 24.0)]
    kinds = "k string, idx bigint, text string, start double, rev bigint"
    old, new = spark.createDataFrame([("s", 0, "a", 0.0, 0), ("s", 1, "b", 5.0, 0)], kinds), spark.createDataFrame([("s", 1, "B", 5.0, 1), ("s", -1, "a", 0.02, 1), ("s", -1, "new", 9.0, 1), ("t", -1, "x", 0.0, 1)], kinds)
    assert sorted((r.k, r.idx, r.text, r.rev) for r in timeline.upsert(old, new, ["k"]).collect()) == [("s", 0, "a", 1), ("s", 1, "B", 1), ("s", 2, "new", 1), ("t", 0, "x", 1)]
    said = spark.createDataFrame([("s", 0, 1, "a", ""), ("s", 0, 2, "a", "p"), ("s", 0, 3, "a", "p"), ("s", 0, 4, "b", "p")], "k string, idx int, rev int, text string, spk string")
    assert [r.action for r in timeline.republished(said, ["k"]).orderBy("rev").collect()] == ["analyse", "refresh", "none", "analyse"]
    heard = spark.createDataFrame([("s", 7, 0.0, 1.0, 0.1), ("s", 3, 2.0, 3.0, 0.2), ("s", 7, 0.0, 1.5, 0.3)], "k string, idx bigint, start double, end double, at double")
    assert sorted((r.idx, r.start) for r in timeline.rebased(heard, ["k"], 10, 100.0).collect()) == [(10, 100.0), (10, 100.0), (11, 102.0)]
    live = spark.createDataFrame([("s", t, n) for t, n in [(0.0, 1), (0.5, 2), (1.0, 5), (1.4, 6), (2.3, 6)]], "k string, t double, n bigint")
    assert sorted(r.t for r in timeline.throttled(live, ["k"], 1.2, 4).collect()) == [0.0, 1.0, 2.3]
    assert tuple(spark.range(1).select(timeline.flat_time(F.lit([1500, 2500]))).first()[0]) == (1.5, 2.5)


def test_evaluation(spark):
    pairs = spark.createDataFrame([(1, "甲乙丙，丁", "甲丙丁"), (2, "", "x"), (3, "abc", "abc")], "i int, want string, got string")
    assert {r.i: r.kept for r in evaluate.retention(pairs, ["i"]).collect()} == {1: 0.75, 2: 0.0, 3: 1.0}
    rates = {r.i: (r.cer, r.substitutions, r.deletions, r.insertions) for r in evaluate.error_rates(pairs.toDF("i", "reference", "heard"), ["i"]).collect()}
    assert rates == {1: (0.25, 0, 1, 0), 2: (0.0, 0, 0, 0), 3: (0.0, 0, 0, 0)}
    truth = spark.createDataFrame([(0, "a"), (1, "b")], "query_id int, kb string")
    hits = lambda *kb: spark.createDataFrame([(i, k, 1) for i, k in enumerate(kb)], "query_id int, kb string, rank int")
    assert tuple(evaluate.own_first(hits("a", "a"), hits("a"), hits("a", "b"), truth).first()) == (2, 1, 1, 2)
    fused = evaluate.with_prior(spark.createDataFrame([(0, "pub", "x", 1), (0, "own", "y", 1)], "query_id int, kb string, title string, rank int"), "pub", 0.0006)
    assert [r.title for r in fused.orderBy("rank").collect()] == ["y", "x"]
    of = spark.createDataFrame([(0, "f1", 0), (0, "f2", 1)], "query_id int, path string, rank0 int")
    truth = spark.createDataFrame([(0, "f2"), (1, "f1")], "query_id int, path string")
    assert tuple(evaluate.split_against_mixed(of, of.where("rank0 = 0"), truth).first()) == (2, 0.0, 0.5, 0.0, 0.0)
    assert {r.query_id: r.right for r in evaluate.answers(of, truth).collect()} == {0: False, 1: False}


@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7))
@settings(max_examples=200, deadline=None)
def test_error_parts(a, b):
    sub, gone, more = evaluate.error_parts(a, b)
    best = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        best = [min([i if j == 0 else 10**9, *([best[j - 1] + (x != b[j - 1])] if j else []), best[j] + 1]) for j in range(len(b) + 1)]
        for j in range(1, len(b) + 1):
            best[j] = min(best[j], best[j - 1] + 1)
    assert sub + gone + more == best[-1] and len(a) - gone + more == len(b)


def test_queries_by_hand(spark):
    """Queries that SQL doesn't express, on whole tables."""
    from tidewater import registry

    talk = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    pairs = [(a, b) for a, b in zip(talk, talk[1:], strict=False) if a.conv_id == b.conv_id]
    like = {(r.conv_id, r.turn): r.similar for r in registry.QUERIES["turn_similarity"](spark, SF).collect()}
    assert like == {(b.conv_id, b.turn): pytest.approx(1.0 if a.text in b.text or b.text in a.text else table_lcs(a.text, b.text) / min(len(a.text), len(b.text)), abs=1e-6) for a, b in pairs}
    marks, errors = re.compile(T.PUNCTUATION), {(r.conv_id, r.turn): r for r in registry.QUERIES["error_parts"](spark, SF).collect()}
    for a, b in pairs:
        x, y = marks.sub("", a.text), marks.sub("", b.text)
        r = errors[b.conv_id, b.turn]
        assert r.longer == len(y) - len(x) and r.edits == round(r.cer * len(x)) >= abs(r.longer)
    docs = {r.doc_id: r.text.replace(".", "。") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    packs = {}
    for r in registry.QUERIES["paragraph_pack"](spark, SF).orderBy("doc_id", "pos").collect():
        packs.setdefault(r.doc_id, []).append(r.n_chars)
    for i, text in docs.items():
        ends = {m.end() for m in re.finditer(r"[。！？!?；;](?![”’）」』】])", text)}
        sizes, at = packs.get(i, []), 0
        assert max(sizes, default=0) <= 208 and sum(sizes) <= len(text)
        if not re.search(r"[。！？!?；;]\s*$|[。！？!?；;]\s+[。！？!?；;]", text):
            continue
        for n in sizes[:-1]:
            at += n
            assert at in ends or text[at - 1] in "，；,;" or n == 156 or sum(sizes) < len(text)


def test_corpus_life(spark):
    def embed(rows):
        return rows.select("id", F.array(F.length("text").cast("double")).alias("embedding"))

    body = "Some words that are long enough to be worth indexing here. "
    kinds = "path string, rel string, source string, mtime double, text string"
    first = [("/r/a.md", "a.md", "s", 1.0, "# A\n" + body), ("/r/b.md", "b.md", "s", 1.0, "# B\n" + body * 2), ("/r/.git/c.md", ".git/c.md", "s", 1.0, body), ("/r/s.md", "s.md", "s", 1.0, "short")]
    held = index.build(spark.createDataFrame(first, kinds), embed, "m@1")
    assert {r.path for r in held.files.collect()} == {"/r/a.md", "/r/b.md"} and held.vectors.count() == held.chunks.count() == 2
    later = [("/r/a.md", "a.md", "s", 2.0, "# A\n" + body), ("/r/d.md", "d.md", "s", 2.0, "# D\nanother text, delta, " + body), *first[2:]]
    new, report = index.sync(held, spark.createDataFrame(later, kinds), "/r", embed, "m@1")
    assert {r.status: r.n for r in report.collect()} == {"touched": 1, "added": 1, "removed": 1, "skipped": 2, "orphans": 0, "embedded": 1}
    assert {r.path for r in new.chunks.collect()} == {"/r/a.md", "/r/d.md"} and new.vectors.count() == 2
    q = spark.createDataFrame([(0, "delta")], "query_id bigint, query string")
    assert search.bm25(new.postings, q).count() == 1 and search.bm25(index.delete_files(new, spark.createDataFrame([("/r/d.md",)], "path string")).postings, q).count() == 0
    again, report = index.sync(new, spark.createDataFrame(later, kinds), "/r", embed, "other@2")
    assert {r.status: r.n for r in report.collect()} == {"rebuilt": 2, "embedded": 2} and again.embedder == "other@2"
    extra = spark.createDataFrame([*later, ("/r/x.csv", "x.csv", "s", 3.0, body * 3), ("/r/e.md", "e.md", "s", 3.0, "# E\n" + body)], kinds)
    more, report = index.imported(new, extra, "/r", embed, "m@1")
    assert {r.status: r.n for r in report.collect()} == {"unchanged": 2, "added": 1, "skipped": 2, "orphans": 0, "embedded": 1, "stored": 1} and more.files.count() == 3
    other = index.healed(new, "cjk")
    assert index.healed(new) is new and other.postings.tokenizer == "cjk" and index.healed(other, "cjk") is other
    with pytest.raises(ValueError):
        index.healed(new, "another")


def test_reports_of_a_session(spark):
    c = spark.createDataFrame([(1, "risk", "late", 10, 0.0), (2, "decision", "go", 11, 5.0)], "clue_id int, kind string, text string, seg_id int, t double")
    seg = spark.createDataFrame([(10, "Ann", 61.0)], "seg_id int, speaker string, start double")
    refs = spark.createDataFrame([(1, r, f"d{r}") for r in range(5)], "clue_id int, rank int, title string")
    got = {r.clue_id: (r.place, r.line, r.refs) for r in report.assembled(c, seg, refs, ["decision", "risk"]).collect()}
    assert got == {1: (2, "01:01 Ann：late", ["d0", "d1", "d2"]), 2: (1, "00:05 go", [])}
    ent = spark.createDataFrame([("Ann", "person", ["An", "A"], "b"), ("Bob", "person", [], None)], "entity string, kind string, names array<string>, body string")
    notes = spark.createDataFrame([("Ann",), ("An",)], "note string")
    assert [(r.entity, r.spellings) for r in report.fragmented(notes, ent).collect()] == [("Ann", ["An", "Ann"])]
    assert [(r.path, r.text) for r in report.note_files(ent, notes).collect()] == [("Bob.md", "---\ntype: person\naliases: []\n---\n\n# Bob\n\n\n")]


def test_state_changes(spark):
    rows = spark.createDataFrame([("ann", "x"), ("bob", "ann")], "name string, actor string")
    assert sorted(map(tuple, state.renamed(rows, spark.createDataFrame([("ann", "Ann B")], "old string, new string"), ["name", "actor"]).select("name", "actor").collect())) == [("Ann B", "x"), ("bob", "Ann B")]
    voices = spark.createDataFrame([("s1", "p1"), ("s2", "bob"), ("s3", "cay")], "spk string, value string")
    assert [r.spk for r in state.removed(voices, spark.createDataFrame([("p1", "bob")], "id string, name string")).collect()] == ["s3"]
    items = spark.createDataFrame([(1, "a", False, 3.0), (2, "a", True, 4.0), (3, "b", True, 5.0)], "id int, list string, done boolean, nw double")
    done = state.marked(items, spark.createDataFrame([(1, True, 1), (1, False, 2), (2, False, 1)], "id int, done boolean, seq int"))
    assert {r.id: r.done for r in done.collect()} == {1: False, 2: False, 3: True} and state.listed(items, "a", True).count() == 1
    assert {r.id: (r.done, r.nw) for r in state.reset(items, "a").collect()} == {1: (False, 0.0), 2: (False, 0.0), 3: (True, 5.0)}


def test_bounded_queue():
    q = windows.Bounded(3)
    q.put([1, 2])
    q.put([3, 4, 5])
    assert q.take() == [1, 2, 3] and q.dropped == 2 and q.take() == []


def test_vectors(spark):
    row = spark.sql("select array(3.0D, 4.0D, 9.0D) as a, array(0.0D, 0.0D, 0.0D) as z, array(1.0D) as s").select(cosine(F.col("a"), F.col("a")), cosine(F.col("a"), F.col("z")), cosine(F.col("a"), F.col("s")), truncated(F.col("a"), 2)).first()
    assert row[0] == pytest.approx(1) and row[1] == row[2] == 0 and row[3] == pytest.approx([0.6, 0.8])


def test_rrf_filter_keeps_global_ranks(spark):
    arm = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (0, 3, 2)], "query_id int, id int, rank0 bigint")
    meta = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "y")], "id int, path string, source string")
    got = {r.path: r.score for r in search.rrf([arm], meta, source=F.col("source") == "y").collect()}
    assert got == {"b": pytest.approx(1 / 62), "a": pytest.approx(1 / 63)}
    twice = {r.path: r.score for r in search.rrf([arm, arm], meta).collect()}
    assert twice["a"] == pytest.approx(2 / 61)


@pytest.fixture(scope="module")
def library(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma"), (3, "gamma gamma alpha"), (4, None), (5, "delta")], "doc_id bigint, text string")
    vectors = spark.createDataFrame([(i, [float(i == j) for j in range(1, 6)]) for i in range(1, 6)], "vec_id bigint, embedding array<float>")
    meta = spark.createDataFrame([(i, f"f{i}", "xy"[i % 2]) for i in range(1, 6)], "id bigint, path string, source string")
    return docs, search.build_index(docs), vectors, meta


def test_index_scores_as_texts_do(spark, library):
    docs, index, _, _ = library
    q = spark.createDataFrame([(0, "alpha gamma"), (1, "delta absent"), (2, ""), (3, None)], "query_id bigint, query string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(search.bm25(index, q)) == rows(search.bm25(docs, q)) != []
    plan = search.top(search.bm25(index, q), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_postings_stay_where_they_are(spark, library):
    """A search moves no postings and no scores whatever the sizes; texts are dealt out once to be cut, in parts of a bounded size."""
    _, index, _, _ = library
    q = spark.createDataFrame([(0, "alpha gamma"), (1, "delta absent")], "query_id bigint, query string")
    plan = search.bm25(index, q)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = search.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(id" in plan


def test_parts_grow_with_the_texts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = search.postings(docs)
    monkeypatch.setattr(search, "PART", 10_000)
    many = search.postings(docs)
    assert few.rdd.getNumPartitions() == 4 < many.rdd.getNumPartitions() and search.parts_of(docs) == many.rdd.getNumPartitions()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_snippets_read_few_chunks_of_a_file(spark):
    """Each file's first chunks against brute force; chunks that no arm has found don't meet the queries but for the first of each file."""
    import random

    draw = random.Random(3)
    meta = [(i, f"f{draw.randrange(4)}" if i % 9 else None) for i in range(200)]
    arms = [[(q, i, n) for q in range(5) for n, i in enumerate(draw.sample(range(200), 6))] for _ in range(2)]
    frames = [spark.createDataFrame(a, "query_id bigint, id bigint, rank0 bigint") for a in arms]
    got = search.file_snippets(frames, spark.createDataFrame(meta, "id bigint, path string"))
    want = {}
    for q in range(5):
        r = [{i: n for k, i, n in a if k == q} for a in arms]
        for path in {p for i, p in meta if p and (i in r[0] or i in r[1])}:
            want[q, path] = sorted((i for i, p in meta if p == path), key=lambda i: (r[0].get(i, 10**6), r[1].get(i, 10**6), i))[:3]
    assert {(x.query_id, x.path): [c.id for c in x.chunks] for x in got.collect()} == want
    assert "WindowGroupLimit [path" in got._jdf.queryExecution().optimizedPlan().toString()


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Every two rows of a person meet, however small the blocks, ids that stand twice included."""
    rng = np.random.default_rng(1)
    rows = [(int(i), int(i) % 3 if i % 31 else None, rng.normal(size=4).tolist()) for i in rng.integers(0, 300, 240)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    u = [np.asarray(v) / np.linalg.norm(v) for _, _, v in rows]
    want = sorted({(i, p) for n, (i, p, _) in enumerate(rows) if p is not None and any(o == p and j < i and round(float(u[n] @ u[m]), 9) > 0.9 for m, (j, o, _) in enumerate(rows))})
    assert 20 < len(want) and sorted(map(tuple, voice.near_duplicates(df, same=0.9).collect())) == want
    monkeypatch.setattr(voice, "ROWS", 16)
    monkeypatch.setattr(voice, "TILE", 5)
    assert sorted(map(tuple, voice.near_duplicates(df, same=0.9).collect())) == want


def test_knn_in_tiles(spark, monkeypatch):
    """The k best with ties, however few scores are held at once, by a broadcast and by blocks."""
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (90, 3)).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>").repartition(2)
    want = sorted((q, i, n) for q in range(0, 90, 4) for n, i in enumerate(sorted(range(90), key=lambda i: (-(v[q] @ v[i]), i))[:7]))
    ask = lambda: sorted((r.query_id, r.id, r.rank0) for r in search.knn(df, df.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id"), 7).collect())
    assert ask() == want
    monkeypatch.setattr(search, "TILE", 5)
    assert ask() == want
    monkeypatch.setattr(search, "VECTORS", 30)
    assert ask() == want


def test_search_modes(spark, library):
    _, index, vectors, meta = library
    q = spark.createDataFrame([(0, "alpha", [0.0, 1.0, 0.0, 0.0, 0.0]), (1, "  ", [1.0, 0.0, 0.0, 0.0, 0.0])], "query_id bigint, query string, embedding array<float>")
    hits = lambda **kw: [(r.query_id, r.path) for r in search.search(index, vectors, q, meta, **kw).orderBy("query_id", "rank0").collect()]
    assert hits(mode="bm25") == [(0, "f1"), (0, "f3")] and hits(mode="vector", k=1) == [(0, "f2")]
    assert hits(mode="hybrid")[0] in {(0, "f1"), (0, "f2"), (0, "f3")} and len(hits(mode="hybrid")) == 5 and not [h for h in hits() if h[0] == 1]
    assert hits(mode="hybrid", embedder="a", stored_embedder="b") == hits(mode="bm25") and hits(mode="vector", embedder="a", stored_embedder="b") == []
    assert hits(mode="bm25", source=F.col("source") == "x") == [] and search.pool(50, True) == 200 and search.pool(50, False) == 50
    with pytest.raises(ValueError):
        hits(mode="other")


def test_process_and_refine(spark, library):
    _, index, _, _ = library
    segs = spark.createDataFrame([("s1", "beta and delta")], "seg_id string, text string")
    words = spark.createDataFrame([("s1", "delta"), ("s1", "absent")], "seg_id string, term string")
    got = {(r.term, r.id) for r in search.process(index, segs, words).collect()}
    assert got == {("", 1), ("", 2), ("", 5), ("delta", 5)}
    assert [r.id for r in search.refine(index, spark.createDataFrame([(0, "delta")], "query_id bigint, term string")).collect()] == [5]


def test_corpora(spark, library, tmp_path):
    library[0].write.parquet(str(tmp_path / "a"))
    found, wrong = search.open_corpora(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}, {"a": "m@5"})
    assert list(found) == ["a"] and wrong == {"b": "missing"}
    with pytest.raises(ValueError):
        search.open_corpora(spark, {"b": str(tmp_path / "b")}, {})
    hits, first = search.union_search(library[0], library[0].select("doc_id", "text"), "GAMMA", ["doc_id"])
    assert [(r.doc_id, r.total) for r in first.collect()] == [(2, 2), (3, 2)]


def test_knn_skips_bad_rows(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.6, 0.8])], "vec_id bigint, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    assert [r.id for r in search.knn(v, q, 5).orderBy("rank0").collect()] == [1, 4]
    assert search.knn(v, q.limit(0), 5).count() == 0
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [0.0, 1.0])], "query_id bigint, embedding array<float>")
    assert {r.query_id for r in search.knn(v, odd, 1).collect()} == {0, 3}


def test_sync_twice_is_unchanged(spark):
    f = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "path string, mtime double, text string")
    m = index.manifest(f)
    assert {r.status for r in index.sync_rows(m, m).collect()} == {"unchanged"}
    assert [r.path for r in index.pruned(spark.createDataFrame([("/a/b/x",), ("/a/bc/y",)], "path string"), "/a/b", spark.createDataFrame([], "path string")).collect()] == ["/a/b/x"]


def test_merged_intervals_are_disjoint(spark):
    rows = [(k, float(s), float(s + d)) for k in (1, 2) for s, d in np.random.default_rng(1).integers(0, 60, (40, 2)).tolist()]
    got = timeline.merge_intervals(spark.createDataFrame(rows, "k int, start double, end double"), ["k"]).orderBy("k", "start").collect()
    assert all(a.k != b.k or a.end < b.start for a, b in zip(got, got[1:], strict=False)) and sum(r.n for r in got) == len(rows)


def test_span_times(spark):
    row = spark.sql("select array(array(100, 200), array(300, 450)) as t, cast(array() as array<array<int>>) as e").select(timeline.span_time(F.col("t")), timeline.span_time(F.col("e"))).first()
    assert tuple(row[0]) == (0.1, 0.45) and tuple(row[1]) == (0.0, 0.0)


def test_voices(spark):
    draw = np.random.default_rng(0)
    x = np.stack([(np.array([1, 0, 0.0]) if i % 2 else np.array([0, 1, 0.0])) + draw.normal(0, 0.05, 3) for i in range(10)])
    assert voice.refit(x) == voice.assign(voice.unit(x)) == [0, 1] * 5
    assert voice.refit(x[:2]) == [0, 0] and voice.inherit_labels(["p", "q"] * 5, [0, 1] * 5) == ["p", "q"] * 5
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 0.0, 1.0])], "query_id bigint, emb array<double>")
    p = spark.createDataFrame([("ann", [1.0, 0.1, 0.0]), ("bob", [0.0, 1.0, 0.0])], "person string, emb array<double>")
    got = {r.query_id: r for r in voice.match(q, p).collect()}
    assert got[0].person == "ann" and got[0].ok and not got[1].ok and got[1].person == "bob"


def test_voices_without_prints_or_vectors(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0]), (3, [0.0, None]), (4, [0.6, 0.8])], "query_id bigint, emb array<double>")
    p = spark.createDataFrame([("ann", [1.0, 0.0]), ("bob", None), ("cay", [0.0, 1.0]), (None, [1.0, 0.0]), ("dan", [1.0])], "person string, emb array<double>")
    assert {(r.query_id, r.person) for r in voice.match(q, p).collect()} == {(0, "ann"), (4, "cay")}
    assert voice.match(q, p.limit(0)).count() == voice.match(q.limit(0), p).count() == 0
    c = voice.cluster(spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, None), (1, 3, [1.0]), (1, 4, [0.9, 0.1])], "s int, i int, v array<double>"), "s", "i", "v")
    assert {(r.i, r.cluster) for r in c.collect()} == {(1, 0), (2, None), (3, None), (4, 0)}
    assert voice.enroll(spark.createDataFrame([("a", 1, "m", None), ("a", 2, "m", [1.0])], "person string, seq bigint, meeting string, emb array<double>")).first().kept == [2]


def test_matches_in_blocks(spark, monkeypatch):
    draw = np.random.default_rng(5)
    x, y, who = draw.standard_normal((40, 6)), draw.standard_normal((70, 6)), draw.integers(0, 9, 70)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "query_id bigint, emb array<double>")
    p = spark.createDataFrame([(f"p{w}", v.tolist()) for w, v in zip(who, y, strict=True)], "person string, emb array<double>")
    cos = voice.unit(x) @ voice.unit(y).T
    best = np.stack([cos[:, who == k].max(1) for k in range(9)], 1)
    monkeypatch.setattr(voice, "NUMBERS", 60)
    got = {r.query_id: r for r in voice.match(q, p).collect()}
    assert all(got[i].person == f"p{best[i].argmax()}" and got[i].second == pytest.approx(max(0, np.sort(best[i])[-2]), abs=1e-6) for i in range(40))
    monkeypatch.setattr(search, "VECTORS", 60)
    hits = search.knn(p.withColumn("vec_id", F.monotonically_increasing_id()).withColumnRenamed("emb", "embedding"), q.withColumnRenamed("emb", "embedding"), 3).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s")).collect()
    assert all(r.s == pytest.approx(np.sort(x[r.query_id] @ y.T)[::-1][:3], abs=1e-6) for r in hits) and len(hits) == 40


@pytest.mark.parametrize("seed", range(6))
def test_average_linkage_by_hand(seed):
    """Heights are those of merging the nearest pair of clusters, by the mean of all distances between them, again and again."""
    x = np.random.default_rng(seed).standard_normal((14, 4))
    d, groups, heights = 1 - voice.unit(x) @ voice.unit(x).T, [[i] for i in range(14)], []
    while len(groups) > 1:
        h, i, j = min((d[np.ix_(groups[i], groups[j])].mean(), i, j) for i in range(len(groups)) for j in range(i))
        heights.append(h)
        groups[j] = groups[j] + groups.pop(i)
    assert sorted(m[2] for m in voice.average_linkage(x)[0]) == pytest.approx(heights)


def test_voice_commands(spark):
    state = spark.createDataFrame([("s1", "ann"), ("s2", ""), ("s3", "bob")], "spk string, value string")
    log = spark.createDataFrame([(1, "reassign", "s2", "ann"), (2, "deny", "s1", "bob"), (3, "unbind", "s3", ""), (4, "rename", "s4", "cay")], "seq int, op string, spk string, value string")
    assert {r.spk: (r.value, r.denied, r.rev) for r in voice.commands(state, log).collect()} == {"s1": ("", ["bob"], 0), "s2": ("ann", [], 1), "s3": ("", [], 1), "s4": ("cay", [], 1)}


def test_enroll(spark):
    rows = [("a", i, f"m{i}", v) for i, v in enumerate([[1.0, 0.0], [1.0, 0.01], [0.0, 1.0]])]
    r = voice.enroll(spark.createDataFrame(rows, "person string, seq bigint, meeting string, emb array<double>")).first()
    assert r["count"] == 3 and r.kept == [0, 2] and r.meetings == ["m0", "m1", "m2"]


def run_fold(*spans):
    rows = []
    for text, start, end, window_end in spans:
        fold.fold(rows, text, start, end, window_end)
    return [(r.text, r.start, r.end) for r in rows]


def test_fold_cases():
    assert run_fold(("今天的进度汇报例会", 0, 3, 5), ("今天的进度汇报例会先说时间", 0.1, 4, 5)) == [("今天的进度汇报例会先说时间", 0, 4)]
    assert len(run_fold(("我这边放了。", 0, 2, 9), ("完全不同的一句话。", 0.1, 2.1, 9))) == 2
    assert run_fold(("不及回宿舍做饭了咱，", 0, 2, 3), ("们去伙房吃吧。", 2.5, 4, 5)) == [("不及回宿舍做饭了咱们去伙房吃吧。", 0, 4)]
    assert run_fold(("机房进场这个时间不", 0, 5, 6), ("进场这个时间不是我们定的", 3, 7, 8))[0][0] == "机房进场这个时间不是我们定的"
    assert run_fold(("嗯", 0, 1, 2)) == []


def table_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@given(st.text(alphabet="ab。c", max_size=12), st.text(alphabet="ab。c", max_size=12))
@settings(max_examples=300, deadline=None)
def test_common_and_seam(a, b):
    assert fold.common(a, b) == table_lcs(a, b)
    assert fold.seam(a, b) == max((b[:n] for n in range(2, min(len(a), len(b)) + 1) if a.endswith(b[:n])), key=len, default="")
    assert fold.similarity(a, b) == (0 if not a or not b else 1 if a in b or b in a else table_lcs(a, b) / min(len(a), len(b)))


def test_fold_rules():
    base = ("今天讨论三号楼的施工进度", 10.0, 14.0, 30)
    assert run_fold(base, ("今天讨论三号", 10.1, 12.6, 30)) == [(base[0], 10, 14)]  # heard again, but shorter
    assert run_fold(base, ("今天讨论三号楼", 10.1, 14.0, 30)) == [("今天讨论三号楼", 10.0, 14.0)]  # shorter, of the whole time
    assert run_fold(base, ("施工进度和材料", 12.0, 16.0, 30)) == [("今天讨论三号楼的施工进度和材料", 10, 16)]
    assert run_fold(base, ("三号楼的施工", 11.5, 13.0, 30)) == [(base[0], 10, 14)]  # nothing new
    assert len(run_fold(("说完了这一句。", 0, 2, 9), ("接着说下一件", 2.2, 4, 9))) == 2 and len(run_fold(("还没有说完", 0, 2, 9), ("接着说下一件", 2.4, 4, 9))) == 1
    assert len(run_fold(("还没有说完", 0, 2, 9), ("接着说下一件", 2.6, 4, 9))) == 2 and len(run_fold(("还没有说完，", 0, 2, 9), ("接着说下一件", 2.8, 4, 9))) == 1
    rows = []
    fold.fold(rows, *base)
    assert fold.fold(rows, base[0], 10.0, 14.2, 15) is None and rows[0].end == 14.2 and rows[0].open and rows[0].revisions == 0
    assert len(run_fold(base, (base[0], 41.0, 45.0, 60))) == 2  # out of reach


def test_stream_fold_equals_batch(spark, tmp_path):
    spans = [(1, "今天的进度汇报例会", 0.0, 3.0, 3.5), (1, "今天的进度汇报例会先说时间", 0.1, 4.0, 5.0), (2, "另外一个会议开始了。", 0.0, 2.0, 2.5), (1, "下面说第二件事情。", 6.0, 8.0, 9.0)]
    kinds = "session bigint, text string, start double, end double, window_end double"
    for i, s in enumerate(spans):
        spark.createDataFrame([s], kinds).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    log = windows.run_to_end(fold.fold_stream(session_files.replay(spark, str(tmp_path / "in"), kinds, per_trigger=10)), "update")
    live = timeline.latest(log, ["session", "idx"], ["revisions", "end"])
    key = lambda df: sorted((r.session, r.idx, r.text, r.start, r.end) for r in df.collect())
    assert key(live) == key(fold.fold_batch(spark.createDataFrame(spans, kinds)))


def docx_bytes(paras, rows):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(map(p, paras))}<w:tbl>{table}</w:tbl></w:body></w:document>')
    return out.getvalue()


def test_docx_and_corpus(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx_bytes(["Head", "B" * 130], [["日期", "2024-01-02", "会议地点", ""], ["会议地点", "线上"], ["职务", "x"], ["1", "Ann", "Org"]]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "n.md").write_bytes(b"# T\n" + b"word " * 20 + b"\xff")
    (tmp_path / ".git").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.md").write_text("skip me " * 10)
    (tmp_path / "s.md").write_text("short")
    got = {r.path.rsplit("/", 1)[-1]: r for r in corpus.gather(spark, str(tmp_path)).collect()}
    assert got["a.docx"].text == "B" * 130 and got["a.docx"].metadata == {"date": "2024-01-02", "place": "线上"} and got["bad.docx"].text == ""
    skips = {r.rel: r.skip for r in corpus.corpus(spark, str(tmp_path)).collect()}
    assert skips == {"n.md": None, "node_modules/x.md": "directory", "s.md": "short"}


def test_hotwords_outline(spark):
    lines = spark.createDataFrame([("a", 0, "mtg => meeting # c"), ("b", 0, "mtg -> Meeting"), ("b", 1, "# only"), ("b", 2, "x = y")], "file string, line int, value string")
    assert {tuple(r) for r in corpus.hotwords(lines).collect()} == {("mtg", "Meeting"), ("x", "y")}
    items = corpus.parse_outline(["一、09:00-09:30 项目进度汇报（张伟）", "   说明一行", "2. 讨论预算"])
    assert [(i["topic"], i["slot"], i["speaker"], i["kind"], i["detail"]) for i in items] == [("项目进度汇报", "09:00-09:30", "张伟", "report", "说明一行"), ("讨论预算", "", "", "topic", "")]


def test_plan_round_trip(spark):
    items = spark.createDataFrame([
        ("s", 0, "i1", "risk", "Budget \n now", True, "two\nlines", 'a "b" c', "", 12.0, 0.0, 0.0, 2.5, [("doc", "p 3", "公共"), ("only", "", "")]),
        ("s", 1, "i2", "odd", "", False, "", "", "g9", None, None, None, None, []),
    ], session_files.PLAN)
    about = spark.createDataFrame([("s", "P", None, "2024-01-02T03:04:05"), ("t", "", "M", "")], "session string, project string, meeting string, updated string")
    files = session_files.render_plan(items, about)
    text = {r.session: r.text for r in files.collect()}
    assert text["s"] == f'''---
type: speaking-plan
project: P
updated: 2024-01-02T03:04:05
items: 2
---

{session_files.PLAN_HEAD}
## 1. Budget now

<!-- plan id=i1 kind=risk done=true src="a \\"b\\" c" x=12 z=2.5 -->

two
lines

- 参考：doc — p 3［公共库］
- 参考：only

## 2. （未命名）

<!-- plan id=i2 kind=topic done=false seg=g9 -->
'''
    assert text["t"].startswith("---\ntype: speaking-plan\nmeeting: M\nitems: 0\n---\n\n# ")
    back = session_files.parse_plans(files)
    assert {r.session: r.text for r in session_files.render_plan(back, about).collect()} == text
    one = back.where("ord = 0").first()
    assert (one.id, one.done, one.detail, one.source, one.nx, one.ny, one.nw, one.nz) == ("i1", True, "two\nlines", 'a "b" c', 12.0, None, 0.0, 2.5)
    assert [tuple(r) for r in one.refs] == [("doc", "p 3", "公共"), ("only", "", "")]


def test_plan_by_hand():
    items = session_files.parse_plan_text("# Title\nnobody's\n## 先说预算\n内容\n- 依据: 文件\n<!-- plan kind=odd done=是 w=abc -->\n### deeper\n##  \n## 3、再说")
    assert [(i["topic"], i["kind"], i["done"], i["detail"], i["nw"], [r["source"] for r in i["refs"]]) for i in items] == [("先说预算", "topic", True, "内容\n### deeper\n##", 0.0, ["文件"]), ("再说", "topic", False, "", 0.0, [])]


def test_session_json_and_partitions(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"session": "s", "unknown": 1, "plan": [{"id": "p", "list": "agenda", "nw": 232.0}], "segments": [{"idx": 1, "text": "a", "start": 0.0, "end": 1.0}]}')
    row = session_files.read_sessions(spark, str(tmp_path / "s.json")).first()
    assert row.plan[0].plan_list == "agenda" and row.plan[0].nw == 0.0 and row.clues is None
    at = str(tmp_path / "t")
    session_files.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), at, "k")
    session_files.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), at, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(at).collect()) == [(1, "a"), (2, "c")]


def test_sessions_round_trip(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"session": "s", "history_rev": 3, "voice_names": {"a": "Ann"}, "plan": [{"id": "p", "plan_list": "agenda", "nw": 5.0}]}')
    one = session_files.read_sessions(spark, str(tmp_path / "s.json"))
    session_files.write_sessions(one, str(tmp_path / "out"))
    assert session_files.read_sessions(spark, str(tmp_path / "out"), False).first() == one.first() and one.first().voice_names == {"a": "Ann"}


def test_frontmatter_lists(spark):
    text = "---\ntype: person\naliases:\n  - An\n  - A: b\nempty:\n---\n# body: x\n"
    got = spark.createDataFrame([(text,), ("none",)], "t string").select(events.frontmatter_lists(F.col("t"))).collect()
    assert got[0][0] == {"type": ["person"], "aliases": ["An", "A: b"], "empty": []} and got[1][0] == {}


def test_command_line(spark, tmp_path, capsys):
    from tidewater.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Alpha\nSome words about the harbour, long enough to be worth it.\n- **[风险]** 可能会延期交付\n")
    main(["index", f"file://{tmp_path}/in", str(tmp_path / "out")])
    main(["search", str(tmp_path / "out"), "harbour"])
    main(["events", f"file://{tmp_path}/in"])
    main(["find", f"file://{tmp_path}/in", "可能会延期交付"])
    said = capsys.readouterr().out
    assert "a.md" in said and "风险" in said and said.count("可能会延期交付") == 1


def test_state(spark):
    cmd = spark.createDataFrame([("ann", "upsert", 1, "x"), ("ann", "upsert", 3, "y"), ("bob", "upsert", 1, "z"), ("bob", "remove", 2, "z")], "name string, op string, seq int, org string")
    assert [tuple(r) for r in state.participants(cmd).collect()] == [("ann", "y")]
    assert state.setting("n", {}, {"n": "4"}, 1) == 4 and state.setting("b", {"b": "yes"}, {}, False) is True and state.setting("q", {}, {}, "d") == "d"


def test_links(spark):
    notes = spark.createDataFrame([("a", "[[b]] and [[b|B]] and [[x#y]]"), ("b", "[[a]]"), ("c", "none")], "note string, text string")
    e = report.edges(notes)
    assert {tuple(r) for r in report.broken(e, notes).select("note", "target").collect()} == {("a", "x")}
    assert {r.note: r.degree for r in report.degrees(e, notes).collect()} == {"a": 2, "b": 2, "c": 0}
