"""Clues: typed spans found by rules, their dedup and merge, keywords, hotword correction, alias links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import norm_key, parse_model_array, tokenize

KINDS = ["requirement", "commitment", "deadline", "decision", "risk", "agreement", "clause", "person", "org", "term"]

# Patterns, stop lists, confidences and limits of the rules.
DATE_CORE = (
    r"\d{1,4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*[日号]"
    r"|\d{4}-\d{1,2}-\d{1,2}"
    r"|\d{1,2}\s*月\s*\d{1,2}\s*[日号]"
    r"|\d{1,2}\s*月"
    r"|(?:\d{1,2}|[一二三四五六七八九十两])\s*[日号]"
    r"|(?:\d{1,2}|[一二三四五六七八九十两])\s*(?:天|周|个?月)"
)
DATE_MORE = r"[ 　]*(?:\d{1,2}|[一二三四五六七八九十两])?\s*(?:[日号]|月|年)"
DATE_TAIL = r"(?:之内|以内|以前|之前|左右|前|后|内|底|初)"
DATE_RELATIVE = r"[下本这]\s*(?:周|个月|月)\s*[一二三四五六日天]?|月底|月初|年底|年后|节前|验收前|进场前"
PROMISE = r"(?:我们|我方|我)(?:会|要|将|来|负责|安排|争取|已经)|(?:我们|我方)(?:这边|的)?(?:负责|安排)"
DUTY = r"要(?:尽快|抓紧|加快|提前|保证|确保|注意|加强|做好)"
OBLIGATION = r"必须|应当|不得|需要|要求|务必|尽快|抓紧|不能"
ORG = r"(?<![\d日月号年])([\u4e00-\u9fff]{2,12}?(?:公司|集团|研究院|研究所|学院|大学|医院|测评中心|监理|设计院))"
ORG_STOP = {"有限公司", "公司", "贵公司", "你们公司", "我们公司", "该公司", "第三方"}
ROLE = r"([\u4e00-\u9fff]{2,4})(?:主任|经理|总工|工程师|老师|院长|科长|处长|主管)"
ROLE_STOP = {"负责", "技术", "项目", "主管", "售后", "客户", "甲方", "乙方", "现场", "相关"}
NAMED = r"(?:请|让|由|叫|找)\s*([\u4e00-\u9fff]{2,4})(?=[^\u4e00-\u9fff]|$|来|去|把|说|做|负责|安排)"
PLACEHOLDER = r"姓名或描述|关键词1|关键词2|示例|xxx|XXX|如：|例如"
CLAUSE = r"[，。；！？,;!?]"
DEADLINE_TEXT = "时间节点："
CONFIDENCE = {"date": 0.85, "relative date": 0.7, "promise": 0.7, "duty": 0.7, "obligation": 0.65, "org": 0.8, "role": 0.7, "known": 0.9, "named": 0.5, "model": 0.6}
SHORTEST_CLAUSE, LONGEST_CLAUSE, SHORTEST_ORG, DATE_UNITS = 4, 30, 4, 4

_WIDE = " \u3000"


class Find(NamedTuple):
    """A span of the utterance that a rule would claim."""

    begin: int
    anchor: str
    kind: str
    rule: str


def dates(rule: str, pattern: str):
    """A date's first unit, grown over the units and the one suffix that go on with it."""
    core, rest = re.compile(pattern), re.compile(f"(?:{DATE_MORE}){{0,{DATE_UNITS}}}(?:{DATE_TAIL})?")

    def find(text: str, people) -> Iterator[Find]:
        for m in core.finditer(text):
            yield Find(m.start(), text[m.start() : rest.match(text, m.end()).end()].strip(), "deadline", rule)

    return find


def clause(rule: str, pattern: str, kind: str):
    """The first clause that is long enough and has the pattern; one with a promise is a commitment, whatever the rule."""
    sought, promise = re.compile(pattern), re.compile(PROMISE)

    def find(text: str, people) -> Iterator[Find]:
        parts = (p.strip(_WIDE) for p in re.split(CLAUSE, text))
        first = next((p[:LONGEST_CLAUSE] for p in parts if len(p) >= SHORTEST_CLAUSE and sought.search(p)), "")
        if first:
            yield Find(text.index(first), first, "commitment" if promise.search(first) else kind, rule)

    return find


def names(rule: str, pattern: str, kind: str, group: int, stop: frozenset | set = frozenset(), least: int = 1):
    """What a group of the pattern holds, unless its name (group 1) is stopped or short."""
    sought = re.compile(pattern)

    def find(text: str, people) -> Iterator[Find]:
        for m in sought.finditer(text):
            if m[1].strip(_WIDE) not in stop and len(m[1].strip(_WIDE)) >= least:
                yield Find(m.start(group), m[group].strip(_WIDE), kind, rule)

    return find


def known(text: str, people: tuple[str, ...]) -> Iterator[Find]:
    return (Find(text.index(p), p, "person", "known") for p in people if p and p in text)


#: The rules in the order in which they claim their spans.
RULES = (
    dates("date", DATE_CORE), dates("relative date", DATE_RELATIVE),
    clause("promise", PROMISE, "commitment"), clause("duty", DUTY, "requirement"), clause("obligation", OBLIGATION, "requirement"),
    names("org", ORG, "org", 1, ORG_STOP, SHORTEST_ORG), names("role", ROLE, "person", 0, ROLE_STOP), known, names("named", NAMED, "person", 1),
)


def claims(text: str | None, people: tuple[str, ...] = ()) -> list[Find]:
    """What the rules find in an utterance, each character claimed once."""
    text, free, out = text or "", bytearray(b"\1" * len(text or "")), []
    for rule in RULES:
        for f in rule(text, people):
            end = f.begin + len(f.anchor)
            if f.anchor and all(free[f.begin : end]):
                free[f.begin : end] = bytes(len(f.anchor))
                out.append(f)
    return out


CLUE = "array<struct<kind: string, anchor: string, rule: string, begin: bigint>>"


def extract(df: DataFrame, keys: list[str], text_col: str = "text", people: tuple[str, ...] = ()) -> DataFrame:
    """keys, kind, text, anchor, confidence, begin, end, rule. Claims depend on order, hence an Arrow function; the rest is
    Catalyst's: no placeholders, anchors that stand in the text, and of anchors within one another the longest."""

    @F.pandas_udf(CLUE)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": f.kind, "anchor": f.anchor, "rule": f.rule, "begin": f.begin} for f in claims(t, people)])

    usable = F.filter(found(F.col(text_col)), lambda c: ~F.rlike(c["anchor"], F.lit(PLACEHOLDER)) & F.contains(F.col(text_col), c["anchor"]))
    rows = df.select(*keys, F.explode(longest_of(usable, "begin")).alias("c"))
    confidence = F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), F.col("c.rule"))
    text = F.when(F.col("c.kind") == "deadline", F.concat(F.lit(DEADLINE_TEXT), "c.anchor")).otherwise(F.col("c.anchor"))
    return rows.select(*keys, "c.kind", text.alias("text"), "c.anchor", confidence.alias("confidence"), "c.begin", (F.col("c.begin") + F.length("c.anchor")).alias("end"), "c.rule")


def longest_of(clues: Column, tie: str) -> Column:
    """An array of clues without those whose anchor is in, or holds, that of a longer one that is kept; ties by a field."""
    order = F.array_sort(clues, lambda a, b: F.when(F.length(a["anchor"]) != F.length(b["anchor"]), F.length(b["anchor"]) - F.length(a["anchor"])).otherwise(F.when(a[tie] < b[tie], -1).when(a[tie] > b[tie], 1).otherwise(0)))
    meets = lambda a, b: F.contains(a["anchor"], b["anchor"]) | F.contains(b["anchor"], a["anchor"])
    return F.aggregate(order, F.slice(order, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: meets(k, x)), acc).otherwise(F.concat(acc, F.array(x))))


def from_model(df: DataFrame, keys: list[str], reply_col: str = "reply", text_col: str = "text") -> DataFrame:
    """Clues of a model's reply (a JSON array), as far as they hold: a known kind, an anchor that stands in the utterance, no
    placeholder, a confidence within 0 and 1, and an actor and a due date that the utterance names."""
    clue = "struct<type: string, text: string, anchor: string, confidence: double, actor: string, due: string>"
    got = df.select(*keys, F.col(text_col).alias("_t"), F.explode(parse_model_array(F.col(reply_col), clue)).alias("c"))
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    named = lambda c: F.when(F.contains("_t", said(c)), said(c)).otherwise("")
    text = F.coalesce(F.nullif(said(F.col("c.text")), F.lit("")), said(F.col("c.anchor")))
    rows = got.select(*keys, "_t", F.trim("c.type").alias("kind"), text.alias("text"), said(F.col("c.anchor")).alias("anchor"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c.confidence", F.lit(CONFIDENCE["model"])))).alias("confidence"), named(F.col("c.actor")).alias("actor"), named(F.col("c.due")).alias("due"))
    rows = rows.where(F.col("kind").isin(KINDS) & (F.col("anchor") != "") & F.contains("_t", F.col("anchor")) & ~F.rlike("anchor", F.lit(PLACEHOLDER)) & ~F.rlike("text", F.lit(PLACEHOLDER)))
    fields = ("kind", "text", "anchor", "confidence", "actor", "due")
    kept = rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("_c")).select(*keys, F.explode(longest_of(F.col("_c"), "kind")).alias("c"))
    return kept.select(*keys, *(f"c.{f}" for f in fields))


def anchors(text: Column, pattern: str) -> Column:
    """All matches of one pattern, in Catalyst."""
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def clause_around(text: Column, pattern: str) -> Column:
    """The first clause of 4 characters or more that matches, cut at 30; null if none."""
    return F.substring(F.get(F.filter(F.split(text, CLAUSE), lambda c: F.rlike(c, F.lit(pattern)) & (F.length(c) >= 4)), 0), 1, 30)


def keep_longest(anchors: Column) -> Column:
    """An array without what is contained in, or contains, a longer string that is kept; longest first, ties by text."""
    order = F.array_sort(F.transform(F.array_distinct(anchors), lambda a: F.struct((-F.length(a)).alias("n"), a.alias("a"))))
    words = F.transform(order, lambda s: s["a"])
    return F.aggregate(words, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda k: F.contains(k, x) | F.contains(x, k)), acc).otherwise(F.concat(acc, F.array(x))))


def merge(rules: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    """Full outer by anchor: the rule's text stays; the model may change the kind unless it is person, org or deadline; the
    higher confidence counts; actor and due are filled."""
    a, b = rules.alias("a"), model.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*by, "anchor")]
    kind = F.when(F.col("a.kind").isin("person", "org", "deadline"), F.col("a.kind")).otherwise(F.coalesce("b.kind", "a.kind"))
    return a.join(b, on, "full_outer").select(
        *(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in (*by, "anchor")), kind.alias("kind"), F.coalesce("a.text", "b.text").alias("text"),
        F.greatest("a.confidence", "b.confidence").alias("confidence"), F.coalesce("b.actor", F.lit("")).alias("actor"), F.coalesce("b.due", F.lit("")).alias("due"),
    )


def board(clues: DataFrame, by: list[str]) -> DataFrame:
    """One clue for each kind and thing. Clues of one norm key (of the anchor, or of the text) meet first, by a plain
    aggregate; of what is left of a kind, keys that hold one another meet in order of time, so that the longest text, the first
    filled blanks and the highest confidence stay. The order matters, as a short key can be in several long ones."""
    keyed = clues.withColumn("norm", norm_key(F.coalesce(F.nullif("anchor", F.lit("")), "text")))
    longest = F.max_by("text", F.struct(F.length("text"), "text"))
    parts = keyed.groupBy(*by, "kind", "norm").agg(longest.alias("text"), F.max("confidence").alias("confidence"), F.max("actor").alias("actor"), F.max("due").alias("due"), F.max("pinned").alias("pinned"), F.min("t").alias("t"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    names = parts.columns

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for c in f.sort_values(["t", "norm"])[names].to_dict("records"):
            same = next((k for k in kept if c["norm"] in k["norm"] or k["norm"] in c["norm"]), None)
            if same is None or not c["norm"]:
                kept.append(c)
                continue
            if len(c["text"]) > len(same["text"]):
                same |= {"text": c["text"], "norm": max(same["norm"], c["norm"], key=len)}
            same |= {k: same[k] or c[k] for k in ("actor", "due")} | {k: max(same[k], c[k]) for k in ("confidence", "pinned")}
        return pd.DataFrame(kept, columns=names)

    return parts.groupBy(*by, "kind").applyInPandas(meet, kinds)


def ordered(clues: DataFrame) -> DataFrame:
    """Pinned first, then by kind's order, time and id."""
    place = F.array_position(F.lit(KINDS), F.col("kind"))
    nth = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("pinned"), place, "t", "id"))
    return clues.withColumn("place", nth.cast("bigint"))


def keywords(df: DataFrame, keys: list[str], text_col: str, stop: list[str], n: int = 6) -> DataFrame:
    """The n most frequent tokens of 2 to 8 characters of each row, first seen first on ties."""
    toks = df.select(*keys, F.posexplode(tokenize(F.col(text_col))).alias("pos", "term")).where(F.length("term").between(2, 8) & ~F.col("term").isin(stop))
    counted = toks.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "pos"))
    return counted.withColumn("rank", nth.cast("bigint")).where(F.col("rank") <= n)


def grounded(words: Column, text: Column, most: int = 6) -> Column:
    """Keywords that stand in the text and in no longer one that is kept, longest first, then by place and term; `most` of them."""
    placed = F.transform(F.filter(F.array_distinct(words), lambda w: (w != "") & F.contains(text, w)), lambda w: F.struct((-F.length(w)).alias("n"), F.instr(text, w).alias("at"), w.alias("w")))
    order = F.transform(F.array_sort(placed), lambda s: s["w"])
    kept = F.aggregate(order, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda k: F.contains(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.slice(kept, 1, most)


def keyword_scores(got: Column, gold: Column) -> Column:
    """struct(precision, recall, f1, noise); a match is containment either way."""
    near = lambda a, b: F.filter(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))
    p = F.when(F.size(got) > 0, F.size(near(got, gold)) / F.size(got)).otherwise(F.lit(0.0))
    r = F.when(F.size(gold) > 0, F.size(near(gold, got)) / F.size(gold)).otherwise(F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"), (1 - p).alias("noise"))


def hamming(a: Column, b: Column) -> Column:
    """Unlike characters of two strings of one length."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda v: v))


def fuzzy_candidates(texts: DataFrame, targets: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Windows of a text that are nearly a target of the same length: 1 unlike character up to length 3, else 2.

    A pair within that distance agrees exactly on one of three parts of the string, so windows and targets meet in equi-joins
    on (length, part, its text), never on length alone."""
    t = targets.select(F.col("target"), F.length("target").alias("n")).where("n between 2 and 24")
    w = texts.select(*keys, F.col(text_col).alias("_t")).crossJoin(F.broadcast(t.select("n").distinct()))  # 23 lengths at most
    w = w.where(F.length("_t") >= F.col("n")).select(*keys, "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("_t") - F.col("n") + 1), lambda i: F.struct(i.alias("at"), F.substr("_t", i, F.col("n")).alias("window")))).alias("s")).select(*keys, "n", "s.*")
    cut = lambda c: F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.substr(c, (F.floor(F.col("n") * k / 3) + 1).cast("int"), (F.floor(F.col("n") * (k + 1) / 3) - F.floor(F.col("n") * k / 3)).cast("int")).alias("piece")) for k in range(3)]))
    a = w.withColumn("p", cut(F.col("window"))).select(*keys, "n", "at", "window", "p.part", "p.piece").where("piece != ''")
    b = t.withColumn("p", cut(F.col("target"))).select("target", "n", "p.part", "p.piece").where("piece != ''")
    near = a.join(b, ["n", "part", "piece"]).where("window != target").withColumn("distance", hamming(F.col("window"), F.col("target")))
    return near.where(F.col("distance") <= F.when(F.col("n") <= 3, 1).otherwise(2)).select(*keys, "at", "window", "target", "distance").distinct()


def sounding(candidates: DataFrame, key=F.soundex, least: float = 0.85) -> DataFrame:
    """Candidates that sound alike: 1 - edit distance of their phonetic keys over the longer key, at least `least`. key: Column to
    Column; a language's own phonetic key goes in here."""
    a, b = key(F.col("window")), key(F.col("target"))
    score = 1 - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b))
    return candidates.withColumn("score", score).where(F.col("score") >= least)


def pick_fixes(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Non-overlapping corrections of each text: the best score first where there is one, else the least distance; then the
    longest, then the first."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        best = -f["score"] if "score" in f else f["distance"]
        f = f.assign(_b=best, _n=-f["window"].str.len()).sort_values(["_b", "_n", "at", "target"])
        taken: list[tuple[int, int]] = []
        keep = []
        for i, at, n in zip(f.index, f["at"], -f["_n"], strict=True):
            if not any(at < y and x < at + n for x, y in taken):
                taken.append((at, at + n))
                keep.append(i)
        return f.loc[keep].drop(columns=["_b", "_n"])

    return candidates.groupBy(*keys).applyInPandas(fold, kinds)


def corrected(texts: DataFrame, fixes: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Texts with their corrections put in, from the last to the first, so that places hold."""
    of = fixes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), "target")), False).alias("_f"))
    put = F.aggregate(F.col("_f"), F.col(text_col), lambda acc, f: F.concat(F.substr(acc, F.lit(1), f["at"] - 1), f["target"], F.substr(acc, f["at"] + F.length(f["target"]))))
    return texts.join(of, keys, "left").withColumn(text_col, F.coalesce(put, F.col(text_col))).drop("_f")


def for_segment(clues: DataFrame, seg_id) -> DataFrame:
    return clues.where(F.col("seg_id") == seg_id)


def edited(clues: DataFrame, log: DataFrame) -> DataFrame:
    """Clues (id, kind, text, pinned, ...) after a log of edits (seq, op, id, kind, text, pinned): the last value that an update
    gives counts, an unknown kind is a term, and what is removed goes."""
    last = lambda c: F.max_by(c, F.struct(F.col(c).isNotNull(), "seq")).alias(f"_{c}")
    per = log.groupBy("id").agg(F.bool_or(F.col("op") == "remove").alias("_gone"), *(last(c) for c in ("kind", "text", "pinned")))
    rows = clues.join(per, "id", "left").where(~F.coalesce("_gone", F.lit(False)))
    kind = F.coalesce("_kind", "kind")
    rows = rows.withColumn("kind", F.when(kind.isin(KINDS), kind).otherwise("term")).withColumn("text", F.coalesce("_text", "text")).withColumn("pinned", F.coalesce("_pinned", "pinned"))
    return rows.select(*clues.columns)


def hotword_targets(participants: DataFrame, clues: DataFrame) -> DataFrame:
    """Names and organisations of participants, and anchors of person, org and term clues, of 2 to 24 characters."""
    names = participants.select(F.explode(F.array("name", "org")).alias("target"))
    return names.union(clues.where(F.col("kind").isin("person", "org", "term")).select("anchor")).where(F.length("target").between(2, 24)).distinct()


def alias_index(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entity, names array -> (name, entity) for names of one entity, and the names that several claim."""
    spelled = entities.select("entity", F.explode("names").alias("name")).where("name != ''").distinct()
    owners = spelled.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("entity"))
    return owners.where("n = 1").select("name", "entity"), owners.where("n > 1").select("name", "n")


LINKED = re.compile(r"(\[\[.*?\]\]|`[^`]*`)", re.DOTALL)


def linkify(text: str, names: dict[str, str], own: str = "") -> str:
    """Link the first mention of each entity, longest names first, outside links and code, never to the note itself."""
    done: set[str] = set()
    for name in sorted(names, key=lambda n: (-len(n), n)):
        entity = names[name]
        if entity == own or entity in done:
            continue
        parts = LINKED.split(text)
        for i in range(0, len(parts), 2):
            if name in parts[i]:
                link = f"[[{entity}]]" if entity == name else f"[[{entity}|{name}]]"
                parts[i] = parts[i].replace(name, link, 1)
                done.add(entity)
                break
        text = "".join(parts)
    return text


def linked(notes: DataFrame, names: DataFrame, note_col: str = "note", text_col: str = "text") -> DataFrame:
    """Notes with their first mentions linked. names: (name, entity), of which only those go to a note that it mentions: by the
    note's runs of letters and digits, so that neither side is held whole."""
    words = lambda c: F.array_distinct(tokenize(c))
    first = names.where("name != ''").withColumn("_w", F.get(words(F.col("name")), 0)).where("_w is not null")
    inside = notes.select(note_col, text_col, F.explode(words(F.col(text_col))).alias("_w")).join(first, "_w").where(F.contains(text_col, F.col("name")))
    mentioned = inside.groupBy(note_col).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("name", "entity")))).alias("_names"))

    @F.pandas_udf("string")
    def put(text: pd.Series, names: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([linkify(t or "", dict(n or {}), o) for t, n, o in zip(text, names, own, strict=True)], dtype=object)

    rows = notes.join(mentioned, note_col, "left")
    return rows.withColumn(text_col, F.when(F.col("_names").isNull(), F.col(text_col)).otherwise(put(F.col(text_col), F.col("_names"), F.col(note_col).cast("string")))).drop("_names")
