"""Session JSON, plan files, and sinks: segments, transcripts, change feeds, dynamic partition overwrite."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SESSION = """session string, history_rev bigint,
participants array<struct<id: string, name: string, org: string, role: string, voice_id: string>>,
voice_names map<string, string>,
segments array<struct<id: string, idx: bigint, text: string, start: double, `end`: double, speaker: string, spk: string>>,
clues array<struct<id: string, kind: string, text: string, seg_id: string, t: double, anchor: string, confidence: double, actor: string, due: string, pinned: boolean>>,
plan array<struct<id: string, topic: string, kind: string, done: boolean, detail: string, plan_list: string, list: string, nw: double>>"""


def read_sessions(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Sessions with a fixed schema: unknown keys are dropped, missing ones null, a legacy `list` becomes plan_list, and the
    legacy width 232 becomes 0."""
    raw = spark.read.schema(SESSION).option("multiLine", str(multi_line).lower()).json(path)
    fix = lambda p: p.withField("plan_list", F.coalesce(p["plan_list"], p["list"])).withField("nw", F.when(p["nw"] == 232.0, 0.0).otherwise(F.coalesce(p["nw"], F.lit(0.0)))).dropFields("list")
    return raw.withColumn("plan", F.transform(F.coalesce("plan", F.array().cast(raw.schema["plan"].dataType)), fix))


def write_sessions(sessions: DataFrame, path: str) -> None:
    """Sessions as JSON, one line each, which read_sessions() reads back. Those written before are replaced when all are written."""
    sessions.write.mode("overwrite").json(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite just the partitions that df has; files of others stay. Spark commits each as a whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def segment_json(rows: DataFrame, source: str) -> DataFrame:
    """One JSON document for each session: segments in order, and where they came from."""
    seg = F.struct(F.round("start", 2).alias("start_s"), F.round("end", 2).alias("end_s"), F.lit("?").alias("spk"), "text")
    return rows.groupBy("session").agg(F.to_json(F.struct(F.sort_array(F.collect_list(seg)).alias("segments"), F.lit(source).alias("source"))).alias("value"))


def publish(batch: DataFrame, epoch: int, path: str) -> None:
    """A foreachBatch sink: a batch replaces its own folder, so that a repeated batch leaves no second copy."""
    batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(path)


# Kinds of plan items, and the format of a plan file.
PLAN_KINDS = ("topic", "report", "confirm", "risk", "followup")
NO_TOPIC, REF, KB_OPEN, KB_CLOSE, DASH = "（未命名）", "- 参考：", "［", "库］", " — "
FRONT = re.compile(r"\A---\s*\n(.*?)\n---\s*\n", re.S)
ITEM = re.compile(r"^##\s+(?:\d+[.、]\s*)?(.*)$")
META = re.compile(r"<!--\s*plan\s*(.*?)-->", re.S)
META_VALUE = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)=(\"(?:[^\"\\]|\\.)*\"|\S+)")
REF_LINE = re.compile(r"^\s*[-*]\s*(?:参考|依据)\s*[:：]\s*(.*)$")
KB_TAIL = re.compile(r"［([^［］]+?)库］\s*$")
YES = ("1", "true", "yes", "是")
#: Of our own, as readers skip it: the title, and where a row's kind stands.
PLAN_HEAD = "# 发言计划\n\n> kind: topic / report / confirm / risk / followup\n"

PLAN = """session string, ord bigint, id string, kind string, topic string, done boolean, detail string, source string, seg_id string,
nx double, ny double, nw double, nz double, refs array<struct<source: string, detail: string, kb: string>>"""


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def quoted(c: Column) -> Column:
    """A value of the comment, in quotes where it needs them."""
    return F.when(F.rlike(c, F.lit(r"""^[^\s"'<>]+$""")), c).otherwise(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def render_plan(items: DataFrame, about: DataFrame) -> DataFrame:
    """items (PLAN), about (session, project, meeting, updated) -> session, text: the plan file, the same for the same items."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" {name}="), quoted(c)))
    number = lambda c: F.when(F.col(c) != 0, F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string")))
    kind = F.when(F.col("kind").isin(*PLAN_KINDS), F.col("kind")).otherwise(PLAN_KINDS[0])
    meta = F.concat(
        F.lit("<!-- plan id="), quoted(F.coalesce("id", F.lit(""))), F.lit(" kind="), kind, F.lit(" done="), F.coalesce("done", F.lit(False)).cast("string"),
        F.concat_ws("", part("src", one_line(F.col("source"))), part("seg", F.col("seg_id")), *(part(n, number(c)) for n, c in (("x", "nx"), ("y", "ny"), ("w", "nw"), ("z", "nz")))), F.lit(" -->"),
    )
    detail = F.trim(F.coalesce("detail", F.lit("")))

    def cited(r: Column) -> Column:
        body = F.array_join(F.filter(F.array(one_line(r["source"]), one_line(r["detail"])), lambda x: x != ""), DASH)
        return F.when(body != "", F.concat(F.lit(REF), body, F.when(one_line(r["kb"]) != "", F.concat(F.lit(KB_OPEN), one_line(r["kb"]), F.lit(KB_CLOSE))).otherwise("")))

    refs = F.filter(F.transform(F.coalesce("refs", F.array().cast(items.schema["refs"].dataType)), cited), lambda x: x.isNotNull())
    nth = F.row_number().over(Window.partitionBy("session").orderBy("ord"))
    topic = F.coalesce(F.nullif(one_line(F.col("topic")), F.lit("")), F.lit(NO_TOPIC))
    blocks = F.concat(F.array(F.concat(F.lit("## "), nth.cast("string"), F.lit(". "), topic), meta), F.when(detail != "", F.array(detail)).otherwise(F.array().cast("array<string>")), F.when(F.size(refs) > 0, F.array(F.array_join(refs, "\n"))).otherwise(F.array().cast("array<string>")))
    rows = items.select("session", "ord", F.array_join(blocks, "\n\n").alias("text"))
    joined = rows.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("_items"))
    line = lambda k, c: F.when(one_line(F.col(c)) != "", F.concat(F.lit(f"{k}: "), one_line(F.col(c))))
    known = about.join(joined, "session", "left").withColumn("_items", F.coalesce("_items", F.array().cast(joined.schema["_items"].dataType)))
    front = F.concat_ws("\n", F.lit("---\ntype: speaking-plan"), line("project", "project"), line("meeting", "meeting"), line("updated", "updated"), F.concat(F.lit("items: "), F.size("_items").cast("string")), F.lit("---"))
    text = F.concat_ws("\n\n", front, F.lit(PLAN_HEAD.rstrip("\n")), F.array_join(F.transform("_items", lambda x: x["text"]), "\n\n"))
    return known.select("session", F.concat(F.regexp_replace(text, r"\n+$", ""), F.lit("\n")).alias("text"))


class Part(NamedTuple):
    """A line of a plan file: what it is, and what it holds."""

    kind: str
    value: object

    @staticmethod
    def of(line: str) -> Part:
        tests = (("item", ITEM.match(line) if not line.startswith("###") else None), ("meta", META.search(line)), ("ref", REF_LINE.match(line)))
        kind, found = next(((k, m) for k, m in tests if m), ("", None))
        if found:
            return Part(kind, found[1])
        return Part("note" if line.startswith((">", "<!--")) or not line.strip() else "detail", line.strip())


def meta_of(text: str) -> dict:
    """The comment's values, as columns; what is no number of a place is left out."""
    values = {k: re.sub(r"\\(.)", r"\1", v[1:-1]) if len(v) > 1 and v[0] == v[-1] == '"' else v for k, v in META_VALUE.findall(text)}
    out = {c: values[k] for k, c in (("id", "id"), ("src", "source"), ("seg", "seg_id")) if k in values}
    if "kind" in values:
        out["kind"] = values["kind"] if values["kind"] in PLAN_KINDS else PLAN_KINDS[0]
    if "done" in values:
        out["done"] = values["done"].lower() in YES
    return out | {c: float(values[k]) for k, c in (("x", "nx"), ("y", "ny"), ("w", "nw"), ("z", "nz")) if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", values.get(k, ""))}


def ref_of(text: str) -> dict | None:
    body = " ".join(text.split())
    kb = KB_TAIL.search(body)
    source, _, detail = (body[: kb.start()] if kb else body).strip().partition(DASH)
    return {"source": source.strip(), "detail": detail.strip(), "kb": kb[1] if kb else ""} if source.strip() else None


def parse_plan_text(text: str) -> list[dict]:
    """Tolerant: what a file written by hand leaves out gets its default; lines before the first item are nobody's."""
    parts = [Part.of(x.rstrip()) for x in FRONT.sub("", text or "", count=1).splitlines()]
    starts = [i for i, p in enumerate(parts) if p.kind == "item"]
    out = []
    for begin, end in zip(starts, [*starts[1:], len(parts)], strict=False):
        own = parts[begin + 1 : end]
        item = {"id": "", "kind": PLAN_KINDS[0], "topic": " ".join(parts[begin].value.split()), "done": False, "detail": "\n".join(p.value for p in own if p.kind == "detail"), "source": "", "seg_id": "", "nx": None, "ny": None, "nw": 0.0, "nz": 0.0}
        for p in (p for p in own if p.kind == "meta"):
            item |= meta_of(p.value)
        out.append(item | {"refs": [r for p in own if p.kind == "ref" and (r := ref_of(p.value))]})
    return [{"ord": n} | x for n, x in enumerate(x for x in out if x["topic"])]


def parse_plans(files: DataFrame) -> DataFrame:
    """session, text -> items (PLAN)."""
    names = [x.split()[0] for x in re.sub(r"<.*", "", PLAN.replace("\n", " ")).split(",")]

    def run(frames):
        for f in frames:
            rows = [{"session": s} | x for s, t in zip(f["session"], f["text"], strict=True) for x in parse_plan_text(t)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("session", "text").mapInPandas(run, PLAN)


def replay(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Recorded rows as a stream, a few files at a time: what a live source would publish."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(folder)
