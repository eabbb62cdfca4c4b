"""File sources: Markdown corpora, event inputs, docx, hotword lists, outlines, wav. Files are read by Spark, never by open()."""

from __future__ import annotations

import io
import re
import wave
import zipfile
from typing import NamedTuple
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.index import skip_reason, worth_indexing


def scan(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """path, rel, mtime, size, content of the files under root that fit pattern, recursively."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = re.sub(r"^file:/+", "/", root).rstrip("/") + "/"
    path = F.regexp_replace("path", r"^file:/+", "/")
    return files.select(path.alias("path"), F.substring_index(path, base, -1).alias("rel"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), F.col("length").alias("size"), "content")


def decoded(content: str) -> Column:
    """A binary column as UTF-8 text; invalid bytes become the replacement character."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def corpus(spark: SparkSession, root: str, least: int = 40) -> DataFrame:
    """What is worth indexing under root: rel, text, mtime, size; and why the rest isn't, in skip."""
    files = scan(spark, root).withColumn("text", decoded("content")).drop("content")
    skip = F.coalesce(skip_reason(F.col("rel")), F.when(~worth_indexing(F.col("text"), least), "short"))
    return files.withColumn("skip", skip)


def gather(spark: SparkSession, root: str) -> DataFrame:
    """Event inputs: md, markdown, txt and docx, as path, text and metadata; docx tables give the metadata."""
    files = scan(spark, root, "*.{md,markdown,txt,docx}")
    plain = files.where(~F.rlike(F.lower("path"), F.lit(r"\.docx$"))).select("path", decoded("content").alias("text"), F.create_map().cast("map<string,string>").alias("metadata"))
    return plain.unionByName(docx(files.where(F.rlike(F.lower("path"), F.lit(r"\.docx$")))).select("path", F.col("body").alias("text"), "metadata"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def paragraphs(root) -> list[str]:
    """Text of each paragraph, tables' cells included; a paragraph isn't searched for further ones."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if _local(node.tag) == "p":
            out.append("".join(t.text or "" for t in node.iter() if _local(t.tag) == "t"))
        else:
            todo.extend(reversed(node))
    return out


def tables(root) -> list[list[str]]:
    """Rows of all tables, as their cells that aren't empty."""
    rows = []
    for row in (n for n in root.iter() if _local(n.tag) == "tr"):
        cells = ["".join(t.text or "" for t in c.iter() if _local(t.tag) == "t").strip() for c in row if _local(c.tag) == "tc"]
        rows.append([c for c in cells if c])
    return rows


# Keys of a table's metadata, and what lines of metadata begin with.
METADATA_KEYS = {"日期": "date", "时间": "time", "会议类型": "kind", "会议内容": "topic", "会议地点": "place", "提交版本": "version"}
METADATA_LINE = re.compile(r"^(?:提交版本|提交日期|会议信息|会议类型|会议内容|会议地点|日期|时间|记录单位|序号|与会人员|职务|单位|备注|数据来源)\b")


def table_metadata(rows: list[list[str]]) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """What follows a known key in its row, the first that isn't empty; numbered rows of 3 cells or more are attendees."""
    pairs = ((METADATA_KEYS[k], v.strip()) for cells in rows for k, v in keyed(cells))
    meta: dict[str, str] = {}
    for k, v in pairs:
        meta[k] = meta.get(k) or v
    return meta, [(cells[1], cells[-1]) for cells in rows if len(cells) >= 3 and re.fullmatch(r"\d+", cells[0])]


def keyed(cells: list[str]):
    """(key, value) of neighbouring cells; a value isn't looked at as a key."""
    free = 0
    for i, (k, v) in enumerate(zip(cells, cells[1:], strict=False)):
        if i >= free and k.strip() in METADATA_KEYS:
            free = i + 2
            yield k.strip(), v


def body_of(parts: list[str]) -> str:
    """The longest paragraph if it has 120 characters, else all over 12 characters that aren't metadata."""
    longest = max(parts, key=len, default="")
    return longest if len(longest) >= 120 else "\n".join(p for p in parts if len(p) > 12 and not METADATA_LINE.match(p))


def docx(files: DataFrame) -> DataFrame:
    """path, content -> path, paragraphs, body, metadata, attendees. A file that isn't a docx gives empty fields."""

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows.append((path, [], "", {}, []))
                    continue
                parts = paragraphs(root)
                meta, people = table_metadata(tables(root))
                rows.append((path, parts, body_of(parts), meta, [{"name": n, "org": o} for n, o in people]))
            yield pd.DataFrame(rows, columns=["path", "paragraphs", "body", "metadata", "attendees"])

    return files.select("path", "content").mapInPandas(run, "path string, paragraphs array<string>, body string, metadata map<string,string>, attendees array<struct<name: string, org: string>>")


def hotwords(lines: DataFrame) -> DataFrame:
    """file, line, value -> wrong, right: `wrong => right`, `wrong -> right` or `wrong = right`; `#` starts a comment, and of
    several rights for a wrong the last, by file and line, counts."""
    text = F.trim(F.regexp_replace("value", r"#.*$", ""))
    shape = r"^(.+?)\s*(?:=>|->|=)\s*(.+)$"
    pairs = lines.select("file", "line", F.trim(F.regexp_extract(text, shape, 1)).alias("wrong"), F.trim(F.regexp_extract(text, shape, 2)).alias("right")).where("wrong != '' and right != ''")
    return pairs.groupBy("wrong").agg(F.max_by("right", F.struct("file", "line")).alias("right"))


def hotword_files(spark: SparkSession, root: str) -> DataFrame:
    """The lines of a folder's *.txt. Line numbers come from each file's whole text, so they don't depend on splits."""
    files = scan(spark, root, "*.txt").select(F.col("rel").alias("file"), F.posexplode(F.split(decoded("content"), r"\r?\n")).alias("line", "value"))
    return hotwords(files)


def wav(files: DataFrame, rate: int = 16000) -> DataFrame:
    """path, content -> path, seconds, samples (mono float at `rate`): 8, 16 and 32 bit, channels averaged, resampled by line."""

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    width, channels, own, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
                x = (np.frombuffer(raw, "u1").astype("f4") - 128) / 128 if width == 1 else np.frombuffer(raw, f"<i{width}").astype("f8") / float(1 << (8 * width - 1))
                x = x.reshape(-1, channels).mean(1)
                n = round(len(x) * rate / own)
                x = np.interp(np.arange(n) * own / rate, np.arange(len(x)), x) if own != rate and len(x) else x
                rows.append((path, len(x) / rate, x.astype("f4").tolist()))
            yield pd.DataFrame(rows, columns=["path", "seconds", "samples"])

    return files.select("path", "content").mapInPandas(run, "path string, seconds double, samples array<float>")


def pcm16(samples: Column) -> Column:
    """Samples clipped to 16-bit integers."""
    return F.transform(samples, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("smallint"))


# Patterns of an outline's lines, and words that say what kind of item a topic is.
NUMBER = re.compile(r"^\s*(?:[一二三四五六七八九十]+[、.．)）]|第[一二三四五六七八九十\d]+[项条点]|\d+[、.．)）]|[(（]\d+[)）]|[（(][一二三四五六七八九十]+[)）])\s*")
BULLET = re.compile(r"^\s*[-*•·‣◦]\s+")
SLOT = re.compile(
    r"^\s*(?:"
    r"[上下]午\s*"
    r"|\d{1,2}\s*[:：]\s*\d{2}\s*(?:[-—~至到]\s*\d{1,2}\s*[:：]\s*\d{2})?"
    r"|[一二三四五六七八九十两]{1,3}\s*[点时时](?:半|一刻|三刻|整)?(?:\s*[-—~至到]\s*[一二三四五六七八九十两]{1,3}\s*[点时时](?:半|一刻|三刻|整)?)?"
    r")\s*[-—:：、.]?\s*"
)
SLOT_REST = re.compile(
    r"^(?:[一二三四五六七八九十两\d]{1,3}\s*[点时时](?:半|一刻|三刻|整)?(?:\s*[-—~至到]\s*[一二三四五六七八九十两\d]{1,3}\s*[点时时](?:半|一刻|三刻|整)?)?"
    r"|\d{1,2}\s*[:：]\s*\d{2}(?:\s*[-—~至到]\s*\d{1,2}\s*[:：]\s*\d{2})?)"
)
TITLE = re.compile(r"会议(?:流程|议程|安排|日程)$|^(?:流程|议程|日程|安排)表?$|^[\u4e00-\u9fff]{2,12}(?:会议|评审会|例会)(?:议程|流程|安排)?$")
OWNER = re.compile(r"(?:负责人|主持人|主持|主讲|汇报人|汇报|召集人|召集)\s*[:：]\s*([\u4e00-\u9fff]{2,4})|[@＠]([\u4e00-\u9fff]{2,4})|[（(]\s*([\u4e00-\u9fff]{2,4})\s*[)）]\s*$")
NOISE = re.compile(r"^[\s\-—_=*#·。，、；：]+$")
NOTE = re.compile(r"^\s*(?:备注|说明|注意|注|提示)\s*[:：]")
EMPTY_BRACKETS = re.compile(r"[（(]\s*[)）]")
GOES_ON = re.compile(r"^(?:接下来|然后|另外|此外|其次|最后|同时|并且|而且|以及|其中|针对|关于|为了|由于|因此|所以|但|而|并|或|和|与|及|等)")
UNFINISHED, LONG = ("，", ",", "、", "：", ":"), 40
KIND_WORDS = (("confirm", r"确认|审定|签字|拍板"), ("report", r"汇报|介绍|说明|通报"), ("followup", r"上次|遗留|跟进|落实"))


class Line(NamedTuple):
    """A line of an outline, taken apart."""

    text: str
    rest: str
    slot: str
    marked: bool
    indented: bool

    @staticmethod
    def of(raw: str) -> Line:
        text = raw.strip()
        bare = BULLET.sub("", NUMBER.sub("", text)).strip() if NUMBER.match(text) or BULLET.match(text) else text
        marked, slot, time = bare != text, "", SLOT.match(bare)
        if time:
            slot, bare = time[0].strip(" -—:：、."), bare[time.end() :].strip()
            more = SLOT_REST.match(bare)
            if more:
                slot, bare = (slot + more[0]).strip(), bare[more.end() :].strip()
        return Line(text, bare, slot, marked or slot != "", raw[:1] in (" ", "\t", "\u3000"))

    def stands_alone(self, topic: str) -> bool:
        """Whether an unmarked line is an item of its own after one with this topic: short, with nothing that says that it goes on."""
        return not self.indented and max(len(self.text), len(topic)) < LONG and not GOES_ON.match(self.text) and not topic.rstrip().endswith(UNFINISHED)


def opened(line: Line) -> dict:
    """A new item. An owner is lifted from its topic, with the brackets that are left empty."""
    found = OWNER.search(line.rest)
    topic = EMPTY_BRACKETS.sub("", OWNER.sub("", line.rest).strip(" 　·-—")).strip() if found else line.rest
    return {"topic": topic, "slot": line.slot, "speaker": next(filter(None, found.groups())) if found else "", "detail": ""}


def parse_outline(lines: list[str]) -> list[dict]:
    """Agenda items: a number, a bullet or a time begins one, and so does a line that stands alone; others go on with the item
    above. Headings end an item; the document's title, before any item, and lines of marks are nothing; a note goes to the last
    finished item. Wording gives the kind."""
    items: list[dict] = []
    begun, current = False, None
    for raw in lines:
        line = Line.of(raw or "")
        if not line.text or NOISE.match(line.text) or not begun and TITLE.search(line.text) and not line.text.startswith("#"):
            continue
        if line.text.startswith("#"):
            current = None
        elif NOTE.match(line.text):
            done = items[:-1] if current else items
            if done:
                done[-1]["detail"] = f"{done[-1]['detail']} {NOTE.sub('', line.text).strip()}".strip()
        elif line.marked or current is None or line.stands_alone(current["topic"]):
            begun, current = True, opened(line)
            items = [*(i for i in items if i["topic"]), current]
        else:
            current["detail"] = f"{current['detail']} {line.rest}".strip()
    kind = lambda topic: next((k for k, words in KIND_WORDS if re.search(words, topic)), "topic")
    return [i | {"kind": kind(i["topic"])} for i in items if i["topic"]]


def outlines(docs: DataFrame) -> DataFrame:
    """path, text -> path, pos, topic, slot, speaker, detail, kind."""

    def run(frames):
        for f in frames:
            rows = [(p, i, *x.values()) for p, t in zip(f["path"], f["text"], strict=True) for i, x in enumerate(parse_outline((t or "").split("\n")))]
            yield pd.DataFrame(rows, columns=["path", "pos", "topic", "slot", "speaker", "detail", "kind"])

    return docs.select("path", "text").mapInPandas(run, "path string, pos bigint, topic string, slot string, speaker string, detail string, kind string")


def outline_files(spark: SparkSession, root: str) -> DataFrame:
    """Items of the outlines under root: paragraphs of docx files, lines of all others, the first column of a csv."""
    files = scan(spark, root, "*")
    is_docx = F.rlike(F.lower("path"), F.lit(r"\.docx$"))
    plain = lines_of(files.where(~is_docx).select("path", decoded("content").alias("text")))
    text = plain.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("text"))
    return outlines(text.unionByName(docx(files.where(is_docx)).select("path", F.array_join("paragraphs", "\n").alias("text"))))


def wav_bytes(samples: list[float], rate: int = 16000) -> bytes:
    """A mono 16-bit file of samples, clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, "f8"), -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def lines_of(files: DataFrame) -> DataFrame:
    """path, line (from 0), value; a csv gives its first column."""
    rows = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line", "value"))
    return rows.withColumn("value", F.when(F.rlike(F.lower("path"), F.lit(r"\.csv$")), F.split("value", ",")[0]).otherwise(F.col("value")))

