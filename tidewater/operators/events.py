"""Event table: rule extraction from minutes, exact aggregation, listing, timeline, full-text find, upsert by meeting.

An events table has meeting_id, date, type, content, deadline, owner, section, seq; a missing value is the empty string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import contains_ci, event_key, first_match, parse_model_array, strip
from tidewater.operators import search

TYPES = ["决策", "行动项", "甲方要求", "甲方确认", "己方承诺", "风险", "进度", "议题", "其他"]

# Words that mean a type, section headings, and patterns of lines, owners, dates and deadlines.
SYNONYMS = {"客户要求": "甲方要求", "业主确认": "甲方确认", "确认": "甲方确认", "承诺": "己方承诺", "待办": "行动项", "决定": "决策", "客户确认": "甲方确认", "要求": "甲方要求"}
SECTIONS = [
    ("纪要", r"^#{2,4}\s*\d*[.、]?\s*会议纪要\s*$"),
    ("摘要", r"^#{2,4}\s*\d*[.、]?\s*会议摘要"),
    ("决策", r"^#{2,4}\s*\d*[.、]?\s*(关键决策|决策)"),
    ("行动项", r"^#{2,4}\s*\d*[.、]?\s*(行动项|待办)"),
    ("跟进", r"^#{2,4}\s*\d*[.、]?\s*(后续跟进|后续)"),
    ("议题", r"^#{2,4}\s*\d*[.、]?\s*(议题要点|议题)"),
]
INLINE = r"^\s*[-*•]\s*\*\*\[\s*([^\]]{1,10})\s*\]\*\*\s*(.*)$"
SUFFIX = r"[（(]\s*(?:期限|截止|deadline)\s*[:：]\s*([^）)]+)[）)]\s*$"
METADATA = r"^(?:提交版本|提交日期|会议信息|会议纪要|会议类型|会议内容|会议地点|日期|时间|记录单位|序号|与会人员|结构化事件|数据来源|项目)(?![\p{L}\p{N}_])"
DATES = [r"(\d{4})[-/年.](\d{1,2})[-/月.](\d{1,2})", r"(\d{4})(\d{2})(\d{2})"]
DEADLINES = [
    r"\d{1,2}\s*月\s*\d{1,2}\s*日\s*(?:前|之前|以前|左右)?",
    r"\d{4}\s*[-/年.]\s*\d{1,2}\s*[-/月.]\s*\d{1,2}\s*日?\s*(?:前|之前)?",
    r"(?:本周|下周|本月|下月|节前|月底|年底)[一二三四五六日天]?\s*(?:前|之前)?",
    r"\d+\s*(?:个)?(?:工作日|天|周|月)(?:内|以内|之内)",
]
OWNER_BOLD = r"^\s*[-*]\s*\[[ xX]?\]?\s*\*\*(.+?)\*\*\s*[:：]?\s*(.*)$"
OWNER_TRAIL = r"^\s*[-*]\s*\[[ xX]?\]?\s*(.+?)\s*[（(]([^（()）]{1,12})[)）]\s*$"
BOLD = r"^\*\*(.+?)\*\*\s*[:：]?\s*(.*)$"
CHECKBOX = r"^[-*]\s*\[[ xX]?\]?\s*"
BULLET = r"^[-*•]\s*"
ACTION = r"^[-*]\s*(\[[ xX]?\]\s*)?"
NOTHING = r"未(?:产生|形成|提及|记录|明确)|无(?:明确|具体)?(?:行动项|待办)"
ATTENDEES = r"参会[人方员][^\n]*[:：]\s*(.+)"
ATTENDEE_ROW = r"(?m)^\|\s*(\d+)\s*\|\s*([^|]{1,12})\s*\|\s*([^|]{0,16})\s*\|"
ROSTER = r"^\d+\s+\S+\s+\S+$|^(?:职务|序号|单位|备注)(?![\p{L}\p{N}_])"
INLINE_SECTION, MODEL_SECTION, OTHER, LEAST, LEAST_MODEL, BATCH = "标注", "llm", "其他", 4, 8, 6
#: Sections in the order in which their events are numbered, with the type of their events.
SECTION_TYPE = {"决策": "决策", "行动项": "行动项", "议题": "议题", "跟进": "己方承诺"}


def normalize_date(text: Column) -> Column:
    """YYYY-MM-DD of the first pattern that matches with numbers in range (2000-2100, 1-12, 1-31); else empty."""
    found = []
    for p in DATES:
        y, m, d = (F.regexp_extract(text, p, i) for i in (1, 2, 3))
        n = [F.when(x == "", None).otherwise(x).cast("int") for x in (y, m, d)]
        fits = n[0].between(2000, 2100) & n[1].between(1, 12) & n[2].between(1, 31)
        found.append(F.when(fits, F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))))
    return F.coalesce(*found, F.lit(""))


def find_deadline(text: Column) -> Column:
    """What the first deadline pattern that matches has found, verbatim."""
    return F.trim(first_match(text, DEADLINES))


def meeting_id(path: Column) -> Column:
    """Stem, 40 characters at most, and 8 of the path's sha1."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.substring(stem, 1, 40), F.lit("-"), F.substring(F.sha1(path.cast("binary")), 1, 8))


def frontmatter(text: Column) -> Column:
    """The `k: v` lines between two `---` at the start, as a map; quotes are stripped. None: an empty map."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    pair = lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.substr(x, F.instr(x, ":") + 1)), r"^[\"']|[\"']$", "").alias("v"))
    pairs = F.transform(lines, pair)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def frontmatter_lists(text: Column) -> Column:
    """The front matter with lists, as a map of arrays: `  - x` lines belong to the key above that has no value of its own."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    entry = r"(?m)^(?!  - )([^:\n]+):[ \t]*([^\n]*)((?:\n  - [^\n]*)*)"
    part = lambda n: F.regexp_extract_all(block, F.lit(entry), F.lit(n))
    items = lambda tail: F.transform(F.regexp_extract_all(tail, F.lit(r"\n  - ([^\n]*)"), F.lit(1)), lambda x: F.trim(x))
    values = F.zip_with(part(2), part(3), lambda v, tail: F.when(F.trim(v) != "", F.array(F.trim(v))).otherwise(items(tail)))
    keys = F.transform(part(1), lambda k: F.trim(k))
    last = F.array_distinct(keys)
    return F.map_from_arrays(last, F.transform(last, lambda k: F.element_at(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: p["k"] == k), -1)["v"]))


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")


def meeting_date(text: Column, path: Column) -> Column:
    """Frontmatter meeting_date, then date, then the first 12 lines of the body, then the file's name."""
    front = frontmatter(text)
    head = F.array_join(F.slice(F.split(body(text), "\n"), 1, 12), "\n")
    tries = [F.coalesce(F.try_element_at(front, F.lit("meeting_date")), F.lit("")), F.coalesce(F.try_element_at(front, F.lit("date")), F.lit("")), head, F.element_at(F.split(path, "/"), -1)]
    return F.coalesce(*[F.nullif(normalize_date(t), F.lit("")) for t in tries], F.lit(""))


def sections(minutes: DataFrame) -> DataFrame:
    """path, pos, line, section: the last known heading above each line; lines before any are dropped, unknown ones end none."""
    lines = minutes.select("path", F.posexplode(F.split(body(F.col("text")), "\n")).alias("pos", "line"))
    label = F.coalesce(*[F.when(F.rlike("line", F.lit(p)), F.lit(n)) for n, p in SECTIONS])
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("label", label).withColumn("section", F.last("label", True).over(w)).where(F.col("section").isNotNull() & F.col("label").isNull()).drop("label")


def known_type(name: Column, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """The name's type, by synonyms too; what is none is other."""
    of = F.create_map(*[F.lit(x) for kv in ({t: t for t in TYPES} | synonyms).items() for x in kv])
    return F.coalesce(F.try_element_at(of, name), F.lit(OTHER))


def accepted(rows: DataFrame) -> DataFrame:
    """path, pos, type, content, owner, section -> events of rows whose tidied content is long enough and no metadata, numbered
    from 1 by section and position. A deadline in brackets at the end leaves the content."""
    tidy = F.regexp_replace(F.regexp_replace("content", r"\s+", " "), r"^[ \-–—·]+|[ \-–—·]+$", "")
    rows = rows.withColumn("content", tidy).where((F.length("content") >= LEAST) & ~F.rlike("content", F.lit(METADATA)))
    lifted, bare = F.trim(F.regexp_extract("content", SUFFIX, 1)), F.trim(F.regexp_replace("content", SUFFIX, ""))
    rows = rows.withColumn("deadline", F.when(lifted != "", lifted).otherwise(find_deadline(bare))).withColumn("content", bare)
    place = F.coalesce(F.array_position(F.lit(list(SECTION_TYPE)), F.col("section")), F.lit(0))
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy(place, "pos")))


def inline_rows(lines: DataFrame) -> DataFrame:
    """Bullets that name their own type, wherever they stand."""
    raw = lines.where(F.rlike("line", F.lit(INLINE))).select("path", "pos", F.trim(F.regexp_extract("line", INLINE, 1)).alias("type"), F.trim(F.regexp_extract("line", INLINE, 2)).alias("content"))
    return raw.select("path", "pos", known_type(F.col("type")).alias("type"), "content", F.lit("").alias("owner"), F.lit(INLINE_SECTION).alias("section"))


def section_rows(parts: DataFrame) -> DataFrame:
    """Lines of sections as (type, content, owner): each section has its own marks. Quotes, tables, headings and blank lines
    are none, and an action list's statement that there is nothing isn't either."""
    s, section = strip(F.col("line")), F.col("section")
    some = parts.withColumn("line", s).where((F.col("line") != "") & ~F.rlike("line", F.lit(r"^[>|#]")))
    line = F.col("line")
    marked, boxed, action = F.rlike(line, F.lit(BULLET)), F.rlike(line, F.lit(CHECKBOX)) & F.rlike(line, F.lit(r"^[-*]\s*\[")), F.rlike(line, F.lit(r"^[-*]"))
    item, bold = F.regexp_replace(line, BULLET, ""), lambda c, p, g: F.trim(F.regexp_extract(c, p, g))
    owned = F.rlike(item, F.lit(BOLD))
    decided = [
        (boxed, F.regexp_replace(line, CHECKBOX, ""), F.lit("")), (marked & owned, bold(item, BOLD, 2), bold(item, BOLD, 1)), (marked, item, F.lit("")), (F.lit(True), line, F.lit("")),
    ]
    acted = [
        (F.rlike(line, F.lit(NOTHING)) | ~action, F.lit(None), F.lit("")), (F.rlike(line, F.lit(OWNER_BOLD)), bold(line, OWNER_BOLD, 2), bold(line, OWNER_BOLD, 1)),
        (F.rlike(line, F.lit(OWNER_TRAIL)), bold(line, OWNER_TRAIL, 1), bold(line, OWNER_TRAIL, 2)), (F.lit(True), F.regexp_replace(line, ACTION, ""), F.lit("")),
    ]
    listed = [(marked, item, F.lit(""))]
    cases = [(section == name, rules) for name, rules in (("决策", decided), ("行动项", acted), ("议题", listed), ("跟进", listed))]
    first = lambda n: F.coalesce(*[F.when(here, chosen(rules, n)) for here, rules in cases])

    def chosen(rules: list, n: int) -> Column:
        out = None
        for rule in rules:
            out = F.when(rule[0], rule[n]) if out is None else out.when(rule[0], rule[n])
        return out

    kind = F.element_at(F.create_map(*[F.lit(x) for kv in SECTION_TYPE.items() for x in kv]), section)
    return some.where(section.isin(list(SECTION_TYPE))).select("path", "pos", kind.alias("type"), first(1).alias("content"), first(2).alias("owner"), "section").where("content is not null and content != ''")


def extract_rules(minutes: DataFrame) -> DataFrame:
    """path, text -> events. Where bullets name their own type, a document's events are these; else those of its sections."""
    lines = minutes.select("path", F.posexplode(F.split(body(F.col("text")), "\r\n|\r|\n")).alias("pos", "line"))
    named = inline_rows(lines)
    parted = section_rows(sections(minutes).join(named.select("path").distinct(), "path", "left_anti"))
    return dated(accepted(named.unionByName(parted)), minutes)


def dated(rows: DataFrame, minutes: DataFrame) -> DataFrame:
    about = minutes.select("path", meeting_id(F.col("path")).alias("meeting_id"), meeting_date(F.col("text"), F.col("path")).alias("date"))
    ref = F.when(F.col("section") == MODEL_SECTION, F.col("path")).otherwise(F.concat_ws("#", "path", F.nullif("section", F.lit(""))))
    return rows.join(about, "path").select("meeting_id", "date", "type", "content", "deadline", "owner", "section", ref.alias("source_ref"), "seq", "path")


def clauses(minutes: DataFrame, batch: int = BATCH) -> DataFrame:
    """path, batch, prompt: a document's clauses, numbered, so many to a prompt for a model."""
    parts = F.filter(F.transform(F.split("text", r"(?<=[。；！？])"), strip), lambda c: c != "")
    numbered = F.transform(parts, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c))
    groups = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(batch)), lambda k: F.array_join(F.slice(numbered, k + 1, F.lit(batch)), "\n"))).otherwise(F.array().cast("array<string>"))
    return minutes.select("path", F.posexplode(groups).alias("batch", "prompt"))


def from_model(minutes: DataFrame, replies: DataFrame) -> DataFrame:
    """Events of a model's replies (path, batch, reply; JSON arrays), as far as they hold: content of 8 characters that is no
    metadata or roster, a known type, and a deadline that stands in the text, else the first that the content has."""
    item = "struct<type: string, content: string, deadline: string, owner: string>"
    got = replies.select("path", "batch", F.posexplode(parse_model_array(F.col("reply"), item)).alias("at", "e")).join(minutes, "path")
    said = lambda f: F.trim(F.coalesce(F.col(f"e.{f}"), F.lit("")))
    rows = got.select("path", "text", F.struct("batch", "at").alias("pos"), known_type(said("type"), {}).alias("type"), said("content").alias("content"), said("deadline").alias("_due"), said("owner").alias("owner"), F.lit(MODEL_SECTION).alias("section"))
    rows = rows.where((F.length("content") >= LEAST_MODEL) & ~F.rlike("content", F.lit(METADATA)) & ~F.rlike("content", F.lit(ROSTER)))
    rows = rows.withColumn("deadline", F.when(grounded(F.col("_due"), F.col("text")), F.col("_due")).otherwise(find_deadline(F.col("content")))).drop("_due", "text")
    return dated(rows.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("pos"))), minutes)


def extract(minutes: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Rules first; a document of which they make nothing gets the events of a model's replies, where there are any."""
    ruled = extract_rules(minutes).withColumn("extractor", F.lit("rule"))
    if replies is None:
        return ruled
    rest = minutes.join(ruled.select("path").distinct(), "path", "left_anti")
    return ruled.unionByName(from_model(rest, replies).withColumn("extractor", F.lit("llm")))


def attendees(minutes: DataFrame) -> DataFrame:
    """path, name, org of those listed in the first line of attendees, 2 to 12 characters each, and in rows of tables."""
    text = body(F.col("text"))
    listed = F.transform(F.split(F.regexp_extract(text, ATTENDEES, 1), r"[、,，\s]+"), lambda n: F.regexp_replace(n, r"^[（）() ]+|[（）() ]+$", ""))
    listed = F.filter(listed, lambda n: F.length(n).between(2, 12) & ~F.startswith(n, F.lit("未")))
    person = lambda n, o: F.struct(n.alias("name"), o.alias("org"))
    rows = F.zip_with(F.regexp_extract_all(text, F.lit(ATTENDEE_ROW), F.lit(2)), F.regexp_extract_all(text, F.lit(ATTENDEE_ROW), F.lit(3)), lambda n, o: person(F.trim(n), F.trim(o)))
    people = F.concat(F.transform(F.array_distinct(listed), lambda n: person(n, F.lit(""))), F.filter(rows, lambda r: r["name"] != ""))
    out = minutes.select("path", F.posexplode(people).alias("pos", "p")).select("path", "pos", "p.*")
    first = Window.partitionBy("path", "name").orderBy("pos")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("path", "name", "org")


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Meetings of fresh replace stored ones; within a meeting, of rows with the same key the first stays, empty keys go."""
    keyed = fresh.withColumn("_key", event_key(F.col("content"))).where("_key != ''")
    nth = F.row_number().over(Window.partitionBy("meeting_id", "_key").orderBy("seq"))
    kept = keyed.withColumn("_n", nth).where("_n = 1").drop("_n", "_key")
    return stored.join(fresh.select("meeting_id").distinct(), "meeting_id", "left_anti").unionByName(kept)


def delete_meeting(stored: DataFrame, meetings: DataFrame) -> DataFrame:
    return stored.join(meetings.select("meeting_id"), "meeting_id", "left_anti")


def where(type: str = "", owner: str = "", has_deadline: bool | None = None, date_from: str = "", date_to: str = "") -> Column:
    """The conjunction of what is given. An owner also counts where the content names it; dates compare as strings."""
    out = F.lit(True)
    if type:
        out &= F.col("type") == type
    if owner:
        out &= (F.col("owner") == owner) | contains_ci(F.col("content"), F.lit(owner))
    if has_deadline is not None:
        out &= (F.col("deadline") != "") if has_deadline else (F.col("deadline") == "")
    if date_from:
        out &= F.col("date") >= date_from
    if date_to:
        out &= F.col("date") <= date_to
    return out


def aggregate(events: DataFrame, **conditions) -> DataFrame:
    return events.where(where(**conditions)).agg(F.count(F.lit(1)).alias("total"))


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def list_by(events: DataFrame, meetings: DataFrame, limit: int, **conditions) -> DataFrame:
    """Events with their meeting's title, by date and seq."""
    return events.where(where(**conditions)).join(meetings.select("meeting_id", "title"), "meeting_id", "left").orderBy("date", "seq", "meeting_id").limit(limit)


def timeline(events: DataFrame, meetings: DataFrame, keyword: str, limit: int = 60) -> DataFrame:
    """The first `limit` events that contain keyword, grouped by date, or by meeting where there is none."""
    first = events.where(contains_ci(F.col("content"), F.lit(keyword))).join(meetings.select("meeting_id", "title"), "meeting_id", "left").orderBy("date", "seq", "meeting_id").limit(limit)
    key = F.coalesce(F.nullif("date", F.lit("")), "meeting_id")
    return first.groupBy(key.alias("at")).agg(F.sort_array(F.collect_list(F.struct("seq", "meeting_id", "content"))).alias("items"), F.min(F.nullif("date", F.lit(""))).alias("first_date"), F.max("date").alias("last_date"))


def find(events: DataFrame, queries: DataFrame, limit: int, id_col: str = "event_id") -> DataFrame:
    return search.top(search.bm25(events, queries, id_col=id_col, text_col="content"), limit)


def stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("meeting_id").alias("meetings"), F.countDistinct(F.nullif("date", F.lit(""))).alias("dates"), F.min(F.nullif("date", F.lit(""))).alias("first_date"), F.max("date").alias("last_date"))


def grounded(deadline: Column, text: Column) -> Column:
    """Whether a model's deadline stands in the text, spaces aside."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return (deadline != "") & F.contains(bare(text), bare(deadline))
