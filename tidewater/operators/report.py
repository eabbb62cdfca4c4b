"""Reports and the link graph: minutes, per-person clues, roster merge, broken links, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINK = r"\[\[([^\]|#]+)"
ACTIONABLE = ["requirement", "commitment", "deadline", "decision", "risk"]


def clock(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("bigint"), whole % 60)


def minutes(clues: DataFrame, by: list[str], order: list[str], keep: int | None = None) -> DataFrame:
    """Sections of a report: for each kind its lines in order, as one text."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = clues.withColumn("_n", nth)
    rows = rows.where(F.col("_n") <= keep) if keep else rows
    lines = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_n", "line"))).alias("_l"), F.count(F.lit(1)).alias("n"))
    return lines.select(*by, "n", F.array_join(F.transform("_l", lambda s: s["line"]), "\n").alias("body"))


def person_clues(clues: DataFrame, segments: DataFrame, most: int = 4) -> DataFrame:
    """Actionable clues of a person: the actor, or else the speaker of the segment; the first few of each kind."""
    who = clues.where(F.col("kind").isin(ACTIONABLE)).join(segments.select("seg_id", "speaker"), "seg_id", "left").withColumn("person", F.coalesce(F.nullif("actor", F.lit("")), "speaker"))
    nth = F.row_number().over(Window.partitionBy("person", "kind").orderBy("clue_id"))
    return who.where("person is not null").withColumn("nth", nth).where(F.col("nth") <= most).groupBy("person", "kind").agg(F.sort_array(F.collect_list("clue_id")).alias("clues"))


def merge_roster(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sections by name: what was written by hand stays, new people are added."""
    return old.alias("a").join(new.alias("b"), F.col("a.name") == F.col("b.name"), "full_outer").select(F.coalesce("a.name", "b.name").alias("name"), F.coalesce(F.nullif("a.body", F.lit("")), "b.body").alias("body"), F.col("a.name").isNull().alias("added"))


def link_ref(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """A link where the target is in the project, else the plain title with its source."""
    known = refs.join(targets.select(F.col("name").alias("title"), F.lit(True).alias("_k")).distinct(), "title", "left")
    return known.withColumn("line", F.when(F.col("_k"), F.concat(F.lit("[["), "title", F.lit("]]"))).otherwise(F.concat("title", F.lit(" ("), "source", F.lit(")")))).drop("_k")


def edges(notes: DataFrame, pattern: str = LINK) -> DataFrame:
    """note, target of each distinct link of a note's text, alias and anchor stripped."""
    return notes.select("note", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("target")).select("note", F.trim("target").alias("target")).where("target != ''").distinct()


def broken(links: DataFrame, known: DataFrame) -> DataFrame:
    return links.join(known.select(F.col("note").alias("target")), "target", "left_anti")


def degrees(links: DataFrame, known: DataFrame) -> DataFrame:
    """Both ends of every link between known notes, counted; isolated notes have 0."""
    inside = links.join(known.select(F.col("note").alias("target")), "target", "left_semi").where("note != target")
    ends = inside.select("note").union(inside.select("target")).groupBy("note").agg(F.count(F.lit(1)).alias("_d"))
    return known.select("note").join(ends, "note", "left").select("note", F.coalesce("_d", F.lit(0)).alias("degree"))


def transcript(segments: DataFrame) -> DataFrame:
    return segments.select("*", F.format_string("[%7.2f] %s：%s", F.col("start").cast("double"), F.col("speaker"), F.col("text")).alias("line"))


def assembled(clues: DataFrame, segments: DataFrame, refs: DataFrame, order: list[str], most: int = 3) -> DataFrame:
    """Lines of minutes: clues (clue_id, kind, text, seg_id, t) in order of kinds, with the speaker and clock of their segment and
    up to `most` references (clue_id, rank, title)."""
    nth = F.row_number().over(Window.partitionBy("clue_id").orderBy("rank"))
    cited = refs.withColumn("_n", nth).where(F.col("_n") <= most).groupBy("clue_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "title"))), lambda r: r["title"]).alias("refs"))
    rows = clues.join(segments.select("seg_id", "speaker", "start"), "seg_id", "left").join(cited, "clue_id", "left")
    place = F.coalesce(F.nullif(F.array_position(F.lit(order), F.col("kind")), F.lit(0)), F.lit(len(order) + 1))
    line = F.concat(clock(F.coalesce("start", "t", F.lit(0.0))), F.lit(" "), F.when(F.coalesce("speaker", F.lit("")) != "", F.concat("speaker", F.lit("："))).otherwise(""), "text")
    return rows.select("clue_id", "kind", place.cast("bigint").alias("place"), line.alias("line"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))


def fragmented(notes: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities (entity, names) that links spell in several ways that each are a note of their own: entity, spellings."""
    spelled = entities.select("entity", F.explode(F.array_distinct(F.concat(F.array("entity"), "names"))).alias("name"))
    own = spelled.join(notes.select(F.col("note").alias("name")).distinct(), "name", "left_semi")
    per = own.groupBy("entity").agg(F.array_sort(F.collect_set("name")).alias("spellings"))
    return per.where(F.size("spellings") > 1)


def note_files(entities: DataFrame, existing: DataFrame) -> DataFrame:
    """path and text of a note for each entity (entity, kind, names, body) that has none: front matter, title, body."""
    new = entities.join(existing.select(F.col("note").alias("entity")), "entity", "left_anti")
    quoted = F.array_join(F.transform("names", lambda n: F.concat(F.lit('"'), F.replace(n, F.lit('"'), F.lit("'")), F.lit('"'))), ", ")
    text = F.concat(F.lit("---\ntype: "), "kind", F.lit("\naliases: ["), quoted, F.lit("]\n---\n\n# "), "entity", F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    return new.select(F.concat("entity", F.lit(".md")).alias("path"), text.alias("text"))
