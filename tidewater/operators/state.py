"""Keyed, mutable tables of a session as set operations: participants, agenda, references, plans, settings."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import norm_key
from tidewater.operators.timeline import latest

PRIVATE = "_"


def participants(commands: DataFrame) -> DataFrame:
    """The last command for each name (op, seq) decides: upserts stay, removals go."""
    return latest(commands, ["name"], ["seq"]).where("op != 'remove'").drop("op", "seq")


def renamed(rows: DataFrame, renames: DataFrame, columns: list[str]) -> DataFrame:
    """A participant's new name (old, new) wherever the old one stands."""
    for c in columns:
        of = renames.select(F.col("old").alias(c), F.col("new").alias("_new"))
        rows = rows.join(of, c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return rows


def removed(voice_names: DataFrame, gone: DataFrame) -> DataFrame:
    """Voices (spk, value) after participants (id, name) went: those bound to one of them are unbound."""
    values = gone.select(F.explode(F.array("id", "name")).alias("value")).where("value is not null")
    return voice_names.join(values.distinct(), "value", "left_anti").select("spk", "value")


def by_name(people: DataFrame, query: str) -> DataFrame:
    """The first person, in order, whose name is the query or contains it."""
    return people.where((F.col("name") == query) | F.contains("name", F.lit(query))).orderBy("ord").limit(1)


def set_list(items: DataFrame, name: str, fresh: DataFrame) -> DataFrame:
    """Replace one list, keep the others; blank topics are dropped."""
    return items.where(F.col("list") != name).unionByName(fresh.withColumn("list", F.lit(name)).where(F.trim("topic") != "").select(*items.columns))


def add_prep(items: DataFrame) -> DataFrame:
    """One item for each norm topic of 2 characters or more: the first, with the provenance of all."""
    keyed = items.withColumn("norm", norm_key(F.col("topic"))).where(F.length("norm") >= 2)
    return keyed.groupBy("norm").agg(F.min_by("topic", "seq").alias("topic"), F.min("seq").alias("seq"), F.array_sort(F.collect_set("source")).alias("sources"))


def replace_plan(file: DataFrame, session: DataFrame) -> DataFrame:
    """The file decides topic, kind, done and which references stay; the session gives layout and where references came from."""
    a, b = file.alias("f"), session.alias("s")
    refs = F.transform("f.refs", lambda r: F.coalesce(F.get(F.filter("s.refs", lambda q: (q["title"] == r["title"]) & (q["snippet"] == r["snippet"])), 0), r))
    return a.join(b, F.col("f.id") == F.col("s.id"), "left").select("f.id", "f.topic", "f.kind", "f.done", refs.alias("refs"), "s.nx", "s.ny", "s.nw", F.when(F.col("s.nw") == 232.0, F.lit(0.0)).otherwise(F.coalesce("s.nw", F.lit(0.0))).alias("width"))


def attach(refs: Column, ref: Column) -> Column:
    return F.array_distinct(F.concat(refs, F.array(ref)))


def detach(refs: Column, at: int) -> Column:
    """Without the reference at a position; out of range nothing changes."""
    return F.filter(refs, lambda _, i: i != at)


def reorder(items: DataFrame, order: DataFrame) -> DataFrame:
    """Items in the order given by (id, pos); those not named follow in their old order."""
    w = Window.partitionBy("list").orderBy(F.col("pos").isNull().cast("int"), "pos", "ord")
    return items.join(order, "id", "left").withColumn("ord", F.row_number().over(w) - 1).drop("pos")


def listed(items: DataFrame, name: str, done: bool | None = None) -> DataFrame:
    """One list's items, or those of it that are done or aren't."""
    rows = items.where(F.col("list") == name)
    return rows if done is None else rows.where(F.col("done") == done)


def marked(items: DataFrame, marks: DataFrame) -> DataFrame:
    """Items after marks (id, done, seq): the last counts."""
    last = latest(marks, ["id"], ["seq"]).select("id", F.col("done").alias("_done"))
    return items.join(last, "id", "left").withColumn("done", F.coalesce("_done", "done")).drop("_done")


def reset(items: DataFrame, name: str) -> DataFrame:
    """One list as if nothing had been done, and in its own layout."""
    mine = F.col("list") == name
    out = items.withColumn("done", F.when(mine, F.lit(False)).otherwise(F.col("done")))
    for c in ("nx", "ny", "nw", "nz"):
        if c in items.columns:
            out = out.withColumn(c, F.when(mine, F.lit(0.0)).otherwise(F.col(c)))
    return out


def snapshot(df: DataFrame) -> DataFrame:
    """The public columns."""
    return df.select(*[c for c in df.columns if not c.startswith(PRIVATE)])


def setting(name: str, given: dict, file: dict, default, env: str = "TIDEWATER_"):
    """Given, then file, then environment, then default, as the default's type."""
    for value in (given.get(name), file.get(name), os.environ.get(env + name.upper())):
        if value is not None and value != "":
            if isinstance(default, bool):
                return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")
            return type(default)(value) if default is not None else value
    return default
