"""python -m tidewater: queries | run NAME SF_DIR | index ROOT OUT | search OUT QUERY | stats OUT | events ROOT | find ROOT WORDS."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tidewater import registry
from tidewater.functions.vectors import hash_embed
from tidewater.operators import events, index, search
from tidewater.operators.store import Store
from tidewater.session import session
from tidewater.sources import corpus


def minutes(spark, root: str):
    return corpus.gather(spark, root).select("path", "text")


def main(args: list[str] | None = None) -> None:
    cli = argparse.ArgumentParser(prog="tidewater", description=__doc__)
    cli.add_argument("command", choices=["queries", "run", "index", "search", "stats", "events", "find"])
    cli.add_argument("rest", nargs="*")
    cli.add_argument("--rows", type=int, default=20)
    given = cli.parse_args(args)
    if given.command == "queries":
        print("\n".join(sorted(registry.QUERIES)))
        return
    spark = session()
    if given.command == "run":
        out = registry.QUERIES[given.rest[0]](spark, given.rest[1])
    elif given.command == "index":
        files = corpus.corpus(spark, given.rest[0]).where("skip is null").withColumn("source", F.substring_index("rel", "/", 1))
        held = Store.create(spark, given.rest[1], embedder="hash@64")
        root = files.select(F.expr("left(path, length(path) - length(rel) - 1)")).first()
        snap, out = held.sync(files, root[0] if root else given.rest[0], lambda rows: hash_embed(rows, ["id"], "text"))
        held.compact()
    elif given.command == "search":
        snap = Store(spark, given.rest[0]).open()
        asked = hash_embed(spark.range(1).select(F.col("id").alias("query_id"), F.lit(given.rest[1]).alias("query")), ["query_id", "query"], "query")
        out = search.search(snap.index(), snap.vectors().withColumnRenamed("id", "vec_id"), asked, snap.chunks().select("id", "path", "source"))
    elif given.command == "stats":
        snap = Store(spark, given.rest[0]).open()
        out = index.stats(snap.chunks(), snap.vectors())
    elif given.command == "events":
        out = events.by_type(events.extract(minutes(spark, given.rest[0])))
    else:
        found = events.extract(minutes(spark, given.rest[0])).withColumn("event_id", F.xxhash64("meeting_id", "seq"))
        asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit(given.rest[1]).alias("query"))
        out = events.find(found, asked, given.rows).join(found.select(F.col("event_id").alias("id"), "date", "type", "content"), "id")
    out.show(given.rows, truncate=80)


if __name__ == "__main__":
    main()
