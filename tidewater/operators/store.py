"""A corpus that lasts: immutable segments in a folder, and a log of manifests that says which of them make up each version.

A segment holds what one write has brought: files (path, mtime, size, content_hash, gone), chunks, vectors, postings, terms (what
it adds to and takes from document frequencies) and dead (ids of the chunks of older segments that it supersedes). So a sync of
a few files writes rows for these alone; nothing that is there is written again. Search reads the postings of all segments but for dead
ids, and sums of frequencies and figures, which gives what an index built anew gives. Small segments are merged in tiers: FAN
neighbours of a tier become one of the next, and what was dead in them is left out, so there are few segments, and each row is
written again once a tier.

A version is published by making its manifest's file, which is there whole or not at all, and fails if the version is there already.
A write that fails leaves files that no manifest names. Of two writers that began from one version the later rests its change on the
other's, unless both changed a path, or one rebuilt the corpus: then it is a Conflict, after which sync and delete begin again
from the newest version. Where a store can't rename or link in one step (some object stores), keep to one writer.

Null paths are not indexed; null texts aren't worth indexing. A path that a scan holds more than once is an error. Empty scans remove
what is under their root. Other columns of files are ignored.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from math import log

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import LETTERS, Tokenizer, tokenizer
from tidewater.operators.index import chunk_rows, manifest, skip_reason, sync_report, sync_rows, worth_indexing
from tidewater.operators.search import Index, parts_of, postings
from tidewater.sources.shared import delete, stored

#: Segments of a tier that are merged, rows of the lowest tier, and rows of postings in a file.
FAN, TIER, FILE_ROWS = 4, 1000, 2_000_000

FILES = "path string, mtime double, size bigint, content_hash string, gone boolean"
TABLES = {"dead": "id bigint, upto bigint", "terms": "term string, df bigint", "postings": "id bigint, dl bigint, term string, tf bigint"}


class Conflict(Exception):
    """Another writer has changed what this one has."""


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this content, in one step; False where it is there already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, draft = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}.draft"))
    fs = at.getFileSystem(conf)
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = [jvm.java.nio.file.Path.of(jvm.java.net.URI(f"file://{p.toUri().getPath()}")) for p in (at, draft)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(draft, at, spark.sparkContext._gateway.new_array(kind, 0))
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)
    return True


@dataclass(frozen=True)
class Segment:
    """seq: the version that brought it, or the latest of those merged in it. rows: how many each table has."""

    name: str
    seq: int
    rows: dict = field(default_factory=dict)

    @property
    def weight(self) -> int:
        return self.rows.get("chunks", 0) + self.rows.get("dead", 0)


def to_merge(weights: list[int], fan: int = FAN, tier: int = TIER) -> slice | None:
    """The neighbours to merge next: the latest `fan` or more side by side of one tier or lower ones, lowest tier first."""
    tiers = [int(log(max(w, 1) / tier, fan)) + 1 if w > tier else 0 for w in weights]
    for t in sorted(set(tiers)):
        end = len(tiers)
        while end:
            begin = end
            while begin and tiers[begin - 1] <= t:
                begin -= 1
            if end - begin >= fan:
                return slice(begin, end)
            end = begin - 1 if begin else 0
    return None


@dataclass
class Snapshot:
    """A version of a corpus; reading it isn't touched by later writes, until they are vacuumed away."""

    store: Store
    version: int
    tokenizer: str
    embedder: str
    segments: list[Segment]
    n: int
    tokens: int

    def rows(self, table: str, segments: list[Segment] | None = None) -> DataFrame | None:
        """All rows of a table as written, with the seq of their segment."""
        out = None
        for s in self.segments if segments is None else segments:
            if s.rows.get(table):
                df = self.store.spark.read.parquet(self.store.path(s.name, table)).withColumn("seq", F.lit(s.seq).cast("bigint"))
                out = df if out is None else out.unionByName(df)
        return out

    def live(self, table: str, segments: list[Segment] | None = None, terms: DataFrame | None = None, least: int = 1) -> DataFrame | None:
        """Rows of chunks, vectors or postings that no later segment supersedes, with their seq. Postings are dealt out by id, in `least`
        parts or more; where a small table of terms is given, those of other terms are left out before that."""
        rows, dead = self.rows(table, segments), self.rows("dead")
        if rows is not None and terms is not None:
            rows = rows.join(F.broadcast(terms), "term", "left_semi").select(rows.columns)
        if rows is not None and table == "postings":
            rows = rows.repartition(max(least, sum(s.rows.get(table, 0) for s in (self.segments if segments is None else segments)) // FILE_ROWS), "id")
        if rows is None or dead is None:
            return rows
        dead = dead.groupBy("id").agg(F.max("upto").alias("upto"))
        return rows.join(dead.hint("shuffle_hash"), "id", "left").where("upto is null or seq >= upto").select(rows.columns)

    def table(self, name: str, schema: str) -> DataFrame:
        rows = self.live(name)
        return self.store.spark.createDataFrame([], schema) if rows is None else rows.drop("seq")

    def files(self) -> DataFrame:
        """path, mtime, size, content_hash of the newest row of each path, but for those that are gone."""
        rows = self.rows("files")
        if rows is None:
            return self.store.spark.createDataFrame([], FILES).drop("gone")
        return newest(rows).where("not gone").drop("gone", "seq")

    def chunks(self) -> DataFrame:
        return self.table("chunks", "id bigint, path string, source string, heading string, text string, start bigint")

    def vectors(self) -> DataFrame:
        return self.table("vectors", "id bigint, embedding array<double>")

    def index(self) -> Index:
        """What search.bm25 and search.search take."""
        spark, terms = self.store.spark, self.rows("terms")
        terms = spark.createDataFrame([], TABLES["terms"]) if terms is None else terms.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        read = (lambda asked: self.live("postings", terms=asked, least=n).drop("seq")) if self.rows("postings") is not None else None
        figures = spark.range(1).select(F.lit(self.n).cast("bigint").alias("n"), F.lit(self.tokens / self.n if self.n else None).cast("double").alias("avgdl"))
        return Index(self.table("postings", TABLES["postings"]), terms, figures, self.tokenizer, read)


def newest(files: DataFrame) -> DataFrame:
    """The row of each path from its latest segment."""
    values = [c for c in files.columns if c not in ("path", "seq")]
    return files.groupBy("path").agg(F.max_by(F.struct(*values), "seq").alias("_v"), F.max("seq").alias("seq")).select("path", *(F.col(f"_v.{c}").alias(c) for c in values), "seq")


class Store:
    """A corpus in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- the folder

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def path(self, segment: str, table: str) -> str:
        return f"{self.root}/segments/{segment}/{table}"

    def log(self, version: int) -> str:
        return f"{self.root}/log/{version:020d}.json"

    def latest(self) -> int | None:
        fs, at = self._fs(f"{self.root}/log")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return max((int(n[:20]) for n in names if n.endswith(".json")), default=None)

    def manifest(self, version: int) -> dict:
        fs, at = self._fs(self.log(version))
        stream = fs.open(at)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    # --- versions

    @classmethod
    def create(cls, spark: SparkSession, root: str, tokenizer: str = LETTERS.name, embedder: str = "") -> Store:
        """The store at root, with an empty version 0 if there is none yet."""
        store = cls(spark, root)
        if store.latest() is None:
            first = {"version": 0, "op": "create", "tokenizer": tokenizer, "embedder": embedder, "segments": [], "n": 0, "tokens": 0, "added": None}
            publish(spark, store.log(0), json.dumps(first))
        return store

    def open(self, version: int | None = None) -> Snapshot:
        version = self.latest() if version is None else version
        if version is None:
            raise ValueError(f"no corpus at {self.root}")
        m = self.manifest(version)
        return Snapshot(self, version, m["tokenizer"], m["embedder"], [Segment(**s) for s in m["segments"]], m["n"], m["tokens"])

    def commit(self, base: Snapshot, op: str, added: Segment | None, replaced: list[str] = (), n: int = 0, tokens: int = 0, **names: str) -> Snapshot:
        """Publish a change of `base` as the next version, on top of what others have published since.

        op: 'write' adds a segment, 'merge' replaces some, 'rebuild' replaces all. n and tokens are what is added to the figures."""
        seen = base.version
        while True:
            latest = self.latest()
            for v in range(seen + 1, latest + 1):
                self.agree(op, added, replaced, self.manifest(v))
            seen, now = latest, self.manifest(latest)
            segments = [Segment(**s) for s in now["segments"]]
            if op == "write":
                segments.append(Segment(added.name, latest + 1, added.rows))
            else:
                at = next((i for i, s in enumerate(segments) if s.name in replaced), 0)
                segments = [s for s in segments if s.name not in replaced]
                segments[at:at] = [added] if added else []
            out = {"version": latest + 1, "op": op, "tokenizer": now["tokenizer"], "embedder": now["embedder"], "segments": [vars(s) for s in segments], "n": now["n"] + n, "tokens": now["tokens"] + tokens, "added": added.name if added else None} | names
            if publish(self.spark, self.log(latest + 1), json.dumps(out)):
                return self.open(latest + 1)

    def agree(self, op: str, added: Segment | None, replaced: list[str], other: dict) -> None:
        """Conflict, if a version of another writer has touched what this change rests on."""
        if op == "rebuild" or other["op"] == "rebuild":
            raise Conflict("the corpus was rebuilt, or changed while it was")
        if op == "merge":
            if set(replaced) - {s["name"] for s in other["segments"]}:
                raise Conflict("a segment is merged already")
        elif other["op"] == "write" and added.rows.get("files"):
            theirs = next((s for s in other["segments"] if s["name"] == other["added"]), None)
            if theirs is None or not theirs["rows"].get("files"):
                return
            mine, others = (self.spark.read.parquet(self.path(s, "files")).select("path") for s in (added.name, theirs["name"]))
            if not mine.join(others, "path", "left_semi").isEmpty():
                raise Conflict("another writer has changed one of the paths")

    def put(self, name: str, table: str, df: DataFrame) -> DataFrame:
        """A table of a segment, written and read back."""
        df.write.parquet(self.path(name, table))
        return self.spark.read.schema(df.schema).parquet(self.path(name, table))

    def write(self, tables: dict[str, DataFrame | None], seq: int = 0, name: str | None = None, there: dict[str, DataFrame] | None = None) -> Segment:
        """A segment with these tables, and with those that are there already."""
        name, rows = name or uuid.uuid4().hex, {}
        for table, df in tables.items():
            if df is not None:
                rows[table] = self.put(name, table, df).count()
        rows |= {table: df.count() for table, df in (there or {}).items()}
        for table in rows:
            if not rows[table]:
                delete(self.spark, self.path(name, table))
        return Segment(name, seq, rows)

    def cut(self, chunks: DataFrame, tokens: Tokenizer) -> DataFrame:
        """Postings of chunks that are stored. They lie by term within files, so that terms are pushed to the scan."""
        return postings(chunks, "id", tokens=tokens, parts=parts_of(chunks, 1)).sortWithinPartitions("term", "id")

    # --- changes

    def sync(self, files: DataFrame, root: str, embed: Callable | None = None, worth: Column | None = None, chunk: Callable[[DataFrame], DataFrame] = chunk_rows, attempts: int = 5) -> tuple[Snapshot, DataFrame]:
        """The corpus after a scan of root (path, rel, source, mtime, text), and the report (status, n). What is unchanged isn't written;
        a sync that finds nothing new publishes nothing. `embed` gives id and embedding for rows of id and text."""
        worth = F.coalesce(skip_reason(F.col("rel")).isNull() & worth_indexing(F.col("text")) if worth is None else worth, F.lit(False)) & F.col("path").isNotNull()
        files = files.select("path", "rel", "source", F.col("mtime").cast("double").alias("mtime"), "text")
        kept = files.where(worth)
        scanned = stored(manifest(kept), "scan")
        if scanned.groupBy("path").count().where("count > 1").isEmpty() is False:
            raise ValueError("a path stands in the scan more than once")
        skipped = files.where(~worth).agg(F.lit("skipped").alias("status"), F.count(F.lit(1)).alias("n"))
        for left in reversed(range(attempts)):
            base = self.open()
            rows = stored(sync_rows(base.files().where(F.startswith("path", F.lit(root.rstrip("/") + "/"))), scanned), "sync")
            report = sync_report(rows).unionByName(skipped)
            if rows.where("status != 'unchanged'").isEmpty():
                return base, report.unionByName(self.spark.createDataFrame([("embedded", 0)], "status string, n bigint"))
            fresh = kept.join(rows.where("status in ('added', 'updated')").select("path"), "path", "left_semi")
            changed = rows.where("status in ('added', 'updated', 'touched')").select("path")
            known = scanned.join(changed, "path", "left_semi").withColumn("gone", F.lit(False))
            gone = rows.where("status = 'removed'").select("path", *(F.lit(None).cast(k).alias(c) for c, k in (("mtime", "double"), ("size", "bigint"), ("content_hash", "string"))), F.lit(True).alias("gone"))
            try:
                new, embedded = self.change(base, known.unionByName(gone), chunk(fresh), rows.where("status in ('updated', 'removed')").select("path"), embed)
                return new, report.unionByName(self.spark.createDataFrame([("embedded", embedded)], "status string, n bigint"))
            except Conflict:
                if not left:
                    raise

    def delete(self, paths: DataFrame, attempts: int = 5) -> Snapshot:
        """Without some files: their chunks, vectors and postings are dead."""
        for left in reversed(range(attempts)):
            base = self.open()
            gone = stored(base.files().join(paths.select("path").distinct(), "path", "left_semi").withColumn("gone", F.lit(True)), "gone")
            if gone.isEmpty():
                return base
            try:
                return self.change(base, gone, None, gone.select("path"), None)[0]
            except Conflict:
                if not left:
                    raise

    def change(self, base: Snapshot, files: DataFrame, chunks: DataFrame | None, gone: DataFrame, embed: Callable | None) -> tuple[Snapshot, int]:
        """Publish a segment of these files and chunks, in which the chunks of the paths in `gone` die; and how many were embedded."""
        tokens = tokenizer(base.tokenizer)
        dead = stored(base.chunks().join(gone, "path", "left_semi").select("id", "text"), "dead")
        name, there = uuid.uuid4().hex, {}
        if chunks is not None:
            chunks = there["chunks"] = self.put(name, "chunks", chunks)
            there["postings"] = self.put(name, "postings", self.cut(chunks, tokens))
        fresh = there.get("postings")
        lost = postings(dead, "id", tokens=tokens, parts=parts_of(dead, 1)).groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
        terms = lost if fresh is None else fresh.groupBy("term").agg(F.count(F.lit(1)).alias("df")).unionByName(lost)
        vectors, embedded = None, 0
        if chunks is not None and embed is not None:
            same = dead.withColumnRenamed("text", "_was").join(chunks.select("id", "text"), "id").where("_was = text").select("id")
            old = base.vectors().join(same, "id", "left_semi")
            todo = stored(chunks.select("id", "text").join(old.select("id"), "id", "left_anti"), "todo")
            vectors, embedded = embed(todo).unionByName(old) if base.rows("vectors") is not None else embed(todo), todo.count()
        tables = {"files": files, "dead": dead.select("id", F.lit(base.version + 1).cast("bigint").alias("upto")), "terms": terms.groupBy("term").agg(F.sum("df").alias("df")).where("df != 0"), "vectors": vectors}
        words = fresh.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0] if fresh is not None else 0
        n_dead, words_dead = dead.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(tokens.tokens(F.col("text")))), F.lit(0))).first()
        segment = self.write(tables, name=name, there=there)
        return self.commit(base, "write", segment, n=segment.rows.get("chunks", 0) - n_dead, tokens=words - words_dead), embedded

    def compact(self, fan: int = FAN, tier: int = TIER) -> Snapshot:
        """Merge segments in tiers until none is due. What another writer has merged meanwhile is left to that one."""
        while True:
            base = self.open()
            due = to_merge([s.weight for s in base.segments], fan, tier)
            if due is None:
                return base
            try:
                self.commit(base, "merge", self.merged(base, base.segments[due]), [s.name for s in base.segments[due]])
            except Conflict:
                continue

    def merged(self, base: Snapshot, segments: list[Segment], **tables: DataFrame | None) -> Segment:
        """One segment in place of some neighbours, with other tables where given. Marks of what is gone or dead stay while there are
        older segments for them."""
        whole = segments[0] is base.segments[0]
        files, dead, terms = (base.rows(t, segments) for t in ("files", "dead", "terms"))
        if files is not None:
            files = newest(files).drop("seq")
            files = files.where("not gone") if whole else files
        live = {t: base.live(t, segments) for t in ("chunks", "vectors")} | {"postings": base.live("postings", segments)}
        out = {t: df.drop("seq") if df is not None else None for t, df in live.items()}
        if out["postings"] is not None and "postings" not in tables:
            out["postings"] = out["postings"].sortWithinPartitions("term", "id")
        out |= {"files": files, "dead": None if whole or dead is None else dead.drop("seq").groupBy("id").agg(F.max("upto").alias("upto"))}
        out["terms"] = terms.groupBy("term").agg(F.sum("df").alias("df")).where("df != 0") if terms is not None else None
        return self.write(out | tables, segments[-1].seq)

    def healed(self, name: str | None = None) -> Snapshot:
        """Postings are derived: they are made anew where another tokenizer made them, or where there are none for chunks that there are."""
        base = self.open()
        name = name or base.tokenizer
        if base.tokenizer == name and (base.rows("postings") is not None or not base.n):
            return base
        if not base.segments:
            return self.commit(base, "rebuild", None, tokenizer=name)
        tokens = tokenizer(name)
        made = stored(self.cut(base.chunks(), tokens), "postings")
        words = made.select("id", "dl").distinct().agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
        segment = self.merged(base, base.segments, postings=made, terms=made.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
        return self.commit(base, "rebuild", segment, [s.name for s in base.segments], tokens=words - base.tokens, tokenizer=name)

    def embedded_by(self, embed: Callable, name: str) -> Snapshot:
        """With vectors of the embedder of this name: all are made anew where another made them, else only those that are missing."""
        base = self.open()
        if not base.segments:
            return base if base.embedder == name else self.commit(base, "rebuild", None, embedder=name)
        todo, old = base.chunks().select("id", "text"), base.rows("vectors")
        if base.embedder == name and old is not None:
            todo = stored(todo.join(base.vectors().select("id"), "id", "left_anti"), "todo")
            if todo.isEmpty():
                return base
            vectors = embed(todo).unionByName(base.vectors())
        else:
            vectors = embed(todo)
        return self.commit(base, "rebuild", self.merged(base, base.segments, vectors=vectors), [s.name for s in base.segments], embedder=name)

    def vacuum(self, keep: int = 1, older_s: float = 86_400) -> int:
        """Delete segments that none of the last `keep` versions names and that are older than what a writer may still be at, and the older
        manifests; how many segments went."""
        latest = self.latest()
        if latest is None:
            return 0
        held = {s["name"] for v in range(max(0, latest - keep + 1), latest + 1) for s in self.manifest(v)["segments"]}
        fs, at = self._fs(f"{self.root}/segments")
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in held and s.getModificationTime() / 1000 <= time.time() - older_s] if fs.exists(at) else []
        for p in gone:
            fs.delete(p, True)
        fs, at = self._fs(f"{self.root}/log")
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.endswith(".json") and int(name[:20]) <= latest - keep and s.getModificationTime() / 1000 <= time.time() - older_s:
                fs.delete(s.getPath(), False)
        return len(gone)
