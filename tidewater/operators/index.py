"""Corpus maintenance: change tests, incremental sync, orphan sweep, skip rules, titles, index figures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import LETTERS, content_hash, strip, tokenizer
from tidewater.operators.chunk import chunks as chunked
from tidewater.operators.search import Index, build_index
from tidewater.sources.shared import stored

# What is never worth indexing.
SKIP_DIRS = [".obsidian", ".trash", ".git", ".svn", "__pycache__", "node_modules", "venv", ".venv", ".idea", ".vscode", "rag", ".plaud"]
SKIP_NAMES = ["session.json", "transcript.txt", "segments.json"]
SKIP_ENDS = ["-transcript.md", "-segments.json", ".pcm", ".wav", ".ogg", ".mp3"]


def skip_reason(rel: Column) -> Column:
    """Why a relative path is skipped: directory, name or pattern; null to index it. The directory test comes first."""
    parts = F.split(rel, "/")
    name = F.element_at(parts, -1)
    inside = F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lit(SKIP_DIRS))
    ends = F.lit(False)
    for e in SKIP_ENDS:
        ends = ends | F.endswith(F.lower(name), F.lit(e))
    return F.when(inside, "directory").when(name.isin(SKIP_NAMES), "name").when(ends, "pattern")


def manifest(files: DataFrame, text_col: str = "text") -> DataFrame:
    """path, mtime, size, content_hash from path, mtime and text."""
    return files.select("path", "mtime", F.octet_length(text_col).cast("bigint").alias("size"), content_hash(F.col(text_col)).alias("content_hash"))


def sync_rows(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """path and status: added, removed, unchanged (same mtime and size), touched (same content) or updated."""
    a, b = stored.alias("a"), scanned.alias("b")
    same = (F.abs(F.col("a.mtime") - F.col("b.mtime")) < 1e-6) & (F.col("a.size") == F.col("b.size"))
    alike = F.col("a.content_hash").eqNullSafe(F.col("b.content_hash"))
    status = F.when(F.col("a.path").isNull(), "added").when(F.col("b.path").isNull(), "removed").when(same, "unchanged").when(alike, "touched").otherwise("updated")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full_outer").select(F.coalesce("a.path", "b.path").alias("path"), status.alias("status"))


def sync_report(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def pruned(stored: DataFrame, root: str, alive: DataFrame) -> DataFrame:
    """Stored paths under root (with its separator, so that /a/b doesn't take /a/bc) that a scan hasn't found."""
    under = F.startswith("path", F.lit(root.rstrip("/") + "/"))
    return stored.where(under).join(alive.select("path"), "path", "left_anti")


def reindexed(chunks: DataFrame, fresh: DataFrame, rows: DataFrame) -> DataFrame:
    """Chunks after a sync: those of updated, added and removed paths go, fresh ones come."""
    gone = rows.where(F.col("status").isin("added", "updated", "removed")).select("path")
    return chunks.join(gone, "path", "left_anti").unionByName(fresh.join(rows.where(F.col("status").isin("added", "updated")).select("path"), "path", "left_semi"))


def missing(chunks: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Chunks that have no vector yet."""
    return chunks.join(vectors.select(key), key, "left_anti")


def usable_arm(stored_identity: str, identity: str) -> bool:
    """Whether the vector arm may be used: the model, its backend and width must be those that the vectors came from."""
    return bool(stored_identity) and stored_identity == identity


def title_for(text: Column, path: Column, heading: Column) -> Column:
    """The first Markdown heading of the text; else the file's stem with the last part of the heading path."""
    first = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#{1,6}\s+(.+)$", 1)), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), "[-_]", " ")
    last = F.element_at(F.split(heading, " > "), -1)
    return F.coalesce(first, F.when(F.coalesce(heading, F.lit("")) != "", F.concat(stem, F.lit(" — "), last)).otherwise(stem))


def worth_indexing(text: Column, least: int = 40) -> Column:
    return F.length(strip(text)) >= least


def stats(chunks: DataFrame, vectors: DataFrame, source: str = "source") -> DataFrame:
    """By source: files, chunks, and chunks with a vector."""
    joined = chunks.join(vectors.select("id").distinct().withColumn("has", F.lit(1)), "id", "left")
    return joined.groupBy(source).agg(F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("chunks"), F.count("has").alias("vectors"))


@dataclass
class Corpus:
    """What is kept of a corpus: files (path, mtime, size, content_hash), chunks (id, path, source, heading, text, start), vectors (id,
    embedding), the postings, and the embedder's identity."""

    files: DataFrame
    chunks: DataFrame
    vectors: DataFrame
    postings: Index
    embedder: str


def chunk_rows(files: DataFrame) -> DataFrame:
    """Chunks of files (path, source, text); a chunk's id is made of its path and place, so that it lasts."""
    rows = chunked(files, "path").join(files.select("path", "source"), "path")
    return rows.select(F.xxhash64("path", "seq").alias("id"), "path", "source", "heading", "text", "start")


def embedded(chunks: DataFrame, vectors: DataFrame | None, embed, limit: int | None = None) -> DataFrame:
    """vectors with those of chunks that had none, by `embed` (rows of id and text to id and embedding); `limit` chunks at most, by id."""
    todo = chunks if vectors is None else missing(chunks, vectors)
    todo = todo.orderBy("id").limit(limit) if limit else todo
    fresh = embed(todo.select("id", "text"))
    return fresh if vectors is None else vectors.unionByName(fresh)


def build(files: DataFrame, embed, embedder: str) -> Corpus:
    """All of a corpus, from files (path, rel, source, mtime, text) that aren't skipped and are worth indexing."""
    kept = files.where(skip_reason(F.col("rel")).isNull() & worth_indexing(F.col("text")))
    chunks = stored(chunk_rows(kept), "chunks")
    return Corpus(stored(manifest(kept), "files"), chunks, stored(embedded(chunks, None, embed), "vectors"), build_index(chunks, "id"), embedder)


def sync(corpus: Corpus, files: DataFrame, root: str, embed, embedder: str) -> tuple[Corpus, DataFrame]:
    """The corpus after a scan of root, and the report: how many files were added, updated, touched, unchanged, removed and skipped,
    chunks that had no file, and chunks embedded. Files outside root stay as they are. Another embedder means that all is built anew."""
    if not usable_arm(corpus.embedder, embedder):
        new = build(files, embed, embedder)
        counted = new.files.agg(F.lit("rebuilt").alias("status"), F.count(F.lit(1)).alias("n"))
        return new, counted.unionByName(new.vectors.agg(F.lit("embedded").alias("status"), F.count(F.lit(1)).alias("n")))
    worth = skip_reason(F.col("rel")).isNull() & worth_indexing(F.col("text"))
    kept = files.where(worth)
    mine = F.startswith("path", F.lit(root.rstrip("/") + "/"))
    scanned = stored(manifest(kept), "files")
    rows = stored(sync_rows(corpus.files.where(mine), scanned), "sync")
    known = corpus.files.where(~mine).unionByName(scanned)
    orphan = corpus.chunks.join(known.select("path").distinct(), "path", "left_anti")
    lost = orphan.join(rows.select("path"), "path", "left_anti")
    left = corpus.chunks.join(orphan.select("id"), "id", "left_anti")
    chunks = stored(reindexed(left, chunk_rows(kept.join(rows.where("status in ('added', 'updated')").select("path"), "path", "left_semi")), rows), "chunks")
    gone = corpus.chunks.join(chunks.select("id", F.xxhash64("text").alias("_h")), (corpus.chunks["id"] == chunks["id"]) & (F.xxhash64(corpus.chunks["text"]) == F.col("_h")), "left_anti").select("id")
    old = corpus.vectors.join(gone, "id", "left_anti").join(chunks.select("id"), "id", "left_semi")
    vectors = stored(embedded(chunks, old, embed), "vectors")
    one = lambda df, name: df.agg(F.lit(name).alias("status"), F.count(F.lit(1)).alias("n"))
    report = sync_report(rows).unionByName(one(files.where(~F.coalesce(worth, F.lit(False))), "skipped")).unionByName(one(lost, "orphans")).unionByName(one(missing(chunks, old), "embedded"))
    return Corpus(stored(known, "files"), chunks, vectors, build_index(chunks, "id"), embedder), report


def imported(corpus: Corpus, files: DataFrame, root: str, embed, embedder: str) -> tuple[Corpus, DataFrame]:
    """The corpus with the files that were copied under root: Markdown is indexed, all else is stored alone, and counted."""
    is_md = F.rlike("rel", F.lit(r"(?i)\.md$"))
    new, report = sync(corpus, files.where(is_md), root, embed, embedder)
    return new, report.unionByName(files.where(~is_md).agg(F.lit("stored").alias("status"), F.count(F.lit(1)).alias("n")))


def delete_files(corpus: Corpus, paths: DataFrame) -> Corpus:
    """Without some files: their chunks, vectors and postings go with them."""
    files = stored(corpus.files.join(paths.select("path"), "path", "left_anti"), "files")
    chunks = stored(corpus.chunks.join(paths.select("path"), "path", "left_anti"), "chunks")
    return Corpus(files, chunks, stored(corpus.vectors.join(chunks.select("id"), "id", "left_semi"), "vectors"), build_index(chunks, "id"), corpus.embedder)


def healed(corpus: Corpus, tokens: str = LETTERS.name) -> Corpus:
    """Postings are derived: they are made again, by the tokenizer of this name, where another made them, or where there are none for
    chunks that there are."""
    if corpus.postings.tokenizer == tokens and (not corpus.postings.postings.isEmpty() or corpus.chunks.isEmpty()):
        return corpus
    return Corpus(corpus.files, corpus.chunks, corpus.vectors, build_index(corpus.chunks, "id", tokens=tokenizer(tokens)), corpus.embedder)
