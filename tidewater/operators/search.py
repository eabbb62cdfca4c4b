"""Hybrid retrieval: postings, BM25, exact nearest vectors, reciprocal rank fusion, grouping by file, several corpora.

Queries are a table (query_id, ...), so that many run as one plan; every rank carries a total order."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.text import LETTERS, Tokenizer, n_tokens, tokenize, tokenizer
from tidewater.functions.vectors import block_join, matrix, usable
from tidewater.sources.shared import fresh_path, stored

K1, B, RRF = 1.2, 0.75, 60
#: Numbers of the query vectors that are broadcast at most, and of a block where there are more.
VECTORS = 1 << 22
#: Bytes of a table of texts that one task cuts into postings, and pairs of query and term that are broadcast at most.
PART, PAIRS = 4 << 20, 1 << 18
#: Queries, and rows, whose scores a task holds at once.
TILE = 1024


def parts_of(docs: DataFrame, least: int | None = None) -> int:
    """Tasks for a table of texts, so that what one holds doesn't grow with the table; `least` (by default as many as a shuffle has)
    where its size isn't known."""
    least = least or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()  # of the tables read: a join's own estimate is a product
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(least, size // PART) if size < 1 << 50 else least


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Tokenizer = LETTERS, parts: int | None = None) -> DataFrame:
    """id, dl, term, tf, dealt out by id. dl, the number of tokens, stands beside each term, so that scoring needs no second join.

    The texts are dealt out, not their tokens, which are counted where they are made: one shuffle of the texts is all."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).repartition(parts or parts_of(docs), "id")
    toks = rows.select("id", tokens.tokens(F.col("_text")).alias("toks")).select("id", F.size("toks").cast("bigint").alias("dl"), F.explode_outer("toks").alias("term")).where("term is not null")
    return toks.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text", tokens: Tokenizer = LETTERS) -> DataFrame:
    """One row: n and avgdl."""
    many = n_tokens(F.col(text_col)) if tokens == LETTERS else F.size(tokens.tokens(F.col(text_col)))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(many).alias("avgdl"))


@dataclass
class Index:
    """Stored postings: a table of (id, dl, term, tf) in buckets of the id, sorted by term; document frequencies of the terms; the
    one row of corpus figures; and the name of the tokenizer that made them. Where postings cost more than a scan, `read` gives those of
    some terms (a small table), dealt out by id."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    tokenizer: str = LETTERS.name
    read: Callable[[DataFrame], DataFrame] | None = None


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Tokenizer = LETTERS) -> Index:
    """Tokenise once, search often. Buckets of the id let scores be summed and cut to the best of each task without a shuffle."""
    spark = docs.sparkSession
    name, path = f"postings_{uuid.uuid4().hex}", fresh_path(spark, "postings")
    n = parts_of(docs)
    postings(docs, id_col, text_col, tokens, n).write.bucketBy(n, "id").sortBy("term").option("path", path).saveAsTable(name)
    table = spark.table(name)
    return Index(table, stored(table.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms"), stored(corpus_stats(docs, text_col, tokens), "figures"), tokens.name)


def bm25(docs: DataFrame | Index, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_col: str = "query") -> DataFrame:
    """query_id, id, score of every document that has a term of the query; from a stored index, or from texts, whose terms of no
    query are dropped before they are counted. The one row of corpus figures joins as a broadcast, and so do the terms of the queries if
    they are PAIRS at most, so that postings stay where they are. Queries are cut by the tokenizer that made the index."""
    cut = tokenizer(docs.tokenizer) if isinstance(docs, Index) else LETTERS
    terms = queries.select("query_id", F.explode(F.array_distinct(cut.tokens(F.col(query_col)))).alias("term"))
    few = F.broadcast if terms.count() <= PAIRS else lambda df: df
    if isinstance(docs, Index):
        tf = docs.read(terms.select("term").distinct()) if docs.read and few is F.broadcast else docs.postings
        df, stats = docs.terms, docs.stats
    else:
        toks = docs.select(F.col(id_col).alias("id"), tokenize(F.col(text_col)).alias("toks")).select("id", F.size("toks").alias("dl"), F.explode_outer("toks").alias("term"))  # outer: no filter that would tokenise once more
        tf = toks.join(few(terms.select("term").distinct()), "term", "left_semi").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
        df, stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), corpus_stats(docs, text_col)
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    sought = few(terms).join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", idf.alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # Rounded, so that equal documents tie whatever the order of the sum.
    return tf.join(few(sought), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 9).alias("score"))


def top(df: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "id") -> DataFrame:
    """The k best for each query, with rank0 from 0. Spark plans a WindowGroupLimit, so no query's rows are all sorted."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie)))
    return df.withColumn("_nth", rank).where(F.col("_nth") <= k).withColumn("rank0", (F.col("_nth") - 1).cast("bigint")).drop("_nth")


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, id, score: the k largest dot products for each query, exact. Vectors that are null, odd or hold nulls take no part.

    Query vectors of VECTORS numbers at most are broadcast, and each task hands on its k best a query: tasks * queries * k rows are
    shuffled, never rows * queries. More queries meet the vectors block by block, in the cluster."""
    rows = usable(vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")), "v")
    asked = usable(queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col(vec_col).alias("q")), "q")
    numbers = lambda df, c: int(df.agg(F.sum(F.size(c))).first()[0] or 0)
    held, schema = numbers(asked, "q"), "query_id bigint, id bigint, score double"

    def best(ids: np.ndarray, q: np.ndarray, parts) -> pa.RecordBatch:
        """The k best for each query over parts (row ids, vectors), TILE queries and rows at a time."""
        held = [(np.zeros((0,), "i8"), np.zeros((0,), "i8"), np.zeros((0,)))] * -(-len(ids) // TILE)  # query's place, row, score
        for at, x in parts:
            if not len(at) or x.shape[1] != q.shape[1]:
                continue
            for n in range(len(held)):
                some = q[n * TILE : (n + 1) * TILE]
                for j in range(0, len(at), TILE):
                    s = np.round(some @ x[j : j + TILE].T, 9)
                    least = np.partition(s, -k, 1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
                    full = np.bincount(held[n][0], minlength=len(s)) >= k
                    worst = np.full(len(s), np.inf)
                    np.minimum.at(worst, held[n][0], held[n][2])
                    row, col = np.nonzero(s >= np.maximum(least, np.where(full, worst, -np.inf))[:, None])
                    new = [np.concatenate(c) for c in zip(held[n], (row, at[j : j + TILE][col], s[row, col]), strict=True)]
                    order = np.lexsort((new[1], -new[2], new[0]))
                    place = new[0][order]
                    nth = np.arange(len(place)) - np.searchsorted(place, place)
                    held[n] = tuple(c[order][nth < k] for c in new)
        out = [(ids[n * TILE : (n + 1) * TILE][p], i, s) for n, (p, i, s) in enumerate(held)] or [(ids, ids, np.zeros(len(ids)))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "id", "score"])

    if held <= VECTORS:
        got = asked.toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast((got["query_id"].to_numpy(), matrix(got["q"])))

        def scan(batches):
            yield best(*shared.value, ((b.column("id").to_numpy(), matrix(b.column("v"))) for b in batches))

        part = rows.mapInArrow(scan, schema)
    else:

        def pair(some: pa.Table, of: pa.Table) -> pa.Table:
            return pa.Table.from_batches([best(some["query_id"].to_numpy(), matrix(some["q"]), [(of["id"].to_numpy(), matrix(of["v"]))])])

        part = block_join(asked, rows, ("query_id", "id"), (-(-held // VECTORS), -(-numbers(rows, "v") // VECTORS)), pair, schema)
    return top(part.withColumn("score", F.round("score", 9)), k)


def pool(k: int, filtered: bool) -> int:
    """Candidates of an arm: more where a filter will drop some."""
    return max(4 * k, 200) if filtered else k


MODES = ("hybrid", "bm25", "vector")


def search(index: Index, vectors: DataFrame, queries: DataFrame, meta: DataFrame, k: int = 10, candidates: int = 50, mode: str = "hybrid", source: Column | None = None, embedder: str = "", stored_embedder: str = "") -> DataFrame:
    """The k best files of each query (query_id, query, embedding), by one arm or both. A blank query has no hits, and a mode that
    isn't one is an error. Where the stored vectors are another embedder's, only the vector arm is left out."""
    if mode not in MODES:
        raise ValueError(f"mode {mode}: one of {', '.join(MODES)}")
    asked, n = queries.where(F.trim("query") != ""), pool(candidates, source is not None)
    arms = []
    if mode != "vector":
        arms.append(top(bm25(index, asked), n))
    if mode != "bm25" and embedder == stored_embedder:
        arms.append(knn(vectors, asked.select("query_id", "embedding"), n))
    if not arms:
        return queries.sparkSession.createDataFrame([], f"query_id bigint, path {meta.schema['path'].dataType.simpleString()}, score double, rank0 bigint")
    return top(rrf(arms, meta, source=source).withColumn("score", F.round("score", 9)), k, tie="path")


def refine(index: Index, terms: DataFrame, k: int = 5) -> DataFrame:
    """Drill down on single terms (query_id, term): the k best chunks of each."""
    return top(bm25(index, terms, query_col="term"), k)


def process(index: Index, segments: DataFrame, keywords: DataFrame, k: int = 5) -> DataFrame:
    """For each segment (seg_id, text) its best chunks, and those of each of its keywords (seg_id, term): seg_id, term ('' for the
    whole segment), id, score, rank0."""
    whole = segments.select("seg_id", F.lit("").alias("term"), F.col("text").alias("query"))
    asked = whole.unionByName(keywords.select("seg_id", "term", F.col("term").alias("query"))).withColumn("query_id", F.xxhash64("seg_id", "term"))
    return top(bm25(index, asked), k).join(asked.select("query_id", "seg_id", "term"), "query_id").select("seg_id", "term", "id", "score", "rank0")


def union_search(hits: DataFrame, segments: DataFrame, query: str, order: list[str], keep: int = 20) -> tuple[DataFrame, DataFrame]:
    """What a search box shows: the corpus's hits, and the first segments that contain the query literally with their number."""
    said = segments.where(F.contains(F.lower("text"), F.lit(query.lower())))
    first = said.orderBy(*order).limit(keep).crossJoin(F.broadcast(said.agg(F.count(F.lit(1)).alias("total"))))
    return hits, first


def open_corpora(spark: SparkSession, paths: dict[str, str], dims: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Those corpora that can be read, and what is wrong with the others, or with all: an error where none is usable."""
    found, wrong = {}, {}
    for kb, path in paths.items():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            found[kb] = spark.read.parquet(path).withColumn("kb", F.lit(kb))
        else:
            wrong[kb] = "missing"
    if not found:
        raise ValueError(f"no usable corpus: {wrong}")
    if len({dims.get(kb) for kb in found}) > 1:
        wrong["*"] = "embedders differ: no vector arm"
    return found, wrong


def rrf(arms: list[DataFrame], meta: DataFrame, path: str = "path", source: Column | None = None) -> DataFrame:
    """Reciprocal rank fusion by file. arms: query_id, id, rank0; meta: id, path and what `source` filters by.

    Ranks are those of the whole arm: a row that the filter drops still takes its rank, so the filter comes after them."""
    meta = meta.where(source) if source is not None else meta
    parts = None
    for n, arm in enumerate(arms):
        best = arm.join(meta.select("id", path), "id").groupBy("query_id", path).agg(F.min("rank0").alias("best"))
        best = best.select("query_id", path, F.lit(n).alias("arm"), (1.0 / (RRF + F.col("best") + 1)).alias("part"))
        parts = best if parts is None else parts.unionByName(best)
    return parts.groupBy("query_id", path).agg(F.sum("part").alias("score"))


def normalised(hits: DataFrame, k: int, path: str = "path") -> DataFrame:
    """The k best files of each query; scores divided by the best, to 4 places."""
    best = top(hits, k, tie=path)
    return best.withColumn("score", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 4))


def file_snippets(arms: list[DataFrame], meta: DataFrame, path: str = "path", keep: int = 3) -> DataFrame:
    """The first chunks of each file that an arm has found, by rank in the first arm, then the second; a chunk that an arm hasn't found
    comes last, by id. meta: id, path of all chunks.

    Of chunks that no arm has found only a file's `keep` first by id can be among its first, so those alone meet the queries."""
    meta = meta.where(F.col(path).isNotNull()).select(path, "id")
    found = None
    for arm in arms:
        some = arm.select("query_id", "id")
        found = some if found is None else found.union(some)
    found = found.distinct()
    own = found.join(meta, "id").select("query_id", path, "id")
    head = meta.withColumn("_nth", F.row_number().over(Window.partitionBy(path).orderBy("id"))).where(F.col("_nth") <= keep).drop("_nth")
    rest = own.select("query_id", path).distinct().join(head, path).join(found, ["query_id", "id"], "left_anti")
    ranked = own.unionByName(rest)
    for n, arm in enumerate(arms):
        ranked = ranked.join(arm.select("query_id", "id", F.col("rank0").alias(f"r{n}")), ["query_id", "id"], "left").fillna({f"r{n}": 1_000_000})
    order = [f"r{n}" for n in range(len(arms))]
    nth = F.row_number().over(Window.partitionBy("query_id", path).orderBy(*order, "id"))
    first = ranked.withColumn("nth", nth).where(F.col("nth") <= keep)
    return first.groupBy("query_id", path).agg(F.sort_array(F.collect_list(F.struct("nth", "id"))).alias("chunks"))


def multi_rrf(hits: DataFrame, k: int, per: int | None = None) -> DataFrame:
    """Fuse corpora by rank. hits: query_id, kb, title, label, id, score. Hits of the same kb, title and label add up."""
    ranked = best_of(hits, per or max(k, 5)).withColumn("part", 1.0 / (RRF + F.col("nth")))
    fused = ranked.groupBy("query_id", "kb", "title", "label").agg(F.round(F.sum("part"), 6).alias("score"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "kb", "title", "label"))
    return fused.withColumn("rank", order.cast("bigint")).where(F.col("rank") <= k).withColumn("score_kind", F.lit("rrf"))


def by_corpus(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each corpus on its own."""
    return best_of(hits, k).withColumn("rank", F.col("nth").cast("bigint")).drop("nth")


def best_of(hits: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id", "kb").orderBy(F.desc("score"), F.asc("id")))
    return hits.withColumn("nth", nth).where(F.col("nth") <= k)


def one_corpus(hits: DataFrame, kb: str) -> DataFrame:
    """A single corpus needs no fusion: its hits, tagged."""
    return hits.withColumn("kb", F.lit(kb))


def pick_terms(query: Column, stop: list[str], most: int = 12) -> Column:
    """Distinct tokens of two characters or more that aren't stop words, longest first (ties by term)."""
    kept = F.array_distinct(F.filter(tokenize(query), lambda t: (F.length(t) >= 2) & ~t.isin(stop)))
    order = F.array_sort(F.transform(kept, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.slice(F.transform(order, lambda s: s["t"]), 1, most)


def passage(text: Column, at: Column, width: int = 150) -> Column:
    """A window around position `at` (from 1, 0 for none), with an ellipsis where it is cut; the head where there is none."""
    begin = F.greatest(F.lit(1), at - width // 2)
    cut = F.substring(text, begin, F.lit(2 * width))
    window = F.concat(F.when(begin > 1, "…").otherwise(""), cut, F.when(begin + 2 * width <= F.length(text), "…").otherwise(""))
    return F.when(at > 0, window).otherwise(F.concat(F.substring(text, 1, 2 * width), F.when(F.length(text) > 2 * width, "…").otherwise("")))


def pick_passage(chunks: DataFrame, terms: Column, by: list[str], order: str = "nth") -> DataFrame:
    """Of each group's chunks the one with most distinct terms, the first on ties, with the first position of any term."""
    hits = F.transform(terms, lambda t: F.instr(F.lower("text"), t))
    found = F.filter(hits, lambda p: p > 0)
    scored = chunks.withColumn("n_terms", F.size(found).cast("bigint")).withColumn("at", F.coalesce(F.array_min(found), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n_terms"), F.asc(order)))
    return scored.withColumn("pick", nth).where("pick = 1").drop("pick")


def refs_for(clues: DataFrame, anchor_hits: DataFrame, segment_hits: DataFrame, keep: int = 2) -> DataFrame:
    """References of a clue: the best hits of its anchor if that has 3 characters or more, else those of its segment."""
    own = anchor_hits.join(clues.where(F.length("anchor") >= 3).select("clue_id"), "clue_id").where(F.col("rank") <= keep)
    rest = clues.where(F.length("anchor") < 3).select("clue_id", "seg_id").join(segment_hits.where(F.col("rank") <= keep), "seg_id")
    return own.select("clue_id", "rank", "hit").union(rest.select("clue_id", "rank", "hit"))


def related(clues: DataFrame, most: int = 6) -> DataFrame:
    """For each clue up to `most` others of the same kind or the same, non-empty, actor, by id.

    `or` would be a nested-loop join; two equi-joins give each side's first `most + 1`, which is all that can be kept."""
    def side(key: str) -> DataFrame:
        rows = clues.where(F.coalesce(F.col(key), F.lit("")) != "")
        nth = F.row_number().over(Window.partitionBy(key).orderBy("clue_id"))
        few = rows.withColumn("nth", nth).where(F.col("nth") <= most + 1).select(key, F.col("clue_id").alias("other"))
        return rows.select("clue_id", key).join(few, key).where("clue_id != other").select("clue_id", "other")

    pairs = side("kind").union(side("actor")).distinct()
    nth = F.row_number().over(Window.partitionBy("clue_id").orderBy("other"))
    return pairs.withColumn("nth", nth.cast("bigint")).where(F.col("nth") <= most)
