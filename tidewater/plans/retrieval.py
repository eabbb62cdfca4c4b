"""Retrieval queries over documents (source as file, lang as corpus), embeddings (vec_id = doc_id) and benchmark (queries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.text import clean, tokenize
from tidewater.functions.vectors import hash_embed, norm, truncated
from tidewater.operators import search as S
from tidewater.sources.shared import fingerprint, stored
from tidewater.sources.tables import read_spread

QUERY = "erheat thnt oned estion leaux ciónmente scher the"
STOP = ["the", "and", "of", "to", "de", "la", "der", "die"]
KNN, ARM, TOP = 10, 50, 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return read_spread(spark, path) if name == "documents" else spark.read.parquet(path)


_indexes: dict[tuple[str, str, str], S.Index] = {}


def index_of(spark: SparkSession, sf: str, name: str = "documents", id_col: str = "doc_id") -> S.Index:
    """The stored index of a table's texts, built once a session for the files that the table has."""
    path = f"{sf}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path, fingerprint(spark, path))
    if key not in _indexes:
        docs = spark.read.parquet(path)
        _indexes[key] = S.build_index(docs if name == "documents" else docs.withColumn("doc_id", F.expr(id_col)))
    return _indexes[key]


def one_query(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, QUERY)], "query_id bigint, query string")


def many_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def tokenize_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"))


def postings(spark, sf):
    return S.postings(spark.read.parquet(f"{sf}/documents.parquet"))


def corpus_stats(spark, sf):
    return S.corpus_stats(table(spark, sf, "documents")).select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark, sf):
    hits = S.top(S.bm25(index_of(spark, sf), one_query(spark)), TOP)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank0")


def bm25_batch(spark, sf):
    hits = S.top(S.bm25(index_of(spark, sf), many_queries(spark, sf)), TOP)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank0")


def vector_queries(spark, sf, where):
    return table(spark, sf, "embeddings").where(where).select(F.col("vec_id").alias("query_id"), "embedding")


def knn_topk(spark, sf):
    return S.knn(table(spark, sf, "embeddings"), vector_queries(spark, sf, "vec_id = 7"), KNN).withColumn("score", F.round("score", 6))


def knn_batch(spark, sf):
    return S.knn(table(spark, sf, "embeddings"), vector_queries(spark, sf, "vec_id % 100 = 0"), KNN).withColumn("score", F.round("score", 6))


def arms(spark, sf, n=ARM):
    docs = table(spark, sf, "documents")
    lexical = S.top(S.bm25(index_of(spark, sf), many_queries(spark, sf)), n)
    queries = table(spark, sf, "embeddings").join(many_queries(spark, sf).select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    dense = S.knn(table(spark, sf, "embeddings").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi"), queries, n)
    meta = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("path"), "lang")
    return [lexical, dense], meta


def rrf_hybrid(spark, sf):
    a, meta = arms(spark, sf)
    return S.top(S.rrf(a, meta).withColumn("score", F.round("score", 9)), TOP, tie="path")


def rrf_source_filter(spark, sf):
    a, meta = arms(spark, sf, S.pool(ARM, True))
    return S.top(S.rrf(a, meta, source=F.col("lang") == "en").withColumn("score", F.round("score", 9)), TOP, tie="path")


def rrf_norm(spark, sf):
    a, meta = arms(spark, sf)
    return S.normalised(S.rrf(a, meta).withColumn("score", F.round("score", 9)), TOP)


def file_top3_chunks(spark, sf):
    a, meta = arms(spark, sf)
    out = S.file_snippets([stored(arm, "arm") for arm in a], meta)
    return out.select("query_id", "path", F.array_join(F.transform("chunks", lambda c: c["id"].cast("string")), ",").alias("ids"))


def corpus_hits(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kb"), F.col("source").alias("title"), F.lit("").alias("label"))
    return S.bm25(index_of(spark, sf), many_queries(spark, sf)).join(docs.hint("shuffle_hash"), "id")


def multi_rrf(spark, sf):
    return S.multi_rrf(corpus_hits(spark, sf), TOP).select("query_id", "kb", "title", "label", "score", "rank", "score_kind")


def grouped_by_kb(spark, sf):
    return S.by_corpus(corpus_hits(spark, sf), 3).select("query_id", "kb", "id", F.round("score", 6).alias("score"), "rank")


def query_terms(spark, sf):
    q = many_queries(spark, sf)
    return q.select("query_id", F.array_join(S.pick_terms(F.col("query"), STOP), " ").alias("terms"))


def passage_pick(spark, sf):
    q = many_queries(spark, sf).select("query_id", S.pick_terms(F.col("query"), STOP).alias("terms"))
    hits = S.top(S.bm25(index_of(spark, sf), many_queries(spark, sf)), 3)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = hits.select("query_id", "id", F.col("rank0").alias("nth")).join(docs, "id").join(q, "query_id")
    out = S.pick_passage(rows, F.col("terms"), ["query_id"])
    return out.select("query_id", "id", "n_terms", F.col("at").cast("bigint").alias("at"))


def passage_window(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", clean(F.col("text")).alias("c"))
    return docs.select("doc_id", S.passage(F.col("c"), F.instr(F.lower("c"), "the")).alias("passage"))


def literal_search(spark, sf):
    hit = table(spark, sf, "conversations").where(F.contains(F.lower("text"), F.lit("and")))
    nth = F.row_number().over(Window.orderBy("conv_id", "turn"))
    first = hit.select("conv_id", "turn").orderBy("conv_id", "turn").limit(20)
    return first.withColumn("nth", nth.cast("bigint")).crossJoin(F.broadcast(hit.agg(F.count(F.lit(1)).alias("total"))))


def evidence_related(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("clue_id"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("actor"))
    return S.related(e)


def embed_hash(spark, sf):
    d = hash_embed(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", 32).select("conv_id", "turn", truncated(F.col("embedding"), 16).alias("v"))
    return d.select("conv_id", "turn", F.round(norm(F.col("v")), 6).alias("length"), F.size("v").alias("width"))


TOKENS = r"""toks AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)"""


def bm25_sql(q: str) -> str:
    return rf"""{TOKENS},
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
ex AS (SELECT id, len(t) AS dl, unnest(t) AS term FROM toks),
qt AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+')) AS term FROM ({q})),
q AS (SELECT DISTINCT query_id, term FROM qt),
tf AS (SELECT id, dl, term, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM q) GROUP BY id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT q.query_id, tf.id, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 9) AS score
  FROM tf JOIN df ON tf.term = df.term JOIN q ON tf.term = q.term CROSS JOIN stats GROUP BY q.query_id, tf.id),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank0 FROM bm)"""


def knn_sql(rows: str, queries: str, k: int) -> str:
    return f"""kq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE {queries}),
kr AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {rows}),
ks AS (SELECT query_id, id, round(list_dot_product(q, v), 9) AS score FROM kq CROSS JOIN kr),
kr0 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS rank0 FROM ks),
knn AS (SELECT * FROM kr0 WHERE rank0 < {k})"""


MANY = "SELECT item_id AS query_id, text AS query FROM benchmark"
ONE = f"SELECT CAST(0 AS BIGINT) AS query_id, '{QUERY}' AS query"


def arms_sql(n: int) -> str:
    return bm25_sql(MANY) + ",\n" + knn_sql("vec_id IN (SELECT doc_id FROM documents)", "vec_id IN (SELECT item_id FROM benchmark)", n)


ARMS = arms_sql(ARM)
STOPS = ", ".join(f"'{s}'" for s in STOP)


def rrf_sql(where: str = "TRUE", n: int = ARM) -> str:
    return f"""{arms_sql(n)},
meta AS (SELECT doc_id AS id, source AS path FROM documents WHERE {where}),
parts AS (SELECT query_id, path, 1.0::DOUBLE / (60 + min(rank0) + 1) AS part FROM bmr JOIN meta USING (id) WHERE rank0 < {n} GROUP BY query_id, path
  UNION ALL SELECT query_id, path, 1.0::DOUBLE / (60 + min(rank0) + 1) FROM knn JOIN meta USING (id) GROUP BY query_id, path),
fused AS (SELECT query_id, path, round(sum(part), 9) AS score FROM parts GROUP BY query_id, path),
best AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) - 1 AS BIGINT) AS rank0 FROM fused) WHERE rank0 < {TOP})"""


HITS = f"""{bm25_sql(MANY)},
hits AS (SELECT bm.query_id, d.lang AS kb, d.source AS title, '' AS label, bm.id, bm.score FROM bm JOIN documents d ON d.doc_id = bm.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb ORDER BY score DESC, id) AS nth FROM hits)"""

QT = rf"""qw AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2 AND t NOT IN ({STOPS}))) AS w FROM benchmark),
qe AS (SELECT query_id, unnest(w) AS t FROM qw),
qr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(t) DESC, t) AS k FROM qe),
qterms AS (SELECT qw.query_id, coalesce(list(t ORDER BY k) FILTER (WHERE k <= 12), []) AS terms FROM qw LEFT JOIN qr USING (query_id) GROUP BY qw.query_id)"""

QUERIES = {
    "tokenize_stats": tokenize_stats, "postings": postings, "corpus_stats": corpus_stats, "bm25_topk": bm25_topk, "bm25_batch": bm25_batch, "knn_topk": knn_topk, "knn_batch": knn_batch,
    "rrf_hybrid": rrf_hybrid, "rrf_source_filter": rrf_source_filter, "rrf_norm": rrf_norm, "file_top3_chunks": file_top3_chunks, "multi_rrf": multi_rrf, "grouped_by_kb": grouped_by_kb,
    "query_terms": query_terms, "passage_pick": passage_pick, "passage_window": passage_window, "literal_search": literal_search, "evidence_related": evidence_related, "embed_hash": embed_hash,
}

SQL = {
    "tokenize_stats": f"WITH {TOKENS} SELECT id AS doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM toks",
    "postings": f"WITH {TOKENS}, ex AS (SELECT id, CAST(len(t) AS BIGINT) AS dl, unnest(t) AS term FROM toks) SELECT id, dl, term, count(*) AS tf FROM ex GROUP BY id, dl, term",
    "corpus_stats": f"WITH {TOKENS} SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM toks",
    "bm25_topk": f"WITH {bm25_sql(ONE)} SELECT query_id, id, round(score, 6) AS score, CAST(rank0 AS BIGINT) AS rank0 FROM bmr WHERE rank0 < {TOP}",
    "bm25_batch": f"WITH {bm25_sql(MANY)} SELECT query_id, id, round(score, 6) AS score, CAST(rank0 AS BIGINT) AS rank0 FROM bmr WHERE rank0 < {TOP}",
    "knn_topk": f"WITH {knn_sql('TRUE', 'vec_id = 7', KNN)} SELECT query_id, id, round(score, 6) AS score, CAST(rank0 AS BIGINT) AS rank0 FROM knn",
    "knn_batch": f"WITH {knn_sql('TRUE', 'vec_id % 100 = 0', KNN)} SELECT query_id, id, round(score, 6) AS score, CAST(rank0 AS BIGINT) AS rank0 FROM knn",
    "rrf_hybrid": f"WITH {rrf_sql()} SELECT query_id, path, score, rank0 FROM best",
    "rrf_source_filter": f"""WITH {rrf_sql("lang = 'en'", 200)} SELECT query_id, path, score, rank0 FROM best""",
    "rrf_norm": f"WITH {rrf_sql()} SELECT query_id, path, round(score / max(score) OVER (PARTITION BY query_id), 4) AS score, rank0 FROM best",
    "file_top3_chunks": f"""WITH {ARMS}, lex AS (SELECT * FROM bmr WHERE rank0 < {ARM}),
found AS (SELECT query_id, id FROM lex UNION SELECT query_id, id FROM knn),
files AS (SELECT DISTINCT query_id, d.source AS path FROM found JOIN documents d ON d.doc_id = found.id),
ch AS (SELECT f.query_id, f.path, d.doc_id AS id, coalesce(lex.rank0, 1000000) AS r0, coalesce(knn.rank0, 1000000) AS r1 FROM files f JOIN documents d ON d.source = f.path
  LEFT JOIN lex ON lex.query_id = f.query_id AND lex.id = d.doc_id LEFT JOIN knn ON knn.query_id = f.query_id AND knn.id = d.doc_id),
nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY r0, r1, id) AS nth FROM ch)
SELECT query_id, path, string_agg(CAST(id AS VARCHAR), ',' ORDER BY nth) AS ids FROM nth WHERE nth <= 3 GROUP BY query_id, path""",
    "multi_rrf": f"""WITH {HITS}, fused AS (SELECT query_id, kb, title, label, round(sum(1.0::DOUBLE / (60 + nth)), 6) AS score FROM ranked WHERE nth <= {TOP} GROUP BY query_id, kb, title, label),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kb, title, label) AS BIGINT) AS rank FROM fused)
SELECT query_id, kb, title, label, score, rank, 'rrf' AS score_kind FROM r WHERE rank <= {TOP}""",
    "grouped_by_kb": f"WITH {HITS} SELECT query_id, kb, id, round(score, 6) AS score, CAST(nth AS BIGINT) AS rank FROM ranked WHERE nth <= 3",
    "query_terms": f"WITH {QT} SELECT query_id, array_to_string(terms, ' ') AS terms FROM qterms",
    "passage_pick": f"""WITH {bm25_sql(MANY)}, {QT},
c AS (SELECT bmr.query_id, bmr.id, rank0, lower(d.text) AS t, terms FROM bmr JOIN documents d ON d.doc_id = bmr.id JOIN qterms ON qterms.query_id = bmr.query_id WHERE rank0 < 3),
p AS (SELECT query_id, id, rank0, list_filter(list_transform(terms, lambda x: strpos(t, x)), lambda x: x > 0) AS pos FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len(pos) DESC, rank0) AS k FROM p)
SELECT query_id, id, CAST(len(pos) AS BIGINT) AS n_terms, CAST(coalesce(list_min(pos), 0) AS BIGINT) AS at FROM r WHERE k = 1""",
    "passage_window": r"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[*#`|>]', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM documents),
p AS (SELECT *, strpos(lower(c), 'the') AS pos, greatest(1, strpos(lower(c), 'the') - 75) AS b FROM c)
SELECT doc_id, CASE WHEN pos > 0 THEN CASE WHEN b > 1 THEN '…' ELSE '' END || substring(c, b, 300) || CASE WHEN b + 300 <= length(c) THEN '…' ELSE '' END
  ELSE substring(c, 1, 300) || CASE WHEN length(c) > 300 THEN '…' ELSE '' END END AS passage FROM p""",
    "literal_search": """WITH h AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS nth, count(*) OVER () AS total FROM conversations WHERE contains(lower(text), 'and'))
SELECT conv_id, turn, CAST(nth AS BIGINT) AS nth, total FROM h WHERE nth <= 20""",
    "evidence_related": """WITH e AS (SELECT event_id, event_type, user_id FROM events),
k AS (SELECT event_type, event_id AS other FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM e) WHERE n <= 7),
a AS (SELECT user_id, event_id AS other FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM e) WHERE n <= 7),
p AS (SELECT event_id AS clue_id, other FROM e JOIN k USING (event_type) WHERE event_id <> other UNION SELECT event_id, other FROM e JOIN a USING (user_id) WHERE event_id <> other),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY clue_id ORDER BY other) AS BIGINT) AS nth FROM p)
SELECT clue_id, other, nth FROM r WHERE nth <= 6""",
}
