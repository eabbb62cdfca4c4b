"""Index queries: two snapshots of documents as a corpus before and after; pages as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.operators import index as I
from tidewater.plans.retrieval import table


def snapshots(spark, sf):
    """Before: without every 7th document. After: others gone, edited or only touched."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("kb/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text", F.col("doc_id").cast("double").alias("mtime"))
    k = F.col("doc_id") % 7
    before = d.where(k != 3)
    after = d.where(k != 4).withColumn("text", F.when(k == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))).withColumn("mtime", F.when(k.isin(1, 2), F.col("mtime") + 1).otherwise(F.col("mtime")))
    return before, after


def sync_rows(spark, sf):
    before, after = snapshots(spark, sf)
    return I.sync_rows(I.manifest(before), I.manifest(after))


def sync_report(spark, sf):
    return I.sync_report(sync_rows(spark, sf))


def sync_pruned(spark, sf):
    before, after = snapshots(spark, sf)
    return I.pruned(I.manifest(before), "kb/src1", I.manifest(after)).select("path")


def reindexed(spark, sf):
    before, after = snapshots(spark, sf)
    out = I.reindexed(before.select("path", "text"), after.select("path", "text"), sync_rows(spark, sf))
    return out.select("path", T.content_hash(F.col("text")).alias("content_hash"))


def content_hash_dups(spark, sf):
    h = table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def embed_missing(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return I.missing(d, table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


def orphan_sweep(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")).join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


def skip_rules(spark, sf):
    rel = F.regexp_replace("url", r"^https?://[^/]*/", "")
    rel = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("rag/"), rel)).when(F.col("page_id") % 5 == 1, F.concat(rel, F.lit("-transcript.md"))).when(F.col("page_id") % 5 == 2, F.concat(rel, F.lit("/session.json"))).otherwise(rel)
    return table(spark, sf, "pages").select("page_id", I.skip_reason(rel).alias("skip_reason"))


def min_chars(spark, sf):
    return table(spark, sf, "documents").where(T.long_enough(F.col("text"))).select("doc_id")


def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean(F.col("text")).alias("c"))


def title_for(spark, sf):
    d = table(spark, sf, "documents").withColumn("h", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Top > "), "lang")).otherwise(F.lit("")))
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("intro\n## "), F.col("lang"), F.lit(" part\n"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", I.title_for(text, F.concat("source", F.lit("/note-"), F.col("doc_id").cast("string"), F.lit(".md")), F.col("h")).alias("title"))


def index_stats(spark, sf):
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("path"))
    return I.stats(c, table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")))


def norm_keys(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.norm_key(F.col("text")).alias("key"), T.is_complete(F.col("text")).alias("complete"))


def sentence_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("sentence")).cast("bigint").alias("longest"))


def oversize_slices(spark, sf):
    d = table(spark, sf, "documents").where(F.length("text") > 400)
    begin = F.explode(F.sequence(F.lit(1), F.length("text"), F.lit(200)))
    return d.select("doc_id", "text", begin.alias("b")).select("doc_id", ((F.col("b") - 1) / 200).cast("bigint").alias("nth"), F.md5(F.substring("text", F.col("b"), F.lit(200)).cast("binary")).alias("digest"))


SNAP = """before AS (SELECT 'kb/' || source || '/' || doc_id || '.md' AS path, text, CAST(doc_id AS DOUBLE) AS mtime FROM documents WHERE doc_id % 7 <> 3),
after AS (SELECT 'kb/' || source || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 7 = 1 THEN text || ' edited' ELSE text END AS text,
  CAST(doc_id AS DOUBLE) + CASE WHEN doc_id % 7 IN (1, 2) THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id % 7 <> 4),
rows AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed'
  WHEN abs(a.mtime - b.mtime) < 1e-6 AND strlen(a.text) = strlen(b.text) THEN 'unchanged' WHEN a.text = b.text THEN 'touched' ELSE 'updated' END AS status FROM before a FULL JOIN after b ON a.path = b.path)"""

QUERIES = {
    "sync_rows": sync_rows, "sync_report": sync_report, "sync_pruned": sync_pruned, "reindexed": reindexed, "content_hash_dups": content_hash_dups, "embed_missing": embed_missing,
    "orphan_sweep": orphan_sweep, "skip_rules": skip_rules, "min_chars": min_chars, "clean_text": clean_text, "title_for": title_for, "index_stats": index_stats, "norm_keys": norm_keys,
    "sentence_split": sentence_split, "oversize_slices": oversize_slices,
}

SQL = {
    "sync_rows": f"WITH {SNAP} SELECT path, status FROM rows",
    "sync_report": f"WITH {SNAP} SELECT status, count(*) AS n FROM rows GROUP BY status",
    "sync_pruned": f"WITH {SNAP} SELECT path FROM before WHERE path LIKE 'kb/src1/%' AND path NOT IN (SELECT path FROM after)",
    "reindexed": f"""WITH {SNAP} SELECT path, left(sha256(text), 32) AS content_hash FROM before WHERE path IN (SELECT path FROM rows WHERE status IN ('unchanged', 'touched'))
UNION ALL SELECT path, left(sha256(text), 32) FROM after WHERE path IN (SELECT path FROM rows WHERE status IN ('added', 'updated'))""",
    "content_hash_dups": "SELECT left(sha256(text), 32) AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1",
    "embed_missing": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "orphan_sweep": "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
    "skip_rules": "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'directory' WHEN 1 THEN 'pattern' WHEN 2 THEN 'name' END AS skip_reason FROM pages",
    "min_chars": "SELECT doc_id FROM documents WHERE length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8195) || chr(12288))) >= 40",
    "clean_text": r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[*#`|>]', ' ', 'g'), '\s+', ' ', 'g')) AS c FROM documents",
    "title_for": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ' part' ELSE 'note ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN ' — ' || lang ELSE '' END END AS title FROM documents""",
    "index_stats": "SELECT source, count(DISTINCT lang) AS files, count(*) AS chunks, count(vec_id) AS vectors FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY source",
    "norm_keys": r"""SELECT conv_id, turn, regexp_replace(text, '[\s，。、；：？！,.;:?!"''“”‘’()（）\[\]【】—…·-]+', '', 'g') AS key, coalesce(right(trim(text), 1) IN ('。', '！', '？', '!', '?', '…'), false) AS complete FROM conversations""",
    "sentence_split": r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？!?；;]*([。！？!?；;]|$)')) AS s FROM documents)
SELECT doc_id, count(*) AS n, CAST(max(length(s)) AS BIGINT) AS longest FROM s WHERE length(trim(s, ' ')) > 0 GROUP BY doc_id""",
    "oversize_slices": "WITH d AS (SELECT doc_id, text, unnest(range(0, length(text), 200)) AS b FROM documents WHERE length(text) > 400) SELECT doc_id, CAST(b // 200 AS BIGINT) AS nth, md5(substring(text, b + 1, 200)) AS digest FROM d",
}
