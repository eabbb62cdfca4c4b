"""Queries of the durable corpus, word segmentation, null-aware anti joins and stored sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewater.functions import segmenter as G
from tidewater.operators import relational, search, sketches, voice
from tidewater.operators.store import Store
from tidewater.plans.retrieval import MANY, TOP, bm25_sql, many_queries, table
from tidewater.sources.shared import fresh_path, stored


def whole_files(rows):
    """A document is a file of one chunk, whose id is in its path."""
    number = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("bigint")
    return rows.select(number.alias("id"), "path", "source", F.lit("").alias("heading"), "text", F.lit(0).cast("bigint").alias("start"))


def synced(spark, sf):
    """A corpus of the documents that was synced twice and then merged: the second scan edits a seventh, lacks one and brings another."""
    at, k = Store.create(spark, fresh_path(spark, "store")), F.col("doc_id") % 7
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/kb/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("rel"), "source", F.lit(1.0).alias("mtime"), "text")
    edited = d.withColumn("text", F.when(k == 1, F.concat("text", F.lit(" edited since"))).otherwise(F.col("text"))).withColumn("mtime", F.when(k == 1, 2.0).otherwise(1.0))
    at.sync(d.where(k != 3), "/kb", worth=F.col("text").isNotNull(), chunk=whole_files)
    snap, report = at.sync(edited.where(k != 4), "/kb", worth=F.col("text").isNotNull(), chunk=whole_files)
    return at, snap, report


def store_sync(spark, sf):
    return synced(spark, sf)[2]


def store_bm25(spark, sf):
    """Search over segments and their dead marks, before any merge."""
    hits = search.top(search.bm25(synced(spark, sf)[1].index(), many_queries(spark, sf)), TOP)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank0")


def store_compacted_terms(spark, sf):
    """Document frequencies of a corpus whose segments were merged."""
    at, _, _ = synced(spark, sf)
    return at.compact(fan=2, tier=1 << 40).index().terms.select("term", "df")


#: Letters as characters of a script without spaces.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "天地人气今明大小上下左右东西南北春秋冬夏日月水火山石"


def letter_runs(texts):
    """Bytes of all runs of a-z in an Arrow array of texts, their lengths, and how many runs each text has."""
    texts = texts.fill_null("")
    at = np.frombuffer(texts.buffers()[1], "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8") if len(texts) else np.zeros(1, "i8")
    text = np.frombuffer(texts.buffers()[2] or b"", "u1")[at[0] : at[-1]]
    at -= at[0]
    held = text - np.uint8(97) < 26
    begins = held.copy()
    begins[1:] &= ~held[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = held[first]  # a text goes on with no word of the one before
    count = np.concatenate([[0], np.cumsum(begins)])
    letters = np.concatenate([[0], np.cumsum(held)])
    sizes = np.diff(letters[np.flatnonzero(begins)], append=letters[-1])
    return text[held], sizes, np.diff(count[at])


def parted(*columns):
    """Slices of a batch's columns, by the size of the first one's texts."""
    for a, b in G.parts(pc.binary_length(columns[0]).fill_null(0).to_numpy().astype("i8")):
        yield [c.slice(a, b - a) for c in columns]


def word_counts(batches):
    """word, n of a few MB of texts at a time."""
    for texts in (some for batch in batches for (some,) in parted(batch.column(0))):
        letters, sizes, _ = letter_runs(texts)
        words = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype("i4")), pa.py_buffer(letters))
        counts = words.value_counts()
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])


def run_of(texts: pa.Array) -> pa.Array:
    letters, sizes, n = letter_runs(texts)
    chars = np.frombuffer(HAN.encode(), "u1").reshape(len(LATIN), -1)[letters - 97]
    at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])] * chars.shape[1]
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(at.astype("i4")), pa.py_buffer(chars.tobytes()))


@F.arrow_udf(StringType())
def without_spaces(texts: pa.Array) -> pa.Array:
    """A text's words in one run, as characters."""
    return pa.concat_arrays([run_of(some) for (some,) in parted(texts)])


def same_of(one: pa.Array, other: pa.Array) -> pa.Array:
    def spans(cut):
        n, sizes = cut.value_lengths().to_numpy().astype("i8"), cut.flatten().to_numpy().astype("i8")
        ends = np.cumsum(sizes)
        before = np.concatenate([[0], ends])[np.cumsum(n) - n]
        return np.repeat(np.arange(len(cut)), n), ends - np.repeat(before, n), sizes

    (of, end, size), (of2, end2, size2) = spans(one), spans(other)
    if not len(of) or not len(of2):
        return pa.array(np.zeros(len(one), "i8"))
    width = max(end.max(), end2.max()) + 1
    there = of2 * width + end2
    at = np.minimum(np.searchsorted(there, of * width + end), len(there) - 1)
    return pa.array(np.bincount(of[(there[at] == of * width + end) & (size2[at] == size)], minlength=len(one)))


def judged_of(texts: pa.Array, found: pa.Array) -> pa.Array:
    _, sizes, n = letter_runs(texts)
    words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype("i4")), pa.array(sizes.astype("i4")))
    return pa.StructArray.from_arrays([pa.array(n.astype("i8")), same_of(words, found)], ["n_words", "n_right"])


@F.arrow_udf(StructType([StructField("n_words", LongType()), StructField("n_right", LongType())]))
def judged(texts: pa.Array, found: pa.Array) -> pa.Array:
    """How many words a text has, and how many of those found, given by their lengths, begin and end as one of them; no word is empty."""
    return pa.concat_arrays([judged_of(*some) for some in parted(texts, found)])


def segment_words(spark, sf):
    """Documents written without spaces, in characters, and cut into words again by their own vocabulary: per document the words, the
    words found, and the words whose begin and end are both right."""
    rows = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    vocabulary = rows.select("text").mapInArrow(word_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    tokens = G.segmenter(vocabulary.select(F.translate("word", LATIN, HAN).alias("word"), "n"))
    cut = rows.select("doc_id", "text", F.transform(tokens.tokens(without_spaces("text")), lambda w: F.length(w)).alias("found"))
    counts = cut.select("doc_id", F.size("found").cast("bigint").alias("n_found"), judged("text", "found").alias("j")).select("doc_id", "j.n_words", "n_found", "j.n_right")
    return stored(counts, "segmented")


def not_in_rows(spark, sf):
    """NOT IN with nulls on either side, on both and on none, and of two columns."""
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("a"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("b"))
    r = table(spark, sf, "labels").select(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("x"), F.lit("en").alias("y"))
    full, none = r.where("x is not null"), r.where("false")
    cases = {"plain": (["a"], full, ["x"]), "null": (["a"], r, ["x"]), "empty": (["a"], none, ["x"]), "two": (["a", "b"], full, ["x", "y"]), "two_null": (["a", "b"], r.where("x is null"), ["x", "y"])}
    out = None
    for name, (keys, right, right_keys) in cases.items():
        rows = relational.not_in(d, right, keys, right_keys).select(F.lit(name).alias("which"), "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def event_sketches(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.to_date(F.col("ts")).alias("day"), "user_id", F.col("value").cast("double").alias("value"))
    return rows, sketches.merged(sketches.sketched(rows, ["kind", "day"], "user_id", "value"), ["kind"])


def sketch_bounds(spark, sf):
    """Estimates of sketches that were stored by kind and day and merged by kind: exact figures, and whether the estimates are within
    their bounds (5 % of the distinct, 3 % of the ranks)."""
    rows, merged = event_sketches(spark, sf)
    exact = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))
    guess = sketches.estimates(merged, ["kind"], (0.5, 0.9)).select("kind", "rows", "distinct", F.get("quantiles", 0).alias("q50"), F.get("quantiles", 1).alias("q90"))
    below = lambda q, strict: F.count_if(F.col("value") < F.col(q) if strict else F.col("value") <= F.col(q))
    rank = rows.join(F.broadcast(guess), "kind").groupBy("kind").agg(*(below(q, s).alias(f"{q}_{int(s)}") for q in ("q50", "q90") for s in (True, False)), F.count("value").alias("m"))
    near = lambda q, share: (F.col(f"{q}_1") <= (share + 0.03) * F.col("m")) & (F.col(f"{q}_0") >= (share - 0.03) * F.col("m"))
    out = exact.join(guess, "kind").join(rank, "kind")
    return out.select("kind", "n", "n_users", (F.col("rows") == F.col("n")).alias("rows_right"), (F.abs(F.col("distinct") - F.col("n_users")) <= F.greatest(F.lit(1), 0.05 * F.col("n_users"))).alias("distinct_near"), (near("q50", 0.5) & near("q90", 0.9)).alias("quantiles_near"))


def span_slices(spark, sf):
    """Vectors of events' spans from windows of their users' other events; an hour counts as a second."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9
    e = table(spark, sf, "events").select("user_id", "event_id", F.round(t, 3).alias("t"), F.col("value").cast("double").alias("value"))
    spans = e.where("event_id % 3 = 0").select("user_id", "event_id", F.col("t").alias("start"), (F.col("t") + 1).alias("end"))
    windows = e.select("user_id", (F.col("t") - 0.5).alias("start"), (F.col("t") + 0.5).alias("end"), F.array("value", F.lit(1.0), F.col("event_id") % 7).alias("emb"))
    out = voice.span_vectors(spans, windows, ["user_id"], "event_id", cell=4.0, pad=0.5, least=12.0, most=6.0)
    return out.select("user_id", "event_id", "n_win", F.round("borrowed", 6).alias("borrowed"), *(F.round(F.get("emb", i), 6).alias(f"x{i}") for i in range(3)))


QUERIES = {
    "span_slices": span_slices,
    "store_sync": store_sync, "store_bm25": store_bm25, "store_compacted_terms": store_compacted_terms, "segment_words": segment_words, "not_in_rows": not_in_rows, "sketch_bounds": sketch_bounds,
}

AFTER = "kept AS (SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN text || ' edited since' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 4 AND text IS NOT NULL)"
CASES = """d AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN doc_id END AS a, CASE WHEN doc_id % 5 <> 0 THEN lang END AS b FROM documents),
r AS (SELECT CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS x, 'en' AS y FROM labels)"""

SQL = {
    "span_slices": """WITH e AS (SELECT user_id, event_id, round(epoch_us(ts) / 3.6e9::DOUBLE, 3) AS t, value::DOUBLE AS value FROM events),
s AS (SELECT user_id, event_id, t AS s0, t + 1 AS e0 FROM e WHERE event_id % 3 = 0),
n AS (SELECT a.user_id, a.event_id, a.s0 - 0.5 AS a, a.e0 + 0.5 AS b, max(b.e0) FILTER (b.e0 <= a.s0) AS low, min(b.s0) FILTER (b.s0 >= a.e0) AS high FROM s a JOIN s b ON a.user_id = b.user_id GROUP BY ALL),
r AS (SELECT *, greatest(0, a - greatest(coalesce(low, a - 6), a - 6)) AS rl, greatest(0, least(coalesce(high, b + 6), b + 6) - b) AS rh, greatest(0, 12 - (b - a)) AS need FROM n),
l AS (SELECT *, least(need / 2, rl) AS l1, least(need - least(need / 2, rl), rh) AS h FROM r),
f AS (SELECT *, l1 + least(need - l1 - h, rl - l1) AS l FROM l),
m AS (SELECT f.user_id, f.event_id, count(*) AS n_win, any_value(l + h) AS borrowed, avg(value) AS m0, avg(1.0::DOUBLE) AS m1, avg(e.event_id % 7) AS m2
  FROM f JOIN e ON e.user_id = f.user_id AND e.t - 0.5 >= a - l - 1e-9 AND e.t + 0.5 <= b + h + 1e-9 GROUP BY f.user_id, f.event_id)
SELECT user_id, event_id, n_win, round(borrowed, 6) AS borrowed, round(m0 / sqrt(m0 * m0 + m1 * m1 + m2 * m2), 6) AS x0, round(m1 / sqrt(m0 * m0 + m1 * m1 + m2 * m2), 6) AS x1, round(m2 / sqrt(m0 * m0 + m1 * m1 + m2 * m2), 6) AS x2 FROM m""",
    "store_sync": """SELECT status, count(*) AS n FROM (SELECT CASE doc_id % 7 WHEN 3 THEN 'added' WHEN 4 THEN 'removed' WHEN 1 THEN 'updated' ELSE 'unchanged' END AS status FROM documents WHERE text IS NOT NULL) GROUP BY status
UNION ALL SELECT 'skipped', count(*) FROM documents WHERE text IS NULL AND doc_id % 7 <> 4 UNION ALL SELECT 'embedded', 0""",
    "store_bm25": f"WITH {AFTER}, {bm25_sql(MANY).replace('FROM documents', 'FROM kept')} SELECT query_id, id, round(score, 6) AS score, CAST(rank0 AS BIGINT) AS rank0 FROM bmr WHERE rank0 < {TOP}",
    "store_compacted_terms": rf"WITH {AFTER}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM kept) SELECT term, count(*) AS df FROM t GROUP BY term",
    "not_in_rows": f"""WITH {CASES}
SELECT 'plain' AS which, doc_id FROM d WHERE a NOT IN (SELECT x FROM r WHERE x IS NOT NULL)
UNION ALL SELECT 'null', doc_id FROM d WHERE a NOT IN (SELECT x FROM r) UNION ALL SELECT 'empty', doc_id FROM d WHERE a NOT IN (SELECT x FROM r WHERE false)
UNION ALL SELECT 'two', doc_id FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE x IS NOT NULL AND coalesce(x = a, true) AND coalesce(y = b, true))
UNION ALL SELECT 'two_null', doc_id FROM d WHERE NOT EXISTS (SELECT 1 FROM r WHERE x IS NULL AND coalesce(x = a, true) AND coalesce(y = b, true))""",
    "sketch_bounds": "SELECT event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS n_users, true AS rows_right, true AS distinct_near, true AS quantiles_near FROM events GROUP BY event_type",
}
