"""Event-table and timeline queries over the driver's events: user as meeting and key, event_type as type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.text import event_key
from tidewater.operators import events as E
from tidewater.operators import timeline as W
from tidewater.plans.retrieval import bm25_sql, index_of, table


def event_table(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id"), F.col("user_id").cast("string").alias("meeting_id"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.col("event_type").alias("type"),
        F.concat_ws(" ", "event_type", "props").alias("content"), F.when(F.col("value") > 50, F.date_format("ts", "MM-dd")).otherwise("").alias("deadline"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("owner"), F.lit("").alias("section"), F.col("event_id").alias("seq"),
    )


def meetings(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("meeting_id"), F.col("c_name").alias("title"))


def spans(spark, sf):
    e = table(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", "user_id", t.alias("start"), (t + F.abs(F.col("value")) * 60).alias("end"), "event_type")


def event_aggregate(spark, sf):
    return E.aggregate(event_table(spark, sf), type="click", owner="u3", has_deadline=False, date_to="2024-06-30")


def event_by_type(spark, sf):
    return E.by_type(event_table(spark, sf))


def event_list(spark, sf):
    return E.list_by(event_table(spark, sf), meetings(spark, sf), 50, has_deadline=True).select("event_id", "date", "seq", "title")


def event_timeline(spark, sf):
    out = E.timeline(event_table(spark, sf), meetings(spark, sf), "PURCH")
    return out.select("at", F.size("items").cast("bigint").alias("n"), F.array_join(F.transform("items", lambda i: i["seq"].cast("string")), ",").alias("seqs"), "first_date", "last_date")


def event_stats(spark, sf):
    return E.stats(event_table(spark, sf))


def event_dedup(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("source").alias("meeting_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content"))
    fresh = lines.select("meeting_id", "content", (F.col("doc_id") * 100_000 + F.col("pos")).alias("seq"))
    kept = E.upsert(fresh.limit(0), fresh)
    return kept.select("meeting_id", "seq", event_key(F.col("content")).alias("key"))


def event_find(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return E.find(index_of(spark, sf, "conversations", "conv_id * 1000 + turn"), q, 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank0")


def regex_dates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("on "), (F.col("doc_id") % 150 + 1960).cast("string"), F.lit("-"), (F.col("doc_id") % 14).cast("string"), F.lit("."), (F.col("doc_id") % 33).cast("string"), F.lit(" text")).alias("s"))
    return d.select("doc_id", E.normalize_date(F.col("s")).alias("date"))


def first_pattern_wins(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("x "), F.when(F.col("doc_id") % 3 == 0, F.lit("5天内 ")).otherwise(""), F.when(F.col("doc_id") % 2 == 0, F.lit("9月5日前")).otherwise(F.lit("月底前"))).alias("s"))
    return d.select("doc_id", E.find_deadline(F.col("s")).alias("deadline"))


def minutes(spark, sf):
    """Minutes made from documents: a heading before every third line, unknown headings too."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    heads = ["## 1. 关键决策", "## 2. 行动项", "### 其它", "## 3. 议题要点"]
    mark = F.flatten(F.transform(lines, lambda x, i: F.when(i % 3 == 1, F.array(F.get(F.lit(heads), (F.floor(i / 3) % 4).cast("int")), x)).otherwise(F.array(x))))
    return table(spark, sf, "documents").select(F.concat(F.lit("m/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.array_join(mark, "\n").alias("text"))


def sections_ffill(spark, sf):
    return E.sections(minutes(spark, sf)).groupBy("path", "section").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("bigint").alias("first"))


def meeting_ids(spark, sf):
    return minutes(spark, sf).select(E.meeting_id(F.col("path")).alias("meeting_id"))


def interval_merge(spark, sf):
    return W.merge_intervals(spans(spark, sf), ["user_id"]).select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


def clip_spans(spark, sf):
    s = spans(spark, sf)
    out = W.clip(s.where("event_type != 'error'"), s.where("event_type = 'error'").select("user_id", "start"), ["user_id"], "event_id")
    return out.select("user_id", "event_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


def sessionize(spark, sf):
    e = spans(spark, sf)
    return W.sessions(e, ["user_id"], F.col("start"), 86400.0).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("start") - F.min("start"), 3).alias("seconds"))


def endpoint_rules(spark, sf):
    e = spans(spark, sf)
    out = W.endpoints(e, ["user_id"], F.col("start"), F.col("event_type") == "purchase", 172800.0, 43200.0, 604800.0)
    return out.select("event_id", "utterance", F.col("piece").cast("bigint").alias("piece"))


def latest_per_key(spark, sf):
    return W.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


def settle_pending(spark, sf):
    e = spans(spark, sf).select(F.col("event_id").alias("idx"), F.col("start").alias("changed_at"), (F.col("event_id") % 3 == 0).alias("analysed"), (F.col("event_id") % 5).alias("tries"))
    return W.settled(e, F.lit(1.9e9), most=40).select("idx", "tries")


def since_poll(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("idx"), (F.col("event_id") % 97).alias("revision"))
    rows, rev = W.since(e, 500)
    return rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(rev))


def spk_counts(spark, sf):
    return table(spark, sf, "events").where("event_type != ''").groupBy(F.col("event_type").alias("spk")).agg(F.count(F.lit(1)).alias("n"))


def nearest_in_time(spark, sf):
    e = spans(spark, sf)
    a = e.where("event_type = 'error'").select("user_id", "event_id", F.col("start").alias("t"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("start").alias("t"))
    return W.nearest(a, b, ["user_id"], "event_id", "click_id").select("user_id", "event_id", "click_id", F.round("away", 3).alias("away"))


def neighbour_bounds(spark, sf):
    return W.neighbour_bounds(spans(spark, sf), ["user_id"], "event_id").select("event_id", F.round("low", 3).alias("low"), F.round("high", 3).alias("high"))


def apportion(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.lit(0.0).alias("start"), F.lit(60.0).alias("end"))
    return W.apportion(c, ["conv_id"], "turn").select("conv_id", "turn", F.round("p_start", 6).alias("p_start"), F.round("p_end", 6).alias("p_end"))


def event_span(spark, sf):
    """First and last date of the events whose content has a word, and of how many meetings they are."""
    e = event_table(spark, sf).where(E.contains_ci(F.col("content"), F.lit("purch")))
    return e.groupBy("type").agg(F.min(F.nullif("date", F.lit(""))).alias("first_date"), F.max(F.nullif("date", F.lit(""))).alias("last_date"), F.countDistinct("meeting_id").alias("meetings"))


def coverage_mask(spark, sf):
    e = spans(spark, sf)
    upto = F.max("start").over(Window.partitionBy("user_id"))
    rows = e.select("user_id", "start", "end", (F.col("event_type") == "error").alias("open"), (upto - 86400 * 30).alias("_upto"))
    out = W.coverage_mask(rows, ["user_id"], F.col("_upto"), margin=86400.0, most=5)
    return out.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


def published_actions(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select("user_id", (F.col("event_id") % 3).alias("idx"), F.col("event_id").alias("rev"), F.col("event_type").alias("text"), F.concat(F.lit("s"), F.floor(F.col("event_id") / 7) % 2).alias("spk"))
    return W.republished(rows, ["user_id"]).select("rev", "action")


def rebased_rows(spark, sf):
    e = spans(spark, sf).select("user_id", "event_id", (F.col("event_id") % 5).alias("idx"), "start", "end", F.col("event_id").alias("at"))
    return W.rebased(e, ["user_id"], 100, 60.0).select("event_id", "idx", F.round("start", 3).alias("start"))


EV = """e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS meeting_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS date, event_type AS type, event_type || ' ' || props AS content,
  CASE WHEN value > 50 THEN strftime(ts, '%m-%d') ELSE '' END AS deadline, 'u' || (user_id % 7) AS owner, event_id AS seq FROM events)"""
MT = "m AS (SELECT CAST(c_custkey AS VARCHAR) AS meeting_id, c_name AS title FROM customer)"
SP = "s AS (SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS a, epoch_us(ts) / 1e6::DOUBLE + abs(value) * 60 AS b FROM events)"
MIN = """d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents),
x AS (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM d),
y AS (SELECT doc_id, i, l[i + 1] AS line, CASE WHEN i % 3 = 1 THEN (i // 3) % 4 END AS h FROM x),
z AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS now, count(h) OVER (PARTITION BY doc_id ORDER BY i) AS heads FROM y),
f AS (SELECT *, last_value(CASE WHEN h <> 2 THEN h END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM z)"""

FIND = bm25_sql("SELECT item_id AS query_id, text AS query FROM benchmark").replace("SELECT doc_id AS id", "SELECT conv_id * 1000 + turn AS id").replace("FROM documents)", "FROM conversations)")

QUERIES = {
    "event_aggregate": event_aggregate, "event_by_type": event_by_type, "event_list": event_list, "event_timeline": event_timeline, "event_stats": event_stats, "event_dedup": event_dedup, "event_find": event_find,
    "regex_dates": regex_dates, "first_pattern_wins": first_pattern_wins, "sections_ffill": sections_ffill, "meeting_ids": meeting_ids, "interval_merge": interval_merge, "clip_spans": clip_spans, "sessionize": sessionize,
    "endpoint_rules": endpoint_rules, "latest_per_key": latest_per_key, "settle_pending": settle_pending, "since_poll": since_poll, "spk_counts": spk_counts, "nearest_in_time": nearest_in_time, "neighbour_bounds": neighbour_bounds, "apportion": apportion,
    "event_span": event_span, "coverage_mask": coverage_mask, "published_actions": published_actions, "rebased_rows": rebased_rows,
}

SQL = {
    "event_span": f"WITH {EV} SELECT type, min(nullif(date, '')) AS first_date, max(nullif(date, '')) AS last_date, count(DISTINCT meeting_id) AS meetings FROM e WHERE contains(lower(content), 'purch') GROUP BY type",
    "coverage_mask": f"""WITH {SP}, u AS (SELECT *, max(a) OVER (PARTITION BY user_id) - 86400 * 30 AS upto FROM s), k AS (SELECT user_id, a, b FROM u WHERE event_type <> 'error' AND b > upto - 86400),
h AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM k),
g AS (SELECT *, sum(CASE WHEN a > hi THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM h),
m AS (SELECT user_id, min(a) AS a, max(b) AS b, count(*) AS n FROM g GROUP BY user_id, g), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a DESC) AS k FROM m)
SELECT user_id, round(a, 3) AS start, round(b, 3) AS "end", n FROM r WHERE k <= 5""",
    "published_actions": """WITH e AS (SELECT user_id, event_id % 3 AS idx, event_id AS rev, event_type AS t, 's' || CAST((event_id // 7) % 2 AS VARCHAR) AS spk FROM events),
l AS (SELECT *, lag(t) OVER w AS pt, lag(spk) OVER w AS ps, lag(rev) OVER w AS pr FROM e WINDOW w AS (PARTITION BY user_id, idx ORDER BY rev))
SELECT rev, CASE WHEN pr IS NULL OR t IS DISTINCT FROM pt THEN 'analyse' WHEN spk IS DISTINCT FROM ps THEN 'refresh' ELSE 'none' END AS action FROM l""",
    "rebased_rows": f"""WITH {SP}, f AS (SELECT user_id, event_id % 5 AS idx, min(event_id) AS met FROM s GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY met, idx) + 99 AS new FROM f)
SELECT event_id, CAST(new AS BIGINT) AS idx, round(a + 60, 3) AS start FROM s JOIN n ON n.user_id = s.user_id AND n.idx = s.event_id % 5""",
    "event_aggregate": f"WITH {EV} SELECT count(*) AS total FROM e WHERE type = 'click' AND (owner = 'u3' OR contains(lower(content), 'u3')) AND deadline = '' AND date <= '2024-06-30'",
    "event_by_type": "SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type",
    "event_list": f"WITH {EV}, {MT} SELECT event_id, date, seq, title FROM e LEFT JOIN m ON e.meeting_id = m.meeting_id WHERE deadline <> '' ORDER BY date, seq, e.meeting_id LIMIT 50",
    "event_timeline": f"""WITH {EV}, t AS (SELECT * FROM e WHERE contains(lower(content), 'purch') ORDER BY date, seq, meeting_id LIMIT 60)
SELECT coalesce(nullif(date, ''), meeting_id) AS at, count(*) AS n, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS seqs, min(nullif(date, '')) AS first_date, max(date) AS last_date FROM t GROUP BY 1""",
    "event_stats": f"WITH {EV} SELECT count(*) AS events, count(DISTINCT meeting_id) AS meetings, count(DISTINCT nullif(date, '')) AS dates, min(nullif(date, '')) AS first_date, max(date) AS last_date FROM e",
    "event_dedup": r"""WITH d AS (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents), x AS (SELECT source, doc_id, l, unnest(range(0, len(l))) AS i FROM d),
k AS (SELECT source AS meeting_id, doc_id * 100000 + i AS seq, substring(regexp_replace(l[i + 1], '[^\p{L}\p{N}]+', '', 'g'), 1, 60) AS key FROM x)
SELECT meeting_id, min(seq) AS seq, key FROM k WHERE key <> '' GROUP BY meeting_id, key""",
    "event_find": f"""WITH {FIND} SELECT query_id, id, round(score, 6) AS score, CAST(rank0 AS BIGINT) AS rank0 FROM bmr WHERE rank0 < 10""",
    "regex_dates": """WITH d AS (SELECT doc_id, doc_id % 150 + 1960 AS y, doc_id % 14 AS m, doc_id % 33 AS d FROM documents)
SELECT doc_id, CASE WHEN y BETWEEN 2000 AND 2100 AND m BETWEEN 1 AND 12 AND d BETWEEN 1 AND 31 THEN y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') ELSE '' END AS date FROM d""",
    "first_pattern_wins": r"""WITH s AS (SELECT doc_id, 'x ' || CASE WHEN doc_id % 3 = 0 THEN '5天内 ' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN '9月5日前' ELSE '月底前' END AS s FROM documents)
SELECT doc_id, trim(coalesce(nullif(regexp_extract(s, '\d{1,2}\s*月\s*\d{1,2}\s*日\s*(?:前|之前|以前|左右)?'), ''), nullif(regexp_extract(s, '\d{4}\s*[-/年.]\s*\d{1,2}\s*[-/月.]\s*\d{1,2}\s*日?\s*(?:前|之前)?'), ''),
  nullif(regexp_extract(s, '(?:本周|下周|本月|下月|节前|月底|年底)[一二三四五六日天]?\s*(?:前|之前)?'), ''), nullif(regexp_extract(s, '\d+\s*(?:个)?(?:工作日|天|周|月)(?:内|以内|之内)'), ''), '')) AS deadline FROM s""",
    "sections_ffill": f"""WITH {MIN} SELECT 'm/' || doc_id || '.md' AS path, CASE sec WHEN 0 THEN '决策' WHEN 1 THEN '行动项' ELSE '议题' END AS section,
count(*) + count(CASE WHEN h = 2 THEN 1 END) AS n, min(CASE WHEN h = 2 THEN i + heads - 1 ELSE i + heads END) AS first FROM f WHERE sec IS NOT NULL GROUP BY doc_id, sec""",
    "meeting_ids": "SELECT doc_id || '-' || left(sha1('m/' || doc_id || '.md'), 8) AS meeting_id FROM documents",
    "interval_merge": f"""WITH {SP}, h AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM s),
g AS (SELECT *, sum(CASE WHEN a > hi THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM h)
SELECT user_id, round(min(a), 3) AS start, round(max(b), 3) AS "end", count(*) AS n FROM g GROUP BY user_id, g""",
    "clip_spans": f"""WITH {SP}, c AS (SELECT s.user_id, s.event_id, s.a, s.b, (SELECT min(m.a) FROM s m WHERE m.event_type = 'error' AND m.user_id = s.user_id AND m.a > s.a AND m.a < s.b) AS cut FROM s WHERE event_type <> 'error')
SELECT user_id, event_id, round(a, 3) AS start, round(coalesce(cut, b), 3) AS "end" FROM c WHERE coalesce(cut, b) - a > 0.2""",
    "sessionize": f"""WITH {SP}, n AS (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY user_id ORDER BY a, event_id) < 86400 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS session FROM n)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(max(a) - min(a), 3) AS seconds FROM g GROUP BY user_id, session""",
    "endpoint_rules": f"""WITH {SP}, n AS (SELECT *, a - lag(a) OVER w AS gap, lag(event_type = 'purchase') OVER w AS done FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, event_id)),
u AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 172800 OR (gap >= 43200 AND done) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u FROM n)
SELECT event_id, CAST(u AS BIGINT) AS utterance, CAST(floor((a - min(a) OVER (PARTITION BY user_id, u)) / 604800) AS BIGINT) AS piece FROM u""",
    "latest_per_key": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "settle_pending": "SELECT event_id AS idx, event_id % 5 AS tries FROM events WHERE event_id % 3 <> 0 AND event_id % 5 < 3 ORDER BY ts, event_id LIMIT 40",
    "since_poll": "SELECT (SELECT count(*) FROM events WHERE event_id >= 500) AS n, (SELECT max(event_id % 97) FROM events) AS history_rev",
    "spk_counts": "SELECT event_type AS spk, count(*) AS n FROM events WHERE event_type <> '' GROUP BY event_type",
    "nearest_in_time": f"""WITH {SP}, p AS (SELECT l.user_id, l.event_id, r.event_id AS click_id, abs(l.a - r.a) AS away, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.a - r.a), r.a, r.event_id) AS k
  FROM s l LEFT JOIN s r ON r.user_id = l.user_id AND r.event_type = 'click' WHERE l.event_type = 'error')
SELECT user_id, event_id, click_id, round(away, 3) AS away FROM p WHERE k = 1""",
    "neighbour_bounds": f"""WITH {SP} SELECT event_id, round((SELECT max(o.b) FROM s o WHERE o.user_id = s.user_id AND o.b <= s.a), 3) AS low, round((SELECT min(o.a) FROM s o WHERE o.user_id = s.user_id AND o.a >= s.b), 3) AS high FROM s""",
    "apportion": """WITH c AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id) AS t, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS u FROM conversations)
SELECT conv_id, turn, round(60.0::DOUBLE * (u - n) / t, 6) AS p_start, round(60.0::DOUBLE * u / t, 6) AS p_end FROM c""",
}
