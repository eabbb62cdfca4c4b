"""Clue, keyword, report, graph, voice and evaluation queries over conversations, documents, pages and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import text as T
from tidewater.functions.vectors import cosine
from tidewater.operators import chunk, clues, evaluate, report, state, voice
from tidewater.operators import search as S
from tidewater.plans.retrieval import HITS, MANY, ONE, QT, TOKENS, arms, bm25_sql, corpus_hits, index_of, many_queries, one_query, rrf_sql, table

STOP = ["the", "and", "of", "to", "is"]
YEAR = r"[a-z]*tion[a-z]*"


def clue_anchors(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(clues.anchors(F.lower("text"), YEAR)).alias("pos", "anchor"))
    return c.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "anchor")


def clue_clause(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", clues.clause_around(F.col("text"), "the").alias("clause"))


def clue_dedup(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", clues.keep_longest(clues.anchors(F.lower("text"), YEAR)).alias("a"))
    return c.select("conv_id", "turn", F.array_join("a", " ").alias("kept"))


def clue_tables(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(clues.anchors(F.lower("text"), YEAR))).alias("anchor"))
    rule = c.where(F.length("anchor") % 2 == 0).select("conv_id", "turn", "anchor", F.when(F.length("anchor") % 3 == 0, "deadline").otherwise("term").alias("kind"), F.col("anchor").alias("text"), F.lit(0.7).alias("confidence"))
    model = c.where(F.length("anchor") % 4 != 1).select("conv_id", "turn", "anchor", F.lit("risk").alias("kind"), F.upper("anchor").alias("text"), (F.length("anchor") / 20).alias("confidence"), F.lit("a").alias("actor"), F.lit("").alias("due"))
    return rule, model


def clue_merge(spark, sf):
    rule, model = clue_tables(spark, sf)
    return clues.merge(rule, model, ["conv_id", "turn"]).withColumn("confidence", F.round("confidence", 6))


def clue_board(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("role").alias("kind"), "text", F.lit("").alias("anchor"), (F.col("turn") / 10).alias("confidence"), F.lit("").alias("actor"), F.lit("").alias("due"), F.lit(False).alias("pinned"), F.col("turn").cast("double").alias("t"))
    return clues.board(c, ["session"]).select("session", "kind", "norm", "text", F.round("confidence", 6).alias("confidence"), "t")


def clue_sorted(spark, sf):
    e = table(spark, sf, "events")
    c = e.select(F.col("user_id").alias("session"), F.element_at(F.lit(clues.KINDS), (F.col("event_id") % 10 + 1).cast("int")).alias("kind"), (F.col("event_id") % 17 == 0).alias("pinned"), F.col("value").alias("t"), F.col("event_id").alias("id"))
    return clues.ordered(c).select("session", "id", "place")


def clue_rules(spark, sf):
    """Utterances made from events, as no table holds Chinese: each kind of event says something of its own."""
    e, day = table(spark, sf, "events"), lambda n: (F.col("event_id") % n + 1).cast("string")
    said = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("我们会在"), day(12), F.lit("月"), day(28), F.lit("日之前交付，软件必须通过测试。")))
        .when(F.col("event_type") == "error", F.concat(F.lit("你们公司要尽快确定，请张伟"), day(9), F.lit("号来")))
        .when(F.col("event_type") == "view", F.concat(F.lit("下周"), F.lit("三由华东设计院答复，王主任"), day(5), F.lit("天内回复")))
        .otherwise(F.concat(F.lit("我方负责现场布线，"), F.col("event_type"), F.lit("不得延期到"), F.lit("2024-"), day(12), F.lit("-"), day(28)))
    )
    return clues.extract(e.select("event_id", said.alias("text")), ["event_id"], people=("张伟",)).drop("rule")


def keywords_topn(spark, sf):
    return clues.keywords(table(spark, sf, "conversations"), ["conv_id", "turn"], "text", STOP).select("conv_id", "turn", "term", "n", "rank")


def keyword_prf(spark, sf):
    """A turn's words as keywords of the turn before."""
    words = lambda c: F.array_distinct(T.tokenize(F.col(c)))
    c = turns(spark, sf).select("conv_id", "turn", words("text").alias("got"), words("prev").alias("gold"))
    return c.select("conv_id", "turn", clues.keyword_scores(F.col("got"), F.col("gold")).alias("s")).select("conv_id", "turn", *[F.round(f"s.{k}", 6).alias(k) for k in ("precision", "recall", "f1", "noise")])


def occurrence_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.occurrences(F.col("text"), F.lit("th")).alias("n"))


def hamming_candidates(spark, sf):
    targets = table(spark, sf, "part").select(F.lower(F.substring_index("p_name", " ", 1)).alias("target")).distinct()
    texts = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("x"), F.translate(F.lower("c_mktsegment"), "ae", "eo")).alias("text"))
    extra = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("target")).distinct()
    return clues.fuzzy_candidates(texts, targets.union(extra).distinct(), ["id"]).select("id", F.col("at").cast("bigint").alias("at"), "window", "target", F.col("distance").cast("bigint").alias("distance"))


def explicit_replace(spark, sf):
    pairs = [("AUTOMOBILE", "MACHINERY"), ("MACHINERY", "CAR"), ("AUTO", "X"), ("BUILD", "B")]
    return table(spark, sf, "customer").select("c_custkey", T.explicit_replace(F.concat("c_mktsegment", F.lit(" AUTO")), pairs).alias("fixed"))


def turns(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").withColumn("prev", F.lag("text").over(w)).where("prev is not null")


def seam_overlap(spark, sf):
    c = turns(spark, sf).select("conv_id", "turn", F.col("text").alias("b"), F.concat(F.col("prev"), F.left("text", F.floor(F.length("text") / 2).cast("int"))).alias("a"))
    return c.select("conv_id", "turn", T.seam_overlap(F.col("a"), F.col("b")).cast("bigint").alias("n"))


def cer_levenshtein(spark, sf):
    c = turns(spark, sf).select("conv_id", "turn", *[F.regexp_replace(c, r"[^\x00-\x7F]", "?").alias(n) for c, n in (("prev", "a"), ("text", "b"))])
    return c.select("conv_id", "turn", F.round(T.cer(F.col("a"), F.col("b")), 6).alias("cer"))


def char_jaccard(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.round(T.char_jaccard(F.lower("prev"), F.lower("text")), 6).alias("similar"))


def alias_conflicts(spark, sf):
    w = table(spark, sf, "documents").select(F.col("source").alias("entity"), F.array_distinct(T.tokenize(F.col("text"))).alias("names"))
    return clues.alias_index(w)[1]


def alias_index(spark, sf):
    w = table(spark, sf, "documents").select(F.col("source").alias("entity"), F.array_distinct(T.tokenize(F.col("text"))).alias("names"))
    return clues.alias_index(w)[0]


HREF = r'href="/([^"]*)"'


def notes(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("note"), F.col("html").alias("text"))


def graph(spark, sf):
    """Links between the first words that pages name: a page's note is the first link it has."""
    e = report.edges(notes(spark, sf), HREF)
    known = e.groupBy("note").agg(F.min("target").alias("name")).select(F.col("name").alias("note")).distinct()
    named = e.groupBy("note").agg(F.min("target").alias("name"))
    links = e.join(named, "note").select(F.col("name").alias("note"), "target").distinct()
    return links, known


def broken_links(spark, sf):
    links, known = graph(spark, sf)
    return report.broken(links, known).select("note", "target")


def link_degree(spark, sf):
    links, known = graph(spark, sf)
    return report.degrees(links, known)


def isolated_nodes(spark, sf):
    return link_degree(spark, sf).where("degree = 0").select("note")


def minutes_sections(spark, sf):
    """Minutes of sessions of 500 events each."""
    e = table(spark, sf, "events").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left")
    rows = e.select(F.floor(F.col("event_id") / 500).alias("session"), F.col("event_type").alias("kind"), "event_id", F.concat(report.clock(F.col("event_id").cast("double")), F.lit(" "), F.coalesce("c_name", F.lit("?"))).alias("line"))
    out = report.minutes(rows, ["session", "kind"], ["event_id"])
    return out.select("session", "kind", "n", F.md5(F.col("body").cast("binary")).alias("digest"))


def person_clues(spark, sf):
    e = table(spark, sf, "events")
    c = e.select(F.col("event_id").alias("clue_id"), F.element_at(F.lit(clues.KINDS), (F.col("event_id") % 10 + 1).cast("int")).alias("kind"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string"))).otherwise("").alias("actor"), F.col("event_id").alias("seg_id"))
    s = e.where("event_id % 2 = 0").select(F.col("event_id").alias("seg_id"), F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("speaker"))
    return report.person_clues(c, s).select("person", "kind", F.array_join(F.transform("clues", lambda x: x.cast("string")), ",").alias("clues"))


def transcript_lines(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") * 1.5).alias("start"), F.col("role").alias("speaker"), "text")
    return report.transcript(c).select("conv_id", "turn", "line")


def prep_items(spark, sf):
    d = table(spark, sf, "documents").select(F.col("text").alias("topic"), F.col("doc_id").alias("seq"), "source")
    return state.add_prep(d).select("norm", "topic", "seq", F.array_join("sources", ",").alias("sources"))


def voice_match(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("emb"))
    p = e.where("vec_id % 100 != 0").select(F.col("label").cast("string").alias("person"), F.col("embedding").alias("emb"))
    return voice.match(q, p).select("query_id", "person", F.round("score", 6).alias("score"), F.round("second", 6).alias("second"), "ok")


def vector_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    a = e.select("vec_id", "label", "embedding")
    first = a.groupBy("label").agg(F.min("vec_id").alias("f"))
    head = first.join(a.select(F.col("vec_id").alias("f"), F.col("embedding").alias("h")), "f").select("label", "h")
    return a.join(F.broadcast(head), "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("h")), 6).alias("cos"))


def enroll_near_dups(spark, sf):
    return voice.near_duplicates(table(spark, sf, "embeddings"), same=0.35)


def voice_enroll(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("person"), F.col("vec_id").alias("seq"), (F.col("vec_id") % 20).cast("string").alias("meeting"), F.col("embedding").alias("emb"))
    out = voice.enroll(e)
    return out.select("person", "count", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), F.array_join("meetings", ",").alias("meetings"))


def speaker_cluster(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("session", (F.col("vec_id") / 50).cast("bigint"))
    return voice.cluster(e, "session", "vec_id", "embedding")


def speaker_online(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("session", (F.col("vec_id") / 50).cast("bigint"))
    return voice.cluster(e, "session", "vec_id", "embedding", online=True)


def longest_to_enroll(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("spk"), F.col("event_id").alias("idx"), F.abs("value").alias("duration"), (F.col("event_id") % 4 == 0).alias("emb_weak"))
    return voice.to_enroll(e).select("spk", "idx", F.col("nth").cast("bigint").alias("nth"))


def chunk_markdown(spark, sf):
    out = chunk.chunks(table(spark, sf, "documents"))
    return out.select("doc_id", "seq", "heading", F.length("text").alias("n_chars"), "start")


def paragraph_pack(spark, sf):
    """Paragraphs of documents, whose full stops count as sentence ends."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(chunk.split_paragraphs(F.regexp_replace("text", r"\.", "。"))).alias("pos", "p"))
    return d.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.length("p").cast("bigint").alias("n_chars"), F.md5(F.col("p").cast("binary")).alias("digest"))


def turn_similarity(spark, sf):
    return evaluate.similarity(turns(spark, sf).select("conv_id", "turn", F.col("prev").alias("a"), F.col("text").alias("b")), ["conv_id", "turn"]).withColumn("similar", F.round("similar", 6))


def error_parts(spark, sf):
    out = evaluate.error_rates(turns(spark, sf).select("conv_id", "turn", F.col("prev").alias("reference"), F.col("text").alias("heard")), ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.round("cer", 6).alias("cer"), (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("edits"), (F.col("insertions") - F.col("deletions")).alias("longer"))


def prior_rrf(spark, sf):
    """Corpora fused with a bonus for all but one."""
    hits = S.best_of(corpus_hits(spark, sf), 5).select("query_id", "kb", "title", F.col("nth").alias("rank"))
    return evaluate.with_prior(hits, "en", 0.0006).select("query_id", "kb", "title", "score", "rank")


def own_first(spark, sf):
    """How often a query's first hit is of its own language: of all documents, of a filtered list, and of an index of its own."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kb"))
    truth = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.element_at(F.lit(["en", "fr", "de", "es"]), (F.col("item_id") % 4 + 1).cast("int")).alias("kb"))
    scored = S.bm25(index_of(spark, sf), many_queries(spark, sf))
    ranked = lambda df: S.top(df, 1).join(docs, "id").select("query_id", "kb", (F.col("rank0") + 1).alias("rank"))
    pool = S.top(scored, 50).drop("rank0").join(docs, "id").join(truth.select("query_id", F.col("kb").alias("_own")), "query_id").where("kb = _own")
    own = scored.join(docs.hint("shuffle_hash"), "id").join(truth.select("query_id", F.col("kb").alias("_own")), "query_id").where("kb = _own")
    return evaluate.own_first(ranked(scored), ranked(pool.select("query_id", "id", "score")), ranked(own.select("query_id", "id", "score")), truth)


def process_segments(spark, sf):
    """The best documents of each benchmark item as a segment, and of its two longest words as keywords."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("seg_id"), "text")
    words = b.select("seg_id", F.explode(S.pick_terms(F.col("text"), STOP, 2)).alias("term"))
    return S.process(index_of(spark, sf), b, words, 3).withColumn("score", F.round("score", 6))


def spoken_digits(spark, sf):
    """Numbers of orders as they are spoken."""
    said = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "零一二三四五六七八九")
    return table(spark, sf, "orders").select("o_orderkey", T.digits(F.concat(F.lit("pad"), said, F.lit("。"))).alias("written"))


def hit_at_k(spark, sf):
    a, meta = arms(spark, sf)
    hits = S.top(S.rrf(a, meta).withColumn("score", F.round("score", 9)), 10, tie="path")
    truth = table(spark, sf, "benchmark").join(table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "source"), "item_id").select(F.col("item_id").alias("query_id"), F.col("source").alias("path"))
    return evaluate.hit_at(hits, truth)


def contamination(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kb"))
    hits = S.top(S.bm25(index_of(spark, sf), many_queries(spark, sf)), 5).join(docs, "id").withColumn("rank", F.col("rank0") + 1)
    truth = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("fr").alias("kb"))
    return evaluate.contamination(hits, truth)


def topk_type_recall(spark, sf):
    """How much of each role's turns the 8 turns most like a query show, against the exact count."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    top8 = S.top(S.bm25(index_of(spark, sf, "conversations", "conv_id * 1000 + turn"), one_query(spark)), 8).join(c, "id").groupBy("role").agg(F.count(F.lit(1)).alias("seen"))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("exact")).join(top8, "role", "left").select("role", "exact", F.coalesce("seen", F.lit(0)).alias("seen"))


def coverage_sets(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), "event_type")
    wanted = e.where("event_type = 'error'").groupBy(F.col("user_id").alias("query_id")).agg(F.collect_set("d").alias("dates"))
    found = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("query_id")).agg(F.collect_set("d").alias("dates"))
    return evaluate.coverage(found, wanted)


def adjacent_overlap(spark, sf):
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf, "events").select("user_id", "event_id", t.alias("start"), (t + 3600 * F.abs("value")).alias("end"), F.col("event_type").alias("text"))
    out = evaluate.adjacent_overlap(e, ["user_id"], ["start", "event_id"])
    return out.select("event_id", F.round("overlap", 6).alias("overlap"), F.round("similar", 6).alias("similar"))


def score_spread(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("lang") == "en").alias("right"))
    return evaluate.score_spread(S.bm25(index_of(spark, sf), many_queries(spark, sf)).join(docs.hint("shuffle_hash"), "id"))


def branch_histogram(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("branch"), F.round("value", 6).alias("gap"))
    return evaluate.branches(e)


def index_orphans(spark, sf):
    return evaluate.orphans(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), table(spark, sf, "documents").select(F.col("doc_id").alias("id")).where("id % 3 != 0"))


TURNS = "t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations), p AS (SELECT * FROM t WHERE prev IS NOT NULL)"
CHARS = "list_distinct(list_filter(string_split({}, ''), lambda x: x <> ''))"
KIND = "CASE event_id % 10 WHEN 0 THEN 'requirement' WHEN 1 THEN 'commitment' WHEN 2 THEN 'deadline' WHEN 3 THEN 'decision' WHEN 4 THEN 'risk' WHEN 5 THEN 'agreement' WHEN 6 THEN 'clause' WHEN 7 THEN 'person' WHEN 8 THEN 'org' ELSE 'term' END"
ANCH = f"a AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '{YEAR}') AS w FROM conversations)"
ALIAS = r"""w AS (SELECT source AS entity, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS name FROM documents), o AS (SELECT name, count(DISTINCT entity) AS n, min(entity) AS entity FROM w GROUP BY name)"""
GRAPH = """e AS (SELECT DISTINCT page_id, trim(unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1))) AS target FROM pages), e2 AS (SELECT * FROM e WHERE target <> ''),
nm AS (SELECT page_id, min(target) AS note FROM e2 GROUP BY page_id), known AS (SELECT DISTINCT note FROM nm), links AS (SELECT DISTINCT nm.note, target FROM e2 JOIN nm USING (page_id)),
ins AS (SELECT * FROM links WHERE target IN (SELECT note FROM known) AND target <> note),
deg AS (SELECT known.note, count(x.note) AS degree FROM known LEFT JOIN (SELECT note FROM ins UNION ALL SELECT target FROM ins) x ON x.note = known.note GROUP BY known.note)"""
VM = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT CAST(label AS VARCHAR) AS person, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 <> 0),
s AS (SELECT query_id, person, max(greatest(round(list_cosine_similarity(q.v, p.v), 9), 0)) AS score FROM q CROSS JOIN p GROUP BY query_id, person),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, person DESC) AS n, coalesce(lead(score) OVER (PARTITION BY query_id ORDER BY score DESC, person DESC), 0) AS second FROM s)"""

NEW = (paragraph_pack, turn_similarity, error_parts, prior_rrf, own_first, process_segments, spoken_digits)

QUERIES = {f.__name__: f for f in NEW} | {f.__name__: f for f in (
    clue_anchors, clue_clause, clue_dedup, clue_merge, clue_board, clue_sorted, clue_rules, keywords_topn, keyword_prf, occurrence_count, hamming_candidates, explicit_replace, seam_overlap, cer_levenshtein, char_jaccard,
    alias_conflicts, alias_index, broken_links, link_degree, isolated_nodes, minutes_sections, person_clues, transcript_lines, prep_items, voice_match, vector_cosine, enroll_near_dups, voice_enroll, speaker_cluster, speaker_online,
    longest_to_enroll, chunk_markdown, hit_at_k, contamination, topk_type_recall, coverage_sets, adjacent_overlap, score_spread, branch_histogram, index_orphans,
)}

SQL = {
    "prior_rrf": f"""WITH {HITS}, f AS (SELECT query_id, kb, title, round(sum(1.0::DOUBLE / (60 + nth) + CASE WHEN kb <> 'en' THEN 0.0006::DOUBLE ELSE 0 END), 9) AS score FROM ranked WHERE nth <= 5 GROUP BY query_id, kb, title),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kb, title) AS BIGINT) AS rank FROM f) SELECT query_id, kb, title, score, rank FROM r WHERE rank <= 3""",
    "own_first": f"""WITH {bm25_sql(MANY)}, t AS (SELECT item_id AS query_id, ['en', 'fr', 'de', 'es'][item_id % 4 + 1] AS own FROM benchmark), h AS (SELECT bmr.query_id, id, score, rank0, lang AS kb, own FROM bmr JOIN documents ON doc_id = id JOIN t ON t.query_id = bmr.query_id)
SELECT (SELECT count(*) FROM t) AS queries, (SELECT count(*) FROM h WHERE rank0 = 0 AND kb = own) AS free, (SELECT count(DISTINCT query_id) FROM h WHERE rank0 < 50 AND kb = own) AS filtered, (SELECT count(DISTINCT query_id) FROM h WHERE kb = own) AS separate""",
    "process_segments": f"""WITH {QT}, a AS (SELECT item_id AS seg_id, '' AS term, text AS q FROM benchmark UNION ALL SELECT query_id, t, t FROM (SELECT query_id, unnest(terms[1:2]) AS t FROM qterms)),
k AS (SELECT *, row_number() OVER () AS query_id FROM a), {bm25_sql("SELECT query_id, q AS query FROM k")}
SELECT seg_id, term, id, round(score, 6) AS score, CAST(rank0 AS BIGINT) AS rank0 FROM bmr JOIN k USING (query_id) WHERE rank0 < 3""",
    "spoken_digits": "SELECT o_orderkey, 'pad' || o_orderkey || '。' AS written FROM orders",
    "clue_anchors": f"WITH {ANCH}, x AS (SELECT conv_id, turn, w, unnest(range(0, len(w))) AS pos FROM a) SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, w[pos + 1] AS anchor FROM x",
    "clue_clause": "SELECT conv_id, turn, substring(list_filter(regexp_split_to_array(text, '[，。；！？,;!?]'), lambda c: contains(c, 'the') AND length(c) >= 4)[1], 1, 30) AS clause FROM conversations",
    "clue_dedup": f"""WITH {ANCH}, d AS (SELECT DISTINCT conv_id, turn, unnest(w) AS x FROM a),
k AS (SELECT d.conv_id, d.turn, d.x FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.conv_id = d.conv_id AND o.turn = d.turn AND o.x <> d.x AND contains(o.x, d.x)))
SELECT c.conv_id, c.turn, coalesce(string_agg(x, ' ' ORDER BY length(x) DESC, x), '') AS kept FROM conversations c LEFT JOIN k ON k.conv_id = c.conv_id AND k.turn = c.turn GROUP BY c.conv_id, c.turn""",
    "clue_merge": f"""WITH {ANCH}, d AS (SELECT DISTINCT conv_id, turn, unnest(w) AS anchor FROM a)
SELECT conv_id, turn, anchor, CASE WHEN length(anchor) % 2 = 0 AND length(anchor) % 3 = 0 THEN 'deadline' WHEN length(anchor) % 4 <> 1 THEN 'risk' ELSE 'term' END AS kind,
CASE WHEN length(anchor) % 2 = 0 THEN anchor ELSE upper(anchor) END AS text,
round(greatest(CASE WHEN length(anchor) % 2 = 0 THEN 0.7::DOUBLE END, CASE WHEN length(anchor) % 4 <> 1 THEN length(anchor) / 20.0::DOUBLE END), 6) AS confidence,
CASE WHEN length(anchor) % 4 <> 1 THEN 'a' ELSE '' END AS actor, '' AS due FROM d WHERE length(anchor) % 2 = 0 OR length(anchor) % 4 <> 1""",
    "clue_sorted": "SELECT user_id AS session, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id % 17 = 0 DESC, event_id % 10, value, event_id) AS BIGINT) AS place FROM events",
    "keywords_topn": rf"""WITH a AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM conversations), x AS (SELECT conv_id, turn, w, unnest(range(0, len(w))) AS pos FROM a),
c AS (SELECT conv_id, turn, w[pos + 1] AS term, count(*) AS n, min(pos) AS pos FROM x WHERE length(w[pos + 1]) BETWEEN 2 AND 8 AND w[pos + 1] NOT IN ('the', 'and', 'of', 'to', 'is') GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, pos) AS BIGINT) AS rank FROM c) SELECT conv_id, turn, term, n, rank FROM r WHERE rank <= 6""",
    "keyword_prf": rf"""WITH {TURNS}, b AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS g, list_distinct(regexp_extract_all(lower(prev), '[\p{{L}}\p{{N}}]+')) AS o FROM p),
m AS (SELECT conv_id, turn, len(g) AS ng, len(o) AS no, len(list_filter(g, lambda x: len(list_filter(o, lambda y: contains(x, y) OR contains(y, x))) > 0)) AS hg, len(list_filter(o, lambda x: len(list_filter(g, lambda y: contains(x, y) OR contains(y, x))) > 0)) AS ho FROM b),
c AS (SELECT conv_id, turn, CASE WHEN ng > 0 THEN hg / ng::DOUBLE ELSE 0 END AS p, CASE WHEN no > 0 THEN ho / no::DOUBLE ELSE 0 END AS r FROM m)
SELECT conv_id, turn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(1 - p, 6) AS noise FROM c""",
    "occurrence_count": "SELECT doc_id, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS BIGINT) AS n FROM documents",
    "hamming_candidates": """WITH t AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS target FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer),
x AS (SELECT c_custkey AS id, 'x' || translate(lower(c_mktsegment), 'ae', 'eo') AS s FROM customer),
w AS (SELECT id, s, target, unnest(range(1, length(s) - length(target) + 2)) AS pos FROM x, t WHERE length(target) BETWEEN 2 AND 24 AND length(s) >= length(target)),
h AS (SELECT id, pos, substring(s, pos, length(target)) AS win, target, hamming(substring(s, pos, length(target)), target) AS d FROM w)
SELECT id, CAST(pos AS BIGINT) AS "at", win AS "window", target, CAST(d AS BIGINT) AS distance FROM h WHERE win <> target AND d <= CASE WHEN length(target) <= 3 THEN 1 ELSE 2 END""",
    "explicit_replace": "SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'MACHINERY' WHEN 'MACHINERY' THEN 'CAR' WHEN 'BUILDING' THEN 'BING' ELSE c_mktsegment END || ' X' AS fixed FROM customer",
    "seam_overlap": f"""WITH {TURNS}, s AS (SELECT conv_id, turn, text AS b, prev || left(text, length(text) // 2) AS a FROM p)
SELECT conv_id, turn, CAST(coalesce(list_max(list_filter(range(2, least(length(a), length(b)) + 1), lambda k: right(a, k) = left(b, k))), 0) AS BIGINT) AS n FROM s""",
    "cer_levenshtein": f"WITH {TURNS}, q AS (SELECT conv_id, turn, regexp_replace(prev, '[^\\x00-\\x7F]', '?', 'g') AS a, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS b FROM p) SELECT conv_id, turn, round(levenshtein(a, b) / greatest(1, length(a))::DOUBLE, 6) AS cer FROM q",
    "char_jaccard": f"WITH {TURNS}, s AS (SELECT conv_id, turn, {CHARS.format('lower(prev)')} AS a, {CHARS.format('lower(text)')} AS b FROM p) SELECT conv_id, turn, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b))))::DOUBLE, 6) AS similar FROM s",
    "alias_conflicts": f"WITH {ALIAS} SELECT name, n FROM o WHERE n > 1",
    "alias_index": f"WITH {ALIAS} SELECT name, entity FROM o WHERE n = 1",
    "broken_links": f"WITH {GRAPH} SELECT note, target FROM links WHERE target NOT IN (SELECT note FROM known)",
    "link_degree": f"WITH {GRAPH} SELECT note, degree FROM deg",
    "isolated_nodes": f"WITH {GRAPH} SELECT note FROM deg WHERE degree = 0",
    "minutes_sections": """WITH e AS (SELECT event_id // 500 AS session, event_type AS kind, event_id, lpad(CAST(event_id // 60 AS VARCHAR), CAST(greatest(2, length(CAST(event_id // 60 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ' ' || coalesce(c_name, '?') AS line
  FROM events LEFT JOIN customer ON c_custkey = user_id), r AS (SELECT *, row_number() OVER (PARTITION BY session, kind ORDER BY event_id) AS n FROM e)
SELECT session, kind, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM r GROUP BY session, kind""",
    "person_clues": f"""WITH c AS (SELECT event_id, {KIND} AS kind, CASE WHEN event_id % 3 = 0 THEN 'p' || (user_id % 5) WHEN event_id % 2 = 0 THEN 's' || (user_id % 4) END AS person FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY person, kind ORDER BY event_id) AS n FROM c WHERE person IS NOT NULL AND kind IN ('requirement', 'commitment', 'deadline', 'decision', 'risk'))
SELECT person, kind, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS clues FROM r WHERE n <= 4 GROUP BY person, kind""",
    "transcript_lines": "SELECT conv_id, turn, '[' || format('{:7.2f}', turn * 1.5::DOUBLE) || '] ' || role || '：' || text AS line FROM conversations",
    "prep_items": r"""WITH d AS (SELECT doc_id, source, text AS topic, regexp_replace(text, '[\s，。、；：？！,.;:?!"''“”‘’()（）\[\]【】—…·-]+', '', 'g') AS norm FROM documents)
SELECT norm, arg_min(topic, doc_id) AS topic, min(doc_id) AS seq, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM d WHERE length(norm) >= 2 GROUP BY norm""",
    "voice_match": f"WITH {VM} SELECT query_id, person, round(score, 6) AS score, round(second, 6) AS second, score >= 0.6 AND score - second >= 0.1 AS ok FROM r WHERE n = 1",
    "vector_cosine": "WITH f AS (SELECT label, min(vec_id) AS f FROM embeddings GROUP BY label) SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(h.embedding AS DOUBLE[])), 6) AS cos FROM embeddings e JOIN f ON f.label = e.label JOIN embeddings h ON h.vec_id = f.f",
    "enroll_near_dups": "SELECT DISTINCT a.vec_id, CAST(a.label AS BIGINT) AS label FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id WHERE round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) > 0.35",
    "longest_to_enroll": """WITH r AS (SELECT user_id AS spk, event_id AS idx, abs(value) AS d, row_number() OVER w AS nth, coalesce(sum(abs(value)) OVER (PARTITION BY user_id ORDER BY abs(value) DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM events WHERE event_id % 4 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY abs(value) DESC, event_id)) SELECT spk, idx, CAST(nth AS BIGINT) AS nth FROM r WHERE nth <= 8 AND ahead < 24""",
    "hit_at_k": f"""WITH {rrf_sql()}, t AS (SELECT item_id AS query_id, source AS path FROM benchmark JOIN documents ON doc_id = item_id), m AS (SELECT t.query_id, min(best.rank0) AS r FROM t LEFT JOIN best ON best.query_id = t.query_id AND best.path = t.path GROUP BY t.query_id)
SELECT count(*) AS queries, round(avg(CASE WHEN r < 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_1, round(avg(CASE WHEN r < 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_3 FROM m""",
    "contamination": f"""WITH {bm25_sql(MANY)}, o AS (SELECT bmr.query_id, rank0 + 1 AS rank, lang = CASE WHEN bmr.query_id % 2 = 0 THEN 'en' ELSE 'fr' END AS ok FROM bmr JOIN documents ON doc_id = bmr.id WHERE rank0 < 5)
SELECT query_id, bool_or(rank = 1 AND ok) AS top1, bool_or(rank <= 3 AND ok) AS in_top3, bool_and(rank > 3 OR ok) AS clean FROM o GROUP BY query_id""",
    "topk_type_recall": "WITH " + bm25_sql(ONE).replace("SELECT doc_id AS id", "SELECT conv_id * 1000 + turn AS id").replace("FROM documents", "FROM conversations") + """, s AS (SELECT role, count(*) AS seen FROM bmr JOIN conversations ON conv_id * 1000 + turn = bmr.id WHERE rank0 < 8 GROUP BY role)
SELECT c.role, count(*) AS exact, CAST(coalesce(any_value(seen), 0) AS BIGINT) AS seen FROM conversations c LEFT JOIN s ON s.role = c.role GROUP BY c.role""",
    "coverage_sets": """WITH w AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS d FROM events WHERE event_type = 'error'), f AS (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS d FROM events WHERE event_type = 'click'),
c AS (SELECT w.user_id, count(*) AS m, count(f.d) AS n FROM w LEFT JOIN f ON f.user_id = w.user_id AND f.d = w.d GROUP BY w.user_id) SELECT user_id AS query_id, n, CASE WHEN n = m THEN 'full' WHEN n > 0 THEN 'partial' ELSE 'none' END AS coverage FROM c""",
    "adjacent_overlap": f"""WITH s AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6::DOUBLE AS a, epoch_us(ts) / 1e6::DOUBLE + 3600 * abs(value) AS b FROM events), l AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lag(event_type) OVER w AS pt FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, event_id)),
o AS (SELECT *, (least(b, pb) - greatest(a, pa)) / greatest(least(b - a, pb - pa), 1e-9::DOUBLE) AS o, {CHARS.format('event_type')} AS x, {CHARS.format('pt')} AS y FROM l WHERE pa IS NOT NULL)
SELECT event_id, round(o, 6) AS overlap, round(len(list_intersect(x, y)) / greatest(1, len(list_distinct(list_concat(x, y))))::DOUBLE, 6) AS similar FROM o WHERE o > 0.3""",
    "score_spread": f"""WITH {bm25_sql(MANY)}, g AS (SELECT query_id, max(CASE WHEN lang = 'en' THEN score END) - max(CASE WHEN lang <> 'en' THEN score END) AS gap FROM bm JOIN documents ON doc_id = bm.id GROUP BY query_id)
SELECT count(gap) AS queries, count(CASE WHEN gap = 0 THEN 1 END) AS ties, count(CASE WHEN gap > 0 THEN 1 END) AS wins, round(median(gap), 6) AS median_gap FROM g""",
    "branch_histogram": """WITH r AS (SELECT event_type AS branch, round(value, 6) AS gap, row_number() OVER (PARTITION BY event_type ORDER BY round(value, 6)) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS m FROM events)
SELECT branch, count(*) AS n, min(gap) AS low, max(CASE WHEN k = m // 2 THEN gap END) AS p50, max(CASE WHEN k = CAST(floor(m * 0.9::DOUBLE) AS BIGINT) THEN gap END) AS p90, max(gap) AS high FROM r GROUP BY branch""",
    "index_orphans": "SELECT count(*) AS orphans FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)",
}
