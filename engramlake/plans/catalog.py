"""One query for each operator, over the whole of its tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.functions import times as TM
from engramlake.functions import vectors as V
from engramlake.operators import context, dedup, graph, lifecycle, metrics, quality, search, store, temporal, vector_index
from engramlake.plans import search as plan
from engramlake.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
TOKENS = f"""list_concat(list_filter(regexp_extract_all(lower({{0}}), '[a-z]+'), lambda w: length(w) > 1 AND w NOT IN {STOP}),
  list_filter(flatten(list_transform(regexp_extract_all(lower({{0}}), '[一-鿿]{{{{2,}}}}'), lambda r: list_concat([r], list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))), lambda w: w NOT IN {STOP}))"""
#: doc tokens, postings, and the queries: benchmark texts' first eight tokens
POSTINGS = f"""
tok AS (SELECT doc_id AS id, {TOKENS.format("text")} AS words FROM documents),
post AS (SELECT id, doc_len, term, count(*) AS tf FROM (SELECT id, len(words) AS doc_len, unnest(words) AS term FROM tok) GROUP BY id, doc_len, term)"""
ASKED = f"""
asked AS (SELECT item_id AS query_id, unnest(list_slice({TOKENS.format("text")}, 1, 8)) AS term FROM benchmark),
terms AS (SELECT query_id, term, count(*) AS times FROM asked GROUP BY query_id, term)"""
BM25 = """
stat AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm25 AS (SELECT query_id, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * doc_len / avgdl))), 6) AS score
  FROM post JOIN terms USING (term) JOIN df USING (term), stat GROUP BY query_id, id),
bm25r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm25)"""
KEYWORD = """
kw AS (SELECT query_id, id, round(0.8 * count(*) / n, 6) AS score FROM post JOIN terms USING (term) JOIN (SELECT query_id, count(*) AS n FROM terms GROUP BY query_id) USING (query_id) GROUP BY query_id, id, n),
kwr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM kw)"""
FACTS = """
facts AS (SELECT event_id AS uuid, user_id AS subject, event_type AS predicate, json_extract_string(props, '$.k') AS object, ts AS valid_from,
  lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_until, value FROM events)"""
EDGES = """
edges AS (SELECT DISTINCT * FROM (
  SELECT 'c:' || o_custkey AS src, 'PLACED' AS type, 'o:' || o_orderkey AS dst FROM orders
  UNION ALL SELECT 'o:' || l_orderkey, 'CONTAINS', 'p:' || l_partkey FROM lineitem
  UNION ALL SELECT 'p:' || l_partkey, 'SUPPLIED_BY', 's:' || l_suppkey FROM lineitem))"""
NOW, EARLIER = "2024-01-20 00:00:00", "2024-01-10 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# A: storage


@query("SELECT doc_id AS id, source AS user_id FROM documents ORDER BY doc_id DESC LIMIT 50")
def a_last_n(spark, sf):
    return src.memories(spark, sf).orderBy(F.desc("id")).limit(50).select("id", "user_id")


@query("SELECT doc_id AS id, n_chars FROM documents ORDER BY doc_id LIMIT 20 OFFSET 40")
def a_page(spark, sf):
    return store.page(src.memories(spark, sf).select("id", "n_chars"), 40, 20, F.col("id"))


@query("SELECT source AS user_id, count(*) AS n FROM documents GROUP BY source")
def a_count_by_user(spark, sf):
    return src.memories(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 40 AS kept FROM documents")
def a_hot_set(spark, sf):
    return store.hot_set(src.memories(spark, sf), "user_id", 40, F.desc("id")).select("id", "kept")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def a_upsert_latest(spark, sf):
    rows = store.latest(src.table(spark, sf, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"))
    return rows.select("user_id", "event_type", "event_id", "value")


@query("SELECT doc_id AS id, CASE WHEN quality = 0 THEN 'redacted' ELSE lang END AS category FROM documents LEFT JOIN labels USING (doc_id)")
def a_update(spark, sf):
    rows = src.memories(spark, sf).select("id", "category")
    bad = src.table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("id"), F.lit("redacted").alias("category"))
    return store.upserted(rows, bad, "id")


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df FROM post WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY term")
def a_delete_cascade(spark, sf):
    gone = src.table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    return store.without(search.postings(src.memories(spark, sf)), gone, "id").groupBy("term").agg(F.count("*").alias("df"))


@query("SELECT conv_id, turn, turn // 4 AS volume, turn % 4 // 2 AS file, turn % 2 AS \"offset\" FROM conversations")
def a_volumes(spark, sf):
    return store.volumes(src.turns(spark, sf).select("conv_id", "turn"), "turn", 4, 2)


@query("SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 100")
def a_archive_scan(spark, sf):
    return src.memories(spark, sf).where(F.contains(F.lower("content"), F.lit("license"))).orderBy("id").select("id").limit(100)


@query("SELECT doc_id AS id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')")
def a_filtered_list(spark, sf):
    return store.filtered(src.memories(spark, sf), category="en", user_id=["src1", "src2"]).select("id")


@query("SELECT user_id, event_type AS entity, count(*) AS verification_count, round(least(1.0, 0.5 + 0.1 * (count(*) - 1)), 6) AS confidence FROM events GROUP BY user_id, event_type")
def a_entity_upsert(spark, sf):
    seen = src.table(spark, sf, "events").select("user_id", F.col("event_type").alias("entity"), F.lit(0.5).alias("confidence"), F.col("event_id").alias("seq"))
    return dedup.reinforced(seen, "user_id", "entity")


@query("""SELECT user_id, entity, access_count, last, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, entity) AS n FROM (
  SELECT user_id, event_type AS entity, count(*) AS access_count, max(event_id) AS last, round(count(*) / (1000000 - max(event_id) + 1), 6) AS score FROM events GROUP BY ALL)) WHERE n <= 2""")
def a_working_set(spark, sf):
    seen = src.table(spark, sf, "events").select("user_id", F.col("event_type").alias("entity"), F.col("event_id").alias("turn"))
    return store.working_set(seen, 1_000_000, 2)


@query("SELECT doc_id AS id, 'text' AS kind, length(text) AS n_chars FROM documents UNION ALL SELECT page_id, 'webpage', length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) FROM pages")
def a_ingest_kinds(spark, sf):
    plain = src.memories(spark, sf).select("id", F.lit("text").alias("kind"), F.length("content").cast("bigint").alias("n_chars"))
    stripped = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "\\s+", " "))
    return plain.union(src.table(spark, sf, "pages").select("page_id", F.lit("webpage"), F.length(stripped).cast("bigint")))


# B: filters


@query("SELECT doc_id AS id FROM documents JOIN labels USING (doc_id) WHERE source IN ('src1', 'src3', 'src5', 'src7') AND lang = 'en' AND quality = 1")
def b_metadata_and(spark, sf):
    good = src.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return store.filtered(src.memories(spark, sf), user_id=["src1", "src3", "src5", "src7"], category="en").join(good, "id", "left_semi").select("id")


@query("SELECT doc_id AS id, doc_id % 10 / 10 AS importance FROM documents WHERE doc_id % 10 / 10 >= 0.7")
def b_prefilter_importance(spark, sf):
    return src.memories(spark, sf).where(F.coalesce("importance", F.lit(0.5)) >= 0.7).select("id", "importance")


@query("SELECT event_id, ts FROM events WHERE json_extract_string(props, '$.k') = '7'")
def b_json_containment(spark, sf):
    return src.table(spark, sf, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id", "ts")


@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'")
def b_event_date_range(spark, sf):
    return src.table(spark, sf, "events").where(F.to_date("ts").between("2024-01-05", "2024-01-09")).select("event_id")


@query(f"WITH {FACTS} SELECT uuid, subject FROM facts WHERE valid_until IS NULL")
def b_active_facts(spark, sf):
    return src.facts(spark, sf).where(F.col("valid_until").isNull()).select("uuid", "subject")


@query("SELECT conv_id, turn, coalesce(nullif(text, ''), role) AS content FROM conversations")
def b_effective_content(spark, sf):
    return src.turns(spark, sf).select("conv_id", "turn", F.coalesce(F.nullif(F.col("text"), F.lit("")), "role").alias("content"))


# C: joins


@query("SELECT r.r_name AS topic, count(n.n_nationkey) AS n FROM region r LEFT JOIN nation n ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name")
def c_left_join_count(spark, sf):
    regions, nations = src.table(spark, sf, "region"), src.table(spark, sf, "nation")
    return regions.join(nations, regions.r_regionkey == nations.n_regionkey, "left").groupBy(F.col("r_name").alias("topic")).agg(F.count("n_nationkey").alias("n"))


@query("""WITH t AS (SELECT DISTINCT c_custkey AS id, n_regionkey AS topic FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT DISTINCT c_custkey, 100 + c_nationkey FROM customer)
SELECT x.id AS a, y.id AS b, count(*) AS shared, round(least(0.5 + 0.1 * count(*), 0.9), 6) AS confidence FROM t x JOIN t y ON x.topic = y.topic AND x.id < y.id GROUP BY x.id, y.id HAVING count(*) >= 2""")
def c_shared_topics(spark, sf):
    people, nations = src.table(spark, sf, "customer"), src.table(spark, sf, "nation")
    both = people.join(nations, people.c_nationkey == nations.n_nationkey)
    links = both.select(F.col("c_custkey").alias("id"), F.col("n_regionkey").alias("topic")).union(both.select("c_custkey", 100 + F.col("c_nationkey"))).distinct()
    return dedup.shared_topics(links, 2)


@query("SELECT doc_id AS id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def c_semi_join(spark, sf):
    good = src.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return src.memories(spark, sf).join(good, "id", "left_semi").select("id")


@query("SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def c_anti_join(spark, sf):
    known = src.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return store.without(src.memories(spark, sf), known, "id").select("id")


@query(f"""WITH {FACTS} SELECT a.uuid AS old_uuid, b.uuid AS new_uuid, a.subject, a.predicate FROM facts a JOIN facts b ON a.subject = b.subject AND a.predicate = b.predicate AND a.uuid < b.uuid AND a.object <> b.object
AND NOT coalesce(a.valid_until < b.valid_from, false) AND NOT coalesce(b.valid_until < a.valid_from, false)""")
def c_interval_overlap(spark, sf):
    return temporal.interval_pairs(src.facts(spark, sf))


@query("""WITH e AS (SELECT DISTINCT doc_id, s, unnest(list_distinct(regexp_extract_all(sentence, '[A-Z][a-z]{2,}'))) AS name FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\\n]')) AS sentence, generate_subscripts(regexp_split_to_array(text, '[.!?\\n]'), 1) AS s FROM documents))
SELECT x.name AS a, y.name AS b, count(*) AS n FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.s = y.s AND x.name < y.name GROUP BY x.name, y.name""")
def c_cooccurrence(spark, sf):
    lines = src.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "[.!?\n]")).alias("s", "sentence"))
    names = lines.select("doc_id", "s", F.explode(T.entities(F.col("sentence"))).alias("name")).distinct()
    x, y = names.alias("x"), names.alias("y")
    both = x.join(y, (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.s") == F.col("y.s")) & (F.col("x.name") < F.col("y.name")))
    return both.groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b")).agg(F.count("*").alias("n"))


# D: aggregates


@query(f"WITH {POSTINGS} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM post GROUP BY term")
def d_tf_df(spark, sf):
    return search.term_frequencies(src.memories(spark, sf))


@query(f"WITH {POSTINGS}, {ASKED}, {BM25} SELECT query_id, id, score, rank FROM bm25r WHERE rank <= 10")
def d_bm25_topk(spark, sf):
    return search.ranked(search.bm25(src.memories(spark, sf), _asked(spark, sf)), 10)


@query(f"WITH {POSTINGS}, {ASKED}, {KEYWORD} SELECT query_id, id, score, rank FROM kwr WHERE rank <= 10")
def d_keyword_ratio(spark, sf):
    return search.ranked(search.keyword_ratio(src.memories(spark, sf), _asked(spark, sf)), 10)


@query(f"""WITH {POSTINGS}, {ASKED}, {BM25}, {KEYWORD}, f AS (SELECT query_id, id, round(sum(w / (60 + rank)), 6) AS score FROM (
SELECT query_id, id, rank, 0.3 AS w FROM bm25r WHERE rank <= 100 UNION ALL SELECT query_id, id, rank, 1.2 FROM kwr WHERE rank <= 100) GROUP BY query_id, id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""")
def d_rrf_two_path(spark, sf):
    paths = plan.recalled(src.memories(spark, sf), _asked(spark, sf), {"fulltext": search.bm25, "keyword": search.keyword_ratio}, 100)
    return search.ranked(search.reciprocal_rank_fusion(paths, weights={"fulltext": 0.3, "keyword": 1.2}), 10)


@query(f"""WITH {POSTINGS}, {ASKED}, {BM25}, {KEYWORD}, p AS (SELECT 'f' AS s, query_id, id, score FROM bm25r WHERE rank <= 100 UNION ALL SELECT 'k', query_id, id, score FROM kwr WHERE rank <= 100),
m AS (SELECT *, min(score) OVER (PARTITION BY s, query_id) AS lo, max(score) OVER (PARTITION BY s, query_id) AS hi FROM p),
f AS (SELECT query_id, id, round(sum(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END) * (1 + 0.1 * (count(*) - 1)), 6) AS score FROM m GROUP BY query_id, id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 10""")
def d_weighted_fusion(spark, sf):
    paths = plan.recalled(src.memories(spark, sf), _asked(spark, sf), {"fulltext": search.bm25, "keyword": search.keyword_ratio}, 100)
    return search.ranked(search.weighted_fusion(paths), 10)


@query(f"""WITH {POSTINGS}, {ASKED}, {BM25}, {KEYWORD} SELECT query_id, id, round(sum(score * w), 9) AS score, string_agg(s, ',' ORDER BY s) AS sources FROM (
SELECT query_id, id, score, 'fulltext' AS s, 0.5 AS w FROM bm25r WHERE rank <= 20 UNION ALL SELECT query_id, id, score, 'keyword', 1.0 FROM kwr WHERE rank <= 20) GROUP BY query_id, id""")
def d_additive_merge(spark, sf):
    paths = plan.recalled(src.memories(spark, sf), _asked(spark, sf), {"fulltext": search.bm25, "keyword": search.keyword_ratio}, 20)
    return search.additive_merge(paths, {"fulltext": 0.5}).withColumn("score", F.round("score", 9))


@query("SELECT name, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2,}'))) AS name FROM documents) GROUP BY name HAVING count(*) >= 5")
def d_entity_mentions(spark, sf):
    return src.memories(spark, sf).select(F.explode(T.entities(F.col("content"))).alias("name")).groupBy("name").agg(F.count("*").alias("n")).where("n >= 5")


@query("""WITH v AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY event_type)
SELECT event_type, n, total, low, high, mean, v[CAST(floor(n * 0.5) AS INT) + 1] AS p50, CASE WHEN n >= 20 THEN v[CAST(floor(n * 0.95) AS INT) + 1] ELSE high END AS p95, CASE WHEN n >= 100 THEN v[CAST(floor(n * 0.99) AS INT) + 1] ELSE high END AS p99 FROM v""")
def d_percentiles(spark, sf):
    return metrics.percentiles(src.table(spark, sf, "events"), "event_type", "value")


@query("""SELECT event_type, le, CAST(n AS BIGINT) AS n FROM (SELECT event_type, unnest([{'le': '10', 'n': sum((value <= 10)::INT)}, {'le': '25', 'n': sum((value <= 25)::INT)}, {'le': '50', 'n': sum((value <= 50)::INT)}, {'le': '100', 'n': sum((value <= 100)::INT)}, {'le': '+Inf', 'n': count(value)}], recursive := true) FROM events GROUP BY event_type)""")
def d_histogram(spark, sf):
    return metrics.histogram(src.table(spark, sf, "events"), "event_type", "value", (10, 25, 50, 100))


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS period, round(sum(value), 6) AS cost, round(100 * round(sum(value), 6) / 500, 6) AS percent FROM events GROUP BY ALL")
def d_budget_usage(spark, sf):
    return metrics.usage(src.table(spark, sf, "events"), "event_type", "ts", "value", "day", 500.0)


@query("SELECT event_type, CAST(sum((value > 50)::INT) AS BIGINT) AS hits, count(*) AS n, round(sum((value > 50)::INT) / count(*), 6) AS rate FROM events GROUP BY event_type")
def d_hit_rate(spark, sf):
    return metrics.hit_rate(src.table(spark, sf, "events"), "event_type", F.col("value") > 50)


@query("SELECT event_type, count(*) AS counter, arg_max(value, row(ts, event_id)) AS gauge FROM events GROUP BY event_type")
def d_counter_gauge(spark, sf):
    return metrics.gauges(src.table(spark, sf, "events"), "event_type", "value", "ts", "event_id")


@query(f"WITH {EDGES} SELECT what, kind, count(*) AS n FROM (SELECT 'node' AS what, split_part(node, ':', 1) AS kind FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) UNION ALL SELECT 'edge', type FROM edges) GROUP BY what, kind")
def d_graph_stats(spark, sf):
    return graph.statistics(src.edges(spark, sf))


@query(f"WITH {POSTINGS} SELECT (SELECT count(*) FROM tok) AS n, (SELECT round(avg(len(words)), 6) FROM tok) AS avgdl, count(DISTINCT term) AS terms FROM post")
def d_index_stats(spark, sf):
    rows = src.memories(spark, sf)
    return search.corpus_statistics(rows).select("n", F.round("avgdl", 6).alias("avgdl")).crossJoin(search.postings(rows).agg(F.countDistinct("term").alias("terms")))


@query("SELECT event_type, p95, CASE WHEN p95 > 200 THEN 'degraded' ELSE 'healthy' END AS status FROM (SELECT event_type, list(value ORDER BY value)[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95 FROM events GROUP BY event_type)")
def d_health(spark, sf):
    return metrics.health(metrics.percentiles(src.table(spark, sf, "events"), "event_type", "value"), "event_type", 200.0)


# E, F: windows and top-k


@query(f"""WITH s AS (SELECT event_id, event_type, CASE WHEN max(value) OVER w = min(value) OVER w THEN 1.0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END AS rel, event_id % 10 / 10 AS imp, exp(-ln(2) * date_sub('second', ts, TIMESTAMP '{NOW}') / 2592000) AS rec FROM events WINDOW w AS (PARTITION BY event_type))
SELECT event_id, round(0.5 * rel + 0.3 * imp + 0.2 * rec, 6) AS score FROM s""")
def e_minmax_recency(spark, sf):
    rows = src.table(spark, sf, "events")
    ends = rows.groupBy(F.col("event_type").alias("t")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    rel = F.when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")))
    score = 0.5 * rel + 0.3 * (F.pmod("event_id", F.lit(10)) / 10) + 0.2 * TM.recency(F.col("ts"), NOW)
    return rows.join(ends, F.col("event_type").eqNullSafe(F.col("t"))).select("event_id", F.round(score, 6).alias("score"))


@query("SELECT event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 10 ORDER BY value DESC, event_id LIMIT 30")
def e_quota_per_type(spark, sf):
    return context.quota(src.table(spark, sf, "events").select("event_id", "event_type", "value"), 10, 30, "event_type", [F.desc("value"), F.col("event_id")])


@query("SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS used FROM conversations) WHERE used <= 200")
def e_token_budget(spark, sf):
    rows = context.within_budget(src.turns(spark, sf), 200, ["conv_id"], [F.desc("turn")], F.floor(F.length("text") / 4))
    return rows.select("conv_id", "turn", "used")


@query()
def e_greedy_pack(spark, sf):
    rows = context.greedy_pack(src.turns(spark, sf), 1200, "conv_id", [F.col("turn")], F.length("text"))
    return rows.select("conv_id", "turn")


@query("SELECT conv_id, turn, question, answer FROM (SELECT conv_id, turn, role, text AS question, lead(text) OVER w AS answer, lead(role) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nxt = 'assistant'")
def e_turn_pairs(spark, sf):
    return context.turn_pairs(src.turns(spark, sf))


@query(f"""WITH {FACTS} SELECT 'before' AS side, uuid FROM (SELECT uuid FROM facts WHERE valid_until <= TIMESTAMP '{EARLIER}' ORDER BY valid_until DESC, uuid LIMIT 100)
UNION ALL SELECT 'after', uuid FROM (SELECT uuid FROM facts WHERE valid_from >= TIMESTAMP '{EARLIER}' ORDER BY valid_from, uuid LIMIT 100)""")
def f_topk_before_after(spark, sf):
    facts = src.facts(spark, sf)
    before = temporal.ended_before(facts, EARLIER, 100).select(F.lit("before").alias("side"), "uuid")
    return before.union(temporal.started_after(facts, EARLIER, 100).select(F.lit("after"), "uuid"))


@query("SELECT * FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 10")
def f_topk_by_score(spark, sf):
    rows = src.table(spark, sf, "events").select("event_type", F.col("event_id").alias("id"), F.col("value").alias("score"))
    along = Window.partitionBy("event_type").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(along).cast("bigint")).where("rank <= 10").select("event_type", F.col("id").alias("event_id"), "rank")


@query()
def f_mmr(spark, sf):
    rows = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return search.mmr_vectors(search.nearest(rows, asked, 20).join(rows, "id"), 10)


# G: sets


@query(f"""WITH {POSTINGS}, a AS (SELECT id FROM post WHERE term = 'license'), b AS (SELECT id FROM post WHERE term = 'licensed')
SELECT 'and' AS op, id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'or', id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'not', id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def g_and_or_except(spark, sf):
    post = search.postings(src.memories(spark, sf))
    a, b = (post.where(F.col("term") == w).select("id") for w in ("license", "licensed"))
    name = lambda op, rows: rows.select(F.lit(op).alias("op"), "id")
    return name("and", a.intersect(b)).union(name("or", a.union(b).distinct())).union(name("not", a.exceptAll(b)))


@query(f"""WITH {POSTINGS}, {ASKED}, {BM25}, {KEYWORD}, u AS (SELECT query_id, id, 1 AS prio, rank FROM kwr WHERE rank <= 5 UNION ALL SELECT query_id, id, 2, rank FROM bm25r WHERE rank <= 5)
SELECT query_id, id, prio FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY prio) AS n FROM u) WHERE n = 1""")
def g_ordered_union(spark, sf):
    rows, asked = src.memories(spark, sf), _asked(spark, sf)
    one = search.ranked(search.keyword_ratio(rows, asked), 5).select("query_id", "id", F.lit(1).alias("prio"))
    two = search.ranked(search.bm25(rows, asked), 5).select("query_id", "id", F.lit(2).alias("prio"))
    return store.latest(one.union(two), ["query_id", "id"], F.col("prio"))


# H: text


@query(f"SELECT doc_id AS id, array_to_string({TOKENS.format('text')}, ' ') AS tokens FROM documents")
def h_tokenizer(spark, sf):
    return src.memories(spark, sf).select("id", F.array_join(T.tokens(F.col("content")), " ").alias("tokens"))


PHRASES = "list_filter(list_concat(regexp_extract_all({}, '[一-龥]{{2,4}}'), regexp_extract_all({}, '[a-zA-Z]{{3,}}')), lambda p: lower(p) NOT IN ('的', '了', '是', '在', '和', '有', '这', '那', 'the', 'a', 'is', 'are', 'to', 'and', 'of', 'in'))"


@query(f"SELECT doc_id AS id, array_to_string({PHRASES.format('text', 'text')}, ' ') AS phrases FROM documents")
def h_noun_phrases(spark, sf):
    return src.memories(spark, sf).select("id", F.array_join(T.noun_phrases(F.col("content")), " ").alias("phrases"))


@query("SELECT item_id, array_to_string(list_slice(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) BETWEEN 3 AND 8))), 1, 10), ' ') AS terms FROM benchmark")
def h_search_terms(spark, sf):
    return src.table(spark, sf, "benchmark").select("item_id", F.array_join(T.search_terms(F.col("text")), " ").alias("terms"))


@query("""SELECT query_id, id FROM (SELECT item_id AS query_id, doc_id AS id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n
FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(substring(b.text, 1, 12)))) WHERE n <= 50""")
def h_substring_scan(spark, sf):
    return search.substring_scan(src.memories(spark, sf), _asked(spark, sf))


@query(f"""WITH q AS (SELECT item_id AS query_id, lower(substring(text, 1, 12)) AS piece, list_filter(regexp_extract_all(lower(text), '[a-z]{{3,50}}'), lambda w: w NOT IN {STOP}) AS k0 FROM benchmark),
q1 AS (SELECT query_id, piece, list_slice(list_filter(k0, lambda w, i: list_position(k0, w) = i), 1, 4) AS kws FROM q),
s AS (SELECT query_id, doc_id AS id, CASE WHEN contains(lower(text), piece) THEN 1.0 ELSE 0.0 END + 0.8 * len(list_filter(kws, lambda w: contains(lower(text), w))) / len(kws) AS score FROM q1, documents WHERE len(kws) > 0)
SELECT * FROM (SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""")
def h_store_score(spark, sf):
    return search.ranked(search.store_score(src.memories(spark, sf), _asked(spark, sf)), 20)


@query("SELECT doc_id AS id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS key FROM documents")
def h_normalized_text(spark, sf):
    return src.memories(spark, sf).select("id", F.md5(T.normalized_text(F.col("content")).cast("binary")).alias("key"))


@query("""WITH n AS (SELECT DISTINCT regexp_replace(lower(name), '[\\s_\\-]', '', 'g') AS name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier))
SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name < y.name AND length(x.name) >= 4 AND length(y.name) >= 4 AND levenshtein(x.name, y.name) <= 1""")
def h_edit1_pairs(spark, sf):
    names = src.table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(src.table(spark, sf, "region").select("r_name")).union(src.table(spark, sf, "supplier").select("s_name"))
    return dedup.edit_pairs(names)


@query("SELECT item_id, length(text) - length(replace(text, ' ', '')) AS spaces, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS est_words, length(text) // 4 AS est_mixed FROM benchmark")
def h_token_estimators(spark, sf):
    c = F.col("text")
    return src.table(spark, sf, "benchmark").select("item_id", (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("bigint").alias("spaces"), T.estimated_tokens(c).alias("est_words"), T.mixed_tokens(c).alias("est_mixed"))


@query("SELECT item_id, len(s) AS n, s[1] AS first FROM (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?\\n])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM benchmark)")
def h_sentences(spark, sf):
    s = T.sentences(F.col("text"))
    return src.table(spark, sf, "benchmark").select("item_id", F.size(s).cast("bigint").alias("n"), F.get(s, F.lit(0)).alias("first"))


@query("SELECT doc_id AS id, md5(regexp_replace(text, '(?i)\\b(license|licensed)\\b', '<b>\\1</b>', 'g')) AS marked FROM documents")
def h_highlight(spark, sf):
    return src.memories(spark, sf).select("id", F.md5(T.highlighted(F.col("content"), "license|licensed").cast("binary")).alias("marked"))


@query(f"SELECT doc_id AS id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,50}}'), lambda w: w NOT IN {STOP}))), ' ') AS keywords FROM documents")
def h_keywords(spark, sf):
    return src.memories(spark, sf).select("id", F.array_join(F.array_sort(T.keywords(F.col("content"))), " ").alias("keywords"))


@query(f"""WITH {POSTINGS}, s AS (SELECT id, term AS topic, round(tf * ln((SELECT count(*) FROM documents) / (1 + df)), 6) AS score FROM post JOIN (SELECT term, count(*) AS df FROM post WHERE length(term) BETWEEN 2 AND 20 GROUP BY term) USING (term))
SELECT id, topic, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic) AS r FROM s) WHERE r <= 3""")
def h_topic_keywords(spark, sf):
    return dedup.topic_keywords(src.memories(spark, sf), 3)


@query("""WITH s AS (SELECT item_id AS id, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS s FROM (SELECT item_id, lower(trim(text)) AS t FROM benchmark))
SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))), 6) AS jaccard FROM s x JOIN s y ON x.id < y.id WHERE len(list_intersect(x.s, y.s)) / len(list_distinct(list_concat(x.s, y.s))) >= 0.1""")
def h_jaccard_pairs(spark, sf):
    rows = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    return dedup.shingle_pairs(rows, 0.1).withColumn("jaccard", F.round("jaccard", 6))


@query()
def h_chunks(spark, sf):
    return context.chunks(src.memories(spark, sf), 128, 32)


@query("SELECT page_id, CASE WHEN regexp_matches(substring(html, 1, 2000), '(?im)^(user|assistant|system|human|ai)\\s*[:：]') THEN 'dialogue' WHEN regexp_matches(substring(html, 1, 2000), '(?m)^\\[?\\d{1,2}:\\d{2}(:\\d{2})?\\]?') THEN 'transcript' ELSE 'other' END AS kind FROM pages")
def h_source_type(spark, sf):
    kind = context.source_type(F.col("html"))
    return src.table(spark, sf, "pages").select("page_id", F.when(kind.isin("dialogue", "transcript"), kind).otherwise("other").alias("kind"))


# I: times


@query("""SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day_start, date_trunc('week', ts)::TIMESTAMP AS week_start, date_trunc('week', ts)::TIMESTAMP + INTERVAL 7 DAY - INTERVAL 1 MICROSECOND AS week_end,
date_trunc('month', ts)::TIMESTAMP + INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND AS month_end, date_trunc('year', ts)::TIMESTAMP AS year_start FROM events""")
def i_calendar_bounds(spark, sf):
    ts = F.col("ts")
    return src.table(spark, sf, "events").select("event_id", TM.bounds(ts, "day")[0].alias("day_start"), TM.bounds(ts, "week")[0].alias("week_start"), TM.bounds(ts, "week")[1].alias("week_end"), TM.bounds(ts, "month")[1].alias("month_end"), TM.bounds(ts, "year")[0].alias("year_start"))


@query(f"SELECT event_id, round(exp(-ln(2) * date_sub('second', ts, TIMESTAMP '{NOW}') / 2592000), 6) AS recency, CASE WHEN date_sub('second', ts, TIMESTAMP '{NOW}') < 3600 THEN 0.1 WHEN date_sub('second', ts, TIMESTAMP '{NOW}') < 86400 THEN 0.05 ELSE 0.0 END AS bonus FROM events")
def i_recency(spark, sf):
    return src.table(spark, sf, "events").select("event_id", F.round(TM.recency(F.col("ts"), NOW), 6).alias("recency"), TM.step_bonus(F.col("ts"), NOW).alias("bonus"))


@query("SELECT event_id, round(greatest(value / 777, 0.01) * power(0.8, event_id % 4), 4) AS confidence FROM events")
def i_hop_decay(spark, sf):
    return src.table(spark, sf, "events").select("event_id", TM.hop_decay(F.col("value") / 777, 0.8, F.pmod("event_id", F.lit(4))).alias("confidence"))


@query(f"""WITH {FACTS}, s AS (SELECT *, date_sub('second', valid_from, TIMESTAMP '{NOW}') / 86400 AS age FROM facts), t AS (SELECT *, CASE WHEN age <= 1 THEN 1 WHEN age <= 7 THEN 2 WHEN age <= 30 THEN 3 ELSE 4 END AS stage FROM s WHERE age BETWEEN 0 AND 365),
u AS (SELECT subject, CASE WHEN count(*) FILTER (stage <= 1) >= 3 THEN 1 WHEN count(*) FILTER (stage <= 2) >= 3 THEN 2 WHEN count(*) FILTER (stage <= 3) >= 3 THEN 3 ELSE 4 END AS used FROM t GROUP BY subject)
SELECT uuid, subject, used FROM t JOIN u USING (subject) WHERE stage <= used""")
def i_expanding_window(spark, sf):
    return temporal.expanding_window(src.facts(spark, sf), NOW).select("uuid", "subject", "used")


# J: vectors

_COS = "list_sum(list_transform(list_zip(q, v), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


@query(f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.id % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 10""")
def j_cosine_topk(spark, sf):
    rows = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.nearest(rows, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 10)


@query(f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT a.id AS query_id, b.id, round(list_inner_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.id % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 10""")
def j_inner_product_topk(spark, sf):
    rows = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search.nearest(rows, rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), 10, "dot")


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS norm FROM embeddings GROUP BY label")
def j_norms(spark, sf):
    return src.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("norm"))


# K: temporal facts


@query(f"WITH {FACTS} SELECT uuid, subject, predicate, object FROM facts WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '{EARLIER}') AND (valid_until IS NULL OR valid_until >= TIMESTAMP '{EARLIER}')")
def k_asof_fact(spark, sf):
    return temporal.as_of(src.facts(spark, sf), EARLIER).select("uuid", "subject", "predicate", "object")


@query(f"WITH {FACTS} SELECT uuid FROM facts WHERE valid_from <= TIMESTAMP '{NOW}' AND (valid_until IS NULL OR valid_until >= TIMESTAMP '{EARLIER}')")
def k_range_overlap(spark, sf):
    return temporal.overlapping(src.facts(spark, sf), EARLIER, NOW).select("uuid")


@query(f"WITH {FACTS}, t AS (SELECT subject, valid_from AS \"at\", 'started' AS what, uuid FROM facts UNION ALL SELECT subject, valid_until, 'ended', uuid FROM facts) SELECT * FROM t WHERE \"at\" BETWEEN TIMESTAMP '{EARLIER}' AND TIMESTAMP '{NOW}'")
def k_timeline(spark, sf):
    return temporal.timeline(src.facts(spark, sf), EARLIER, NOW)


@query(f"""WITH {FACTS}, o AS (SELECT DISTINCT subject, predicate, object, 1 AS o FROM facts WHERE valid_from <= TIMESTAMP '{EARLIER}' AND (valid_until IS NULL OR valid_until >= TIMESTAMP '{EARLIER}')),
n AS (SELECT DISTINCT subject, predicate, object, 1 AS n FROM facts WHERE valid_from <= TIMESTAMP '{NOW}' AND (valid_until IS NULL OR valid_until >= TIMESTAMP '{NOW}'))
SELECT subject, count(*) FILTER (o IS NULL) AS added, count(*) FILTER (n IS NULL) AS removed, count(*) FILTER (o = 1 AND n = 1) AS unchanged FROM o FULL JOIN n USING (subject, predicate, object) GROUP BY subject""")
def k_snapshot_diff(spark, sf):
    return temporal.snapshot_diff(src.facts(spark, sf), EARLIER, NOW)


@query("SELECT event_id AS uuid, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_until FROM events")
def k_supersede(spark, sf):
    return temporal.superseded(src.facts(spark, sf).drop("valid_until").withColumn("valid_until", F.lit(None).cast("timestamp_ntz"))).select("uuid", "valid_from", "valid_until")


@query("SELECT user_id AS subject, count(DISTINCT event_type) AS predicates, count(*) AS n FROM events GROUP BY user_id")
def k_subjects(spark, sf):
    return src.facts(spark, sf).groupBy("subject").agg(F.countDistinct("predicate").alias("predicates"), F.count("*").alias("n"))


# L: graph


@query(f"WITH {EDGES} SELECT src AS node, type, dst AS neighbour FROM edges WHERE type = 'PLACED' UNION ALL SELECT dst, type, src FROM edges WHERE type = 'PLACED'")
def l_neighbours(spark, sf):
    return graph.neighbours(src.edges(spark, sf), "both", ["PLACED"])


@query(f"WITH {EDGES} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON x.dst = y.src WHERE x.type = 'PLACED' AND y.type = 'CONTAINS'")
def l_triple(spark, sf):
    return graph.two_step(src.edges(spark, sf), "PLACED", "CONTAINS")


@query(f"""WITH {EDGES}, s AS (SELECT 'c:' || c_custkey AS start FROM customer WHERE c_custkey % 50 = 0), d1 AS (SELECT DISTINCT start, dst AS node FROM s JOIN edges ON src = start), d2 AS (SELECT DISTINCT start, dst AS node FROM d1 JOIN edges ON src = node),
d3 AS (SELECT DISTINCT start, dst AS node FROM d2 JOIN edges ON src = node)
SELECT start, node, min(depth) AS depth FROM (SELECT start, start AS node, 0 AS depth FROM s UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) GROUP BY start, node""")
def l_bfs(spark, sf):
    return graph.breadth_first(src.edges(spark, sf), _starts(spark, sf), 3)


def _starts(spark, sf):
    return src.table(spark, sf, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("start"))


@query(f"""WITH {EDGES}, s AS (SELECT 'c:' || c_custkey AS start FROM customer WHERE c_custkey % 50 = 0), w1 AS (SELECT start, dst AS node, 1 AS n FROM s JOIN edges ON src = start), w2 AS (SELECT start, dst AS node, sum(n) AS n FROM w1 JOIN edges ON src = node GROUP BY ALL)
SELECT start, node, 1 AS depth, CAST(n AS BIGINT) AS n FROM w1 UNION ALL SELECT start, node, 2, CAST(n AS BIGINT) FROM w2""")
def l_walks(spark, sf):
    return graph.walks(src.edges(spark, sf), _starts(spark, sf), 2)


@query(f"""WITH {EDGES}, s AS (SELECT 'c:' || c_custkey AS start FROM customer WHERE c_custkey % 50 = 0), d1 AS (SELECT DISTINCT start, dst AS node FROM s JOIN edges ON src = start), v AS (SELECT start, start AS node, 0 AS depth FROM s UNION ALL SELECT *, 1 FROM d1)
SELECT start, dst AS id, round(sum(1.0 / (depth + 1)), 6) AS score FROM v JOIN edges ON src = node GROUP BY start, dst""")
def l_graph_recall(spark, sf):
    return graph.recall_by_graph(src.edges(spark, sf), _starts(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"""WITH {EDGES}, s AS (SELECT 'c:' || c_custkey AS start FROM customer WHERE c_custkey % 50 = 0), r AS (SELECT start AS node FROM s UNION SELECT dst FROM s JOIN edges ON src = start)
SELECT DISTINCT src, type, dst FROM edges WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)""")
def l_subgraph(spark, sf):
    edges = src.edges(spark, sf)
    return graph.subgraph(edges, graph.breadth_first(edges, _starts(spark, sf), 1))


@query()
def l_components(spark, sf):
    found = graph.connected_components(src.coded_edges(spark, sf))
    return found.select(src.node_name("node").alias("node"), src.node_name("component").alias("component"))


@query()
def l_label_propagation(spark, sf):
    found = graph.label_propagation(src.coded_edges(spark, sf, "SUPPLIED_BY"), 3)
    return found.select(src.node_name("node").alias("node"), src.node_name("label").alias("label"))


# M: contradictions


@query(f"""WITH {FACTS} SELECT a.uuid AS old_uuid, b.uuid AS new_uuid, 'direct' AS kind, CAST(0.8 AS DOUBLE) AS base FROM facts a JOIN facts b ON a.subject = b.subject AND a.predicate = b.predicate AND a.uuid < b.uuid AND a.object <> b.object
WHERE NOT coalesce(a.valid_until < b.valid_from, false) AND NOT coalesce(b.valid_until < a.valid_from, false)""")
def m_direct_conflict(spark, sf):
    return quality.direct(src.facts(spark, sf))


@query(f"""WITH {FACTS} SELECT a.uuid AS old_uuid, b.uuid AS new_uuid, 'logical' AS kind, CAST(0.6 AS DOUBLE) AS base FROM facts a JOIN facts b ON a.subject = b.subject AND a.object = b.object AND a.uuid <> b.uuid AND a.predicate = 'click' AND b.predicate = 'purchase'
WHERE NOT coalesce(a.valid_until < b.valid_from, false) AND NOT coalesce(b.valid_until < a.valid_from, false)""")
def m_logical_conflict(spark, sf):
    return quality.logical(src.facts(spark, sf), [("click", "purchase")])


@query("SELECT user_id::VARCHAR AS entity, 'kind' AS attribute, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS found FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def m_attribute_conflicts(spark, sf):
    said = src.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("entity"), F.lit("kind").alias("attribute"), F.col("event_type").alias("value"))
    return quality.attribute_conflicts(said).drop("severity")


@query("SELECT user_id::VARCHAR AS entity, min(value) AS low, max(value) AS high FROM events GROUP BY user_id HAVING max(value) - min(value) > 1")
def m_number_conflicts(spark, sf):
    said = src.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("entity"), F.lit("age").alias("attribute"), F.col("value").cast("string").alias("value"))
    return quality.number_conflicts(said).drop("severity")


@query(f"WITH {FACTS}, e AS (SELECT subject, min(valid_from) AS ended FROM facts WHERE predicate = 'purchase' GROUP BY subject) SELECT f.subject, uuid, predicate FROM facts f JOIN e USING (subject) WHERE valid_from > ended AND predicate <> 'purchase'")
def m_acts_after_end(spark, sf):
    return quality.acts_after_end(src.facts(spark, sf), "purchase").drop("severity")


# N: duplicates and links


@query("""SELECT key, n, least FROM (SELECT md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS key, count(*) AS n, min(doc_id) AS least FROM documents GROUP BY 1) WHERE n > 1""")
def n_exact_dedupe(spark, sf):
    return dedup.exact_groups(src.memories(spark, sf))


@query("SELECT doc_id AS id, source AS user_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq FROM documents) QUALIFY seq - lag(seq) OVER (PARTITION BY source, trim(text, ' ') ORDER BY seq) <= 100")
def n_recent_repeats(spark, sf):
    return dedup.recent_repeats(src.memories(spark, sf))


@query("SELECT min(doc_id) AS id FROM documents GROUP BY md5(text)")
def n_import_dedupe(spark, sf):
    return dedup.import_dedupe(src.memories(spark, sf).withColumn("external_id", F.lit(None).cast("string"))).select("id")


#: Distinct word sets (one document of each), pairs of word Jaccard 0.75 or more by rare-word prefixes, and the names they share.
LINKS = r"""w AS (SELECT doc_id AS id, text, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS ws FROM documents),
one AS (SELECT min(id) AS id, any_value(ws) AS ws FROM w WHERE len(ws) > 0 GROUP BY md5(array_to_string(ws, ' '))),
t AS (SELECT id, unnest(ws) AS t, len(ws) AS n FROM one), df AS (SELECT t, count(*) AS df FROM t GROUP BY t),
h AS (SELECT * FROM (SELECT id, t, n, row_number() OVER (PARTITION BY id ORDER BY df, t) AS r FROM t JOIN df USING (t)) WHERE r <= n - CAST(ceil(0.75 * n) AS BIGINT) + 1),
near AS (SELECT DISTINCT x.id AS a, y.id AS b FROM h x JOIN h y ON x.t = y.t AND x.id < y.id AND least(x.n, y.n) >= 0.75 * greatest(x.n, y.n)),
sim AS (SELECT a, b, len(list_intersect(x.ws, y.ws)) / len(list_distinct(list_concat(x.ws, y.ws))) AS similarity FROM near JOIN one x ON a = x.id JOIN one y ON b = y.id),
ents AS (SELECT id, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS e FROM w),
p AS (SELECT a, b, similarity, len(list_intersect(x.e, y.e)) AS shared FROM sim JOIN ents x ON a = x.id JOIN ents y ON b = y.id WHERE similarity >= 0.75),
links AS (SELECT a, b, CASE WHEN shared >= 3 AND similarity >= 0.85 THEN 'FOLLOWS' ELSE 'RELATED' END AS relation FROM p WHERE shared >= 1 OR similarity >= 0.85)"""


@query(f"WITH {LINKS} SELECT * FROM links")
def n_event_links(spark, sf):
    return dedup.event_links(dedup.event_pairs(src.memories(spark, sf))).select("a", "b", "relation")


@query()
def n_three_stages(spark, sf):
    rows, vectors = src.memories(spark, sf).select("id", "content"), src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    sides = ["id % 2 = 0", "id % 2 = 1"]
    return dedup.three_stages(*[rows.where(x) for x in sides], vectors=tuple(vectors.where(x) for x in sides))


@query()
def n_leader_clusters(spark, sf):
    return dedup.leader_clusters(src.memories(spark, sf).select("id", "content", "user_id"))


# O, P: pipelines and triggers


@query()
def o_search_pipeline(spark, sf):
    return plan.search(src.memories(spark, sf), _asked(spark, sf))


@query(f"""WITH {POSTINGS}, {ASKED}, {BM25}, {KEYWORD}, e AS (SELECT item_id AS query_id, unnest(list_slice(l, 1, 3)) AS name FROM (SELECT item_id, list_filter(x, lambda w, i: list_position(x, w) = i) AS l FROM (SELECT item_id, regexp_extract_all(text, '[A-Z][a-z]{{2,}}') AS x FROM benchmark))),
en AS (SELECT DISTINCT query_id, id, 0.7 AS score FROM e JOIN (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{2,}}'))) AS name FROM documents) USING (name)),
enr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM en),
f AS (SELECT query_id, id, sum(w / (60 + rank)) AS s FROM (SELECT query_id, id, rank, 0.3 AS w FROM bm25r WHERE rank <= 50 UNION ALL SELECT query_id, id, rank, 1.2 FROM kwr WHERE rank <= 50 UNION ALL SELECT query_id, id, rank, 1.0 FROM enr WHERE rank <= 50) GROUP BY query_id, id),
g AS (SELECT query_id, id, round(0.5 * CASE WHEN max(s) OVER w = min(s) OVER w THEN 1.0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END + 0.3 * (id % 10 / 10) + 0.1, 6) AS score FROM f WINDOW w AS (PARTITION BY query_id))
SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g) WHERE rank <= 10""")
def o_search_fast(spark, sf):
    return plan.search(src.memories(spark, sf), _asked(spark, sf), plan.FAST)


@query("SELECT user_id, CAST(least(greatest(1000 + 2 * count(*), 500), 8000) AS BIGINT) AS budget FROM events GROUP BY user_id")
def o_adaptive_budget(spark, sf):
    return src.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", context.adaptive_budget(1000, F.col("n")).alias("budget"))


@query("""SELECT id, user_id, since FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, since DESC, id) AS r FROM (SELECT doc_id AS id, source AS user_id, doc_id % 10 / 10 AS importance, 100 - doc_id % 97 AS since FROM documents)
WHERE importance >= 0.5 AND since >= CASE WHEN importance > 0.7 THEN 20 ELSE 40 END) WHERE r <= 3""")
def o_reminders(spark, sf):
    rows = src.memories(spark, sf).withColumn("last_turn", F.pmod("id", F.lit(97)))
    return context.reminders(rows, F.lit(100), 40).select("id", "user_id", "since")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seen FROM conversations WHERE role = 'user') WHERE seen % 2 = 0")
def p_every_nth_turn(spark, sf):
    return context.every_nth(src.turns(spark, sf), 2).select("conv_id", "turn")


@query("SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def p_rate_window(spark, sf):
    return src.table(spark, sf, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


# further windows, graphs, vectors and context


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25 OFFSET 50")
def e_clamped_page(spark, sf):
    rows = src.table(spark, sf, "events").select("event_id", "value")
    return store.clamped_page(rows, 3, 25, F.desc("value"), F.col("event_id"))


@query(f"""WITH {FACTS} SELECT uuid, CASE WHEN predicate = 'click' THEN TIMESTAMP '{NOW}' END AS expired_at FROM facts""")
def k_expire(spark, sf):
    facts = src.facts(spark, sf)
    return temporal.expired(facts, facts.where("predicate = 'click'").select("uuid"), NOW).select("uuid", "expired_at")


@query(f"""WITH {EDGES}, s AS (SELECT 'c:' || c_custkey AS start FROM customer WHERE c_custkey % 50 = 0), d1 AS (SELECT DISTINCT start, dst AS node FROM s JOIN edges ON src = start), d2 AS (SELECT DISTINCT start, dst AS node FROM d1 JOIN edges ON src = node),
d3 AS (SELECT DISTINCT start, dst AS node FROM d2 JOIN edges ON src = node) SELECT start, node AS goal, 3 AS hops FROM d3 WHERE node IN ('s:1', 's:2', 's:3')""")
def l_shortest_paths(spark, sf):
    goals = spark.createDataFrame([("s:1",), ("s:2",), ("s:3",)], "goal string")
    return graph.shortest_paths(src.edges(spark, sf), _starts(spark, sf).crossJoin(goals), 3)


@query("""SELECT count(*) AS communities, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean_size FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) >= 2)""")
def l_community_stats(spark, sf):
    return graph.community_statistics(src.table(spark, sf, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("label")), "label")


@query("SELECT user_id AS entity, event_type AS type, count(*) AS n, max(value) AS confidence, min(event_id) AS first FROM events GROUP BY user_id, event_type HAVING count(*) >= 3")
def d_entity_occurrences(spark, sf):
    rows = src.table(spark, sf, "events")
    return rows.groupBy(F.col("user_id").alias("entity"), F.col("event_type").alias("type")).agg(F.count("*").alias("n"), F.max("value").alias("confidence"), F.min("event_id").alias("first")).where("n >= 3")


@query("SELECT n_name AS name, r_name AS community FROM nation JOIN region ON n_regionkey = r_regionkey")
def l_node_community(spark, sf):
    nations, regions = src.table(spark, sf, "nation"), src.table(spark, sf, "region")
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(F.col("n_name").alias("name"), F.col("r_name").alias("community"))


@query("""WITH t AS (SELECT conv_id AS query_id, turn AS ord, role || ': ' || text AS line FROM conversations),
a AS (SELECT *, 0 AS section, sum(length(line)) OVER (PARTITION BY query_id ORDER BY ord) AS used FROM t WHERE line LIKE 'user:%'), b AS (SELECT *, 1 AS section, sum(length(line)) OVER (PARTITION BY query_id ORDER BY ord) AS used FROM t WHERE line LIKE 'assistant:%')
SELECT query_id, section, ord, line FROM (SELECT * FROM a WHERE used <= 400 UNION ALL SELECT * FROM b WHERE used <= 1200)""")
def o_context_sections(spark, sf):
    rows = src.turns(spark, sf).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ord"), F.concat("role", F.lit(": "), "text").alias("line"))
    return context.sections([rows.where(F.col("line").startswith("user:")), rows.where(F.col("line").startswith("assistant:"))], [400, 1200])


@query("SELECT q.vec_id AS query_id, e.vec_id AS id, round(0.7 * list_cosine_similarity(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(e.embedding, lambda x: CAST(x AS DOUBLE))) + 0.3 * (e.vec_id % 7 / 7), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0")
def j_fine_rank(spark, sf):
    rows = src.table(spark, sf, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    own = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.pmod("vec_id", F.lit(7)) / 7).alias("score"))
    return search.fine_ranked(own, asked)


@query()
def j_ivf_topk(spark, sf):
    rows = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    model = vector_index.fit(rows, vector_index.n_cells(rows.count()))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return vector_index.nearest(vector_index.indexed(rows, model), asked, model, 10, vector_index.n_probes(len(model.clusterCenters())))


@query("SELECT event_type, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'resolved') AS resolved FROM (SELECT event_type, CASE WHEN value > 100 THEN 'pending' ELSE 'resolved' END AS status FROM events) GROUP BY event_type")
def m_status_counts(spark, sf):
    status = F.when(F.col("value") > 100, "pending").otherwise("resolved")
    rows = src.table(spark, sf, "events").withColumn("status", status)
    one = lambda s: F.sum(F.when(F.col("status") == s, 1).otherwise(0))
    return rows.groupBy("event_type").agg(one("pending").alias("pending"), one("resolved").alias("resolved"))


@query(f"""WITH {FACTS}, d AS (SELECT a.uuid AS old_uuid, min(b.valid_from) AS cut FROM facts a JOIN facts b ON a.subject = b.subject AND a.predicate = b.predicate AND a.uuid < b.uuid AND a.object <> b.object
WHERE NOT coalesce(a.valid_until < b.valid_from, false) AND NOT coalesce(b.valid_until < a.valid_from, false) GROUP BY a.uuid) SELECT uuid, coalesce(cut, valid_until) AS valid_until FROM facts LEFT JOIN d ON uuid = old_uuid""")
def m_supersede(spark, sf):
    facts = src.facts(spark, sf)
    return quality.resolved(facts, quality.direct(facts), "supersede").select("uuid", "valid_until")


@query("SELECT entity, n, round(greatest(0.5, 1 - 0.1 * n), 6) AS confidence FROM (SELECT user_id::VARCHAR AS entity, count(*) AS n FROM events WHERE value > 150 GROUP BY user_id)")
def m_consistency_report(spark, sf):
    said = src.table(spark, sf, "events").where("value > 150").select(F.col("user_id").cast("string").alias("entity"))
    return quality.report(said)


@query(f"WITH {EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node) SELECT split_part(node, ':', 1) AS kind, count(*) AS nodes, round(avg(degree), 6) AS mean_degree FROM d GROUP BY 1")
def d_average_degree(spark, sf):
    degree = graph.both_ways(src.edges(spark, sf)).groupBy("src").agg(F.count("*").alias("degree"))
    return degree.groupBy(F.substring_index("src", ":", 1).alias("kind")).agg(F.count("*").alias("nodes"), F.round(F.avg("degree"), 6).alias("mean_degree"))


# lifecycle


def _contexts(spark, sf):
    return src.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "user_id", F.col("ts").alias("last_used"), (F.pmod("event_id", F.lit(20)) / 20).alias("confidence"), F.lit(1).cast("bigint").alias("use_count"), F.col("props").alias("content"))


@query(f"SELECT event_id AS id, round(c, 6) AS confidence, round(c, 6) <= 0.1 AS archived FROM (SELECT event_id, CASE WHEN date_sub('second', ts, TIMESTAMP '{NOW}') > 14 * 86400 THEN event_id % 20 / 20 * 0.95 ELSE event_id % 20 / 20 END AS c FROM events)")
def i_confidence_decay(spark, sf):
    return lifecycle.decayed(_contexts(spark, sf), NOW).select("id", "confidence", "archived")


@query(f"SELECT event_id AS id, date_sub('second', ts, TIMESTAMP '{NOW}') > 10 * 86400 AS archived FROM events")
def n_archive(spark, sf):
    return lifecycle.archived(_contexts(spark, sf), NOW, 10, "last_used").select("id", "archived")


@query("""SELECT user_id, event_type AS kind, arg_min(props, row(-length(props), props)) AS content, count(*) AS use_count, round(least(1.0, max(event_id % 20 / 20) + 0.1 * (count(*) - 1)), 6) AS confidence FROM events GROUP BY ALL""")
def n_context_merge(spark, sf):
    return lifecycle.merged(_contexts(spark, sf), "user_id", "kind")


@query("SELECT event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 20 / 20 DESC, event_id) <= 30 AS is_active FROM events")
def n_context_consolidation(spark, sf):
    return lifecycle.consolidated(_contexts(spark, sf), "kind", 30).select("id", "is_active")


@query("SELECT a.event_id AS id, 1 + count(b.event_id) AS use_count FROM events a LEFT JOIN (SELECT event_id, event_id // 2 AS id FROM events) b ON a.event_id = b.id GROUP BY a.event_id")
def n_usage_marking(spark, sf):
    log = src.table(spark, sf, "events").select(F.floor(F.col("event_id") / 2).alias("id"), "ts")
    return lifecycle.marked_used(_contexts(spark, sf), log, "id").select("id", "use_count")


@query(f"""WITH RECURSIVE {LINKS}, w2 AS (SELECT id AS start, id AS node, 0 AS depth FROM w WHERE id % 50 = 0 UNION SELECT start, b, depth + 1 FROM w2 JOIN links ON a = node WHERE depth < 5)
SELECT start::VARCHAR AS start, node::VARCHAR AS node, min(depth) AS depth FROM w2 GROUP BY start, node""")
def n_event_chain(spark, sf):
    starts = src.memories(spark, sf).where("id % 50 = 0").select(F.col("id").cast("string").alias("start"))
    return lifecycle.event_chain(QUERIES["n_event_links"](spark, sf), starts, 5)
