"""Further operators of the data model: lookups, names, topics, negations, budgets, summaries, time phrases and signatures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.operators import context, dedup, entities, graph, quality, search, store
from engramlake.plans.catalog import EDGES, FACTS, KEYWORD, POSTINGS, ASKED, query
from engramlake.sources import tables as src


@query("SELECT doc_id AS id, source AS user_id, text AS content FROM documents WHERE doc_id % 50 = 0")
def a_point_lookup(spark, sf):
    rows = src.memories(spark, sf)
    return store.by_ids(rows, rows.where("id % 50 = 0").select("id")).select("id", "user_id", "content")


@query("SELECT doc_id AS id, doc_id // 100000 AS volume, doc_id % 100000 // 10000 AS file, doc_id % 10000 AS \"offset\" FROM documents WHERE doc_id % 50 = 0")
def a_volume_lookup(spark, sf):
    rows = src.memories(spark, sf)
    return store.by_ids(store.volumes(rows, "id"), rows.where("id % 50 = 0").select("id")).select("id", F.col("volume").cast("bigint").alias("volume"), F.col("file").cast("bigint").alias("file"), "offset")


@query("SELECT source AS user_id, count(*) AS n FROM documents WHERE source NOT IN (SELECT min(source) FROM documents) GROUP BY source")
def a_clear_user(spark, sf):
    rows = src.memories(spark, sf)
    return store.without(rows, rows.agg(F.min("user_id").alias("user_id")), "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_orderkey AS episode, l_partkey AS memory FROM lineitem) SELECT memory, count(DISTINCT episode) AS episodes, min(episode) AS first FROM m WHERE memory % 50 = 0 GROUP BY memory""")
def a_episodes_by_memory(spark, sf):
    rows = src.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(F.collect_set("l_partkey").alias("memory_ids"))
    asked = src.table(spark, sf, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("memory"))
    return store.holding(rows, "memory_ids", asked, "memory").groupBy("memory").agg(F.count("*").alias("episodes"), F.min("episode").alias("first"))


@query("""WITH k AS (SELECT l_orderkey AS episode, l_partkey AS p FROM lineitem WHERE l_partkey % 7 <> 0) SELECT episode, count(DISTINCT p) AS n FROM k GROUP BY episode""")
def a_purge_references(spark, sf):
    rows = src.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(F.collect_set("l_partkey").alias("refs"))
    gone = src.table(spark, sf, "part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id"))
    return store.purged(rows, gone, "id", "refs").select("episode", F.size("refs").cast("bigint").alias("n"))


@query("""SELECT * FROM (SELECT o_orderkey AS episode, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 3""")
def k_recent_episodes(spark, sf):
    rows = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("episode"), F.col("o_custkey").alias("user_id"), "o_orderdate")
    along = Window.partitionBy("user_id").orderBy(F.desc("o_orderdate"), F.desc("episode"))
    return rows.withColumn("rank", F.row_number().over(along)).where("rank <= 3").select("episode", "user_id", F.col("rank").cast("bigint").alias("rank"))


_TOPICS = "topics AS (SELECT DISTINCT doc_id AS id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2,}'))) AS topic FROM documents)"


def _topics(spark, sf):
    return src.memories(spark, sf).select("id", F.explode(T.entities(F.col("content"))).alias("topic"))


@query(f"WITH {_TOPICS}, q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{{2,}}'))) AS topic FROM benchmark) SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id DESC) AS n FROM (SELECT DISTINCT query_id, id FROM q JOIN topics USING (topic))) WHERE n <= 20")
def n_search_by_topic(spark, sf):
    asked = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.entities(F.col("text"))).alias("topic"))
    found = _topics(spark, sf).join(asked, "topic").select("query_id", "id").distinct()
    return found.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("id")))).where("n <= 20").select("query_id", "id")


@query(f"WITH {_TOPICS} SELECT id, count(*) AS n, string_agg(topic, ',' ORDER BY topic) AS topics FROM topics GROUP BY id")
def n_topics_of_memory(spark, sf):
    return _topics(spark, sf).groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("topic")), ",").alias("topics"))


@query(f"WITH {_TOPICS}, w AS (SELECT topic FROM topics GROUP BY topic HAVING count(*) BETWEEN 2 AND 20) SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT id FROM topics JOIN w USING (topic))")
def b_topic_filter(spark, sf):
    topics = _topics(spark, sf)
    wanted = topics.groupBy("topic").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 20").select("topic")
    return src.memories(spark, sf).select("id").join(topics.join(wanted, "topic", "left_semi"), "id", "left_semi")


@query(f"""WITH {POSTINGS}, {ASKED}, {KEYWORD} SELECT query_id, id, score FROM (SELECT query_id, kw.id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kw.id) AS n FROM kw JOIN documents d ON d.doc_id = kw.id WHERE source = (SELECT min(source) FROM documents)) WHERE n <= 10""")
def b_user_isolation(spark, sf):
    rows = src.memories(spark, sf)
    own = rows.join(rows.agg(F.min("user_id").alias("user_id")), "user_id")
    asked = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.ranked(search.keyword_ratio(own, asked), 10).select("query_id", "id", "score")


@query(f"WITH {POSTINGS}, {ASKED} SELECT DISTINCT query_id, term FROM terms WHERE term IN (SELECT term FROM post)")
def b_known_terms(spark, sf):
    asked = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    words = src.memories(spark, sf).select(F.explode(T.tokens(F.col("content"))).alias("term"))
    return search.first_words(asked).select("query_id", "term").distinct().join(words, "term", "left_semi").select("query_id", "term")


def _suppliers(spark, sf):
    rows = src.table(spark, sf, "supplier")
    return rows.select(F.col("s_suppkey").cast("bigint").alias("id"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string"))).alias("aliases"))


@query("SELECT 's-' || s_suppkey AS query, s_suppkey AS id FROM supplier WHERE s_suppkey % 50 = 0")
def c_alias_lookup(spark, sf):
    asked = src.table(spark, sf, "supplier").where("s_suppkey % 50 = 0").select(F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("query"))
    return entities.by_name(_suppliers(spark, sf), asked)


@query("SELECT q.query, s_suppkey AS id FROM supplier JOIN (SELECT DISTINCT '1' || r_regionkey AS query FROM region) q ON contains(lower(s_name), q.query) OR contains('s-' || s_suppkey, q.query)")
def c_name_contains(spark, sf):
    asked = src.table(spark, sf, "region").select(F.concat(F.lit("1"), F.col("r_regionkey").cast("string")).alias("query")).distinct()
    return entities.containing(_suppliers(spark, sf), asked)


@query("SELECT c_name AS name, coalesce('Nation ' || n_name, c_name) AS canonical FROM customer LEFT JOIN nation ON c_custkey = n_nationkey")
def c_resolve_batch(spark, sf):
    aliases = src.table(spark, sf, "customer").join(src.table(spark, sf, "nation"), F.col("c_custkey") == F.col("n_nationkey")).select(F.upper("c_name").alias("alias"), F.concat(F.lit("Nation "), "n_name").alias("canonical"))
    return entities.canonical(src.table(spark, sf, "customer").select(F.col("c_name").alias("name")), aliases)


@query(f"WITH {EDGES} SELECT coalesce(s_name, dst) AS name, count(*) AS n FROM edges LEFT JOIN supplier ON dst = 's:' || s_suppkey WHERE type = 'SUPPLIED_BY' GROUP BY 1")
def c_edge_names(spark, sf):
    names = src.table(spark, sf, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("dst"), F.col("s_name").alias("name"))
    rows = src.edges(spark, sf).where("type = 'SUPPLIED_BY'").join(names, "dst", "left")
    return rows.groupBy(F.coalesce("name", "dst").alias("name")).agg(F.count("*").alias("n"))


@query("SELECT lower(name) AS key, min(id) AS id, count(*) AS verification_count, string_agg(DISTINCT name, '|' ORDER BY name) AS aliases FROM (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS name FROM documents) GROUP BY lower(name)")
def l_merge_nodes(spark, sf):
    rows = src.memories(spark, sf).select("id", F.explode(F.regexp_extract_all("content", F.lit("[A-Z][a-z]{2,}"), F.lit(0))).alias("name"))
    return entities.merged(rows)


@query(f"WITH {EDGES}, s AS (SELECT 'c:' || c_custkey AS start FROM customer WHERE c_custkey % 50 = 0), d1 AS (SELECT DISTINCT start, dst AS node FROM s JOIN edges ON src = start), d2 AS (SELECT DISTINCT start, dst AS node FROM d1 JOIN edges ON src = node) SELECT start, node FROM (SELECT start, start AS node FROM s UNION SELECT * FROM d1 UNION SELECT * FROM d2)")
def l_reachable(spark, sf):
    starts = src.table(spark, sf, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("start"))
    return graph.breadth_first(src.edges(spark, sf), starts, 2).select("start", "node")


@query(f"WITH {EDGES} SELECT type, count(*) AS n FROM edges WHERE src NOT IN (SELECT 'c:' || c_custkey FROM customer WHERE c_nationkey = 1) GROUP BY type")
def l_clear_user(spark, sf):
    gone = src.table(spark, sf, "customer").where("c_nationkey = 1").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("src"))
    return store.without(src.edges(spark, sf), gone, "src").groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS}, f AS (SELECT *, valid_from + INTERVAL 1 DAY AS known_at FROM facts) SELECT uuid, subject FROM f WHERE known_at <= TIMESTAMP '2024-01-15 00:00:00'")
def k_asof_known(spark, sf):
    facts = src.facts(spark, sf).withColumn("known_at", F.col("valid_from") + F.expr("INTERVAL 1 DAY"))
    return facts.where(F.col("known_at") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("uuid", "subject")


@query("SELECT user_id, round(sum(value) / 1000 * 0.002, 6) AS cost, round(greatest(0, 5 - sum(value) / 1000 * 0.002), 6) AS remaining, sum(value) / 1000 * 0.002 <= 5 AS affordable FROM events GROUP BY user_id")
def d_cost_and_budget(spark, sf):
    cost = F.sum("value") / 1000 * 0.002
    rows = src.table(spark, sf, "events").groupBy("user_id").agg(cost.alias("c"))
    return rows.select("user_id", F.round("c", 6).alias("cost"), F.round(F.greatest(F.lit(0.0), 5 - F.col("c")), 6).alias("remaining"), (F.col("c") <= 5).alias("affordable"))


@query("SELECT event_type AS kind, count(*) AS n, round(avg(event_id % 20 / 20), 6) AS confidence FROM events GROUP BY event_type")
def d_context_stats(spark, sf):
    return src.table(spark, sf, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(F.pmod("event_id", F.lit(20)) / 20), 6).alias("confidence"))


@query("SELECT l_orderkey AS id, CAST((n - 1) // 20 AS BIGINT) AS batch, count(*) AS n, min(l_linenumber) AS first FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem) GROUP BY l_orderkey, (n - 1) // 20")
def e_row_batches(spark, sf):
    rows = context.row_batches(src.table(spark, sf, "lineitem"), "l_orderkey", 20, "l_linenumber", "l_partkey")
    return rows.groupBy(F.col("l_orderkey").alias("id"), "batch").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("first"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_id) AS n FROM events) WHERE n <= 3")
def f_priority_sort(spark, sf):
    order = ["purchase", "signup", "click"]
    rows = src.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return context.by_priority(rows, "user_id", "event_type", order, "event_id").where("n <= 3").drop("n")


@query(f"""WITH {FACTS} SELECT a.uuid AS old_uuid, b.uuid AS new_uuid, round(least(1.0, 0.8 * 0.7 + ((a.uuid % 10) / 10 + (b.uuid % 10) / 10) / 2 * 0.3), 6) AS confidence FROM facts a JOIN facts b ON a.subject = b.subject AND a.predicate = b.predicate AND a.uuid < b.uuid AND a.object <> b.object
WHERE NOT coalesce(a.valid_until < b.valid_from, false) AND NOT coalesce(b.valid_until < a.valid_from, false)""")
def m_confidence(spark, sf):
    found = quality.direct(src.facts(spark, sf))
    part = lambda c: F.pmod(F.col(c), F.lit(10)) / 10
    return found.select("old_uuid", "new_uuid", F.round(quality.confidence(F.col("base"), part("old_uuid"), part("new_uuid")), 6).alias("confidence"))


@query("SELECT a.user_id::VARCHAR AS entity, a.event_type AS x, b.event_type AS y FROM (SELECT DISTINCT user_id, event_type FROM events) a JOIN (SELECT DISTINCT user_id, event_type FROM events) b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'")
def m_opposite_states(spark, sf):
    said = src.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("entity"), F.lit("state").alias("attribute"), F.col("event_type").alias("value"))
    return quality.opposite_conflicts(said, spark.createDataFrame([("click", "purchase")], "x string, y string")).drop("severity")


@query("""WITH r AS (SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day, ts FROM events), f AS (SELECT user_id, event_type, min(ts) AS t FROM r GROUP BY ALL)
SELECT a.user_id::VARCHAR AS entity, a.event_type AS x, b.event_type AS y FROM f a JOIN f b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.t > b.t""")
def m_event_sequence(spark, sf):
    said = src.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("event"), F.col("ts").alias("at"))
    return quality.out_of_order(said, [("click", "purchase")])


@query()
def h_minhash(spark, sf):
    rows = src.memories(spark, sf).select("id", T.shingles(F.coalesce("content", F.lit("")), 3).alias("s"))
    return rows.withColumn("signature", dedup.signature(F.col("s"))).select("id", F.size("s").alias("pieces"), "signature")


@query()
def c_lsh_candidates(spark, sf):
    rows = src.memories(spark, sf).select("id", "content")
    return dedup.lsh_pairs(rows.where("id % 50 = 0"), rows, 0.8).where("id <> match").withColumn("jaccard", F.round("jaccard", 6))
