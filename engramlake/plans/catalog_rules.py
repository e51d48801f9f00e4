"""Further operators: rules on relations, denials, tenses and marks of time, splits, core settings, phrase search, contexts, recency, pictures."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.operators import context, graph, metrics, quality, search
from engramlake.plans import search as plan
from engramlake.plans.catalog import EDGES, PHRASES, SQL, query
from engramlake.sources import tables as src


@query("""WITH r AS (SELECT DISTINCT user_id AS a, json_extract_string(props, '$.k')::BIGINT % 5 AS b, event_type AS r FROM events),
p AS (SELECT a, b, x.r AS r1, y.r AS r2 FROM r x JOIN r y USING (a, b) WHERE x.r <> y.r AND ((contains(x.r, 'click') AND contains(y.r, 'err')) OR (contains(x.r, 'view') AND (contains(y.r, 'sign') OR contains(y.r, 'click')))))
SELECT DISTINCT a, b, least(r1, r2) AS x, greatest(r1, r2) AS y, 0.75 AS severity FROM p""")
def m_relation_conflicts(spark, sf):
    rows = src.table(spark, sf, "events").select(F.col("user_id").alias("a"), (F.get_json_object("props", "$.k").cast("bigint") % 5).alias("b"), F.col("event_type").alias("relation"))
    return quality.relation_conflicts(rows, {"click": ["err"], "view": ["sign", "click"]})


@query("""WITH f AS (SELECT user_id, substr(arg_min(event_type, event_id), 1, 4) AS denied FROM events GROUP BY user_id)
SELECT DISTINCT e.user_id AS entity, event_type AS action, denied, 0.85 AS severity FROM events e JOIN f USING (user_id) WHERE contains(event_type, denied)""")
def m_denied_acts(spark, sf):
    rows = src.table(spark, sf, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("action"), "event_id")
    denials = rows.groupBy("entity").agg(F.substring(F.min_by("action", "event_id"), 1, 4).alias("denied"))
    return quality.denied_acts(rows, denials)


@query("""WITH t AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey % 7 IN (0, 6) AS p, o_orderkey % 7 IN (1, 6) AS f FROM orders)
SELECT * FROM (SELECT x.id, x.date, count(*) AS n_against, 0.6 AS severity FROM t x JOIN t y ON x.date = y.date AND x.id <> y.id AND ((x.p AND y.f) OR (x.f AND y.p)) GROUP BY x.id, x.date)""")
def m_tense_conflicts(spark, sf):
    n = F.col("o_orderkey") % 7
    cue = F.when(n == 0, "昨天").when(n == 1, "明天").when(n == 6, "以前和以后").otherwise("")
    text = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("："), cue)
    return quality.tense_conflicts(src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")))


_MARKS = " UNION ALL ".join(
    [f"SELECT doc_id AS id, '{kind}' AS type, unnest(regexp_extract_all(text, '{pattern}', 0, 'i')) AS t FROM documents" for pattern, kind in T.TIME_MARKS]
    + [f"SELECT doc_id, 'KEYWORD', substr(text, greatest(i - 10, 1), i + length(w) + 20 - greatest(i - 10, 1)) FROM (SELECT doc_id, text, w, strpos(lower(text), w) AS i FROM documents, (SELECT unnest({list(T.TIME_WORDS)}) AS w)) WHERE i > 0"]
)


@query(f"SELECT id, type, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM (SELECT DISTINCT * FROM ({_MARKS})) GROUP BY id, type")
def h_time_marks(spark, sf):
    rows = src.memories(spark, sf).select("id", F.explode(T.time_marks(F.col("content"))).alias("m"))
    return rows.groupBy("id", "m.type").agg(F.count("*").alias("n"), F.sum(F.length("m.text")).alias("chars"))


@query("""WITH d AS (SELECT doc_id AS id, text, length(text) AS l, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{2,}'))) AS n, doc_id % 10 / 10 AS c FROM documents)
SELECT id, round(least(1.0, (l > 500)::INT * 0.15 + (l > 1000)::INT * 0.15 + (n / greatest(l / 100, 1) > 0.5)::INT * 0.2 + (n > 3)::INT * 0.15 + (n > 5)::INT * 0.1 + regexp_matches(text, '\\d{4}-\\d{2}-\\d{2}')::INT * 0.15
+ (n > 0 AND c < 0.6)::INT * 0.2 + (len(string_split_regex(text, '[.!?。！？]')) > 5)::INT * 0.1), 6) AS score FROM d""")
def h_complexity(spark, sf):
    text = F.col("content")
    score = T.complexity(text, F.size(T.entities(text)), F.col("importance"), text.rlike(r"\d{4}-\d{2}-\d{2}"))
    return src.memories(spark, sf).select("id", score.alias("score"))


def _pieces(split: str) -> str:
    return f"list_filter(list_transform({split}, lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"


@query(f"""WITH d AS (SELECT doc_id AS id, text, regexp_replace(text, '\\. ', chr(10) || 'user : ', 'g') AS said FROM documents), s AS (SELECT id, 'article' AS kind, {_pieces("string_split_regex(text, '\\n\\s*\\n')")} AS p FROM d
UNION ALL SELECT id, 'conversation', CASE WHEN len(p) > 0 THEN p ELSE [said] END FROM (SELECT id, said, {_pieces("string_split(regexp_replace(said, '(\\n\\s*(?:User|AI|Assistant|Human|System|Bot)\\s*[:：])', chr(1) || '\\1', 'gi'), chr(1))")} AS p FROM d))
SELECT id, kind, len(p) AS n, CAST(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0) AS BIGINT) AS chars FROM s""")
def h_split_by_kind(spark, sf):
    rows = src.memories(spark, sf)
    said = F.regexp_replace("content", r"\. ", "\nuser : ")
    article = rows.select("id", F.lit("article").alias("kind"), T.paragraphs(F.col("content")).alias("p"))
    both = article.union(rows.select("id", F.lit("conversation"), T.spoken_turns(said)))
    return both.select("id", "kind", F.size("p").cast("bigint").alias("n"), F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("chars"))


@query("""SELECT p_partkey AS id, concat_ws(chr(10) || chr(10), CASE p_partkey % 3 WHEN 0 THEN concat_ws(chr(10) || chr(10), p_name, p_brand) WHEN 1 THEN p_type END, CASE WHEN p_size % 4 > 0 THEN 'size ' || p_size END) AS text FROM part""")
def a_core_settings(spark, sf):
    scenario = F.element_at(F.array(F.lit("roleplay"), F.lit("coding"), F.lit("general")), (F.col("p_partkey") % 3 + 1).cast("int"))
    rules = F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("size "), F.col("p_size").cast("string"))).otherwise("")
    text = T.injected(scenario, {"roleplay": [F.col("p_name"), F.lit(""), F.col("p_brand")], "coding": [F.col("p_type"), F.lit("")]}, rules)
    return src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))


@query("SELECT event_type AS source, count(*) AS calls, count(*) FILTER (value < 50) AS succeeded, round(sum(value), 6) AS total_ms, round(max(value), 6) AS max_ms, CAST(coalesce(sum(event_id % 9) FILTER (value < 50), 0) AS BIGINT) AS results FROM events GROUP BY event_type")
def d_source_statistics(spark, sf):
    calls = src.table(spark, sf, "events").select(F.col("event_type").alias("source"), F.col("value").alias("time_ms"), (F.col("event_id") % 9).alias("n"), (F.col("value") < 50).alias("success"))
    return metrics.source_statistics(calls)


@query(f"""WITH {EDGES}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), k AS (SELECT node FROM n ORDER BY length(node), node LIMIT 200)
SELECT * FROM edges WHERE src IN (SELECT node FROM k) AND dst IN (SELECT node FROM k) ORDER BY src, type, dst LIMIT 500""")
def l_drawable(spark, sf):
    edges = src.edges(spark, sf)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return graph.drawable(nodes, edges, F.length("node"), F.col("node"))


@query("""WITH c AS (SELECT user_id, event_id AS id, event_type AS word, json_extract_string(props, '$.k') AS k FROM events),
q AS (SELECT c_custkey AS user_id, 'Was it CLICK or view, no ' || c_custkey % 10 AS text FROM customer),
s AS (SELECT q.user_id AS query_id, id, round(0.1 + 0.3 * contains(lower(text), word)::INT + 0.4 * contains(lower(text), k)::INT + 0.2 * (len(list_filter(string_split(lower(text), ' '), lambda w: contains(word || ' ' || k, w))) > 0)::INT, 6) AS score FROM c JOIN q USING (user_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def o_relevant_contexts(spark, sf):
    k = F.get_json_object("props", "$.k")
    contexts = src.table(spark, sf, "events").select("user_id", F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", k).alias("content"), F.array("event_type").alias("keywords"), F.array(k).alias("entities"))
    text = F.concat(F.lit("Was it CLICK or view, no "), (F.col("c_custkey") % 10).cast("string"))
    asked = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("user_id"), text.alias("text"))
    return context.relevant(contexts, asked)


@query(f"""WITH q AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT -1, '12 3 . 4'), a AS (SELECT DISTINCT query_id, unnest({PHRASES.format("text", "text")}) AS p FROM q),
h AS (SELECT DISTINCT query_id, id FROM (SELECT doc_id AS id, unnest(list_distinct({PHRASES.format("text", "text")})) AS p FROM documents) JOIN a USING (p)),
s AS (SELECT query_id, doc_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS n FROM q JOIN documents d ON contains(lower(d.text), lower(substr(q.text, 1, 12))) WHERE query_id NOT IN (SELECT query_id FROM h))
SELECT query_id, count(*) AS n, min(id) AS first, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT * FROM h UNION ALL SELECT query_id, id FROM s WHERE n <= 50) GROUP BY query_id""")
def h_phrase_search(spark, sf):
    asked = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    asked = asked.union(spark.createDataFrame([(-1, "12 3 . 4")], asked.schema))
    return search.phrase_search(src.memories(spark, sf), asked).groupBy("query_id").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.sum("id").alias("ids"))


@query(SQL["o_search_fast"].replace("+ 0.1, 6) AS score FROM f", "+ 0.2 * CASE WHEN id % 11 = 0 THEN 0.5 ELSE pow(0.5, greatest(0, 181 - id % 365) / 30.0) END, 6) AS score FROM f"))
def o_search_recent(spark, sf):
    written = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(id % 365 AS INT))")
    rows = src.memories(spark, sf).withColumn("created_at", F.when(F.col("id") % 11 != 0, written))
    asked = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return plan.search(rows, asked, replace(plan.FAST, now="2024-06-30 00:00:00"))
