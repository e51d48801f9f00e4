"""Further operators: transcripts, sentences, summaries, core facts, re-ranking, fields, phrases of time, scopes and totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.functions import times as TM
from engramlake.operators import context, search, store
from engramlake.plans.catalog import ASKED, BM25, EDGES, FACTS, POSTINGS, STOP, TOKENS, query
from engramlake.sources import tables as src

_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?\\n])\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_CUT = f"cut AS (SELECT doc_id AS id, unnest(s) AS x, generate_subscripts(s, 1) AS p FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents))"


def _bm25(name: str, docs: str, asked: str) -> str:
    """Common table expressions that end in ``name`` (query_id, id, score) for documents (id, text) and queries (query_id, text)."""
    words = TOKENS.format("text")
    return f"""{name}t AS (SELECT id, {words} AS words FROM ({docs})), {name}s AS (SELECT count(*) AS n, avg(len(words)) AS l FROM {name}t),
{name}p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(words) AS len, unnest(words) AS term FROM {name}t) GROUP BY ALL),
{name}d AS (SELECT term, count(*) AS df FROM {name}p GROUP BY term),
{name}q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_slice({words}, 1, 8)) AS term FROM ({asked})) GROUP BY ALL),
{name} AS (SELECT query_id, id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / l))) AS score
  FROM {name}p JOIN {name}q USING (term) JOIN {name}d USING (term), {name}s GROUP BY query_id, id)"""


@query("""WITH RECURSIVE s AS (SELECT user_id, min(ts) AS start FROM events GROUP BY user_id UNION ALL
SELECT s.user_id, min(e.ts) FROM s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.start + INTERVAL 21600 SECOND GROUP BY s.user_id)
SELECT user_id, start AS segment_start, count(*) AS n FROM (SELECT e.user_id, e.event_id, max(s.start) AS start FROM events e JOIN s ON e.user_id = s.user_id AND s.start <= e.ts GROUP BY ALL) GROUP BY user_id, start""")
def e_transcript_segments(spark, sf):
    rows = context.segments(src.table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", "ts", 21600, "event_id")
    return rows.groupBy("user_id", "segment_start").agg(F.count("*").alias("n"))


@query(f"WITH {_CUT}, f AS (SELECT x, min((id, p)) AS f FROM cut GROUP BY x) SELECT id, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM (SELECT struct_extract_at(f, 1) AS id, x FROM f) GROUP BY id")
def e_first_sentences(spark, sf):
    return context.first_sentences(src.memories(spark, sf)).groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query(f"""WITH {_CUT}, d AS (SELECT id, x, min(p) AS p FROM cut WHERE length(x) >= 10 GROUP BY id, x), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p) AS n FROM d),
k AS (SELECT r.*, sum(length(x)) OVER (PARTITION BY id ORDER BY p) AS used FROM r JOIN (SELECT doc_id AS id, lower(regexp_extract(text, '[A-Z][a-z]{{2,}}')) AS name FROM documents) USING (id) WHERE n <= 5 OR (name <> '' AND contains(lower(x), name)))
SELECT id, count(*) AS n, md5(string_agg(x, ' ' ORDER BY p)) AS summary FROM k WHERE used <= 12000 GROUP BY id""")
def h_extractive_summary(spark, sf):
    kept = context.extractive_summary(F.col("content"), F.regexp_extract("content", "[A-Z][a-z]{2,}", 0))
    rows = src.memories(spark, sf).select("id", kept.alias("s")).where("size(s) > 0")
    return rows.select("id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", " ").cast("binary")).alias("summary"))


@query("""WITH e AS (SELECT user_id, event_type AS name, json_extract_string(props, '$.k') AS state, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events),
l AS (SELECT user_id, name, max(c) AS c, name || ': ' || string_agg(state, ', ' ORDER BY n) AS line FROM e WHERE n <= 3 GROUP BY user_id, name),
u AS (SELECT user_id, name, line, CAST(sum(length(line)) OVER (PARTITION BY user_id ORDER BY c DESC, name) AS BIGINT) AS used FROM l) SELECT * FROM u WHERE used <= 60""")
def e_core_facts(spark, sf):
    rows = src.table(spark, sf, "events").select("user_id", F.col("event_type").alias("name"), F.get_json_object("props", "$.k").alias("state"), "ts", "event_id")
    counts = rows.groupBy("user_id", "name").agg(F.count("*").alias("confidence"))
    newest = F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), (-F.col("event_id")).alias("i"))
    return context.core_lines(rows.join(counts, ["user_id", "name"]), "user_id", "name", "state", "confidence", newest, 60)


@query("SELECT user_id, id, rank, mentions FROM (SELECT source AS user_id, doc_id AS id, contains(lower(text), 'license') AS mentions, row_number() OVER (PARTITION BY source ORDER BY contains(lower(text), 'license') DESC, doc_id) AS rank FROM documents) WHERE rank <= 10")
def e_mentioning_first(spark, sf):
    rows = context.mentioning_first(src.memories(spark, sf), "user_id", "content", "License", F.col("id"), 10)
    return rows.select("user_id", "id", F.col("rank").cast("bigint").alias("rank"), "mentions")


@query(f"""WITH {POSTINGS}, {ASKED}, {BM25}, k AS (SELECT item_id AS query_id, lower(text) AS q, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,50}}'), lambda w: w NOT IN {STOP})) AS kws FROM benchmark),
s AS (SELECT query_id, id, round(score + 0.05 * len(list_filter(kws, lambda w: contains(lower(text), w))) + CASE WHEN contains(lower(text), q) THEN 0.2 ELSE 0 END, 6) AS score FROM bm25r JOIN k USING (query_id) JOIN documents ON doc_id = id WHERE rank <= 20)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def h_rerank(spark, sf):
    rows, asked = src.memories(spark, sf), src.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    first = search.ranked(search.bm25(rows, asked), 20).drop("rank")
    return search.reranked(first.join(rows.select("id", "content"), "id").join(asked, "query_id"), 10, 1 << 20)


_PARTS = "SELECT p_partkey AS query_id, p_name || ' ' || p_type AS text FROM part WHERE p_partkey % 50 = 0"


def _parts(spark, sf):
    return src.table(spark, sf, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))


@query(f"""WITH {_bm25("nm", "SELECT p_partkey AS id, p_name AS text FROM part", _PARTS)}, {_bm25("ty", "SELECT p_partkey AS id, p_type AS text FROM part", _PARTS)},
s AS (SELECT query_id, id, round(sum(score), 6) AS score FROM (SELECT query_id, id, 2 * score AS score FROM nm UNION ALL SELECT * FROM ty) GROUP BY query_id, id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def h_field_weights(spark, sf):
    rows = src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_type")
    return search.best_by_fields(rows, _parts(spark, sf), {"p_name": 2, "p_type": 1}, 10)


_GRAPH = "SELECT 'node:p:' || p_partkey AS id, p_name || ' ' || p_type AS text FROM part UNION ALL SELECT 'edge:n:' || n_nationkey || ':r:' || r_regionkey, n_name || ' located in ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"""WITH {_bm25("g", _GRAPH, _PARTS + " UNION ALL SELECT -1 - r_regionkey, r_name FROM region")}, s AS (SELECT query_id, id, round(score, 6) AS score FROM g)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def l_graph_search(spark, sf):
    nation, region = src.table(spark, sf, "nation"), src.table(spark, sf, "region")
    key = lambda c: F.col(c).cast("string")
    nodes = src.table(spark, sf, "part").select(F.concat(F.lit("node:p:"), key("p_partkey")).alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("content"))
    links = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    edges = links.select(F.concat(F.lit("edge:n:"), key("n_nationkey"), F.lit(":r:"), key("r_regionkey")), F.concat("n_name", F.lit(" located in "), "r_name"))
    asked = _parts(spark, sf).union(region.select(-1 - F.col("r_regionkey"), "r_name"))
    return search.best_by_fields(nodes.union(edges), asked, {"content": 1}, 10)


@query("""SELECT o_orderkey AS id, CASE k WHEN 0 THEN d - INTERVAL 1 DAY WHEN 1 THEN o_orderdate - to_days(o_orderkey % 40) WHEN 2 THEN date_trunc('week', d) - INTERVAL 7 DAY WHEN 3 THEN date_trunc('month', d) - INTERVAL 1 MONTH
WHEN 4 THEN o_orderdate - INTERVAL 60 DAY WHEN 5 THEN date_trunc('year', d) - INTERVAL 1 YEAR WHEN 6 THEN o_orderdate - INTERVAL 123 DAY WHEN 7 THEN TIMESTAMP '1996-02-29 00:00:00' END AS first,
CASE k WHEN 0 THEN d - INTERVAL 1 MICROSECOND WHEN 1 THEN o_orderdate WHEN 2 THEN date_trunc('week', d) - INTERVAL 1 MICROSECOND WHEN 3 THEN date_trunc('month', d) - INTERVAL 1 MICROSECOND
WHEN 4 THEN o_orderdate WHEN 5 THEN date_trunc('year', d) - INTERVAL 1 MICROSECOND WHEN 6 THEN o_orderdate WHEN 7 THEN TIMESTAMP '1996-02-29 23:59:59.999999' END AS last
FROM (SELECT *, o_orderkey % 9 AS k, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS d FROM orders)""")
def i_time_phrases(spark, sf):
    said = ["Seen yesterday", None, "of last week", "上个月的事", "in the past 2 months", "去年", "一百二十三天前", "on 1996-02-29", "no time at all"]
    phrase = F.element_at(F.array(*[F.lit(s) if s else F.concat((F.col("o_orderkey") % 40).cast("string"), F.lit(" days ago")) for s in said]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    first, last = TM.phrase_range(phrase, F.col("o_orderdate").cast("timestamp_ntz"))
    return src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), first.alias("first"), last.alias("last"))


@query("SELECT source AS user_id, lang AS category, source || '/' || lang AS path, count(*) AS n FROM documents GROUP BY source, lang")
def a_scopes(spark, sf):
    return store.scopes(src.memories(spark, sf), "user_id", "category")


@query("SELECT DISTINCT l_orderkey AS summary, p_partkey AS id, p_name AS content FROM lineitem JOIN part ON l_partkey = p_partkey")
def n_drill_down(spark, sf):
    made = src.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("summary")).agg(F.collect_set("l_partkey").alias("ids"))
    return store.expanded(made, "ids", src.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content")), "id")


@query(f"""WITH {EDGES}, {FACTS} SELECT 'memories' AS name, count(*) AS value FROM documents UNION ALL SELECT 'users', count(DISTINCT source) FROM documents UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'active facts', count(*) FROM facts WHERE valid_until IS NULL UNION ALL SELECT 'entities', count(DISTINCT e) FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{{2,}}')) AS e FROM documents)""")
def d_engine_stats(spark, sf):
    rows = src.memories(spark, sf)

    def total(name, value):
        return value.select(F.lit(name).alias("name"), F.col("value"))

    found = total("memories", rows.agg(F.count("*").alias("value"))).union(total("users", rows.agg(F.countDistinct("user_id").alias("value"))))
    found = found.union(total("edges", src.edges(spark, sf).agg(F.count("*").alias("value")))).union(total("active facts", src.facts(spark, sf).where("valid_until IS NULL").agg(F.count("*").alias("value"))))
    return found.union(total("entities", rows.select(F.explode(T.entities(F.col("content"))).alias("e")).agg(F.countDistinct("e").alias("value"))))
