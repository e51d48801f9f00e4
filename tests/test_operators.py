"""Operators against hand-computed values."""

import collections
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.functions import times as TM
from engramlake.operators import context, dedup, graph, lifecycle, quality, search, set_join, store, temporal
from engramlake.streaming import ingest


def test_rrf(spark):
    rows = [("p1", 1, "doc1", 0.9), ("p1", 1, "doc2", 0.8), ("p1", 1, "doc3", 0.7), ("p2", 1, "doc2", 0.85), ("p2", 1, "doc4", 0.75), ("p2", 1, "doc1", 0.6), ("p3", 1, "doc3", 0.95), ("p3", 1, "doc5", 0.65), ("p3", 1, "doc2", 0.5)]
    found = {r.id: r.score for r in search.reciprocal_rank_fusion(spark.createDataFrame(rows, "source string, query_id int, id string, score double")).collect()}
    assert found["doc2"] == pytest.approx(1 / 62 + 1 / 61 + 1 / 63)
    assert found["doc1"] == pytest.approx(1 / 61 + 1 / 63) == pytest.approx(found["doc3"])
    assert found["doc4"] == pytest.approx(1 / 62)


def test_weighted_fusion_of_equal_scores(spark):
    rows = [("a", 1, "x", 0.5), ("a", 1, "y", 0.5), ("b", 1, "x", 2.0)]
    found = {r.id: r.score for r in search.weighted_fusion(spark.createDataFrame(rows, "source string, query_id int, id string, score double")).collect()}
    assert found["y"] == pytest.approx(1.0) and found["x"] == pytest.approx(2.2)


def test_tokens_of_mixed_text(spark):
    row = spark.createDataFrame([("The cat 我爱北京 x",)], "t string").select(T.tokens(F.col("t")).alias("w")).first()
    assert row.w == ["cat", "我爱北京", "我爱", "爱北", "北京"]


@pytest.mark.parametrize(("text", "value"), [("十二", 12), ("一百二十三", 123), ("一万二千", 12000), ("十二万", 120000), ("42", 42), ("x", None)])
def test_chinese_numbers(text, value):
    assert TM.chinese_number(text) == value


def test_time_phrases():
    now = datetime(2024, 2, 29, 12)
    assert TM.parse_phrase("what happened yesterday", now)[0] == datetime(2024, 2, 28)
    assert TM.parse_phrase("last year", now) == (datetime(2023, 1, 1), datetime(2023, 12, 31, 23, 59, 59, 999999))
    assert TM.parse_phrase("3 days ago", now) == (datetime(2024, 2, 26, 12), now)
    assert TM.parse_phrase("on 2024-01-05", now)[0] == datetime(2024, 1, 5)
    assert TM.parse_phrase("nothing here", now) is None


def test_as_of_with_open_ends(spark):
    rows = [(1, None, None), (2, datetime(2024, 1, 1), None), (3, None, datetime(2024, 1, 1)), (4, datetime(2024, 2, 1), None)]
    facts = spark.createDataFrame(rows, "uuid int, valid_from timestamp_ntz, valid_until timestamp_ntz")
    assert {r.uuid for r in temporal.as_of(facts, "2024-01-01 00:00:00").collect()} == {1, 2, 3}


def test_graph_cycle_loop_and_diamond(spark):
    edges = spark.createDataFrame([("a", "E", "b"), ("b", "E", "c"), ("c", "E", "a"), ("a", "E", "a"), ("a", "E", "d"), ("d", "E", "c"), ("x", "E", "y")], "src string, type string, dst string")
    seen = {r.node: r.depth for r in graph.breadth_first(edges, spark.createDataFrame([("a",)], "start string"), 5).collect()}
    assert seen == {"a": 0, "b": 1, "d": 1, "c": 2}
    roots = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert roots == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_contradictions_first_rule_wins(spark):
    rows = [(1, "s", "p", "o", None, None), (2, "s", "p", "q", None, None), (3, "s", "p", "o", datetime(2024, 1, 1), None), (4, "s", "anti", "o", None, None)]
    facts = spark.createDataFrame(rows, "uuid int, subject string, predicate string, object string, valid_from timestamp_ntz, valid_until timestamp_ntz")
    found = {(r.old_uuid, r.new_uuid): r.kind for r in quality.contradictions(facts, [("p", "anti")]).collect()}
    assert found[1, 2] == "direct" and found[1, 3] == "temporal" and found[1, 4] == "logical"


def test_budget_and_greedy_pack(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 1, 9), (1, 2, 4)], "g int, n int, size int")
    assert [r.n for r in context.within_budget(rows, 10, ["g"], [F.col("n")], F.col("size")).collect()] == [0]
    assert sorted(r.n for r in context.greedy_pack(rows, 10, "g", [F.col("n")], F.col("size")).collect()) == [0, 2]


def test_edit_pairs(spark):
    names = spark.createDataFrame([("Alice",), ("alise",), ("al ice",), ("bob",), ("boc",), ("alicia",)], "name string")
    assert {(r.a, r.b) for r in dedup.edit_pairs(names).collect()} == {("alice", "alise")}


def test_upsert_and_purge(spark):
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {(r.id, r.v) for r in store.upserted(base, new, "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    refs = spark.createDataFrame([("x", [1, 2]), ("y", [2])], "name string, ids array<int>")
    left = store.purged(refs, spark.createDataFrame([(2,)], "id int"), "id", "ids")
    assert [(r.name, r.ids) for r in left.collect()] == [("x", [1])]


def test_streaming_dedupe_and_resume(spark, tmp_path):
    schema = "id bigint, ts timestamp, user string"
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1, 0), "a"), (1, datetime(2024, 1, 1, 1), "a"), (2, datetime(2024, 1, 1, 2), "b")], schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    for _ in range(2):
        stream = ingest.deduplicated(ingest.arriving(spark, str(tmp_path / "in"), schema), "ts", ["id"])
        ingest.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_ivf_recall(spark, sf):
    from engramlake.operators import vector_index

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    model = vector_index.fit(rows, vector_index.n_cells(rows.count()))
    near = vector_index.nearest(vector_index.indexed(rows, model), asked, model, 10, vector_index.n_probes(len(model.clusterCenters())))
    exact = search.nearest(rows, asked, 10)
    assert exact.join(near, ["query_id", "id"]).count() >= 0.9 * exact.count()


def test_expired_facts(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b")], "uuid int, v string")
    found = {r.uuid: r.expired_at for r in temporal.expired(facts, facts.where("uuid = 1"), "2024-01-01 00:00:00").collect()}
    assert found == {1: datetime(2024, 1, 1), 2: None}


def test_chunks_and_source_types(spark):
    docs = spark.createDataFrame([(1, "One two three. Four five six! Seven eight? Nine."), (2, "")], "id bigint, content string")
    rows = context.chunks(docs, 5, 2).orderBy("id", "idx").collect()
    assert [r.content for r in rows if r.id == 1][0] == "One two three." and all(r.total == len([x for x in rows if x.id == r.id]) for r in rows)
    kinds = spark.createDataFrame([("User: hi\nAI: ho",), ("[00:12] start",), ('{"a": 1}',), ("a,b,c\n1,2,3",), ("plain words",)], "t string").select(context.source_type(F.col("t")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["dialogue", "transcript", "json", "csv", "article"]


def _words(t):
    return frozenset(w for w in t.lower().split() if w)


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_leader_clusters_are_those_of_one_pass(spark):
    chance = random.Random(5)
    vocab = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(160):
        base = vocab[(i % 4) * 5 : (i % 4) * 5 + 10]
        own = [w if chance.random() > 0.1 else chance.choice(vocab) for w in base]
        rows.append((i, " ".join(own) if i % 29 else "", "u" if i % 3 else None))
    got = {r.id: r.leader for r in dedup.leader_clusters(spark.createDataFrame(rows, "id bigint, content string, user_id string")).collect()}
    want = {}
    for user in ("u", None):
        leaders = []
        for i, t, u in rows:
            if u != user:
                continue
            own = next((j for j, w in leaders if w == _words(t) or _jaccard(w, _words(t)) >= 0.8), None)
            if own is None:
                leaders.append((i, _words(t)))
                own = i
            want[i] = own
    assert {i: got[i] for i in want if rows[i][2] == "u"} == {i: want[i] for i in want if rows[i][2] == "u"}
    assert {i: got[i] for i in want} == want


def test_signatures_estimate_jaccard_and_find_pairs(spark):
    chance = random.Random(6)
    base = "".join(chance.choice("abcdefghij ") for _ in range(400))
    rows = [(0, base), (1, base[:380] + "zzzzzzzzzz"), (2, "".join(chance.choice("klmnopqrst ") for _ in range(400))), (3, ""), (4, None)]
    table = spark.createDataFrame(rows, "id bigint, content string")
    pairs = {(r.id, r.match): r.jaccard for r in dedup.lsh_pairs(table, table, 0.8).collect() if r.id < r.match}
    pieces = lambda t: {t.strip().lower()[i : i + 3] for i in range(max(len(t.strip()) - 2, 1))}
    exact = {(a, b): _jaccard(pieces(x or ""), pieces(y or "")) for a, x in rows for b, y in rows if a < b}
    assert pairs == {k: v for k, v in exact.items() if v >= 0.8}


def test_components_of_a_graph(spark):
    chance = random.Random(7)
    edges = [(f"n{chance.randrange(60)}", "T", f"n{chance.randrange(60)}") for _ in range(45)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, _, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src string, type string, dst string")).collect()}
    assert got == {n: find(n) for n in root}


def test_vector_mmr(spark):
    rows = [(1, i, s, v) for i, (s, v) in enumerate([(0.9, [1.0, 0.0]), (0.89, [1.0, 0.01]), (0.6, [0.0, 1.0]), (0.5, None)])]
    got = search.mmr_vectors(spark.createDataFrame(rows, "query_id bigint, id bigint, score double, v array<double>"), 3).orderBy("rank").collect()
    assert [r.id for r in got] == [0, 2, 3]


def test_phrase_columns_against_the_parser(spark):
    now = datetime(2024, 3, 31, 15, 30)
    said = ["yesterday", "the day before yesterday", "今天", "tomorrow", "last week", "本周", "last month", "这个月", "last year", "今年", "3 days ago", "past 2 months", "十二万天前", "一百二十三天前", "两周内", "on 2024-02-29", "on 2023-02-29", "nothing", "", "Last 4 weeks, not yesterday"]
    rows = spark.createDataFrame([(i, p, now) for i, p in enumerate(said)] + [(-1, None, now)], "i int, p string, now timestamp_ntz")
    first, last = TM.phrase_range(F.col("p"), F.col("now"))
    found = {r.i: (r.a, r.b) for r in rows.select("i", first.alias("a"), last.alias("b")).collect()}
    assert found.pop(-1) == (None, None)
    assert found == {i: TM.parse_phrase(p, now) or (None, None) for i, p in enumerate(said)}
    numerals = ["十", "一百二十三", "一万二千", "十二万", "零", "42", "x", ""]
    got = spark.createDataFrame([(n,) for n in numerals], "n string").select("n", TM.numeral(F.col("n")).alias("v"))
    assert {r.n: r.v for r in got.collect()} == {n: TM.chinese_number(n) if n else None for n in numerals}


def test_segments_are_anchored_at_their_first_row(spark):
    t = datetime(2024, 1, 1)
    lines = [("a", s) for s in (0, 100, 179, 180, 180, 300, 361, None)] + [(None, 5), (None, 400)]
    rows = spark.createDataFrame([(k, t + timedelta(seconds=s) if s is not None else None, "old") for k, s in lines], "k string, t timestamp_ntz, segment_start string")
    out = context.segments(rows, "k", "t")
    got = sorted((r.k or "", (r.t - t).seconds if r.t else -1, (r.segment_start - t).seconds if r.segment_start else -1) for r in out.collect())
    assert got == [("", 5, 5), ("", 400, 400), ("a", -1, -1), ("a", 0, 0), ("a", 100, 0), ("a", 179, 0), ("a", 180, 180), ("a", 180, 180), ("a", 300, 180), ("a", 361, 361)]
    assert context.segments(rows.limit(0), "k", "t").count() == 0


def test_sentences_and_summaries(spark):
    text = "1 one. 2 two! Alma went home today.  Alma went home today. short. Then it rained a lot. Nobody saw alma again"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (0, "2 two!")], "id int, content string")
    first = sorted((r.id, r.pos, r.sentence) for r in context.first_sentences(rows).collect())
    assert first == [(0, 0, "2 two!"), (1, 0, "1 one."), (1, 2, "Alma went home today."), (1, 4, "short."), (1, 5, "Then it rained a lot."), (1, 6, "Nobody saw alma again")]
    kept = context.extractive_summary(F.col("content"), F.lit("Alma"), first=1, budget=30)
    assert {r.id: r.s for r in rows.select("id", kept.alias("s")).collect()} == {1: ["Alma went home today."], 2: None, 3: [], 0: []}
    wide = context.extractive_summary(F.col("content"), F.lit("Alma"), first=1)
    assert rows.where("id = 1").select(wide.alias("s")).first().s == ["Alma went home today.", "Nobody saw alma again"]


def test_names_that_hold_the_asked_text_anywhere(spark):
    from engramlake.operators import entities

    rows = spark.createDataFrame([(1, "Anna Bell", ["Nan"]), (2, "Bo", None), (3, None, ["xanny"]), (4, "ann", [])], "id bigint, name string, aliases array<string>")
    asked = spark.createDataFrame([("ANN",), ("b",), ("",), (None,), ("zzzzzzzzzzzzzzz",)], "query string")
    assert {(r.query, r.id) for r in entities.containing(rows, asked).collect()} == {("ANN", 1), ("ANN", 3), ("ANN", 4), ("b", 1), ("b", 2)}


def test_tokens_repeat_runs_of_two_and_leave_stopwords(spark):
    from engramlake.functions import text as T

    row = spark.createDataFrame([("It has 北京 and 没有人 a b",)], "t string").select(T.tokens(F.col("t")).alias("w"), T.noun_phrases(F.col("t")).alias("p")).first()
    assert row.w == ["北京", "北京", "没有人", "有人"] and row.p == ["北京", "没有人", "has"]


def test_marks_of_time(spark):
    from engramlake.functions import text as T

    rows = spark.createDataFrame([("1999年5月3日 done",), ("SINCE last spring",), ("",), (None,)], "t string")
    marks = [None if r.m is None else [(x.text, x.type) for x in r.m] for r in rows.select(T.time_marks(F.col("t")).alias("m")).collect()]
    assert marks[0][:3] == [("1999年5月3日", "POINT"), ("1999年5月", "POINT"), ("1999年", "POINT")] and ("1999年5月3日 done", "KEYWORD") in marks[0]
    assert marks[1] == [("SINCE last spring", "START"), ("SINCE last spring", "KEYWORD")] and marks[2] == [] and marks[3] is None


def test_relations_denials_and_tenses_against_brute_force(spark):
    from engramlake.operators import quality

    said = [("a", "b", "好朋友"), ("a", "b", "死敌"), ("a", "b", "死敌"), ("a", "c", "敌人"), ("a", "d", None), ("b", "a", "信任"), ("b", "a", "不信任")]
    found = quality.relation_conflicts(spark.createDataFrame(said, "a string, b string, relation string"))
    assert {(r.a, r.b, r.x, r.y) for r in found.collect()} == {("a", "b", "好朋友", "死敌"), ("b", "a", "不信任", "信任")}
    acts = spark.createDataFrame([("x", "sing aloud"), ("x", "sing aloud"), ("x", "s"), ("y", "sing")], "entity string, action string")
    never = spark.createDataFrame([("x", "sing"), ("x", None), ("z", "sing")], "entity string, denied string")
    assert [tuple(r)[:3] for r in quality.denied_acts(acts, never).collect()] == [("x", "sing aloud", "sing")]
    texts = [(1, "昨天 2020/1/2 和 2020-1-2"), (2, "明天 2020年1月2日"), (3, "以前以后 2020/1/2"), (4, "2020/1/2"), (5, "昨天 2021/1"), (6, None), (7, "昨天 2020/1/2")]
    rows = quality.tense_conflicts(spark.createDataFrame(texts, "id bigint, text string"))
    assert {(r.id, r.date, r.n_against) for r in rows.collect()} == {(1, "2020-1-2", 2), (2, "2020-1-2", 3), (3, "2020-1-2", 3), (7, "2020-1-2", 2)}


def test_splits_settings_and_recency(spark):
    from engramlake.functions import text as T

    rows = spark.createDataFrame([("a\n \n\tb\n",), ("User: hi\n  AI： yes\nno",), ("  ",), (None,)], "t string")
    got = [tuple(r) for r in rows.select(T.paragraphs(F.col("t")), T.spoken_turns(F.col("t"))).collect()]
    assert got[0] == (["a", "b"], ["a\n \n\tb"]) and got[1][1] == ["User: hi", "AI： yes\nno"] and got[2] == ([], ["  "])
    assert got[3][0] is None


def test_percentiles_against_sorted_lists(spark):
    from engramlake.operators import metrics

    draw = random.Random(3)
    rows = [(g, None if draw.random() < 0.1 else float(draw.randrange(40))) for g, n in (("a", 300), ("b", 30), (None, 50), ("c", 1)) for _ in range(n)] + [("d", None)]
    got = {r.g: (r.n, r.low, r.high, r.p50, r.p95, r.p99) for r in metrics.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    for g in {r[0] for r in rows}:
        all_, v = [r for r in rows if r[0] == g], sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
        n, high = len(all_), v[-1] if v else None
        at = lambda q: v[int(n * q)] if int(n * q) < len(v) else None
        assert got[g] == (n, v[0] if v else None, high, at(0.5), at(0.95) if n >= 20 else high, at(0.99) if n >= 100 else high)
    assert metrics.percentiles(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def _vector_rows():
    chance = random.Random(11)
    rows = [(i, [chance.gauss(0, 1) for _ in range(6)]) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(40)]  # equal scores go to the smaller id
    return rows + [(800, None), (801, [0.0] * 6), (802, [1.0, 2.0]), (803, [None] + [1.0] * 5)]


def _best(rows, asked, k, measure):
    """Brute force: unlike lengths and zero vectors have cosine 0, nulls come last."""
    out = {}
    for q, v in asked:
        found = []
        for i, w in rows:
            if w is None or (None in w and len(w) == len(v)) or (measure == "dot" and len(w) != len(v)):
                found.append((float("inf"), i, None))
                continue
            s = sum(x * y for x, y in zip(v, w, strict=False) if y is not None) if len(v) == len(w) else 0.0
            if measure == "cosine":
                scale = sum(x * x for x in v) ** 0.5 * sum(x * x for x in w if x is not None) ** 0.5
                s = s / scale if scale and len(v) == len(w) else 0.0
            found.append((-round(s, 6), i, round(s, 6)))
        out[q] = [(i, s) for _, i, s in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("measure", ["cosine", "dot"])
def test_nearest_by_blocks_is_brute_force(spark, measure):
    rows = _vector_rows()
    table = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(3)
    asked = [(q, rows[q][1]) for q in (0, 3, 50)]
    found = search.nearest(table, spark.createDataFrame(asked, "query_id bigint, q array<double>"), 60, measure)
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan  # pairs never are rows of Spark
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = _best(rows, asked, 60, measure)
    assert got == {q: [(i, pytest.approx(s) if s is not None else None) for i, s in x] for q, x in want.items()}
    every = search.nearest(table, spark.createDataFrame(asked, "query_id bigint, q array<double>"), len(rows), measure).orderBy("query_id", "rank").collect()
    assert [(r.id, r.score is None) for r in every if r.query_id == 3] == [(i, s is None) for i, s in _best(rows, asked, len(rows), measure)[3]]


def test_fine_ranks_of_all_pairs_without_a_join(spark):
    rows = spark.createDataFrame([(i, v, i % 7 / 7) for i, v in _vector_rows()], "id bigint, v array<double>, score double")
    asked = rows.where("id IN (0, 3, 50)").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    found = search.fine_ranked(rows, asked)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {(r.query_id, r.id): r.score for r in found.collect()}
    want = {(r.query_id, r.id): r.score for r in search.fine_rank(rows.crossJoin(asked)).collect()}
    assert got == {k: pytest.approx(s, abs=1e-6) if s is not None else None for k, s in want.items()}


def test_probed_cells_hold_exact_scores(spark):
    from engramlake.operators import vector_index

    rows = spark.createDataFrame(_vector_rows()[:740], "id bigint, v array<double>")
    asked = rows.where("id IN (0, 3, 50)").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    model = vector_index.fit(rows, 9)
    index = vector_index.indexed(rows, model)
    found = vector_index.nearest(index, asked, model, 5, 3)
    assert "SortMergeJoin" not in (text := found._jdf.queryExecution().toString()) and "HashJoin" not in text  # a query doesn't travel once for each cell
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, pytest.approx(r.score, abs=1e-6)))
    cells = {r.id: r.cell for r in index.collect()}
    vectors = dict(_vector_rows()[:740])
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    for q, mine in got.items():
        probed = {i for i, _ in _best(centres, [(q, vectors[q])], 3, "cosine")[q]}
        assert mine == _best([(i, v) for i, v in vectors.items() if cells[i] in probed], [(q, vectors[q])], 5, "cosine")[q]


def test_best_by_fields_scores_one_row_of_equal_ones(spark):
    chance = random.Random(12)
    vocab = ["red", "blue", "ring", "bolt", "plate", "gear"]
    rows = [(i, " ".join(chance.choice(vocab) for _ in range(3)) if i % 41 else None, chance.choice(["large", "small", ""])) for i in range(900)]
    table = spark.createDataFrame(rows, "id bigint, name string, kind string")
    asked = spark.createDataFrame([(i, n or "", k) for i, n, k in rows[::9]], "query_id bigint, name string, kind string").select("query_id", F.concat_ws(" ", "name", "kind").alias("text"))
    fields = {"name": 2, "kind": 1}
    found = search.best_by_fields(table, asked, fields, 10)
    want = search.ranked(search.field_weighted(table, asked, fields), 10)
    key = lambda rows: {(r.query_id, r["rank"]): (r.id, r.score) for r in rows.collect()}
    assert key(found) == key(want)


def test_shared_topics_compare_classes_only(spark):
    chance = random.Random(13)
    links = {(i, t) for i in range(90) for t in ([i % 4, 100 + i % 8] if i % 5 else [chance.randrange(6) for _ in range(3)])}
    table = spark.createDataFrame([*links, (1000, None)], "id bigint, topic bigint")
    found = dedup.shared_topics(table, 2, block=4)
    got = sorted((r.a, r.b, r.shared, r.confidence) for r in found.collect())
    own = {i: {t for j, t in links if j == i} for i, _ in links}
    want = sorted((a, b, n, pytest.approx(min(0.5 + 0.1 * n, 0.9))) for a in own for b in own if a < b and (n := len(own[a] & own[b])) >= 2)
    assert got == want
    # pairs are made at the end, so none of them is grouped or dealt
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(ids_b") < plan.index("Aggregate")


def test_shared_topics_explode_blocks_apart(spark):
    import re

    table = spark.createDataFrame([(i, t) for i in range(40) for t in (i % 2, 100 + i % 4)], "id bigint, topic bigint")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = dedup.shared_topics(table, 2, block=4)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 4 * 45 == found.distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # stages of generated code hold all that they make of a row: a memory's pairs with a block, not those of two blocks
    stages = re.findall(r"(\*\(\d+\) )?Generate explode\(\S*ids_[ab]", plan)
    assert len(stages) == 2 and stages[0] != stages[1]


def test_node_codes_have_the_order_of_names(spark):
    from engramlake.sources import tables as src

    keys = [0, 1, 2, 10, 12, 19, 100, 999, 10**15, 10**16 - 1, -1, -10, 7, 70]
    table = spark.createDataFrame([(k,) for k in keys], "k bigint")
    rows = [r for kind in "cops" for r in table.select(F.concat(F.lit(kind + ":"), F.col("k").cast("string")).alias("name"), src.node_code(kind, "k").alias("code")).collect()]
    assert [r.name for r in sorted(rows, key=lambda r: r.code)] == sorted(r.name for r in rows)
    back = spark.createDataFrame(rows, "name string, code bigint").select("name", src.node_name("code").alias("again")).collect()
    assert all(r.name == r.again for r in back)


def test_coded_graphs_give_what_names_give_and_leave_no_rounds_behind(spark, sf):
    import os

    from engramlake.plans import catalog
    from engramlake.sources import tables as src

    names = lambda rows, *columns: sorted(tuple(r[c] for c in columns) for r in rows.collect())
    edges = src.edges(spark, sf)
    assert names(catalog.QUERIES["l_components"](spark, sf), "node", "component") == names(graph.connected_components(edges), "node", "component")
    left = set(os.listdir(folder := graph._folder(spark).removeprefix("file:") + "/tables"))
    labels = catalog.QUERIES["l_label_propagation"](spark, sf)
    assert len(set(os.listdir(folder)) - left) == 1  # before, each round left its table
    want = {n: n for e in edges.where("type = 'SUPPLIED_BY'").collect() for n in (e.src, e.dst)}
    around = {n: set() for n in want}
    for e in edges.where("type = 'SUPPLIED_BY'").collect():
        around[e.src].add(e.dst)
        around[e.dst].add(e.src)
    for _ in range(3):
        votes = {n: [want[m] for m in near] for n, near in around.items()}
        want = {n: min(set(v), key=lambda x: (-v.count(x), x)) for n, v in votes.items()}
    assert names(labels, "node", "label") == sorted(want.items())
    loose = spark.createDataFrame([(5, 5), (7, 3), (3, 2), (None, 9)], "src bigint, dst bigint")
    assert names(graph.connected_components(loose), "node", "component") == [(2, 2), (3, 2), (5, 5), (7, 2), (9, 9)]


def test_store_scores_read_a_text_once_for_all_queries(spark):
    rows = [(1, "The Quickness of foxes, brown-red"), (2, "QUICK brown"), (3, None), (4, ""), (5, "qu ick fox 狐狸"), (6, "x" * 70 + "fox")]
    asked = [(1, "quick brown fox"), (2, "The fox"), (3, "a of"), (4, None), (5, "Fox 狐狸")]
    found = search.store_score(spark.createDataFrame(rows, "id bigint, content string"), spark.createDataFrame(asked, "query_id bigint, text string"))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # before, every text met every query
    want = {}
    for q, t in asked:
        kws = [w for w in dict.fromkeys((t or "").lower().split()) if w.isascii() and len(w) > 2 and w not in T.STOPWORDS][:4]
        for i, c in rows if kws else []:
            if c is not None and (s := (t[:12].lower() in c.lower()) + 0.8 * sum(w in c.lower() for w in kws) / len(kws)):
                want[q, i] = pytest.approx(s)
    assert {(r.query_id, r.id): r.score for r in found.collect()} == want


def _pairs_by_brute_force(sets, least):
    own = {i: set(s) for i, s in sets if s}
    found = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a in own for b in own if a < b}
    return {k: v for k, v in found.items() if v >= least}


def test_set_pairs_against_brute_force(spark):
    chance = random.Random(11)
    sets = [(-1, []), (-2, None)]
    for i in range(300):
        own = chance.sample(range(400), chance.choice([1, 2, 5, 9, 20, 70, 150, 300]))
        if i and chance.random() < 0.5:
            own = list(chance.choice(sets)[1] or own)
            for _ in range(chance.randrange(1, max(2, len(own) // 5))):
                own[chance.randrange(len(own))] = chance.randrange(400)
        sets.append((i, list(dict.fromkeys(own))))
    table = spark.createDataFrame([(i, s and [f"w{x}" for x in s]) for i, s in sets], "id bigint, s array<string>")
    for least in (0.1, 0.75, 1.0):
        assert {(r.a, r.b): r.jaccard for r in dedup.set_pairs(table, least).collect()} == _pairs_by_brute_force(sets, least)


def test_lsh_pairs_of_one_bucket_leave_the_sets_behind(spark):
    # texts that share bands without being similar enough, and copies: what travels doesn't grow with the pairs of a bucket
    chance = random.Random(12)
    base = [chance.choice("abcdefghij ") for _ in range(600)]
    rows = []
    for i in range(120):
        own = list(base)
        for at in chance.sample(range(600), 40):
            own[at] = chance.choice("abcdefghij")
        rows.append((i, "".join(own)))
    rows += [(200, rows[0][1]), (201, ""), (202, None), (203, "é𝄞"), (204, "é𝄞")]
    table = spark.createDataFrame(rows, "id bigint, content string")
    pieces = lambda t: {t.strip().lower()[i : i + 3] for i in range(max(len(t.strip()) - 2, 1))}
    exact = _pairs_by_brute_force([(i, pieces(t or "")) for i, t in rows], 0.85)
    found = {(r.id, r.match): r.jaccard for r in dedup.lsh_pairs(table, table, 0.85).collect() if r.id < r.match}
    assert found == {k: exact[k] for k in found} and {(0, 200), (201, 202), (203, 204)} <= set(found) and len(found) >= 0.95 * len(exact)
    plan = dedup.lsh_pairs(table, table, 0.85)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "array_intersect" not in plan


def test_three_stages_with_vectors_aside(spark):
    rows = [(2, "Same text!", None), (1, "same  text", None), (3, "SAME TEXT", None), (4, "another thing", [1.0, 0.0]), (5, "far away words", [1.0, 0.05]), (6, None, None), (7, "elsewhere", [-1.0, 0.0]), (8, "x y z", [0.0, 1.0])]
    table = spark.createDataFrame(rows, "id bigint, content string, v array<double>")
    new, known = table.where("id % 2 = 0"), table.where("id % 2 = 1")
    for got in (dedup.three_stages(new, known), dedup.three_stages(new.drop("v"), known.drop("v"), vectors=(new.select("id", "v"), known.select("id", "v")))):
        assert {r.id: (r.match, r.stage) for r in got.collect()} == {2: (1, "exact"), 4: (5, "cosine"), 6: (None, "new"), 8: (5, "new")}


def test_event_pairs_count_common_names_without_joining_texts(spark):
    words = "Anna Bell Carl met near the old harbour and spoke about nothing in particular that day".split()
    rows = [(1, " ".join(words)), (2, " ".join(words[:-1] + ["night"])), (3, " ".join(reversed(words))), (4, " ".join(["anna", *words[1:-1], "night"])), (5, ""), (6, None)]
    pairs = dedup.event_pairs(spark.createDataFrame(rows, "id bigint, content string"))
    # 3 holds the words of 1 and 4 those of 2, in other cases or orders
    assert {(r.a, r.b, round(r.similarity, 6), r.shared) for r in pairs.collect()} == {(1, 2, round(15 / 17, 6), 3)}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "array_union" not in plan


def test_word_pairs_stay_within_a_user(spark):
    rows = [(1, "a b c d e", "u"), (2, "a b c d e f", "u"), (3, "a b c d e", "w"), (4, "a b c d e f", None), (5, "E d c b a", None)]
    table = spark.createDataFrame(rows, "id bigint, content string, user_id string")
    pairs = dedup.word_pairs(table, dedup.word_classes(table, "user_id"), 0.8, "user_id")
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (4, 5)}


def test_sets_travel_as_gaps_of_ranks_and_only_with_keys_that_meet(spark, monkeypatch):
    chance = np.random.default_rng(13)
    hashes = np.unique(chance.integers(0, 2**64, 30_000, np.uint64))
    rank = chance.permutation(len(hashes) - 1000)
    sets = [chance.choice(hashes, n, replace=False) for n in (1, 700, 9000, 9000, 25_000)] + [hashes[-500:]]
    size, flat = np.array([len(s) for s in sets]), np.concatenate(sets)
    parts = set_join._gaps(size, flat, hashes[:-1000], rank)
    # before, a member took 8 bytes
    assert sum(v.nbytes for _, v in parts) < 2 * len(flat)
    opened = set_join._Opened(*[np.split(v, np.cumsum(n)[:-1]) for n, v in parts])
    a, b = np.triu_indices(6, 1)
    assert opened.size.tolist() == size.tolist() and opened.shared(a, b).tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    # of known sets only those with a band of a new one are dealt
    rows = pa.RecordBatch.from_pydict({"id": [1, 2], "side": pa.array([2, 2], pa.int8()), "h": [s.view(np.int64).tolist() for s in sets[1:3]]})
    known = SimpleNamespace(value=np.unique(dedup.bands(size[2:3], sets[2])[1]))
    came = set_join._Sets(set_join._dealt(4, dedup.bands, known)([rows]))
    assert set(came.ident.tolist()) == {2}
    # blocks in several passes give the same pairs
    words = [(i, [f"w{x}" for x in range(i % 7, 60 + i % 11)]) for i in range(60)]
    table = spark.createDataFrame(words, "id bigint, s array<string>")
    monkeypatch.setattr(set_join, "DISK", 1)
    assert {(r.a, r.b): r.jaccard for r in dedup.set_pairs(table, 0.9).collect()} == _pairs_by_brute_force(words, 0.9)


def test_sets_are_dealt_in_passes_over_the_keys(spark, monkeypatch):
    chance = random.Random(14)
    base = [f"w{x}" for x in range(90)]
    words = [(i, [*chance.sample(base, 80), f"own{i}"]) for i in range(150)]
    sets = [np.unique(np.array([hash((13, w)) & (2**63 - 1) for w in s], np.uint64)) for _, s in words]
    rows = pa.RecordBatch.from_pydict({"id": list(range(150)), "side": pa.array([0] * 150, pa.int8()), "h": [s.view(np.int64).tolist() for s in sets]})
    keys = set_join._rarest(0.75, SimpleNamespace(value=(np.empty(0, np.uint64), np.empty(0, np.uint64))))
    whole, *passes = (sum(x.nbytes for x in set_join._dealt(16, keys, None, only)([rows])) for only in ((1, 0), *((4, k) for k in range(4))))
    # before, all sets went to all tasks of their keys at once
    assert max(passes) < 0.5 * whole and sum(passes) < 1.5 * whole
    # twice the sets have at most about twice the bytes on the disk at once: more parts come with more passes
    for n in (240_000, 480_000, 2_880_000):
        parts, many = set_join._planned({9: (n, 330 * n)}, 0.75, 200)
        assert n * (77 * parts * (1 - (1 - 1 / parts) ** 83) + 12 * 83) / many < 16 * 330 * n
    monkeypatch.setattr(set_join, "SHARE", 0)
    monkeypatch.setattr(set_join, "DISK", 20_000)
    classes = {7: (150, 150 * 81)}
    assert set_join._planned(classes, 0.75, 4)[1] > 1
    table = spark.createDataFrame(words, "id bigint, s array<string>")
    assert {(r.a, r.b): r.jaccard for r in dedup.set_pairs(table, 0.75).collect()} == _pairs_by_brute_force(words, 0.75)


def test_event_chains_follow_links_of_several_passes(spark, monkeypatch):
    chance = random.Random(15)
    rows = [(i, " ".join([f"Abcd Efgh Ijkl w{i // 40}", *(f"v{x}" for x in range(i // 2, i // 2 + 30) if chance.random() < 0.99)])) for i in range(80)]
    rows += [(80, rows[7][1]), (81, ""), (82, None)]
    own = {i: w for w, i in {_words(t): i for i, t in reversed(rows[:-3])}.items()}  # one row of each set
    steps = {i: {j for j in own if i < j and _jaccard(own[i], own[j]) >= 0.75} for i in own}
    want = {(str(i), str(i)): 0 for i in (0, 50, 80)}
    for s in (0, 50):
        front = {s}
        for d in range(1, 6):
            front = {j for i in front for j in steps[i] if (str(s), str(j)) not in want}
            want |= {(str(s), str(j)): d for j in front}
    monkeypatch.setattr(set_join, "SHARE", 0)
    monkeypatch.setattr(set_join, "DISK", 8000)
    links = dedup.event_links(dedup.event_pairs(spark.createDataFrame(rows, "id bigint, content string")))
    starts = spark.createDataFrame([("0",), ("50",), ("80",)], "start string")
    assert len(want) > 20 and {(r.start, r.node): r.depth for r in lifecycle.event_chain(links, starts, 5).collect()} == want


def test_leader_clusters_by_several_passes(spark, monkeypatch):
    chance = random.Random(16)
    rows = [(i, " ".join(f"w{x}" for x in chance.sample(range(i % 4 * 30, i % 4 * 30 + 23), 21)), f"u{i % 3}") for i in range(90)]
    table = spark.createDataFrame(rows, "id bigint, content string, user_id string")
    monkeypatch.setattr(set_join, "SHARE", 0)
    monkeypatch.setattr(set_join, "DISK", 4000)
    got, want, leaders = {r.id: r.leader for r in dedup.leader_clusters(table).collect()}, {}, []
    for i, t, u in rows:
        want[i] = next((j for j, w, v in leaders if v == u and _jaccard(w, _words(t)) >= 0.8), i)
        leaders += [(i, _words(t), u)] if want[i] == i else []
    assert got == want and 12 <= len(set(want.values())) < 90


def test_each_task_gets_one_part_of_the_keys(spark):
    labels = set_join._labels(spark, 37)
    rows = spark.createDataFrame([(int(x),) for x in labels], "part int").repartition(37, "part")
    # before, parts were dealt by the hash of their number, and some tasks got several
    assert {r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()} == {1} and len(set(labels.tolist())) == 37


def test_sets_go_to_the_tasks_of_their_scope_only(spark, monkeypatch):
    chance = random.Random(22)
    # one large user, some small ones, and one of null; similar sets within users and across
    users = ["u0"] * 60 + [f"u{1 + i % 9}" for i in range(54)] + [None] * 6
    rows = [(i, " ".join(f"w{x}" for x in chance.sample(range(i % 5 * 30, i % 5 * 30 + 23), 21)), u) for i, u in enumerate(users)]
    h = np.random.default_rng(23).integers(0, 1 << 63, (120, 30), dtype=np.int64)
    u = np.array([hash(str(x)) for x in users], np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array(np.zeros(120, np.int8)), pa.array(u), pa.array(list(h), pa.list_(pa.int64()))], ["id", "side", "u", "h"])
    counted = pa.Table.from_batches(list(set_join._counts([batch]))).to_pylist()
    classes, scopes = ({r[k]: (r["c"], r["m"]) for r in counted if own(r)} for k, own in (("kind", lambda r: r["t"] is None), ("t", lambda r: r["kind"] == -1)))
    assert sorted(scopes.values()) == sorted((n, 30 * n) for n in collections.Counter(users).values())
    keys = set_join._rarest(0.2, SimpleNamespace(value=(np.empty(0, np.uint64), np.empty(0, np.uint64))))
    # one scope without a range of its own
    scopes.pop(int(u[-1]))
    places = set_join._places(scopes, classes, 0.2)
    before, after = (set_join._dealt(40, keys, places=p) for p in (None, places))
    copies = [sum(set_join._Sets([b.slice(i, 1)]).n for b in f([batch]) for i in range(b.num_rows)) for f in (before, after)]
    # before, a set of 25 keys went to 19 of 40 tasks; a small user's has a range of 2
    assert copies[1] < copies[0] / 1.5 and set_join._planned(classes, 0.2, 40, places[2])[0] <= set_join._planned(classes, 0.2, 40)[0]
    met = [set_join._Sets([b]) for b in pa.Table.from_batches(list(after([batch]))).to_batches()]
    assert sum(len(s.key) for s in met) == sum(len(s.key) for s in [set_join._Sets([b]) for b in before([batch])])
    monkeypatch.setattr(set_join, "TASK", 300)
    monkeypatch.setattr(set_join, "SCOPES", 4)
    got, want, leaders = {r.id: r.leader for r in dedup.leader_clusters(spark.createDataFrame(rows, "id bigint, content string, user_id string")).collect()}, {}, []
    for i, t, u in rows:
        want[i] = next((j for j, w, v in leaders if v == u and _jaccard(w, _words(t)) >= 0.8), i)
        leaders += [(i, _words(t), u)] if want[i] == i else []
    assert got == want and 12 <= len(set(want.values())) < 120
