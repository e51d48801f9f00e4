"""Duplicates, entity resolution, event links and consolidation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.operators import graph, set_join, vector_index

#: Thresholds of the three stages: share of shingles, cosine, and the cosine from which a match is borderline.
PRESETS = {"default": (0.85, 0.90, 0.80), "class": (0.70, 0.85, 0.70), "strict": (0.8, 0.9, 0.75), "loose": (0.6, 0.8, 0.65)}


def exact_groups(memories: DataFrame) -> DataFrame:
    """Rows (key, n, least) of normalised texts that occur more than once; the key is their md5."""
    key = F.md5(T.normalized_text(F.col("content")).cast("binary"))
    return memories.select("id", key.alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1")


def first_of_each(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row of each key, the first in order."""
    along = Window.partitionBy("_key").orderBy(*order)
    return rows.withColumn("_key", key).withColumn("_n", F.row_number().over(along)).where("_n = 1").drop("_key", "_n")


def import_dedupe(rows: DataFrame) -> DataFrame:
    """The first row (least id) of each external id, or of each content where there is none."""
    return first_of_each(rows, F.coalesce("external_id", F.md5(F.col("content").cast("binary"))), F.col("id"))


def recent_repeats(rows: DataFrame, last: int = 100) -> DataFrame:
    """Rows whose trimmed content equals that of one of the ``last`` rows before them (same user, by id)."""
    along = Window.partitionBy("user_id").orderBy("id")
    numbered = rows.withColumn("seq", F.row_number().over(along)).withColumn("key", F.trim("content"))
    before = Window.partitionBy("user_id", "key").orderBy("seq")
    return numbered.withColumn("previous", F.lag("seq").over(before)).where(F.col("seq") - F.col("previous") <= last).select("id", "user_id")


def set_pairs(sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, jaccard) of rows (id, s) whose sets have a Jaccard of at least ``least``; empty sets pair with none.

    Prefix filter, exact: with members ordered from rare to common, similar sets share one of their first
    n - ceil(least * n) + 1. So only rare members join, and only sets of similar size.
    """
    return set_join.similar(sets.withColumn("side", F.lit(0)), least, set_join.hashed(F.col("s"))).select("a", "b", "jaccard")


def shingle_pairs(items: DataFrame, least: float, k: int = 3) -> DataFrame:
    """Pairs (a, b, jaccard) of items (id, content) whose k-character shingle sets have a Jaccard of at least ``least``."""
    return set_pairs(items.select("id", T.shingles(F.col("content"), k).alias("s")), least)


def signature(pieces: Column, n: int = 128) -> Column:
    """MinHash signature of an array of strings: ``n`` least values of odd multiples of their hashes; nulls if it is empty.

    The strings are hashed in the JVM; the ``n`` passes over whole batches of hashes are numpy's.
    """

    @F.arrow_udf("array<bigint>")
    def least(hashes: pa.Array) -> pa.Array:
        size = pa.compute.fill_null(pa.compute.list_value_length(hashes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = minima(size, hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), n)
        values = pa.array(out.reshape(-1), mask=np.repeat(size == 0, n))
        return pa.ListArray.from_arrays(np.arange(len(size) + 1, dtype=np.int32) * n, values)

    return least(F.transform(pieces, lambda p: F.xxhash64(p)))


def minima(size: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Signatures of sets of hashes, as a row of ``n`` values each; zeros if a set is empty."""
    chance = np.random.default_rng(20240607)
    times, plus = (chance.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))
    full = np.flatnonzero(size)
    out, ends, a = np.zeros((len(size), n), np.int64), np.cumsum(size[full]), 0
    while a < len(full):
        # as many members at a time as a core's cache holds
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 14), "right")))
        first = ends[a:b] - size[full[a:b]]
        h = own[first[0] : ends[b - 1]]
        x, y, first = np.empty_like(h), np.empty_like(h), first - first[0]
        for i in range(n):
            np.multiply(h, times[i] | np.uint64(1), out=x)
            np.add(x, plus[i], out=x)
            np.right_shift(x, np.uint64(31), out=y)
            np.bitwise_xor(x, y, out=x)
            out[full[a:b], i] = np.minimum.reduceat(x, first).view(np.int64)
        a = b
    return out


def signature_jaccard(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures: an estimate of the sets' Jaccard."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def bands(size: np.ndarray, own: np.ndarray, n: int = 128, rows: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (row, key, 0) of sets of hashes: of each ``rows`` values of their signatures a hash."""
    sig = minima(size, own, n).view(np.uint64).reshape(len(size), n // rows, rows)
    key = np.broadcast_to(np.arange(1, n // rows + 1, dtype=np.uint64), sig.shape[:2])
    for i in range(rows):
        key = key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        key = key ^ (key >> np.uint64(32))
    return np.repeat(np.arange(len(size)), n // rows), key.reshape(-1), np.zeros(key.size, np.int32)


def lsh_pairs(new: DataFrame, known: DataFrame, least: float, k: int = 3) -> DataFrame:
    """Pairs (id, match, jaccard) of new and known items (id, content) that share a band of their signatures and have an exact Jaccard of ``least`` or more.

    16 bands of 8: pairs of 0.85 share one with probability 0.994.
    """
    both = new.select("id", "content", F.lit(1).alias("side")).union(known.select("id", "content", F.lit(2)))
    found = set_join.similar(both, least, set_join.shingled(F.coalesce("content", F.lit("")), k), keys=bands, two=True)
    return found.select(F.col("a").alias("id"), F.col("b").alias("match"), "jaccard")


def word_classes(memories: DataFrame, *scope: str) -> DataFrame:
    """Rows (id, lead, some): the least id of the scope that has the same word set, and whether that holds words."""
    words = F.array_sort(T.words(F.coalesce("content", F.lit(""))))
    # a struct, in which a null scope equals another
    rows = memories.select("id", F.struct(*scope, F.md5(F.array_join(words, " ").cast("binary")).alias("words")).alias("k"), (F.size(words) > 0).alias("some"))
    rows = graph.written(rows)
    return graph.written(rows.join(rows.groupBy("k").agg(F.min("id").alias("lead")), "k").select("id", "lead", "some"))


def word_pairs(memories: DataFrame, classes: DataFrame, least: float, *scope: str, also: Column | None = None) -> DataFrame:
    """``set_join.similar`` of the different word sets of each scope, one row of each."""
    heads = set_join.within(memories, classes.where("id <> lead").select("id"), "left_anti")
    return set_join.similar(heads.withColumn("side", F.lit(0)), least, set_join.hashed(T.words(F.coalesce("content", F.lit(""))), *scope), also, scope=F.xxhash64(*scope) if scope else None)


def event_pairs(memories: DataFrame, least: float = 0.75) -> DataFrame:
    """Pairs (a, b, similarity, shared) of different word sets of similarity ``least`` or more, one row of each set: word Jaccard and the names that both hold."""
    near = word_pairs(memories, word_classes(memories), least, also=set_join.hashed(T.entities(F.col("content"))))
    return near.select("a", "b", F.col("jaccard").alias("similarity"), "shared")


def three_stages(new: DataFrame, known: DataFrame, preset: str = "default", vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows (id, match, stage, similarity) of new items (id, content, v) against known ones: exact, shingles, cosine, else new.

    A cosine between the third and second threshold is flagged borderline and stays new. ``vectors``: (id, v) of new and of known items that hold no v.
    """
    near, same, unsure = PRESETS[preset]
    new_v, known_v = vectors or (new.select("id", "v"), known.select("id", "v"))
    # contents stay where they are, their keys are compared
    keys = [graph.written(rows.select("id", F.md5(T.normalized_text(F.col("content")).cast("binary")).alias("k"))) for rows in (new, known)]
    # one known row of each content
    leads = graph.written(keys[1].groupBy("k").agg(F.min("id").alias("match")))
    exact = graph.written(keys[0].join(leads, "k").groupBy("id").agg(F.min("match").alias("match")).select("id", "match", F.lit("exact").alias("stage"), F.lit(1.0).alias("similarity")))
    copies = keys[1].select("id").join(leads.select(F.col("match").alias("id")), "id", "left_anti")
    left, heads = (set_join.within(rows.select("id", "content"), ids, "left_anti") for rows, ids in ((new, exact.select("id")), (known, copies)))
    best = lsh_pairs(left, heads, near).groupBy("id").agg(F.max(F.struct("jaccard", -F.col("match"))).alias("m"))
    shingle = graph.written(best.select("id", (-F.col("m.col2")).alias("match"), F.lit("shingles").alias("stage"), F.col("m.jaccard").alias("similarity")))
    rest = keys[0].select("id").join(exact.select("id"), "id", "left_anti").join(shingle.select("id"), "id", "left_anti")
    # of known vectors those in the cells nearest to a row's own; rows without a vector are new
    vectors = known_v.where("v IS NOT NULL").select("id", "v")
    asked = rest.join(new_v.where("v IS NOT NULL"), "id").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    n = vectors.count()
    if n:
        model = vector_index.fit(vectors, min(n, vector_index.n_cells(n)))
        found = vector_index.nearest(vector_index.indexed(vectors, model), asked, model, 1, min(16, len(model.clusterCenters())))
        found = found.select(F.col("query_id").alias("id"), F.col("id").alias("match"), F.col("score").alias("similarity"))
    else:
        found = asked.select(F.col("query_id").alias("id"), F.lit(None).cast("bigint").alias("match"), F.lit(None).cast("double").alias("similarity"))
    top = rest.select("id").join(found, "id", "left")
    stage = F.when(F.col("similarity") >= same, "cosine").when(F.col("similarity") >= unsure, "borderline").otherwise("new")
    semantic = top.select("id", "match", stage.alias("stage"), "similarity")
    return exact.unionByName(shingle).unionByName(semantic)


def edit_pairs(names: DataFrame) -> DataFrame:
    """Pairs of distinct normalised names at most one edit apart, both of four characters or more.

    Names one edit apart share the name with one character left out, or one is the other with one left out.
    """
    own = names.select(T.normalized_key(F.col("name")).alias("name")).distinct().where("length(name) >= 4")
    cuts = F.concat(F.array("name"), F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.concat(F.substring("name", F.lit(1), i - 1), F.substring("name", i + 1, F.length("name")))))
    forms = own.select("name", F.explode(F.array_distinct(cuts)).alias("form"))
    pairs = forms.alias("x").join(forms.alias("y"), (F.col("x.form") == F.col("y.form")) & (F.col("x.name") < F.col("y.name"))).select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()
    return pairs.where(T.edit_at_most_one(F.col("a"), F.col("b")))


def shared_topics(links: DataFrame, least: int = 1, block: int = 1024) -> DataFrame:
    """Pairs (a, b, shared, confidence) of memories with common topics: confidence min(0.5 + 0.1 shared, 0.9)."""
    # memories of the same topics are one class: only classes are compared
    own = links.where("id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list("topic")).alias("s"))
    classes = own.groupBy("s").agg(F.min("id").alias("lead"), F.ceil(F.count("*") / block).alias("blocks"))
    topics = classes.select("lead", F.explode("s").alias("topic"))
    x, y = topics.alias("x"), topics.alias("y")
    both = x.join(y, (F.col("x.topic") == F.col("y.topic")) & (F.col("x.lead") <= F.col("y.lead"))).groupBy(F.col("x.lead").alias("a"), F.col("y.lead").alias("b")).agg(F.count("*").alias("shared"))
    both = both.where(F.col("shared") >= least).withColumn("confidence", F.round(F.least(0.5 + 0.1 * F.col("shared"), F.lit(0.9)), 6))
    # members travel in blocks, and pairs are made where the two blocks of a pair of classes meet
    members = own.join(classes, "s").groupBy("lead", F.pmod(F.xxhash64("id"), "blocks").alias("block")).agg(F.collect_list("id").alias("ids"))
    one, two = (members.select(F.col("lead").alias(c), F.col("block").alias(f"block_{c}"), F.col("ids").alias(f"ids_{c}")) for c in "ab")
    met = both.join(one, "a").join(two, "b").where("a < b OR block_a <= block_b")
    met = met.repartition(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b", "block_a", "block_b")
    # a transform has no generated code, so the explodes run apart: what one makes of a row waits in memory, a row's pairs of two blocks otherwise
    met = met.withColumn("id_a", F.explode(F.transform("ids_a", lambda x: x))).withColumn("id_b", F.explode("ids_b")).where("a < b OR block_a < block_b OR id_a < id_b")
    return met.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "shared", "confidence")


def event_links(pairs: DataFrame) -> DataFrame:
    """Relation of pairs (a, b, shared, similarity): FOLLOWS with 3 shared entities and 0.85, RELATED with 1 and 0.75, or 0.85 alone."""
    follows = (F.col("shared") >= 3) & (F.col("similarity") >= 0.85)
    related = ((F.col("shared") >= 1) & (F.col("similarity") >= 0.75)) | (F.col("similarity") >= 0.85)
    return pairs.withColumn("relation", F.when(follows, "FOLLOWS").when(related, "RELATED")).where("relation IS NOT NULL")


def reinforced(mentions: DataFrame, *keys: str) -> DataFrame:
    """One row of each key: how often it was seen, and confidence min(1, first + 0.1 for each further time)."""
    first = F.min_by("confidence", "seq")
    return mentions.groupBy(*keys).agg(F.count("*").alias("verification_count"), first.alias("first")).select(*keys, "verification_count", F.round(F.least(F.lit(1.0), F.col("first") + 0.1 * (F.col("verification_count") - 1)), 6).alias("confidence"))


def topic_keywords(memories: DataFrame, most: int) -> DataFrame:
    """Rows (id, topic, score): the ``most`` words of largest tf * ln(N / (1 + df)), ties by word."""
    from engramlake.operators.search import postings

    words = postings(memories).where("length(term) BETWEEN 2 AND 20")
    df = words.groupBy("term").agg(F.count("*").alias("df"))
    n = memories.agg(F.count("*").alias("n"))
    scored = words.join(df, "term").crossJoin(n).select("id", F.col("term").alias("topic"), F.round(F.col("tf") * F.log(F.col("n") / (1 + F.col("df"))), 6).alias("score"))
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "topic"))).where(F.col("r") <= most).drop("r")


def leader_clusters(memories: DataFrame, least: float = 0.8) -> DataFrame:
    """Rows (id, leader): what one pass by id within each user gives where a row joins the first leader whose words have a Jaccard of at least ``least``.

    Only similar pairs meet. A row without an earlier similar leader leads; it is known to be one as soon as all of its earlier
    similar rows are known to follow, so each round settles every row that the rounds before it decide. Rows of one word set
    are one; rows without words follow their first.
    """
    rows = word_classes(memories, "user_id")
    pairs = graph.cut(word_pairs(memories, rows, least, "user_id").select("a", "b"))
    none = pairs.select(F.col("b").alias("id"), F.col("a").alias("leader")).limit(0)
    open_, follows = pairs, none
    while True:
        # a row that no open pair puts behind another leads, and all behind it follow
        leads = open_.select(F.col("a").alias("id")).distinct().join(open_.select(F.col("b").alias("id")), "id", "left_anti")
        new = graph.cut(open_.join(leads.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader")))
        if new.isEmpty():
            break
        follows = follows.union(new)
        gone = new.select("id")
        open_ = graph.cut(open_.join(leads.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
    # a row that a later round settled may have an earlier leader than the one that settled it
    own = follows.select(F.col("id").alias("b"))
    first = pairs.join(own, "b").join(own.withColumnRenamed("b", "a"), "a", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    return rows.select("id", "lead").join(first.withColumnRenamed("id", "lead"), "lead", "left").select("id", F.coalesce("leader", "lead").alias("leader"))
