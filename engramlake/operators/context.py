"""Context assembly: budgets, quotas, chunks and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import text as T


def within_budget(rows: DataFrame, budget: int, by: list[str], order: list[Column], size: Column) -> DataFrame:
    """The longest run of first rows of each group whose sizes sum to at most ``budget``, with ``used`` so far."""
    along = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", F.sum(size).over(along)).where(F.col("used") <= budget)


def quota(rows: DataFrame, each: int, total: int, kind: str, order: list[Column]) -> DataFrame:
    """At most ``each`` rows of each kind, then at most ``total`` overall."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("_n") <= each).drop("_n")
    return first.orderBy(*order).limit(total)


def greedy_pack(rows: DataFrame, budget: int, by: str, order: list[Column], size: Column) -> DataFrame:
    """Rows in order that still fit: one that doesn't is skipped. The first of a group goes in, cut to the budget, even if too long."""
    packed = rows.withColumn("_size", size.cast("int")).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    listed = packed.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_n", "_size"))).alias("l"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        fits = (state["used"] + x["_size"] <= budget) | (x["_n"] == 1)
        return F.struct(F.when(fits, F.least(state["used"] + x["_size"], F.lit(budget))).otherwise(state["used"]).alias("used"), F.when(fits, F.array_append(state["kept"], x["_n"])).otherwise(state["kept"]).alias("kept"))

    chosen = listed.select(by, F.explode(F.aggregate("l", start, step)["kept"]).alias("_n"))
    return packed.join(chosen, [by, "_n"]).drop("_n", "_size")


def turn_pairs(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, question, answer): a user's turn and the assistant's that follows it directly."""
    along = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.withColumns({"answer": F.lead("text").over(along), "next": F.lead("role").over(along)})
    return both.where((F.col("role") == "user") & (F.col("next") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def every_nth(turns: DataFrame, n: int) -> DataFrame:
    """Turns at which a count of user turns reaches a multiple of ``n``."""
    along = Window.partitionBy("conv_id").orderBy("turn")
    return turns.where(F.col("role") == "user").withColumn("seen", F.row_number().over(along)).where(F.col("seen") % n == 0)


def reminders(rows: DataFrame, now_turn: Column, after: int, top: int = 3) -> DataFrame:
    """Important rows that weren't mentioned for ``after`` turns (half of it above importance 0.7): the ``top`` of each user."""
    since = now_turn - F.col("last_turn")
    due = rows.withColumn("since", since).where((F.col("importance") >= 0.5) & (F.col("since") >= F.when(F.col("importance") > 0.7, after / 2).otherwise(after)))
    return due.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("importance"), F.desc("since"), "id"))).where(F.col("r") <= top).drop("r")


def adaptive_budget(base: int, n_rows: Column, low: int = 500, high: int = 8000) -> Column:
    """Base plus two tokens a row, between ``low`` and ``high``."""
    return F.least(F.greatest(F.lit(base) + 2 * n_rows, F.lit(low)), F.lit(high)).cast("bigint")


def chunks(docs: DataFrame, most: int = 512, overlap: int = 64) -> DataFrame:
    """Rows (id, idx, total, content): sentences packed to ``most`` estimated tokens; a chunk starts with the last two sentences of the one before if it stays within 115 %."""

    def cut(batches):
        import pandas as pd

        def size(text: str) -> int:
            return len(text.split())

        for rows in batches:
            out = []
            for i, sentences in zip(rows["id"], rows["sentences"], strict=True):
                done: list[list[str]] = [[]]
                used = 0
                for s in sentences:
                    if done[-1] and used + size(s) > most:
                        tail = done[-1][-2:]
                        done.append(tail if sum(map(size, tail)) <= overlap and sum(map(size, tail)) + size(s) <= 1.15 * most else [])
                        used = sum(map(size, done[-1]))
                    done[-1].append(s)
                    used += size(s)
                done = [c for c in done if c]
                out += [(i, n, len(done), " ".join(c)) for n, c in enumerate(done)]
            yield pd.DataFrame(out, columns=["id", "idx", "total", "content"])

    return docs.select("id", T.sentences(F.col("content")).alias("sentences")).mapInPandas(cut, "id bigint, idx int, total int, content string")


def source_type(text: Column) -> Column:
    """dialogue, transcript, json, csv or article, by the first 2000 characters."""
    head = F.substring(text, 1, 2000)
    return (
        F.when(head.rlike("(?im)^(user|assistant|system|human|ai)\\s*[:：]"), "dialogue")
        .when(head.rlike("(?m)^\\[?\\d{1,2}:\\d{2}(:\\d{2})?\\]?"), "transcript")
        .when(head.rlike("^\\s*[\\[{]") & F.try_parse_json(text).isNotNull(), "json")
        .when(head.rlike("^[^\\n,]+(,[^\\n,]*){2,}\\n[^\\n,]*(,[^\\n,]*){2,}"), "csv")
        .otherwise("article")
    )


def sections(parts: list[DataFrame], budgets: list[int]) -> DataFrame:
    """Sections (query_id, ord, line) one after the other, each within its budget of characters: rows (query_id, section, ord, line)."""
    out = None
    for k, (part, budget) in enumerate(zip(parts, budgets, strict=True)):
        rows = within_budget(part, budget, ["query_id"], [F.col("ord")], F.length("line")).select("query_id", F.lit(k).alias("section"), "ord", "line")
        out = rows if out is None else out.unionByName(rows)
    return out


def row_batches(rows: DataFrame, key: str, size: int, *order: str) -> DataFrame:
    """``batch`` from 0: every ``size`` rows of a key in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size))


def by_priority(rows: DataFrame, key: str, kind: str, order: list[str], *then: str) -> DataFrame:
    """``n`` from 1 within each key: kinds in the given order, others last, equals by ``then``."""
    place = F.coalesce(*[F.when(F.col(kind) == k, F.lit(i)) for i, k in enumerate(order)], F.lit(len(order)))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(place, *then)))


def segments(rows: DataFrame, by: str, ts: str, seconds: int = 180, *order: str) -> DataFrame:
    """``rows`` with ``segment_start``: a segment of a group ends with the last row less than ``seconds`` after its first one.

    Where a segment starts depends on the one before, so rows of a group pass one task in order, in constant memory however many
    they are. Rows without a time come first in their group and have no segment; a column of the new name is replaced.
    """
    span = seconds * 1_000_000
    rows = rows.drop("segment_start")

    def run(batches):
        import pyarrow as pa

        held, start = None, None
        for batch in batches:
            keys, at, out = batch.column(by).to_pylist(), batch.column(ts).cast(pa.int64()).to_pylist(), []
            for k, t in zip(keys, at, strict=True):
                if k != held:
                    held, start = k, None
                if t is not None and (start is None or t - start >= span):
                    start = t
                out.append(start if t is not None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64()).cast(pa.timestamp("us"))], [*batch.schema.names, "segment_start"])

    sorted_ = rows.repartition(by).sortWithinPartitions(by, ts, *order)
    return sorted_.mapInArrow(run, rows.select("*", F.lit(None).cast("timestamp_ntz").alias("segment_start")).schema)


def first_sentences(rows: DataFrame, id_column: str = "id", text: str = "content") -> DataFrame:
    """Rows (id, pos, sentence): each different sentence where it comes first (least id, then place). Null texts have none."""
    cut = rows.select(F.col(id_column).alias("id"), F.posexplode(T.sentences(F.col(text))).alias("pos", "sentence"))
    first = cut.groupBy("sentence").agg(F.min(F.struct("id", "pos")).alias("f"))
    return first.select("f.id", "f.pos", "sentence")


def extractive_summary(text: Column, name: Column, first: int = 5, least: int = 10, budget: int = 12000) -> Column:
    """Different sentences of ``least`` characters or more, the ``first`` ones and those that mention ``name``, while their lengths sum to at most ``budget``."""
    different = F.array_distinct(F.filter(T.sentences(text), lambda s: F.length(s) >= least))
    kept = F.filter(different, lambda s, i: (i < first) | ((name != "") & F.contains(F.lower(s), F.lower(name))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("n"))

    def step(state: Column, s: Column) -> Column:
        used = state["used"] + F.length(s)
        return F.struct(used.alias("used"), (state["n"] + F.when(used <= budget, 1).otherwise(0)).alias("n"))

    return F.slice(kept, F.lit(1), F.aggregate(kept, start, step)["n"])


def core_lines(states: DataFrame, by: str, name: str, state: str, confidence: str, newest: Column, budget: int, most: int = 3) -> DataFrame:
    """Rows (by, line): each name with its ``most`` newest states, by falling confidence, while the lines' lengths fit ``budget``."""
    along = Window.partitionBy(by, name).orderBy(newest)
    few = states.withColumn("_n", F.row_number().over(along)).where(F.col("_n") <= most)
    said = few.groupBy(by, name).agg(F.max(confidence).alias("_c"), F.array_sort(F.collect_list(F.struct("_n", F.col(state).alias("s")))).alias("l"))
    lines = said.withColumn("line", F.concat(F.col(name), F.lit(": "), F.array_join(F.transform("l", lambda x: x["s"]), ", ")))
    return within_budget(lines, budget, [by], [F.desc("_c"), F.col(name)], F.length("line")).select(by, name, "line", "used")


def mentioning_first(rows: DataFrame, by: str, text: str, name: str, last: Column, top: int) -> DataFrame:
    """The ``top`` rows of each group, those that mention ``name`` in any case first; ``rank`` from 1."""
    hit = F.coalesce(F.contains(F.lower(text), F.lit(name.lower())), F.lit(False))
    along = Window.partitionBy(by).orderBy(F.desc("mentions"), last)
    return rows.withColumn("mentions", hit).withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= top)


def relevant(contexts: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """Rows (query_id, id, score, rank): of a user's contexts the ``k`` that suit the user's query best.

    ``contexts``: rows (user_id, id, content, keywords, entities), ``asked``: rows (query_id, user_id, text). 0.1 for every context, 0.3 for each
    keyword and 0.4 for each entity inside the query, 0.2 if one of the query's words is inside the content, in any case. Ties go to the smaller id.
    """
    low = F.lower("text")
    inside = lambda names: F.size(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda w: F.contains(low, F.lower(w))))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    says = F.exists(words, lambda w: F.contains(F.lower("content"), w))
    score = 0.1 + 0.3 * inside(F.col("keywords")) + 0.4 * inside(F.col("entities")) + F.when(says, 0.2).otherwise(0.0)
    rows = contexts.join(asked, "user_id").select("query_id", "id", F.round(score, 6).alias("score"))
    along = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))
