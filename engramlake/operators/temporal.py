"""Temporal facts: closed validity intervals whose missing ends are open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at(point: str) -> Column:
    return F.lit(point).cast("timestamp_ntz")


def holds(point: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    return (F.col(start).isNull() | (F.col(start) <= point)) & (F.col(end).isNull() | (F.col(end) >= point))


def as_of(facts: DataFrame, point: str) -> DataFrame:
    return facts.where(holds(at(point)))


def overlapping(facts: DataFrame, start: str, end: str) -> DataFrame:
    return facts.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at(end))) & (F.col("valid_until").isNull() | (F.col("valid_until") >= at(start))))


def timeline(facts: DataFrame, start: str, end: str) -> DataFrame:
    """Rows (subject, at, what, uuid): starts and ends inside the closed range."""
    events = F.explode(F.array(F.struct(F.col("valid_from").alias("at"), F.lit("started").alias("what")), F.struct(F.col("valid_until").alias("at"), F.lit("ended").alias("what"))))
    return facts.select("subject", "uuid", events.alias("e")).select("subject", "e.at", "e.what", "uuid").where(F.col("at").between(at(start), at(end)))


def snapshot_diff(facts: DataFrame, before: str, after: str) -> DataFrame:
    """Per subject how many (predicate, object) pairs hold only after, only before, and at both points."""
    keys = ["subject", "predicate", "object"]
    old, new = as_of(facts, before).select(*keys).distinct().withColumn("o", F.lit(1)), as_of(facts, after).select(*keys).distinct().withColumn("n", F.lit(1))
    both = old.join(new, keys, "full_outer")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.groupBy("subject").agg(one(F.col("o").isNull()).alias("added"), one(F.col("n").isNull()).alias("removed"), one(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("unchanged"))


def ended_before(facts: DataFrame, point: str, k: int) -> DataFrame:
    return facts.where(F.col("valid_until") <= at(point)).orderBy(F.desc("valid_until"), "uuid").limit(k)


def started_after(facts: DataFrame, point: str, k: int) -> DataFrame:
    return facts.where(F.col("valid_from") >= at(point)).orderBy("valid_from", "uuid").limit(k)


def superseded(facts: DataFrame) -> DataFrame:
    """A fact ends when the next one of its subject and predicate starts."""
    along = Window.partitionBy("subject", "predicate").orderBy("valid_from", "uuid")
    return facts.withColumn("valid_until", F.coalesce(F.lead("valid_from").over(along), "valid_until"))


def expired(facts: DataFrame, uuids: DataFrame, now: str) -> DataFrame:
    """System-time close of the facts in ``uuids``."""
    gone = uuids.select("uuid").distinct().withColumn("gone", F.lit(True))
    return facts.join(gone, "uuid", "left").withColumn("expired_at", F.when(F.col("gone"), at(now))).drop("gone")


def expanding_window(rows: DataFrame, now: str, least: int = 3, by: str = "subject") -> DataFrame:
    """Per ``by`` the rows of the first of 1, 7, 30 and 365 days back from now that holds ``least`` rows; else of the widest."""
    age = F.timestamp_diff("SECOND", F.col("valid_from"), at(now)) / 86400
    stage = F.when(age <= 1, 1).when(age <= 7, 2).when(age <= 30, 3).when(age <= 365, 4)
    staged = rows.where((age >= 0) & (age <= 365)).withColumn("stage", stage)
    counts = staged.groupBy(by).agg(*[F.sum(F.when(F.col("stage") <= s, 1).otherwise(0)).alias(f"n{s}") for s in range(1, 5)])
    used = F.coalesce(*[F.when(F.col(f"n{s}") >= least, s) for s in range(1, 4)], F.lit(4))
    return staged.join(counts.select(by, used.alias("used")), by).where(F.col("stage") <= F.col("used"))


def interval_pairs(facts: DataFrame) -> DataFrame:
    """Pairs of one subject and predicate with different objects whose intervals overlap (closed, open where missing)."""
    a, b = facts.alias("a"), facts.alias("b")
    same = (F.col("a.subject") == F.col("b.subject")) & (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.uuid") < F.col("b.uuid")) & (F.col("a.object") != F.col("b.object"))
    meet = ~F.coalesce(F.col("a.valid_until") < F.col("b.valid_from"), F.lit(False)) & ~F.coalesce(F.col("b.valid_until") < F.col("a.valid_from"), F.lit(False))
    return a.join(b, same & meet).select(F.col("a.uuid").alias("old_uuid"), F.col("b.uuid").alias("new_uuid"), F.col("a.subject").alias("subject"), F.col("a.predicate").alias("predicate"))
