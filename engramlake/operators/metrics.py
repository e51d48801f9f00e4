"""Metrics, budgets and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.operators.graph import cut

#: Upper bounds of the histogram's buckets (fixed values).
BUCKETS = (10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """count, sum, min, max, avg and the values at floor(n q): p50; p95 from 20 rows on and p99 from 100 on, else the maximum.

    Equal values are counted before they travel; ranges of (group, value) and the totals of the ranges before give a value's place, so
    no task holds a whole group. Null values count in ``n`` only; a null group is a group.
    """
    told = rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.avg(value), 6).alias("mean"))
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.struct(by).alias("_by"), F.col(value).alias("_value")).agg(F.count("*").alias("_c"))
    ranged = cut(counted.repartitionByRange("_by", "_value").withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_by", "_part").agg(F.sum("_c").alias("_c"))
    before = Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_by", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    upto = F.sum("_c").over(Window.partitionBy("_by", "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn("_upto", upto).join(parts, ["_by", "_part"]).withColumn("_upto", F.col("_upto") + F.col("_before"))
    told = told.withColumn("_by", F.struct(by))
    at = lambda q: F.max(F.when((F.col("_upto") > F.floor(F.col("n") * q)) & (F.col("_upto") - F.col("_c") <= F.floor(F.col("n") * q)), F.col("_value"))).alias(f"_{q}")
    found = placed.join(told.select("_by", "n"), "_by").groupBy("_by").agg(at(0.5), at(0.95), at(0.99))
    late = lambda least, q: F.when(F.col("n") >= least, F.col(f"`_{q}`")).otherwise(F.col("high"))
    return told.join(found, "_by", "left").select(by, "n", "total", "low", "high", "mean", F.col("`_0.5`").alias("p50"), late(20, 0.95).alias("p95"), late(100, 0.99).alias("p99"))


def histogram(rows: DataFrame, by: str, value: str, buckets: tuple = BUCKETS) -> DataFrame:
    """Rows (by, le, n): cumulative counts of values up to each bound, and of all (+Inf)."""
    counts = rows.groupBy(by).agg(*[F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(buckets)], F.count(value).alias("all"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)]
    return counts.select(by, F.explode(F.array(*pairs, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))).alias("x")).select(by, "x.le", "x.n")


def usage(rows: DataFrame, by: str, ts: str, cost: str, unit: str, budget: float) -> DataFrame:
    """Cost of each calendar hour or day and its share of the budget in percent."""
    return rows.groupBy(by, F.date_trunc(unit, ts).cast("timestamp_ntz").alias("period")).agg(F.round(F.sum(cost), 6).alias("cost")).withColumn("percent", F.round(100 * F.col("cost") / budget, 6))


def hit_rate(rows: DataFrame, by: str, hit: Column) -> DataFrame:
    return rows.groupBy(by).agg(F.sum(F.when(hit, 1).otherwise(0)).alias("hits"), F.count("*").alias("n")).withColumn("rate", F.round(F.col("hits") / F.col("n"), 6))


def gauges(rows: DataFrame, by: str, value: str, ts: str, tie: str) -> DataFrame:
    """Last value of each, by time."""
    return rows.groupBy(by).agg(F.count("*").alias("counter"), F.max_by(value, F.struct(ts, tie)).alias("gauge"))


def health(stats: DataFrame, by: str, limit: float) -> DataFrame:
    """healthy if the 95th percentile stays within the limit, else degraded."""
    return stats.select(by, "p95", F.when(F.col("p95") > limit, "degraded").otherwise("healthy").alias("status"))


def source_statistics(calls: DataFrame) -> DataFrame:
    """Per source of calls (source, time_ms, n, success): calls, those that succeeded, total and longest time, rows that successful ones gave."""
    won = F.when(F.col("success"), F.col("n")).otherwise(0)
    times = [F.round(F.sum("time_ms"), 6).alias("total_ms"), F.round(F.max("time_ms"), 6).alias("max_ms")]
    return calls.groupBy("source").agg(F.count("*").alias("calls"), F.count_if("success").alias("succeeded"), *times, F.sum(won).alias("results"))
