"""Life of a context or memory: decay, archive, merge, usage, and chains of linked events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import times as TM


def decayed(contexts: DataFrame, now: str, days: int = 14, factor: float = 0.95, least: float = 0.1) -> DataFrame:
    """Confidence times ``factor`` for rows unused for more than ``days``; rows at or below ``least`` are archived."""
    idle = TM.age_seconds(F.col("last_used"), now) > days * 86400
    out = contexts.withColumn("confidence", F.round(F.when(idle, F.col("confidence") * factor).otherwise(F.col("confidence")), 6))
    return out.withColumn("archived", F.col("confidence") <= least)


def archived(rows: DataFrame, now: str, days: int, ts: str) -> DataFrame:
    """``archived`` tells rows not updated for more than ``days``."""
    return rows.withColumn("archived", TM.age_seconds(F.col(ts), now) > days * 86400)


def merged(contexts: DataFrame, *keys: str) -> DataFrame:
    """One row of each key: the longest content (then the least), use_count summed, confidence + 0.1 for each further row, at most 1."""
    pick = F.min(F.struct((-F.length("content")).alias("l"), "content"))
    out = contexts.groupBy(*keys).agg(pick.alias("p"), F.sum("use_count").alias("use_count"), F.max("confidence").alias("c"), F.count("*").alias("n"))
    return out.select(*keys, F.col("p.content").alias("content"), "use_count", F.round(F.least(F.lit(1.0), F.col("c") + 0.1 * (F.col("n") - 1)), 6).alias("confidence"))


def marked_used(contexts: DataFrame, usage: DataFrame, key: str) -> DataFrame:
    """use_count and last_used after a log of uses (key, ts)."""
    used = usage.groupBy(key).agg(F.count("*").alias("more"), F.max("ts").alias("at"))
    both = contexts.join(used, key, "left")
    return both.withColumns({"use_count": F.col("use_count") + F.coalesce("more", F.lit(0)), "last_used": F.greatest("last_used", "at")}).drop("more", "at")


def consolidated(contexts: DataFrame, kind: str, most: int) -> DataFrame:
    """Of each kind the ``most`` rows of highest confidence stay active."""
    along = Window.partitionBy(kind).orderBy(F.desc("confidence"), "id")
    return contexts.withColumn("is_active", F.row_number().over(along) <= most)


def event_chain(links: DataFrame, starts: DataFrame, depth: int = 20) -> DataFrame:
    """Rows (start, node, depth): events that FOLLOWS or RELATED links lead to."""
    from engramlake.operators.graph import breadth_first

    return breadth_first(links.select(F.col("a").cast("string").alias("src"), F.col("relation").alias("type"), F.col("b").cast("string").alias("dst")), starts, depth)
