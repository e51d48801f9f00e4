"""Row store operations as set operations: the newest version of a row wins, deletions are anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Upsert: of each key the first row in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upserted(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``changes`` replace rows of their key and add new ones."""
    both = rows.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, [key], F.desc("_new")).drop("_new")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascade of a delete: rows of any table that don't refer to a deleted key."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def purged(rows: DataFrame, gone: DataFrame, key: str, array: str) -> DataFrame:
    """Deleted keys leave arrays of references; a row whose array becomes empty goes."""
    names = [c for c in rows.columns if c != array]
    left = rows.select(*names, F.posexplode(array).alias("_at", key)).join(gone.select(key).distinct(), key, "left_anti")
    return left.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", key))), lambda x: x[key]).alias(array)).select(*rows.columns)


def hot_set(rows: DataFrame, user: str, cap: int, *order: Column) -> DataFrame:
    """The ``cap`` first rows of each user in order, with ``kept`` telling hot rows from evicted ones."""
    return rows.withColumn("kept", F.row_number().over(Window.partitionBy(user).orderBy(*order)) <= cap)


def page(rows: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def clamped_page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1), moved to the nearest page that exists; two-level ranks, so no task sorts all rows' contents."""
    total = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("pages"))
    first = rows.orderBy(*order).limit(number * size).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    own = first.crossJoin(total).withColumn("_page", F.least(F.greatest(F.lit(number), F.lit(1)), F.col("pages")))
    return own.where(F.ceil(F.col("_n") / size) == F.col("_page")).drop("_n", "_page", "pages")


def volumes(rows: DataFrame, turn: str, volume: int = 100_000, file: int = 10_000) -> DataFrame:
    """Where a turn is archived: volume, file in it and offset in that."""
    return rows.withColumns({"volume": F.floor(F.col(turn) / volume), "file": F.floor(F.col(turn) % volume / file), "offset": F.col(turn) % file})


def working_set(mentions: DataFrame, turn: int, capacity: int) -> DataFrame:
    """Entities of largest access_count / (turn - last + 1), ties by name."""
    own = mentions.groupBy("user_id", "entity").agg(F.count("*").alias("access_count"), F.max("turn").alias("last"))
    scored = own.withColumn("score", F.round(F.col("access_count") / (F.lit(turn) - F.col("last") + 1), 6))
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "entity"))).where(F.col("_n") <= capacity).drop("_n")


def filtered(rows: DataFrame, **conditions) -> DataFrame:
    """AND of equalities; a list means any of."""
    for name, value in conditions.items():
        rows = rows.where(F.col(name).isin(value) if isinstance(value, list | tuple) else F.col(name) == value)
    return rows


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the asked keys; a key that no row has gives none."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def holding(rows: DataFrame, array: str, asked: DataFrame, key: str) -> DataFrame:
    """Rows whose array holds an asked key, with that key: a reverse lookup as an equi-join."""
    return rows.withColumn(key, F.explode(F.array_distinct(array))).join(asked.select(key).distinct(), key, "left_semi")


def scopes(rows: DataFrame, *levels: str) -> DataFrame:
    """Each scope that holds rows: its levels, its ``path`` and how many rows it holds; a missing level is ``default``."""
    named = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("default")).alias(c) for c in levels])
    return named.groupBy(*levels).agg(F.count("*").alias("n")).withColumn("path", F.concat_ws("/", *levels))


def expanded(summaries: DataFrame, ids: str, rows: DataFrame, key: str) -> DataFrame:
    """The rows that each summary was made of; ids that no row has are left out."""
    return summaries.withColumn(key, F.explode(F.array_distinct(ids))).drop(ids).join(rows, key)
