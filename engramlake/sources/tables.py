"""Reading and writing: the driver's tables in the roles of the engine's data model, and import / export."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{where}/{name}.parquet")


def memories(spark: SparkSession, where: str) -> DataFrame:
    """documents as memory rows: source as user, lang as category, importance from the id."""
    docs = table(spark, where, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("user_id"), F.col("lang").alias("category"), (F.pmod("doc_id", F.lit(10)) / 10).alias("importance"), "n_chars"
    )


def turns(spark: SparkSession, where: str) -> DataFrame:
    return table(spark, where, "conversations")


def facts(spark: SparkSession, where: str) -> DataFrame:
    """events as temporal facts: a user's value of an event type holds until the next event of that type."""
    from pyspark.sql import Window

    along = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, where, "events").select(
        F.col("event_id").alias("uuid"),
        F.col("user_id").alias("subject"),
        F.col("event_type").alias("predicate"),
        F.get_json_object("props", "$.k").alias("object"),
        F.col("ts").alias("valid_from"),
        F.lead("ts").over(along).alias("valid_until"),
        F.col("value").alias("value"),
    )


def edges(spark: SparkSession, where: str) -> DataFrame:
    """orders and line items as a graph: customer PLACED order, order CONTAINS part, part SUPPLIED_BY supplier."""
    orders, items = table(spark, where, "orders"), table(spark, where, "lineitem")

    def node(kind: str, column: str) -> Column:
        return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))

    placed = orders.select(node("c", "o_custkey").alias("src"), F.lit("PLACED").alias("type"), node("o", "o_orderkey").alias("dst"))
    contains = items.select(node("o", "l_orderkey"), F.lit("CONTAINS"), node("p", "l_partkey"))
    supplied = items.select(node("p", "l_partkey"), F.lit("SUPPLIED_BY"), node("s", "l_suppkey"))
    return placed.union(contains).union(supplied).distinct()


#: Kinds of nodes, in the order of their names, and characters of a key that a code holds.
KINDS, WIDTH = "cops", 17


def node_code(kind: str, column: str) -> Column:
    """The node kind:key as a bigint of the same order: the key's characters as digits of base 12, from the left."""

    @F.arrow_udf("bigint")
    def code(keys: pa.Array) -> pa.Array:
        key = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.abs(key)
        if len(key) and (size.max() >= 10 ** (WIDTH - 1) or key.min() == np.iinfo(np.int64).min):
            raise ValueError(f"keys of more than {WIDTH - 1} digits have no code")
        tens, twelves = 10 ** np.arange(WIDTH, dtype=np.int64), 12 ** np.arange(WIDTH + 1, dtype=np.int64)
        digits = np.searchsorted(tens[1:], size, side="right") + 1
        # - comes before the digits, and the end of a key before both; digits are read as of one number, from the right
        value, out = size.copy(), np.zeros(len(key), np.int64)
        for i in range(int(digits.max(initial=0))):
            left = i < digits
            value, digit = value // 10, value % 10
            out += np.where(left, (digit + 2) * twelves[i], 0)
        out = out * twelves[WIDTH - digits - (key < 0)] + (key < 0) * twelves[WIDTH - 1]
        return pa.array(out + KINDS.index(kind) * 12**WIDTH, mask=keys.is_null().to_numpy(zero_copy_only=False))

    return code(F.col(column).cast("bigint"))


def node_name(column: str) -> Column:
    """The name of a node's code."""

    @F.arrow_udf("string")
    def name(codes: pa.Array) -> pa.Array:
        code = pc.fill_null(codes, 0).to_numpy(zero_copy_only=False)
        kind, left = np.divmod(code, 12**WIDTH)
        minus = left >= 12 ** (WIDTH - 1)
        minus &= left < 2 * 12 ** (WIDTH - 1)
        left = np.where(minus, (left - 12 ** (WIDTH - 1)) * 12, left)
        key = np.zeros(len(code), np.int64)
        while left.any():
            digit, left = left // 12 ** (WIDTH - 1), left % 12 ** (WIDTH - 1) * 12
            key = np.where(digit > 1, key * 10 + digit - 2, key)
        kinds = pa.array([f"{k}:" for k in KINDS]).take(pa.array(kind))
        text = pc.binary_join_element_wise(kinds, pa.array(np.where(minus, -key, key)).cast(pa.string()), "")
        return pc.if_else(codes.is_null(), pa.scalar(None, pa.string()), text)

    return name(F.col(column))


def coded_edges(spark: SparkSession, where: str, *types: str) -> DataFrame:
    """Rows (src, dst) of the ``edges`` of some types with codes for names; an edge comes as often as the tables state it."""
    orders, items = table(spark, where, "orders"), table(spark, where, "lineitem")
    own = {"PLACED": (orders, ("c", "o_custkey"), ("o", "o_orderkey")), "CONTAINS": (items, ("o", "l_orderkey"), ("p", "l_partkey")), "SUPPLIED_BY": (items, ("p", "l_partkey"), ("s", "l_suppkey"))}
    out = None
    for rows, a, b in (own[t] for t in types or own):
        part = rows.select(node_code(*a).alias("src"), node_code(*b).alias("dst"))
        out = part if out is None else out.union(part)
    return out


def export_json(rows: DataFrame, path: str) -> None:
    """JSON lines, one object a row; nulls are left out."""
    rows.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_scoped(rows: DataFrame, path: str, *scope: str) -> None:
    """Replace the scopes (partitions) that ``rows`` hold and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)
