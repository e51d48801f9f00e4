"""Entities by name and alias: lookup, merging, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forms(entities: DataFrame) -> DataFrame:
    """Rows (form, id) of entities (id, name, aliases): each lower-cased name and alias once."""
    every = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), F.lower))
    return entities.select("id", F.explode(every).alias("form")).where("form IS NOT NULL").select("form", "id")


def by_name(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (query, id): entities whose name or alias equals the asked one in any case. ``asked``: rows (query)."""
    return asked.select("query", F.lower("query").alias("form")).join(forms(entities), "form").select("query", "id").distinct()


def containing(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (query, id): entities one of whose names holds the asked text in any case.

    Names are cut into pieces of the asked lengths, so an equi-join finds them. ``asked`` is a stated set of short texts.
    """
    want = asked.select("query", F.lower("query").alias("piece")).where("length(piece) > 0")
    lengths = [r.n for r in want.select(F.length("piece").alias("n")).distinct().collect()]  # at most the longest name's
    if not lengths:
        return want.select("query", F.lit(None).cast("bigint").alias("id")).limit(0)

    def pieces_of(n: int):
        cut = F.transform(F.sequence(F.lit(1), F.length("form") - (n - 1)), lambda i: F.substring("form", i, F.lit(n)))
        return F.when(F.length("form") >= n, cut).otherwise(F.array().cast("array<string>"))

    cuts = [pieces_of(n) for n in lengths]
    pieces = forms(entities).select("id", F.explode(F.array_distinct(F.flatten(F.array(*cuts)))).alias("piece"))
    return want.join(pieces, "piece").select("query", "id").distinct()


def merged(mentions: DataFrame) -> DataFrame:
    """One node of each lower-cased name (name, id): its least id, how often it was seen, and the spellings, in order."""
    return mentions.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"), F.count("*").alias("verification_count"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("aliases"))


def canonical(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows (name, canonical): what ``aliases`` (alias, canonical) says of a name in any case; else the name itself."""
    return names.join(aliases.select(F.lower("alias").alias("_k"), "canonical"), F.lower("name") == F.col("_k"), "left").select("name", F.coalesce("canonical", "name").alias("canonical"))
