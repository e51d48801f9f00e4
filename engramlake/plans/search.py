"""The search pipeline: recall paths, fusion, prefilter, weighting and diversity, for a table of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions import text as T
from engramlake.operators import search as S

#: A recall path: (memories, queries) to rows (query_id, id, score).
Path = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Config:
    """Weights of the paths, sizes, and what the final score is made of."""

    weights: dict = field(default_factory=lambda: {"keyword": 1.2, "fulltext": 0.3, "entity": 1.0})
    candidates: int = 100
    top_k: int = 10
    relevance: float = 0.5
    importance: float = 0.3
    recency: float = 0.2
    diversity: float | None = 0.7
    min_importance: float | None = None
    #: the time that ages of rows (column created_at) are counted to, and the age in days that halves recency
    now: str | None = None
    half_life: float = 30.0


FAST = Config(candidates=50, diversity=None)
ACCURATE = Config(candidates=300)


def entity_path(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """0.7 for rows that mention one of the query's first capitalised words."""
    asked = queries.select("query_id", F.explode(F.slice(T.entities(F.col("text")), 1, 3)).alias("entity"))
    names = F.col("_names") if "_names" in memories.columns else T.entities(F.col("content"))
    held = memories.select("id", F.explode(names).alias("entity"))
    return held.join(asked, "entity").groupBy("query_id", "id").agg(F.lit(0.7).alias("score"))


PATHS: dict[str, Path] = {"keyword": S.keyword_ratio, "fulltext": S.bm25, "entity": entity_path}


def recalled(memories: DataFrame, queries: DataFrame, paths: dict[str, Path], candidates: int) -> DataFrame:
    """The best ``candidates`` rows of every path: rows (source, query_id, id, score)."""
    out = None
    for name, path in paths.items():
        rows = S.ranked(path(memories, queries), candidates).select(F.lit(name).alias("source"), "query_id", "id", "score")
        out = rows if out is None else out.union(rows)
    return out


def search(memories: DataFrame, queries: DataFrame, config: Config = Config(), paths: dict[str, Path] | None = None) -> DataFrame:
    """Rows (query_id, id, score, rank): fused by reciprocal ranks, weighed by importance, and made diverse."""
    found = recalled(memories, queries, paths, config.candidates) if paths else recalled(S.indexed(memories), queries, PATHS, config.candidates)
    fused = S.reciprocal_rank_fusion(found, weights=config.weights)
    timed = config.now is not None and "created_at" in memories.columns
    rows = fused.join(memories.select("id", "importance", "content", *(["created_at"] if timed else [])), "id")
    if config.min_importance is not None:
        rows = rows.where(F.coalesce("importance", F.lit(0.5)) >= config.min_importance)
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    scaled = F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low))
    # without a time a row's recency is the neutral 0.5
    recency = F.lit(0.5)
    if timed:
        age = F.unix_micros(F.lit(config.now).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
        recency = F.coalesce(F.pow(F.lit(0.5), F.when(age > 0, age).when(age <= 0, 0) / (config.half_life * 86400e6)), recency)
    important = F.least(F.greatest(F.coalesce("importance", F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    score = config.relevance * scaled + config.importance * important + config.recency * recency
    rows = rows.select("query_id", "id", F.round(score, S.DIGITS).alias("score"), "content")
    if config.diversity is None:
        return S.ranked(rows, config.top_k).select("query_id", "id", "score", "rank")
    return S.mmr(rows, config.top_k, config.diversity)
