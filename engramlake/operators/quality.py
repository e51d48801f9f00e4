"""Contradictions between facts, and consistency of attributes that texts state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence of a rule before the facts' own confidence counts (fixed values).
BASE = {"direct": 0.8, "temporal": 0.7, "logical": 0.6}


def pairs(facts: DataFrame, keys: list[str], rule: Column) -> DataFrame:
    """Pairs (a, b) of facts that agree on ``keys`` and fulfil ``rule``, the older uuid first."""
    same = F.col("a.uuid") != F.col("b.uuid")
    for k in keys:
        same &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return facts.alias("a").join(facts.alias("b"), same & rule)


def meet() -> Column:
    return ~F.coalesce(F.col("a.valid_until") < F.col("b.valid_from"), F.lit(False)) & ~F.coalesce(F.col("b.valid_until") < F.col("a.valid_from"), F.lit(False))


def _told(found: DataFrame, kind: str) -> DataFrame:
    return found.select(F.col("a.uuid").alias("old_uuid"), F.col("b.uuid").alias("new_uuid"), F.lit(kind).alias("kind"), F.lit(BASE[kind]).alias("base"))


def direct(facts: DataFrame) -> DataFrame:
    """Same subject and predicate, different objects, overlapping intervals."""
    return _told(pairs(facts, ["subject", "predicate"], (F.col("a.uuid") < F.col("b.uuid")) & (F.col("a.object") != F.col("b.object")) & meet()), "direct")


def temporal(facts: DataFrame) -> DataFrame:
    """The same statement twice, only one of them with a start."""
    return _told(pairs(facts, ["subject", "predicate", "object"], (F.col("a.uuid") < F.col("b.uuid")) & (F.col("a.valid_from").isNull() != F.col("b.valid_from").isNull())), "temporal")


def logical(facts: DataFrame, exclusive: list[tuple[str, str]]) -> DataFrame:
    """Same subject and object under two predicates that exclude each other, overlapping intervals."""
    rule = F.lit(False)
    for x, y in exclusive:
        rule |= (F.col("a.predicate") == x) & (F.col("b.predicate") == y)
    return _told(pairs(facts, ["subject", "object"], rule & meet()), "logical")


def contradictions(facts: DataFrame, exclusive: list[tuple[str, str]], extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """All rules; of several on one pair the first in order counts. ``extra`` rules return rows like the built-in ones."""
    order = ["direct", "temporal", "logical", *(extra or {})]
    found = direct(facts).unionByName(temporal(facts)).unionByName(logical(facts, exclusive))
    for rule in (extra or {}).values():
        found = found.unionByName(rule(facts))
    first = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(order)], F.lit(len(order)))
    return found.groupBy("old_uuid", "new_uuid").agg(F.min(F.struct(first.alias("p"), "kind", "base")).alias("r")).select("old_uuid", "new_uuid", "r.kind", "r.base")


def confidence(base: Column, old: Column, new: Column) -> Column:
    """70 % of the rule's confidence and 30 % of the facts' mean, at most 1."""
    return F.least(F.lit(1.0), base * 0.7 + (old + new) / 2 * 0.3)


def resolved(facts: DataFrame, found: DataFrame, strategy: str) -> DataFrame:
    """supersede: older facts end where the newer starts; reject: newer facts go; coexist and manual: nothing changes."""
    if strategy == "supersede":
        ends = found.join(facts.select(F.col("uuid").alias("new_uuid"), F.col("valid_from").alias("cut")), "new_uuid").groupBy(F.col("old_uuid").alias("uuid")).agg(F.min("cut").alias("cut"))
        return facts.join(ends, "uuid", "left").withColumn("valid_until", F.coalesce("cut", "valid_until")).drop("cut")
    if strategy == "reject":
        return facts.join(found.select(F.col("new_uuid").alias("uuid")), "uuid", "left_anti")
    return facts


def attribute_conflicts(statements: DataFrame, severity: float = 0.8) -> DataFrame:
    """Entities that have several values of one attribute. ``statements``: rows (entity, attribute, value)."""
    values = statements.groupBy("entity", "attribute").agg(F.sort_array(F.collect_set(F.lower(F.trim("value")))).alias("v"))
    return values.where(F.size("v") > 1).select("entity", "attribute", F.concat_ws("|", "v").alias("found"), F.lit(severity).alias("severity"))


def number_conflicts(statements: DataFrame, attribute: str = "age", most: float = 1.0, severity: float = 0.7) -> DataFrame:
    """Entities whose stated numbers of an attribute lie more than ``most`` apart."""
    own = statements.where(F.col("attribute") == attribute).select("entity", F.expr("try_cast(value AS double)").alias("x")).where("x IS NOT NULL")
    return own.groupBy("entity").agg(F.min("x").alias("low"), F.max("x").alias("high")).where(F.col("high") - F.col("low") > most).withColumn("severity", F.lit(severity))


def opposite_conflicts(statements: DataFrame, opposites: DataFrame, attribute: str = "state", severity: float = 0.9) -> DataFrame:
    """Entities in two states that exclude each other. ``opposites``: rows (x, y)."""
    own = statements.where(F.col("attribute") == attribute).select("entity", F.lower("value").alias("value")).distinct()
    a, b = own.select("entity", F.col("value").alias("x")), own.select(F.col("entity").alias("e"), F.col("value").alias("y"))
    return a.join(opposites, "x").join(b, (F.col("entity") == F.col("e")) & (b.y == opposites.y)).select("entity", "x", b.y.alias("y"), F.lit(severity).alias("severity"))


def acts_after_end(events: DataFrame, end: str, severity: float = 0.95) -> DataFrame:
    """Events of a subject later than its first event of type ``end``."""
    ends = events.where(F.col("predicate") == end).groupBy("subject").agg(F.min("valid_from").alias("ended"))
    return events.join(ends, "subject").where((F.col("valid_from") > F.col("ended")) & (F.col("predicate") != end)).select("subject", "uuid", "predicate", F.lit(severity).alias("severity"))


def report(violations: DataFrame) -> DataFrame:
    """Per entity the number of violations and the confidence max(0.5, 1 - 0.1 n)."""
    return violations.groupBy("entity").agg(F.count("*").alias("n")).withColumn("confidence", F.round(F.greatest(F.lit(0.5), 1 - 0.1 * F.col("n")), 6))


def out_of_order(events: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
    """Rows (entity, x, y): entities whose first event x comes after their first y, though ``order`` says x before y. ``events``: rows (entity, event, at)."""
    first = events.groupBy("entity", "event").agg(F.min("at").alias("at"))
    out = None
    for x, y in order:
        a, b = first.where(F.col("event") == x).alias("a"), first.where(F.col("event") == y).alias("b")
        found = a.join(b, "entity").where("a.at > b.at").select("entity", F.lit(x).alias("x"), F.lit(y).alias("y"))
        out = found if out is None else out.union(found)
    return out


#: Words of a relation, and words that contradict it (fixed values).
RELATION_OPPOSITES = {
    "朋友": ["敌人", "仇人", "对手", "死敌"],
    "敌人": ["朋友", "盟友", "同伴", "挚友", "好友"],
    "恋人": ["仇人", "敌人", "陌生人", "前任"],
    "夫妻": ["陌生人", "前夫", "前妻", "离婚"],
    "亲人": ["陌生人", "外人"],
    "主人": ["仆人", "奴隶"],
    "同盟": ["敌对", "对立", "敌方"],
    "信任": ["背叛", "欺骗", "不信任"],
}
#: Words that tell of the past and of the future (fixed values).
PAST = ("之前", "以前", "去年", "上个月", "昨天", "曾经", "年前", "月前", "天前")
FUTURE = ("之后", "以后", "明年", "下个月", "明天", "将来", "年后", "月后", "天后")


def relation_conflicts(relations: DataFrame, opposites: dict[str, list[str]] = RELATION_OPPOSITES, severity: float = 0.75) -> DataFrame:
    """Rows (a, b, x, y, severity): different relations x < y stated of a pair, one holding a word and the other a word against it.

    ``relations``: rows (a, b, relation). Words are found inside relations; they meet by an equi-join on the pair and the word.
    """
    own = relations.select("a", "b", "relation").where("relation IS NOT NULL").distinct()

    def holding(words: dict[str, list[str]]) -> DataFrame:
        held = F.array_compact(F.array(*[F.when(_any(F.col("relation"), ws), F.lit(k)) for k, ws in words.items()]))
        return own.select("a", "b", "relation", F.explode(held).alias("word"))

    for_it = holding({k: [k] for k in opposites}).withColumnRenamed("relation", "x")
    met = for_it.join(holding(opposites).withColumnRenamed("relation", "y"), ["a", "b", "word"]).where("x <> y")
    return met.select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().withColumn("severity", F.lit(severity))


def _any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out |= F.contains(text, F.lit(w))
    return out


def denied_acts(acts: DataFrame, denials: DataFrame, severity: float = 0.85) -> DataFrame:
    """Rows (entity, action, denied, severity): an act that holds, or is held by, what its entity said it would not do.

    ``acts``: rows (entity, action); ``denials``: rows (entity, denied). Both count once and need two characters.
    """
    did = acts.select("entity", "action").where("length(action) >= 2").distinct()
    never = denials.select("entity", "denied").where("length(denied) >= 2").distinct()
    met = did.join(never, "entity").where(F.contains("denied", "action") | F.contains("action", "denied"))
    return met.select("entity", "action", "denied", F.lit(severity).alias("severity"))


def tense_conflicts(texts: DataFrame, past: tuple[str, ...] = PAST, future: tuple[str, ...] = FUTURE, severity: float = 0.6) -> DataFrame:
    """Rows (id, date, n_against, severity): texts (id, text) that name a date as past, or as future, and how many others name it as the opposite.

    Counts of each date stand for its pairs, so a date in a third of all texts costs one row of counts. Null texts name nothing.
    """
    date = r"(\d{4})[年/-](\d{1,2})[月/-]?(\d{1,2})?"
    parts = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(date), F.lit(g)).alias(n) for g, n in ((1, "y"), (2, "m"), (3, "d"))])
    named = texts.withColumn("_at", F.explode(F.array_distinct(parts)))
    key = F.concat_ws("-", "_at.y", "_at.m", F.nullif(F.col("_at.d"), F.lit("")))
    said = named.select("id", key.alias("date"), _any(F.col("text"), past).alias("p"), _any(F.col("text"), future).alias("f")).where("p OR f")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counts = said.groupBy("date").agg(one(F.col("p")).alias("np"), one(F.col("f")).alias("nf"), F.count("*").alias("n")).where("np > 0 AND nf > 0")
    # of the other texts: all for one of both tenses, else those of the other tense
    against = F.when(F.col("p") & F.col("f"), F.col("n") - 1).when(F.col("p"), F.col("nf")).otherwise(F.col("np"))
    return said.join(counts, "date").select("id", "date", against.cast("bigint").alias("n_against"), F.lit(severity).alias("severity")).where("n_against > 0")
