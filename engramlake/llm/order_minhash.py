"""Document fingerprints by Order MinHash, in DataFrame operations only.

The k-mers are runs of K words. Repeats of a k-mer in a text are numbered, so each occurrence is one
element. A fingerprint has SLOTS slots; each takes the two least elements of its own order, puts them in the order in
which they stand in the text, and hashes that pair. Two texts agree on a slot only if they share the k-mers
and their order, so likeness follows edit distance more closely than a set's MinHash does.

A slot's order is that of the elements' hashes on a ring, from the slot's own point on: the least two are
the first two that follow the point, so a text of two k-mers or more fills each slot with two. Any two elements are
equally likely to be a slot's least, as under a random permutation; one sort serves all slots, since no slot
needs more than the least two elements of each arc between points.

The rows of a text's k-mers stay in the task that holds the text: numbering and minima need no
exchange beyond the one that brings texts and their neighbours together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm.store import written

#: Words of a k-mer; slots of a fingerprint, a power of two.
K, SLOTS = 2, 32
_ARC_BITS = SLOTS.bit_length() - 1


def elements(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows (keys, e, at): a hash and the place of each numbered k-mer. ``keys`` name a row.

    A text of fewer than K words is one k-mer, its whole string, and only an empty one has none.
    """
    words = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    kmers = (
        F.when(F.col(text) == "", F.array().cast("array<bigint>"))
        .when(F.size("_w") < K, F.array(F.xxhash64(F.col(text))))
        .otherwise(F.transform(F.slice("_w", F.lit(1), F.size("_w") - (K - 1)), lambda w, i: F.xxhash64(w, *[F.get("_w", i + j) for j in range(1, K)])))
    )
    rows = texts.select(*keys, text).withColumn("_w", words).select(*keys, F.posexplode(kmers).alias("_at", "_kmer"))
    # the n-th occurrence of a k-mer is an element of its own
    number = F.row_number().over(Window.partitionBy(*keys, "_kmer").orderBy("_at"))
    return rows.select(*keys, F.xxhash64("_kmer", number).alias("_e"), "_at")


def slots(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows (keys, slots): SLOTS hashes of ordered pairs. A text of one k-mer has that in each slot; one without any has no row.

    No exchange is needed if ``texts`` is dealt by some of ``keys``.
    """
    # the high bits of an element's hash name the arc between two slots' points that it falls in
    rows = elements(texts, keys, text).withColumn("_arc", F.shiftrightunsigned("_e", 64 - _ARC_BITS).cast("int"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_arc").orderBy("_e", "_at"))
    least = rows.withColumn("_nth", nth).where("_nth <= 2")
    ring = least.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_arc", "_e", "_at"))).alias("_ring"))
    n = F.size("_ring")
    first = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.size(F.filter("_ring", lambda x: x["_arc"] < s)))

    def tuple_hash(a: Column, b: Column) -> Column:
        return F.when(n == 1, F.hash(a["_e"])).when(a["_at"] < b["_at"], F.hash(a["_e"], b["_e"])).otherwise(F.hash(b["_e"], a["_e"]))

    own = F.transform("_first", lambda i: tuple_hash(F.get("_ring", i % n), F.get("_ring", (i + 1) % n)))
    return ring.withColumn("_first", first).select(*keys, own.alias("slots"))


def likeness(a: str, b: str) -> Column:
    """Share of slots that agree; 1 if neither text has any, 0 if only one has."""
    x, y = F.col(a), F.col(b)
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda s: s))
    return F.when(x.isNull() & y.isNull(), 1.0).when(x.isNull() | y.isNull(), 0.0).otherwise(same / SLOTS).cast("double")


def as_string(slots: str) -> Column:
    """Eight hex digits a slot, in order; an empty string where there are none."""
    own = F.transform(slots, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint").bitwiseAND(0xFFFFFFFF))), 8, "0"))
    return F.coalesce(F.array_join(own, ""), F.lit(""))


def _in_order(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Rows (g, id, text): ranges g of ids, one after the other; rows of one range are in one task.

    The borders of ranges are approximate quantiles of the ids: a bounded list, whatever the table's size.
    """
    parts = 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = 4 * parts
    borders = sorted({int(x) for x in rows.approxQuantile("id", [i / n for i in range(1, n)], 1 / (4 * n))})
    return rows.select(_range_of("id", borders).alias("g"), "id", "text").repartition(parts, "g")


def _range_of(column: str, borders: list[int]) -> Column:
    """How many of the sorted ``borders`` are at or below the value: a binary search in one array, a step of it per power of two."""
    if not borders:
        return F.when(F.col(column).isNull(), F.lit(1)).otherwise(F.lit(0))
    all_ = F.split(F.lit(",".join(map(str, borders))), ",").cast("array<bigint>")  # folded to one constant
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(borders).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(all_, at + step - 1) <= F.col(column), at + step).otherwise(at))
    # never null, so no join adds a filter that would part two uses of one exchange
    return F.coalesce(F.when(F.col(column).isNull(), F.lit(len(borders) + 1)).otherwise(found), F.lit(0))


def _after(rows: DataFrame, first: str, value: str) -> DataFrame:
    """Rows (g, after): what the ``first`` row of the next filled range has as ``value``, in a struct; the last range's next is the first."""
    lead = rows.where(first).select("g", F.struct(F.col(value)).alias("after"))
    # one small number a range: the order of the ranges is settled without their values
    along = Window.orderBy("g")
    around = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = lead.select("g").select("g", F.coalesce(F.lead("g").over(along), F.first("g").over(around)).alias("k"))
    return order.join(lead.withColumnRenamed("g", "k"), "k").select("g", "after")


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with the first floor(n_chars / 2) code points (or all) of the next row's text in place of its own last
    ones. Rows follow in ascending id, null ids last, rows of one id by their texts' hashes; after the last comes the first, so
    a single row is its own next. Null texts are empty, and two empty texts are alike (1.0). Repeated rows follow one another and are
    each returned; other columns are left out; an empty table gives an empty one.
    """
    # rows that are equal in all of it are equal altogether: any order of them will do
    along = Window.partitionBy("g").orderBy(F.col("id").asc_nulls_last(), F.xxhash64("text"))
    rows = _in_order(docs, id_column, text).withColumns({"n": F.row_number().over(along), "inner": F.lead(F.struct("text")).over(along)})
    half = F.floor(F.length("text") / 2).cast("int")
    both = rows.join(_after(rows, "n = 1", "text"), "g").withColumn("head", F.coalesce("inner", "after")["text"])
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("head", F.lit(1), half))
    both = both.select("g", "n", "id", "text", edited.alias("edited"))
    # text 2n is the row's own, 2n + 1 the edited one
    variants = F.explode(F.array(*[F.struct((F.col("n") * 2 + v).alias("v"), F.col(c).alias("t")) for v, c in enumerate(("text", "edited"))])).alias("x")
    found = slots(both.select("g", variants).select("g", "x.v", "x.t"), ["g", "v"], "t")
    # the two fingerprints of a row come together in its own task
    own, new = (F.max(F.when(F.col("v") % 2 == v, F.col("slots"))).alias(name) for v, name in enumerate(("own", "new")))
    found = found.groupBy("g", F.floor(F.col("v") / 2).cast("int").alias("n")).agg(own, new)
    plain = both.select("g", "n", "id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"))
    out = plain.join(found, ["g", "n"], "left").withColumn("next", F.lead(F.struct("own")).over(Window.partitionBy("g").orderBy("n")))
    out = written(out)
    out = out.join(_after(out, "n = 1", "own"), "g").withColumn("next", F.coalesce("next", "after")["own"])
    return out.select(F.col("id").alias(id_column), "n_chars", "edited_sha256", as_string("own").alias("fingerprint"), as_string("new").alias("edited_fingerprint"), likeness("own", "new").alias("near_edited"), likeness("own", "next").alias("near_next"))
