"""Removal of long repeated word sequences, found by recompression.

Recompression rewrites a text in rounds: runs of one symbol become one symbol
(block compression), then neighbours whose symbols fall on the left and right
side of a split of the alphabet become one symbol (pair compression). A symbol's
name and side are functions of the words it stands for, so all tasks name
equal runs and pairs equally without asking each other, and equal passages
get equal symbols except near their ends. Each symbol carries the range of
words that decides it: inside that range, equal words always give it.

1. Each window of ``window`` words is represented by the symbol that stands for
   the most words among those decided inside it (a window without one
   represents itself). One Spark exchange of representatives, pre-aggregated,
   finds those that occur twice.
2. Only windows whose representative repeats are compared, by two independent hashes of all
   their words' bytes (96 bits); all but the earliest of equal windows go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import kernels as K
from engramlake.llm import store as S

U = np.uint64
ROUNDS = 5
SECOND_BASE = 0xA24BAED4963EE407 | 1


def symbols(word: np.ndarray, offsets: np.ndarray, rounds: int = ROUNDS):
    """Symbols of all rounds over the words of several texts: name, first word, end, deciding range [low, high)."""
    n = len(word)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    name, first = word, np.arange(n)
    end, low, high = first + 1, first, first + 1
    # words that differ on either side of a border show that two symbols differ
    out = []
    for r in range(rounds):
        if len(name) < 2:
            break
        # runs of equal symbols
        joined = (name[1:] == name[:-1]) & (text[first[1:]] == text[first[:-1]])
        head = np.flatnonzero(np.r_[True, ~joined])
        tail = np.r_[head[1:], len(name)] - 1
        size = tail - head + 1
        run = np.where(size > 1, K.mixed(name[head] * U(0x9FB21C651E98DF25) + size.astype(U)), name[head])
        before, after = np.maximum(head - 1, 0), np.minimum(tail + 1, len(name) - 1)
        # that a run ends here is decided by the next symbol: its first word if that differs, else all of it
        easy = word[np.minimum(end[tail], n - 1)] != word[first[tail]]
        far = np.where(easy, np.minimum(end[tail] + 1, n), high[after])
        easy = word[np.maximum(first[head] - 1, 0)] != word[end[head] - 1]
        near = np.where(easy, np.maximum(first[head] - 1, 0), low[before])
        # a text's border counts as one word beyond it
        starts, ends = offsets[text[first[head]]], offsets[text[first[head]] + 1]
        far = np.where(end[tail] >= ends, ends + 1, far)
        near = np.where(first[head] <= starts, starts - 1, near)
        low, high = np.minimum(low[head], near), np.maximum(high[tail], far)
        name, first, end = run, first[head], end[tail]
        # pairs over the border of the split
        side = (K.mixed(name ^ U(0xC2B2AE3D27D4EB4F * (r + 1) & 0xFFFFFFFFFFFFFFFF)) >> U(33)) & U(1)
        right = np.zeros(len(name), bool)
        right[1:] = (side[:-1] == 0) & (side[1:] == 1) & (text[first[1:]] == text[first[:-1]])
        left = np.r_[right[1:], False]
        # a symbol that stays alone is decided by the neighbour it could have joined
        alone = ~left & ~right
        last, start = end >= offsets[text[first] + 1], first <= offsets[text[first]]
        up = np.where(last, end + 1, np.r_[high[1:], n + 1])
        down = np.where(start, first - 1, np.r_[-1, low[:-1]])
        high = np.where(alone & (side == 0), np.maximum(high, up), high)
        low = np.where(alone & (side == 1), np.minimum(low, down), low)
        at = np.flatnonzero(~right)
        two = left[at]
        second = np.minimum(at + 1, len(name) - 1)
        name = np.where(two, K.mixed(name[at] + K.mixed(name[second] ^ U(0x165667B19E3779F9)) * U(3)), name[at])
        end, high = np.where(two, end[second], end[at]), np.where(two, np.maximum(high[second], high[at]), high[at])
        low = np.where(two, np.minimum(low[at], low[second]), low[at])
        first = first[at]
        out.append((name, first, end, low, high))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.empty(0, t) for t in (U, int, int, int, int))


def representatives(word: np.ndarray, offsets: np.ndarray, window: int, whole: np.ndarray):
    """Of every window that stays in its text: its first word, the name that represents it, and that name's place."""
    n = len(word)
    starts = np.flatnonzero(K.within(offsets, n, window)) if n >= window else np.empty(0, np.int64)
    if not len(starts):
        return starts, np.empty(0, U), starts
    name, first, end, low, high = symbols(word, offsets)
    fits = np.flatnonzero((high - low <= window) & (end - first >= 2))
    a, b = np.maximum(high[fits] - window, 0), low[fits]  # windows that start in [a, b] decide it
    ok = (b >= a) & (b >= 0)
    fits, a, b = fits[ok], a[ok], b[ok]
    size = np.minimum(end[fits] - first[fits], 31).astype(U)
    rank = (size << U(59)) | ((name[fits] >> U(37)) << U(32)) | np.arange(len(fits), dtype=U)
    best = [np.zeros(n + 1, U) for _ in range(window.bit_length())]
    span = b - a + 1
    level = np.floor(np.log2(span)).astype(np.int64) if len(span) else span
    for t in range(len(best)):
        own = level == t
        np.maximum.at(best[t], a[own], rank[own])
        np.maximum.at(best[t], b[own] - (1 << t) + 1, rank[own])
    for t in range(len(best) - 1, 0, -1):
        half = 1 << (t - 1)
        best[t - 1] = np.maximum(best[t - 1], best[t])
        best[t - 1][half:] = np.maximum(best[t - 1][half:], best[t][:-half])
    chosen = best[0][starts]
    at = (chosen & U(0xFFFFFFFF)).astype(np.int64)
    has = chosen > 0
    if not len(fits):
        return starts, whole[starts], starts
    own = fits[np.where(has, at, 0)]
    return starts, np.where(has, name[own], whole[starts]), np.where(has, first[own], starts)


def _words(batch: pa.RecordBatch, window: int):
    """For runs of whole texts: their rows, bytes, word spans, hashes, word offsets and the two hashes of windows."""
    for a, b, data, offsets in K.chunks(batch.column("text")):
        starts, ends, own = K.word_spans(data, offsets)
        word, other = (K.word_hashes(data, starts, ends, base) if len(starts) else np.empty(0, U) for base in (K.BASE, SECOND_BASE))
        n = max(len(word) - window + 1, 0)
        at = np.arange(n)
        one = K.mixed(K.range_hash(K.prefix_hash(word), at, at + window))
        two = K.mixed(K.range_hash(K.prefix_hash(other, SECOND_BASE), at, at + window, SECOND_BASE))
        yield a, b, data, starts, ends, word, own, one, two


def _distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys = batch.column("tkey").to_numpy()
    _, first = np.unique(keys, return_index=True)
    return batch if len(first) == len(keys) else batch.take(pa.array(np.sort(first)))


def _places(names: np.ndarray, owner: np.ndarray, place: np.ndarray):
    """Distinct (name, owner, place); the place holds the word where the symbol starts."""
    order = np.lexsort((place, owner, names))
    names, owner, place = names[order], owner[order], place[order]
    new = np.r_[True, (names[1:] != names[:-1]) | (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])] if len(names) else np.empty(0, bool)
    return names[new], owner[new], place[new]


def symbol_sightings(window: int, parts: int):
    def run(batches):
        for batch in batches:
            batch, found = _distinct(batch), []
            keys = batch.column("tkey").to_numpy()
            for a, b, _, _, _, word, own, one, _ in _words(batch, window):
                starts, name, place = representatives(word, own, window, one)
                new = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (place[1:] != place[:-1])]) if len(name) else starts
                name, place = name[new], place[new]
                doc = np.searchsorted(own, place, "right") - 1
                found.append(_places(name, keys[a:b][doc], place - own[doc]))
            if found:
                yield from S.sightings(parts, *(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def window_entries(window: int, parts: int):
    """Windows whose representative repeats: the earliest of equal ones of a batch travels by hash, the others are known."""

    def run(batches):
        for batch in batches:
            keys, ids, places = batch.column("tkey").to_numpy(), batch.column("lead").fill_null(np.iinfo(np.int64).max).to_numpy(), batch.column("places")
            found = []
            for a, b, _, _, _, word, own, one, two in _words(batch, window):
                starts, _, place = representatives(word, own, window, one)
                wanted = [np.frombuffer(places[i].as_py(), np.uint32).astype(np.int64) + own[i - a] for i in range(a, b)]
                starts = starts[np.isin(place, np.concatenate(wanted))]
                doc = np.searchsorted(own, starts, "right") - 1
                found.append((one[starts], (two[starts] >> U(32)).astype(np.uint32), ids[a:b][doc], keys[a:b][doc], (starts - own[doc]).astype(np.uint32)))
            if not found:
                continue
            one, two, lead, owner, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((place, owner, lead, two, one))
            one, two, lead, owner, place = (x[order] for x in (one, two, lead, owner, place))
            head = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(one) else np.empty(0, bool)
            again = ~head
            again[1:] &= (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
            yield from S.packed(parts, one[head], two[head], lead[head], owner[head], place[head])
            yield from S.aside(parts, S.owned(parts, owner[again], place[again]))

    return run


def later_windows(parts: int):
    """For ``per_owner`` the places of windows that aren't the earliest of their kind."""

    def run(batches):
        here, sure = S.both_kinds(parts, batches)
        one, two, lead, owner, place = S.unpacked(here, U, np.uint32, np.int64, np.int64, np.uint32)
        _, o, p = S.unpacked(sure, U, np.int64, np.uint32)
        if len(one):
            order = np.lexsort((place, owner, lead, two, one))
            one, two, lead, owner, place = (x[order] for x in (one, two, lead, owner, place))
            head = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            size = np.diff(np.r_[head, len(one)])
            later = (owner != np.repeat(owner[head], size)) | (place != np.repeat(place[head], size))
            o, p = np.r_[o, owner[later]], np.r_[p, place[later]]
        yield from S.owned(parts, o, p)

    return run


def _kept(window: int):
    """Per text what stays: with ``places``, the words that no window at one of them covers; else all words."""

    def run(batches):
        for batch in batches:
            rows = []
            cut = "places" in batch.schema.names
            for i, text in enumerate(batch.column("text")):
                words = text.as_buffer().to_pybytes().split()
                n, kept = len(words), words
                if cut:
                    at = np.frombuffer(batch.column("places")[i].as_py(), np.uint32).astype(np.int64)
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:n]) > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rest = b" ".join(kept)
                rows.append((n, n - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode() if cut else ""))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            own = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            if cut:
                yield pa.RecordBatch.from_arrays([batch.column("tkey"), *own], ["tkey", "n_words", "n_removed", "sha256", "kept"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tkey"), own[0], own[2]], ["id", "tkey", "n_words", "sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, id_column: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_words, n_removed and the sha256 of the kept words joined by one space (``with_text``: also ``kept``).

    A word goes if a window of ``window`` words that covers it also starts earlier: in a row of a smaller
    integer id, or further left in the same text. Words are ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have none; texts
    shorter than a window stay; a null id comes last; among rows of one id the order is that of their texts'
    hashes, and equal rows count as one window, so both stay. Other columns are left out; an empty table
    gives an empty one.
    """
    if not 8 <= window <= 31:
        raise ValueError("window must be 8 to 31 words")
    parts = S.n_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    base = S.written(rows.mapInArrow(S.lean(S.short(_kept(window), 10_000, 24 << 20)), "id bigint, tkey bigint, n_words bigint, sha256 string"))
    long_ = F.octet_length("text") >= 2 * window - 1
    lead = base.where(F.col("n_words") >= window).groupBy("tkey").agg(F.min("id").alias("lead"))
    seen = S.exchanged(rows.where(long_).select("tkey", "text").mapInArrow(S.lean(S.short(symbol_sightings(window, parts), 10_000, 24 << 20)), S.PACKED), parts)
    places = S.written(S.per_owner(seen.mapInArrow(S.lean(S.repeated_places(parts)), S.PACKED), parts, np.uint32, ("owner", "places")))
    del seen
    S.settled(docs.sparkSession)
    some = S.key_filter(rows.where(long_), places.select(F.col("owner").alias("tkey")), "tkey")
    wanted = places.join(lead, places.owner == lead.tkey).select("owner", "lead", "places")
    found = S.written(some.join(wanted, (F.col("tkey") == F.col("owner")) & F.col("id").eqNullSafe(F.col("lead"))).select("tkey", "lead", "text", "places"))
    S.settled(docs.sparkSession)
    entries = S.exchanged(found.mapInArrow(S.lean(S.short(window_entries(window, parts), 10_000, 24 << 20)), S.PACKED), parts)
    later = S.written(S.per_owner(entries.mapInArrow(S.lean(later_windows(parts)), S.PACKED), parts, np.uint32, ("owner", "places")))
    del entries
    S.settled(docs.sparkSession)
    texts = found.select("tkey", "text").join(later, F.col("tkey") == F.col("owner")).select("tkey", "text", "places").dropDuplicates(["tkey"])
    cut = texts.mapInArrow(S.lean(S.short(_kept(window), 10_000, 24 << 20)), "tkey bigint, n_words bigint, n_removed bigint, sha256 string, kept string")
    cut = S.written(cut.select("tkey", "n_removed", F.col("sha256").alias("kept_sha256"), *(["kept"] if with_text else [])))
    S.dropped(places, found, later)
    out = base.join(lead, "tkey", "left").join(cut, "tkey", "left")
    # a later copy of a text starts later in every window
    copy = (F.col("n_words") >= window) & ~F.col("id").eqNullSafe(F.col("lead"))
    columns = [
        F.col("id").alias(id_column),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    ]
    if not with_text:
        return out.select(*columns)
    own = rows.select(F.col("id").alias("i"), F.col("tkey").alias("k"), F.col("text").alias("whole")).dropDuplicates(["i", "k"])
    joined = out.join(own, F.col("tkey").eqNullSafe(F.col("k")) & F.col("id").eqNullSafe(F.col("i")))
    words = F.trim(F.regexp_replace("whole", "[\\x20\\x09-\\x0D]+", " "))
    return joined.select(*columns, F.when(copy, "").otherwise(F.coalesce("kept", words)).alias("kept"))
