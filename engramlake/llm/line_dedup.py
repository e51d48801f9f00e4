"""Fuzzy line deduplication by MinHash.

Lines of a text are its parts between line feeds, without the white space around them. Equal lines
are one by hash. Signatures of character shingles are cut into bands (BANDS of ROWS values: lines of
Jaccard similarity 0.8 share one with probability 0.974, of 0.85 with 0.997); lines that share one, and whose
32 one-bit minima agree well enough, are verified by exact Jaccard counts. Union-find
joins them, and the earliest line of each component stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import kernels as K
from engramlake.llm import ngram_join as J
from engramlake.llm import store as S

U = np.uint64
ROWS, BANDS, SHINGLE = 6, 12, 5
#: Of 32 bits: lines of similarity 0.8 differ in 3.2 on average, in more than this with a chance of 1 in 2,000.
UNLIKE = 9
#: A band shared by more lines than this is hot.
HOT = 3
#: Cells of a line's sketch.
CELLS = 128
_chance = np.random.default_rng(20240601)
_TIMES = _chance.integers(1, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_PLUS = _chance.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
FOUND = "kind tinyint, x bigint, y bigint, slack tinyint, n int, z bigint"


def lines(data: np.ndarray, offsets: np.ndarray):
    """Code points of several UTF-8 texts, and of their lines: text, number in it, first and end code point without outer white space."""
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    own = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    feed = np.flatnonzero(code == 10)
    start, end = np.sort(np.r_[own[:-1], feed + 1]), np.sort(np.r_[feed, own[1:]])
    count = np.searchsorted(feed, own[1:]) - np.searchsorted(feed, own[:-1]) + 1
    text = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    solid = np.flatnonzero(~((code == 32) | ((code >= 9) & (code <= 13))))
    if len(solid):
        a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
        start, end = np.where(b > a, solid[np.minimum(a, len(solid) - 1)], start), np.where(b > a, solid[b - 1] + 1, start)
    else:
        end = start
    return code, text, number, start, end


def shingles(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of lines of at least SHINGLE code points, and where each line's begin."""
    size = end - start - SHINGLE + 1
    n = len(prefix) - SHINGLE
    all_ = (prefix[SHINGLE:] - prefix[:n]) * K.powers(len(prefix), pow(K.BASE, -1, 1 << 64))[:n]
    return K.mixed(all_[K.ranges(start, size)]), np.cumsum(size) - size


def distinct(shingle: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's hashes sorted, without repeats, and their offsets. Sorts in place."""
    ends = np.append(cut[1:], len(shingle))
    for s, e in zip(cut.tolist(), ends.tolist(), strict=True):
        shingle[s:e].sort()
    new = np.ones(len(shingle), bool)
    new[1:] = shingle[1:] != shingle[:-1]
    new[cut] = True
    return shingle[new], np.r_[0, np.cumsum(new)][np.r_[cut, len(shingle)]]


def signatures(shingle: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (BANDS x lines) and 32 one-bit minima of lines."""
    h = (shingle >> U(32)).astype(np.uint32)
    x = np.empty_like(h)
    bits, out = np.zeros(len(cut), np.uint32), np.empty((BANDS, len(cut)), U)
    for band in range(BANDS):
        total = np.full(len(cut), band + 1, U)
        for k in range(band * ROWS, (band + 1) * ROWS):
            # odd factor and offset: a permutation of 32-bit numbers
            np.multiply(h, _TIMES[k], out=x)
            np.add(x, _PLUS[k], out=x)
            least = np.minimum.reduceat(x, cut)
            if k < 32:
                bits |= ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)) << np.uint32(k)
            total = K.mixed(total * U(K.BASE) + least)
        out[band] = total
    return out, bits


def _seen(min_chars: int, parts: int):
    """Band entries of this batch's different lines; aside, where each line is first and again."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("id").fill_null(np.iinfo(np.int64).max).to_numpy(), batch.column("rkey").to_numpy()
            place, known = [], set()
            for a, b, data, offsets in K.chunks(batch.column("text")):
                code, text, number, start, end = lines(data, offsets)
                keep = end - start >= max(min_chars, 1)
                text, number, start, end = text[keep], number[keep], start[keep], end[keep]
                if not len(text):
                    continue
                prefix = K.prefix_hash(code)
                name = K.named(code, prefix, start, end)
                place.append((name, ids[a:b][text], keys[a:b][text], number.astype(np.uint32)))
                _, first = np.unique(name, return_index=True)
                first = first[(end - start)[first] >= SHINGLE]  # shorter lines have no shingles: equal or not
                first = first[[x not in known and not known.add(x) for x in name[first].tolist()]]
                if len(first):
                    band, bits = signatures(*shingles(prefix, start[first], end[first]))
                    yield from S.packed(parts, band.reshape(-1), np.tile(name[first], BANDS).view(np.int64), np.tile(bits, BANDS))
            if not place:
                continue
            name, doc, key, number = (np.concatenate(x) for x in zip(*place, strict=True))
            order = np.lexsort((number, key, doc, name))
            name, doc, key, number = (x[order] for x in (name, doc, key, number))
            head = np.r_[True, name[1:] != name[:-1]]
            again = ~head
            # the first of equal lines travels by hash; the others go whatever comes
            state = np.where(head, 0, 1).astype(np.uint8)
            again[1:] &= (key[1:] != key[:-1]) | (number[1:] != number[:-1])
            rows = head | again
            yield from S.aside(parts, S.packed(parts, name[rows], doc[rows], key[rows], number[rows], state[rows]))

    return run


def _joined(parts: int):
    """Rows of kinds 0 to 2 of ``ngram_join.candidates``, 3 the first of equal lines (line, row key, number, id), 4 lines to drop (row key in y, number in n)."""
    names = [x.split()[0] for x in FOUND.split(", ")]

    def told(kind, x, y, z, n):
        for a in range(0, len(x), 50000):
            m = len(x[a : a + 50000])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), *(pa.array(c[a : a + 50000]) for c in (x, y)), pa.array(np.zeros(m, np.int8)), pa.array(n[a : a + 50000].astype(np.int32)), pa.array(z[a : a + 50000])], names)

    def run(batches):
        here, there = S.both_kinds(parts, batches)
        sig, sid, bits = S.unpacked(here, U, np.int64, np.uint32)
        del here
        for b in J.candidates(sig, sid, np.full(len(sig), -1, np.int8), bits, UNLIKE, HOT):
            m = len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(m, np.int64))], names)
        del sig, sid, bits
        name, doc, key, number, state = S.unpacked(there, U, np.int64, np.int64, np.uint32, np.uint8)
        order = np.lexsort((state, number, key, doc, name))
        name, doc, key, number, state = (x[order] for x in (name, doc, key, number, state))
        if not len(name):
            return
        head = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
        size = np.diff(np.r_[head, len(name)])
        first = np.repeat(head, size)
        drop = (key != key[first]) | (number != number[first])
        new = np.r_[True, (key[1:] != key[:-1]) | (number[1:] != number[:-1]) | (name[1:] != name[:-1])]
        drop &= new
        yield from told(3, name[head].view(np.int64), key[head], doc[head], number[head])
        yield from told(4, name[drop].view(np.int64), key[drop], doc[drop], number[drop])

    return run


def _sets(batches):
    """Rows (set_id, size, sketch, members) of the lines named in ``wanted``: (number, set_id) pairs of a text; a set's members are the line."""
    for batch in batches:
        wanted = batch.column("wanted")
        first = np.r_[0, np.cumsum(pa.compute.list_value_length(wanted).to_numpy())]
        pairs = wanted.flatten()
        number, name = (pairs.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "x"))
        for a, b, data, offsets in K.chunks(batch.column("text")):
            code, text, _, start, end = lines(data, offsets)
            at = np.searchsorted(text, np.repeat(np.arange(b - a), np.diff(first[a : b + 1]))) + number[first[a] : first[b]]
            if not len(at):
                continue
            h, own = distinct(*shingles(K.prefix_hash(code), start[at], end[at]))
            sketches = [J.sketch(h[s:e], CELLS) for s, e in zip(own[:-1], own[1:], strict=True)]
            # a line is smaller than its hashes
            members = [code[s:e].tobytes().decode("utf-32-le").encode() for s, e in zip(start[at], end[at], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(name[first[a] : first[b]]), pa.array(np.diff(own)), pa.array(sketches, pa.binary()), pa.array(members, pa.binary())], ["set_id", "size", "sketch", "members"])


def _read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sets of whole lines."""
    data, offsets = K.buffers(column)
    own = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return distinct(*shingles(K.prefix_hash(code), own[:-1], own[1:]))


def _cut(batches):
    """Texts without the lines numbered in ``gone``."""
    for batch in batches:
        rows = []
        for key, text, gone in zip(batch.column("rkey").to_pylist(), batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            drop = set(gone)
            kept = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
            rows.append((key, len(drop), hashlib.sha256(kept.encode()).hexdigest(), kept))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["rkey", "n_removed", "kept_sha256", "kept"])


def dedup_lines(docs: DataFrame, percent: int = 80, min_chars: int = 15, id_column: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_lines, n_removed and the sha256 of the text that stays; ``with_text``: all columns of ``docs`` and n_lines, n_removed, kept.

    A line goes if its component, joined by lines whose sets of 5-character shingles have a Jaccard similarity of
    ``percent`` / 100 or more, holds an earlier one: in a row of a smaller id (null last, ties by the row's hash), or further up. Lines of
    fewer than ``min_chars`` code points, and blank ones, stay and join nothing; those under five join equal ones only. Null texts are empty (one empty line); fully equal
    rows (id and text) count as one and lose the same lines; an empty table gives an empty one.
    """
    parts = S.n_partitions(docs.sparkSession)
    whole = F.coalesce(F.col(text), F.lit(""))
    key = F.xxhash64(F.col(id_column).cast("bigint"), whole)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), whole.alias("text"), key.alias("rkey"))
    seen = S.exchanged(rows.mapInArrow(S.lean(S.short(_seen(min_chars, parts))), S.PACKED), parts)
    found = S.written(seen.mapInArrow(S.lean(_joined(parts)), FOUND))
    del seen
    S.settled(docs.sparkSession)
    first = found.where("kind = 3").select("x", F.col("y").alias("k"), F.col("z").alias("doc"), "n")

    def members(ids: DataFrame) -> DataFrame:
        own = first.join(ids, F.col("x") == F.col("set_id"), "left_semi").groupBy("k").agg(F.collect_list(F.struct("n", "x")).alias("wanted"))
        own = S.written(own, small=True)
        some = S.key_filter(rows, own.select(F.col("k").alias("rkey")), "rkey").join(own, F.col("rkey") == F.col("k")).select("text", "wanted")
        return S.kept(some.mapInArrow(S.lean(S.short(_sets)), "set_id bigint, size bigint, sketch binary, members binary"))

    _, roots = J.linked(found, members, None, percent, parts, _read, small=True)
    S.settled(docs.sparkSession)
    near = first.join(roots, F.col("x") == F.col("node"))
    least = near.groupBy("root").agg(F.min(F.struct("doc", "k", "n")).alias("least"))
    near = near.join(least, "root").where(F.struct("doc", "k", "n") != F.col("least")).select("k", "n")
    gone = found.where("kind = 4").select(F.col("y").alias("k"), "n").union(near)
    gone = S.kept(gone.groupBy("k").agg(F.array_distinct(F.collect_list("n")).alias("gone")))
    some = S.key_filter(rows, gone.select(F.col("k").alias("rkey")), "rkey")
    cut = some.join(gone, F.col("rkey") == F.col("k")).select("rkey", "text", "gone").mapInArrow(S.lean(S.short(_cut)), "rkey bigint, n_removed bigint, kept_sha256 string, kept string")
    cut = S.written((cut if with_text else cut.drop("kept")).withColumnRenamed("rkey", "k").dropDuplicates(["k"]))
    S.dropped(found, gone)
    n_lines = (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    removed = F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed")
    if with_text:
        plain = docs.drop("n_lines", "n_removed", "kept", "rkey", "k").select("*", key.alias("rkey"), n_lines.alias("n_lines"))
        return plain.join(cut.drop("kept_sha256"), F.col("rkey") == F.col("k"), "left").withColumns({"n_removed": removed, "kept": F.coalesce("kept", whole)}).drop("rkey", "k")
    base = docs.select(F.col(id_column), key.alias("rkey"), n_lines.alias("n_lines"), F.sha2(whole, 256).alias("sha256"))
    return base.join(cut, F.col("rkey") == F.col("k"), "left").select(id_column, "n_lines", removed, F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
