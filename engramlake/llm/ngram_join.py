"""Exact Jaccard self-join of word-shingle sets by universe partition.

Two sets of sizes a and b are similar to at least ``threshold`` t only if their symmetric difference
is at most (1 - t) / (1 + t) * (a + b). So, by the pigeonhole principle, if a hash
deals the universe of shingles to m segments, similar sets agree on some segment,
or differ there by one shingle, as the allocation below demands:

* Sets are grouped in bands of sizes; a band has its own segments. A set joins
  its own band and, as a guest, each higher band that may hold a partner.
* A band's *exact* segments index the subset itself (worth 1), its *deletion* segments the
  subset and all its one-deletion neighbours (worth 2). What they are worth together exceeds the
  band's largest difference by a slack; the cheapest allocation is chosen by its cost: signatures sent, and
  the share of sets whose empty segments use up the slack.
* Empty subsets are never indexed: the slack pays for them. Sets with more empty segments than
  slack meet in a space of their own.
* Subsets held by very many sets (hot) are paid from what slack is left, too. Only sets whose slack
  doesn't suffice are compared there: first with one leader each, then, once linked
  sets are one component, across components.
* Links inside a component that hot subsets hide are counted in the end: its sets that hold any
  are compared block by block, each pair once, and only counts leave the blocks.

Equal sets are one before anything travels. Candidates are verified by exact counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.llm import kernels as K
from engramlake.llm import store as S
from engramlake.llm.components import components

U = np.uint64
#: A subset held by more sets than this is hot.
HOT = 12
FOUND = "kind tinyint, x bigint, y bigint, slack tinyint, n int"
#: Cells of a set's sketch, four bits each.
CELLS = 1024
#: Sets of a hot signature that one task compares with as many others.
BLOCK = 4096
#: Sets, and their shingles, of a component that one task counts links with as many others.
COUNT_SETS, COUNT_SHINGLES = 1024, 1 << 20
_SPACE = U(0xB5AD4ECEDA1CE2A9)


def shingle_sets(column: pa.Array, k: int = 5):
    """For runs of whole texts: first row, end row, all sets' hashes one after the other (each sorted, distinct), offsets.

    A text's set holds its k-word shingles, words lower-cased (A-Z); with fewer words the whole
    sequence as one; without words it is empty.
    """
    for a, b, data, offsets in K.chunks(column):
        data = K.lowered(data)
        starts, ends, own = K.word_spans(data, offsets)
        n = len(starts)
        if not n:
            yield a, b, np.empty(0, U), np.zeros(b - a + 1, np.int64)
            continue
        prefix = K.prefix_hash(K.word_hashes(data, starts, ends))
        words = np.diff(own)
        short = (words > 0) & (words < k)
        count = np.where(short, 1, np.maximum(words - k + 1, 0))
        first = K.ranges(own[:-1], count)
        size = np.repeat(np.where(short, words, k), count)
        h = K.mixed(K.range_hash(prefix, first, first + size) ^ (size.astype(U) * _SPACE))
        cut = np.r_[0, np.cumsum(count)]
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if e - s > 1:
                h[s:e].sort()
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        new[cut[:-1][count > 0]] = True
        yield a, b, h[new], np.r_[0, np.cumsum(new)][cut]


def set_ids(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One int64 for equal sets; 0 for empty ones."""
    size = np.diff(offsets)
    total = np.r_[U(0), np.cumsum(K.mixed(h + _SPACE))]
    out = K.mixed(total[offsets[1:]] - total[offsets[:-1]] + size.astype(U) * U(K.BASE))
    return np.where(size > 0, out, U(0)).view(np.int64)


@lru_cache(maxsize=4096)
def allocation(low: int, high: int, percent: int) -> tuple[int, int, int]:
    """(exact segments, deletion segments, slack) of the band of sizes low..high: the cheapest by cost."""
    worst = (100 - percent) * 2 * high // (100 + percent)
    best = None
    for more in np.unique(np.linspace(0, 14 + worst // 8, 64).astype(int)).tolist():
        for deletions in {0, 1, 2, 3, (worst + 1 + more) // 2, (worst + 2 + more) // 2}:
            exact = max(worst + 1 + more - 2 * deletions, 0)
            m, slack = exact + deletions, exact + 2 * deletions - worst - 1
            if slack < 0 or m < 1:
                continue
            empty = (1 - 1 / m) ** low
            nearly = empty + low / m * (1 - 1 / m) ** (low - 1)
            mean, var = exact * empty + 2 * deletions * nearly, exact * empty * (1 - empty) + 4 * deletions * nearly * (1 - nearly)
            # signatures of a set, and a price on those that lack slack (a normal tail)
            z = (slack + 0.5 - mean) / sqrt(var + 1e-9)
            lacking = 1.0 if z < 0 else 0.5 * np.exp(-0.5 * z * z)
            cost = m + deletions * low / m + lacking * 40 * m
            if best is None or cost < best[0]:
                best = (cost, exact, deletions, slack)
    _, exact, deletions, slack = best
    # what is spare pays for hot subsets
    more = 0 if deletions else exact // 16
    return exact + more, deletions, slack + more


@lru_cache(maxsize=8)
def bands(largest: int, percent: int) -> tuple[tuple[int, int], ...]:
    """Bands of sizes, each about 1.4 times the one below; the least sizes that can have a different partner come first."""
    out, low = [], ceil(percent / (100 - percent)) if percent < 100 else 1
    while low <= largest or not out:
        high = max(low, int(low * 1.4))
        out.append((low, high))
        low = high + 1
    return tuple(out)


def signatures(h: np.ndarray, offsets: np.ndarray, percent: int):
    """Signatures of sets: (signature with the band in its low 6 bits, set's row, slack left)."""
    sizes = np.diff(offsets)
    if not len(sizes) or percent >= 100:
        return
    for number, (low, high) in enumerate(bands(int(sizes.max()), percent)):
        rows = np.flatnonzero((sizes <= high) & (100 * sizes >= percent * low))
        if not len(rows):
            continue
        exact, deletions, slack = allocation(low, high, percent)
        m = exact + deletions
        seed = U((number + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        own = h[K.ranges(offsets[rows], sizes[rows])]
        segment = ((K.mixed(own ^ seed) >> U(32)) * U(m) >> U(32)).astype(np.int64)
        cell = np.repeat(np.arange(len(rows)) * m, sizes[rows]) + segment
        value = K.mixed(own + seed)
        total = np.zeros(len(rows) * m, U)
        np.add.at(total, cell, value)
        count = np.bincount(cell, minlength=len(rows) * m)
        at = np.tile(np.arange(m), len(rows))
        salt = at.astype(U) * U(K.BASE) + seed
        few = count.reshape(len(rows), m)
        lost = (few[:, :exact] == 0).sum(1) + 2 * (few[:, exact:] <= 1).sum(1)
        left = np.clip(slack - lost, -1, 100).astype(np.int8)
        band, mask = U(number), ~U(63)
        full = np.flatnonzero(count)
        yield (K.mixed(total[full] + salt[full]) & mask) | band, rows[full // m], left[full // m]
        if deletions:
            some = np.flatnonzero((segment >= exact) & (count[cell] >= 2))
            yield (K.mixed(total[cell[some]] - value[some] + salt[cell[some]]) & mask) | band, rows[cell[some] // m], left[cell[some] // m]
        if (lost > slack).any():
            poor = np.flatnonzero(np.repeat(lost > slack, m) & (count <= np.where(at >= exact, 1, 0)))
            yield (K.mixed(salt[poor] ^ _SPACE) & mask) | band, rows[poor // m], left[poor // m]


def _described(k: int):
    """Rows (id, tkey, n_shingles, set_id)."""

    def run(batches):
        for batch in batches:
            sizes, ids = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for a, b, h, offsets in shingle_sets(batch.column("text"), k):
                sizes[a:b], ids[a:b] = np.diff(offsets), set_ids(h, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tkey"), pa.array(sizes), pa.array(ids)], ["id", "tkey", "n_shingles", "set_id"])

    return run


def _indexed(k: int, percent: int, parts: int):
    def run(batches):
        for batch in batches:
            seen: set[int] = set()
            for _, _, h, offsets in shingle_sets(batch.column("text"), k):
                ids = set_ids(h, offsets)
                fresh = np.array([i not in seen and not seen.add(i) and i != 0 for i in ids.tolist()], bool)
                rows = np.flatnonzero(fresh)
                if not len(rows):
                    continue
                sizes = np.diff(offsets)[rows]
                own, at = h[K.ranges(offsets[rows], sizes)], np.r_[0, np.cumsum(sizes)]
                parts_ = [(s, ids[rows][r], left) for s, r, left in signatures(own, at, percent)]
                if parts_:
                    yield from S.packed(parts, *(np.concatenate(x) for x in zip(*parts_, strict=True)))

    return run


def _candidates(batches):
    yield from candidates(*S.unpacked(batches, U, np.int64, np.int8))


def candidates(sig: np.ndarray, sid: np.ndarray, slack: np.ndarray, bits: np.ndarray | None = None, unlike: int = 0, hot_from: int = HOT):
    """Rows (kind, x, y, slack, n): 0 pairs of sets of one band, their larger slack, and signatures shared here (times 64,
    plus the band); 1 a hot signature and a set that holds it; 2 pairs of chance neighbours of one hot group.

    With ``bits``, only pairs that differ in at most ``unlike`` of them. Groups of more than ``hot_from`` sets are hot.
    """
    if not len(sig):
        return

    def told(left, right):
        x, y = sid[left], sid[right]
        band, most = (sig[left] & U(63)).astype(np.int64), np.maximum(slack[left], slack[right])
        if bits is not None:
            ok = np.bitwise_count(bits[left] ^ bits[right]) <= unlike
            x, y, band, most = x[ok], y[ok], band[ok], most[ok]
        return np.minimum(x, y), np.maximum(x, y), band, most

    def rows_of(kind, pairs):
        x, y, band, most = (np.concatenate(c) for c in zip(*pairs, strict=True))
        order = np.lexsort((band, y, x))
        x, y, band, most = x[order], y[order], band[order], most[order]
        cut = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (band[1:] != band[:-1])]) if len(x) else np.empty(0, np.int64)
        n = np.diff(np.r_[cut, len(x)])
        for a in range(0, len(cut), 50000):
            c, m = cut[a : a + 50000], n[a : a + 50000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), kind, np.int8)), pa.array(x[c]), pa.array(y[c]), pa.array(most[c]), pa.array((m * 64 + band[c]).astype(np.int32))], names)

    names = [x.split()[0] for x in FOUND.split(", ")]
    # most signatures are held once
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    shared = np.zeros(len(sig), bool)
    same = sig[1:] == sig[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    sig, order = sig[shared], order[shared]
    sid, slack, bits = sid[order], slack[order], bits[order] if bits is not None else None
    order = np.lexsort((sid, sig))
    sig, sid, slack, bits = sig[order], sid[order], slack[order], bits[order] if bits is not None else None
    new = np.r_[True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])] if len(sig) else np.empty(0, bool)
    sig, sid, slack, bits = sig[new], sid[new], slack[new], bits[new] if bits is not None else None
    cut = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, np.int64)
    size = np.diff(np.r_[cut, len(sig)])
    pairs = []
    for gap in range(1, hot_from):
        own = (size > gap) & (size <= hot_from)
        if not own.any():
            break
        left = K.ranges(cut[own], size[own] - gap)
        pairs.append(told(left, left + gap))
    hot = size > hot_from
    if hot.any():
        # chance neighbours, others for each signature; where sets share many of them, a quarter will do
        rows = K.ranges(cut[hot], size[hot])
        near = rows[np.lexsort((K.mixed(sid[rows].view(U) ^ K.mixed(sig[rows])), sig[rows]))]
        seeds = []
        for gap in (1,) if bits is None else (1, 2):
            left = K.ranges(np.cumsum(size[hot]) - size[hot], size[hot] - gap)
            if bits is None:
                left = left[(K.mixed(sig[near[left]]) & U(3)) == 0]
            seeds.append(told(near[left], near[left + gap]))
        yield from rows_of(2, seeds)
        for a in range(0, len(rows), 50000):
            r = rows[a : a + 50000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(r), np.int8)), pa.array(sig[r].view(np.int64)), pa.array(sid[r]), pa.array(slack[r]), pa.array(np.zeros(len(r), np.int32))], names)
    if pairs:
        yield from rows_of(0, pairs)


def sketch(h: np.ndarray, cells: int = CELLS) -> bytes:
    """Members by hash cells, counted up to 15: differences of these counts never exceed those of the sets."""
    count = np.minimum(np.bincount((h >> U(7)).astype(np.int64) & (cells - 1), minlength=cells), 15).astype(np.uint8)
    return (count[::2] | count[1::2] << 4).tobytes()


def unsketched(column: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)
    return np.concatenate([packed & 15, packed >> 4], 1).view(np.int8)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric difference of sets, row by row."""
    return np.abs(x - y).sum(1, dtype=np.int64)


def _sketches(k: int):
    """Rows (tkey, id, size, sketch)."""

    def run(batches):
        for batch in batches:
            for a, b, h, offsets in shingle_sets(batch.column("text"), k):
                cells = [sketch(h[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("tkey").slice(a, b - a), batch.column("id").slice(a, b - a), pa.array(np.diff(offsets)), pa.array(cells, pa.binary())], ["tkey", "id", "size", "sketch"])

    return run


def _possible(percent: int):
    """Pairs whose cell counts alone don't already differ by more than similar sets can."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, y = (unsketched(batch.column(c).to_pylist()) for c in ("sa", "sb"))
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            mask = pa.array((100 + percent) * apart(x, y) <= (100 - percent) * total)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _verified(percent: int, read: Callable):
    def run(batches):
        for batch in batches:
            for s in range(0, len(batch), 500):
                part = batch.slice(s, 500)
                (x, p), (y, q) = read(part.column("ma")), read(part.column("mb"))
                keep = np.zeros(len(part), bool)
                for i in range(len(part)):
                    both = np.concatenate([x[p[i] : p[i + 1]], y[q[i] : q[i + 1]]])
                    both.sort()
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[i] = 100 * common >= percent * (len(both) - common)
                mask = pa.array(keep)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], ["a", "b"])

    return run


def _across(percent: int, read: Callable | None):
    """Of rows sorted by (sig, low, high): possible pairs (a, b) of one group, of different roots and, if low < high, blocks.

    With ``read``, pairs are verified and only those are told that join what nothing told before has joined.
    """

    def possible(group: pa.Table):
        own, root, ids, size = (group.column(c).to_numpy() for c in ("own", "root", "set_id", "size"))
        if (root == root[0]).all():
            return
        cells = unsketched(group.column("sketch").to_pylist())
        blocks = (own != own[0]).any()
        for i in range(len(ids) - 1):
            js = np.arange(i + 1, len(ids))
            js = js[root[js] != root[i]]
            js = js[100 * np.minimum(size[js], size[i]) >= percent * np.maximum(size[js], size[i])]
            if blocks:
                js = js[own[js] != own[i]]
            if len(js):
                js = js[(100 + percent) * apart(cells[js], cells[i]) <= (100 - percent) * (size[js] + size[i])]
            if len(js):
                yield i, js

    def compared(group: pa.Table):
        ids = group.column("set_id").to_numpy()
        if read is None:
            for i, js in possible(group):
                yield np.minimum(ids[js], ids[i]), np.maximum(ids[js], ids[i])
            return
        sets, joined = None, group.column("root").to_numpy().copy()
        for i, js in possible(group):
            sets = sets or read(group.column("members").combine_chunks())
            for j in js.tolist():
                if joined[i] == joined[j]:
                    continue
                h, at = sets
                both = np.concatenate([h[at[i] : at[i + 1]], h[at[j] : at[j + 1]]])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= percent * (len(both) - common):
                    joined[joined == joined[j]] = joined[i]
                    yield np.array([min(ids[i], ids[j])]), np.array([max(ids[i], ids[j])])

    def run(batches):
        for groups in _groups(batches, "sig", "low", "high"):
            found = [p for group in groups for p in compared(group)]
            if found:
                p = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["a", "b"])

    return run


def _common(h: np.ndarray, at: np.ndarray, g: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """How many members each set of (hashes ``h``, offsets ``at``) shares with each of (``g``, ``bt``)."""
    n, m = len(at) - 1, len(bt) - 1
    _, key = np.unique(np.concatenate([h, g]), return_inverse=True)
    key, other = key[: len(h)], key[len(h) :]
    row, column = np.repeat(np.arange(n), np.diff(at)), np.repeat(np.arange(m), np.diff(bt))
    many = int(max(key.max(initial=-1), other.max(initial=-1))) + 1
    held, holds = np.bincount(key, minlength=many), np.bincount(other, minlength=many)
    out = np.zeros(n * m, np.int32)
    # members that few sets hold: pair by pair
    dense = held * holds > n * m // 64
    own = np.flatnonzero((holds[key] > 0) & ~dense[key])
    order = np.argsort(other, kind="stable")
    first = np.cumsum(holds) - holds
    ends = np.cumsum(holds[key[own]])
    a = 0
    while a < len(own):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 21), "right")))
        part = own[a:b]
        count = holds[key[part]]
        np.add.at(out, np.repeat(row[part] * m, count) + column[order[K.ranges(first[key[part]], count)]], 1)
        a = b
    # those that many hold: products of 0/1 matrices
    out = out.reshape(n, m)
    names = np.flatnonzero(dense)
    place = np.full(many, -1)
    place[names] = np.arange(len(names))
    for a in range(0, len(names), 1024):
        sides = []
        for k, r, height in ((key, row, n), (other, column, m)):
            some = np.flatnonzero((place[k] >= a) & (place[k] < a + 1024))
            side = np.zeros((height, min(1024, len(names) - a)), np.float32)
            side[r[some], place[k[some]] - a] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int32)
    return out


def _link_counts(percent: int, read: Callable):
    """Of rows sorted by (root, low, high): each set's links (set_id, n) with the group's other sets and, if low < high, of the other block."""

    def counted(group: pa.Table):
        own, ids = group.column("own").to_numpy(), group.column("set_id").to_numpy()
        h, at = read(group.column("members").combine_chunks())
        sides = []
        for block in np.unique(own).tolist():
            rows = np.flatnonzero(own == block)
            size = at[rows + 1] - at[rows]
            sides.append((ids[rows], size, h[K.ranges(at[rows], size)], np.r_[0, np.cumsum(size)]))
        if group.column("low")[0].as_py() == group.column("high")[0].as_py():
            sides *= 2
        elif len(sides) < 2:  # a block that got no sets
            return
        (ids, size, *left), (other, sizes, *right) = sides
        both = _common(*left, *right).astype(np.int64)
        links = 100 * both >= percent * (size[:, None] + sizes - both)
        if sides[0] is sides[1]:
            np.fill_diagonal(links, False)
        else:
            yield other, links.sum(0)
        yield ids, links.sum(1)

    def run(batches):
        for groups in _groups(batches, "root", "low", "high"):
            for ids, n in (c for group in groups for c in counted(group)):
                yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0].astype(np.int64))], ["set_id", "n"])

    return run


def _groups(batches, *names: str):
    """Lists of whole groups of rows that are sorted by the columns ``names``."""
    rest = None
    for batch in _ended(batches):
        table = pa.Table.from_batches([batch]) if batch is not None else None
        if rest is not None:
            table = pa.concat_tables([rest, table]) if table is not None else rest
        if table is None or not len(table):
            continue
        new = np.zeros(len(table), bool)
        new[0] = True
        for key in (table.column(c).to_numpy() for c in names):
            new[1:] |= key[1:] != key[:-1]
        cut = np.flatnonzero(new)
        ends = np.r_[cut[1:], len(table)]
        whole = len(cut) if batch is None else len(cut) - 1
        yield [table.slice(s, e - s) for s, e in zip(cut[:whole], ends[:whole], strict=True)]
        rest = table.slice(cut[-1]) if batch is not None else None


def _ended(batches):
    yield from batches
    yield None


def linked(found: DataFrame, sketches: Callable, members: Callable | None, percent: int, parts: int, read: Callable, worth: Column | None = None, small: bool = False) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) and their components (node, root) of what ``candidates`` found.

    ``sketches`` gives rows (set_id, size, sketch) of a table of set_ids, ``members`` rows (set_id, members), from which ``read``
    makes the sets' distinct hashes and their offsets, a column at a time. ``worth`` is what a hot signature costs in each band; without it no set has slack. ``small`` members travel with
    hot groups, which then tell links at once, and only what joins their sets.
    """
    hot = found.where("kind = 1").select(F.col("x").alias("sig"), F.col("y").alias("set_id"), "slack").withColumn("band", F.col("sig").bitwiseAND(63))
    price = F.get(worth, F.col("band").cast("int")) if worth is not None else F.lit(1)
    # similar sets share signatures worth more than the slack that either has left after its hot ones
    pairs = found.where("kind = 0").groupBy("x", "y", (F.col("n") % 64).alias("band")).agg(F.sum(F.floor(F.col("n") / 64)).alias("n"), F.max("slack").alias("slack"))
    if worth is not None:
        held = hot.groupBy("set_id", "band").agg((F.count("*") * F.max(price)).alias("held"))
        for end in ("x", "y"):
            pairs = pairs.join(held.select(F.col("set_id").alias(end), "band", F.col("held").alias(f"held_{end}")), [end, "band"], "left")
        pairs = pairs.where(F.col("n") * price > F.col("slack") - F.greatest(F.coalesce("held_x", F.lit(0)), F.coalesce("held_y", F.lit(0))))
    pairs = pairs.select("x", "y").union(found.where("kind = 2").select("x", "y"))
    pairs = S.written(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), small=True)
    sets = sketches(pairs.select(F.explode(F.array("a", "b")).alias("set_id")).union(hot.select("set_id")).distinct())

    def verified(near: DataFrame) -> DataFrame:
        # only sets that a sketch couldn't part travel whole
        near = S.written(near, small=True)
        own = sets if small else members(near.select(F.explode(F.array("a", "b")).alias("set_id")).distinct())
        a, b = (own.select(F.col("set_id").alias(x), F.col("members").alias(f"m{x}")) for x in "ab")
        out = S.written(near.join(a, "a").join(b, "b").select("a", "b", "ma", "mb").mapInArrow(S.lean(_verified(percent, read)), "a bigint, b bigint").distinct(), small=True)
        S.dropped(near, *([] if small else [own]))
        return out

    a, b = (sets.select(F.col("set_id").alias(x), F.col("size").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    near = pairs.join(a, "a").join(b, "b").where("100 * least(na, nb) >= %d * greatest(na, nb)" % percent)
    links = verified(near.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(S.lean(_possible(percent)), "a bigint, b bigint"))
    roots = S.written(components(links), small=True)
    S.settled(found.sparkSession)
    # hot signatures: sets whose slack doesn't pay for all of theirs, across components
    poor = hot
    if worth is not None:
        # sets that no other signature brings together share more hot ones than the slack left; so in one order of
        # signatures, rarest first, they share one that isn't among the last of either
        size = hot.groupBy("sig").agg(F.count("*").alias("group"))
        held = hot.join(size, "sig")
        own = Window.partitionBy("set_id", "band")
        along = own.orderBy("group", "sig")
        held = held.withColumns({"nth": F.row_number().over(along), "all": F.count("*").over(own)})
        poor = held.where((F.col("nth") - 1) * price < F.col("all") * price - F.greatest(F.col("slack").cast("int"), F.lit(0))).select("sig", "set_id")
    poor = poor.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left")
    poor = S.written(poor.select("sig", "set_id", F.coalesce("root", "set_id").alias("root")), small=True)
    # blocks of at most BLOCK sets are compared with each other, by sketches: bounded tasks, and only possible pairs leave them
    split = poor.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low != high").select("sig", "blocks")
    what = ["set_id", "size", "sketch", *(["members"] if small else [])]
    poor = poor.join(split, "sig").join(sets.select(*what), "set_id").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    poor = poor.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    poor = poor.select("sig", "low", "high", "own", "root", *what).repartition(parts, "sig", "low", "high").sortWithinPartitions("sig", "low", "high")
    across = S.written(poor.mapInArrow(S.lean(_across(percent, read if small else None)), "a bigint, b bigint").distinct(), small=True)
    if not across.isEmpty():
        links = S.written(links.union(across if small else verified(across.join(links, ["a", "b"], "left_anti"))).distinct(), small=True)
        roots = S.written(components(links), small=True)
    S.dropped(sets)
    return links, roots


def link_counts(links: DataFrame, roots: DataFrame, hot: DataFrame, sizes: DataFrame, members: Callable, percent: int, parts: int, read: Callable) -> DataFrame:
    """Rows (set_id, n): all sets that each set is similar to.

    ``links`` lacks pairs of ``hot`` sets (set_id) only, and those are in one component of ``roots``: such sets are compared
    with each other there, and other links are taken as they are. ``sizes`` has rows (set_id, n_shingles).
    """
    group = S.written(hot.join(roots.withColumnRenamed("node", "set_id"), "set_id"), small=True)
    ends = links
    for end in ("a", "b"):
        ends = ends.join(group.select(F.col("set_id").alias(end), F.lit(True).alias(f"hot_{end}")), end, "left")
    ends = ends.where("hot_a is null or hot_b is null").select(F.explode(F.array("a", "b")).alias("set_id"), F.lit(1).cast("bigint").alias("n"))
    blocks = F.ceil(F.greatest(F.count("*") / COUNT_SETS, F.sum("n_shingles") / COUNT_SHINGLES)).cast("int")
    split = group.join(sizes, "set_id").groupBy("root").agg(F.count("*").alias("all"), blocks.alias("blocks")).where("all > 1").select("root", "blocks")
    own = S.written(group.join(split, "root"), small=True)
    rows = own.join(members(own.select("set_id")), "set_id").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    rows = rows.select("root", "low", "high", "own", "set_id", "members").repartition(parts, "root", "low", "high").sortWithinPartitions("root", "low", "high")
    inside = S.written(rows.mapInArrow(S.lean(_link_counts(percent, read)), "set_id bigint, n bigint"), small=True)
    return ends.union(inside).groupBy("set_id").agg(F.sum("n").alias("n_links"))


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_column: str = "doc_id", text: str = "text", with_links: bool = True) -> DataFrame:
    """Per row of ``docs``: id, n_shingles, component_id and, ``with_links``, n_links (all other, different sets similar to its own).

    Rows link when 100 * |intersection| >= ``percent`` * |union| of their k-word shingle sets; component_id is the
    least id that links lead to, the row's own included. Rows without words have no shingles and link
    with nothing; equal sets link whatever their size; rows of null id take part and a component of such rows
    alone has a null component_id. Other
    columns are left out; repeated rows stay; an empty table gives an empty one.
    """
    parts = S.n_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    base = S.kept(rows.mapInArrow(S.lean(S.short(_described(k))), "id bigint, tkey bigint, n_shingles bigint, set_id bigint"))
    index = S.exchanged(rows.select("text").mapInArrow(S.lean(S.short(_indexed(k, percent, parts))), S.PACKED), parts)
    found = S.written(index.mapInArrow(S.lean(_candidates), FOUND))
    del index
    S.settled(docs.sparkSession)
    # a set is read from one row that has it
    lead = base.where("set_id != 0").groupBy("set_id").agg(F.min(F.struct("tkey", "id")).alias("lead")).select("set_id", "lead.tkey", "lead.id")

    def places(ids: DataFrame) -> DataFrame:
        return S.written(lead.join(ids, "set_id", "left_semi").select("set_id", F.col("tkey").alias("k"), F.col("id").alias("i")), small=True)

    here = (F.col("tkey") == F.col("k")) & F.col("id").eqNullSafe(F.col("i"))

    def sketches(ids: DataFrame) -> DataFrame:
        own = places(ids)
        # the sketch is made where the text is read
        some = S.key_filter(rows, own.select(F.col("k").alias("tkey")), "tkey", S.short(_sketches(k)), "tkey bigint, id bigint, size bigint, sketch binary")
        return S.kept(some.join(own, here).select("set_id", "size", "sketch"))

    def members(ids: DataFrame) -> DataFrame:
        own = places(ids)
        some = S.key_filter(rows, own.select(F.col("k").alias("tkey")), "tkey")
        return S.kept(some.join(own, here).select("set_id", F.col("text").cast("binary").alias("members")))

    def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found, offsets = [], [np.zeros(1, np.int64)]
        for _, _, h, own in shingle_sets(texts, k):
            found.append(h)
            offsets.append(own[1:] + offsets[-1][-1])
        return np.concatenate(found), np.concatenate(offsets)

    worth = F.array(*[F.lit(2 if allocation(low, high, percent)[1] else 1) for low, high in bands(1 << 30, percent)])
    links, roots = linked(found, sketches, members, percent, parts, read, worth)
    sets = base.where("set_id != 0").groupBy("set_id").agg(F.min("id").alias("least")).join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = sets.join(named, "root").select("set_id", "component_id")
    what = [F.col("id").alias(id_column), "n_shingles", F.when(F.col("set_id") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id")]
    if with_links:
        hot = found.where("kind = 1").select(F.col("y").alias("set_id")).distinct()
        sizes = base.where("set_id != 0").groupBy("set_id").agg(F.max("n_shingles").alias("n_shingles"))
        labels = labels.join(link_counts(links, roots, hot, sizes, members, percent, parts, read), "set_id", "left")
        what.append(F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    S.dropped(found)
    return base.join(labels, "set_id", "left").select(*what)
