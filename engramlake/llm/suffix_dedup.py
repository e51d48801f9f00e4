"""Removal of every byte covered by a long string that starts anywhere else.

A suffix array finds such strings as neighbours. Here the suffixes are sorted
only where they can have a neighbour:

1. Each window of ``length`` bytes names the smallest hash among its k-grams as
   its anchor (winnowing), so equal windows name equal anchors at equal offsets.
   One exchange of anchors finds those that occur twice: about one position in
   64 travels.
2. For repeated anchors only, the bytes around them travel to the anchor's
   task. There the suffixes that start at equal offsets before one anchor are
   merge-sorted; two suffixes are compared by a binary search for their common
   extension with prefix polynomial hashes, a logarithmic number of steps. Equal
   neighbours are verified byte by byte.
3. Places with a twin go back to their texts.

Whole copies are found by sha256 first and count as covered. Texts are known by
xxhash64, never by position in a file, so every step can be re-run.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import kernels as K
from engramlake.llm import store as S

U = np.uint64
WIDTH_LOG2 = 7
#: Bytes of context that one step of a task sorts at a time, if its groups allow.
STEP = 2 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows: their positions and hashes, first window start and number of windows that name each."""
    k, n = length - (1 << WIDTH_LOG2) + 1, len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none.view(U), none, none
    prefix = K.prefix_hash(data)
    gram = K.mixed((prefix[k:] - prefix[:-k]) * K.powers(n + 1, pow(K.BASE, -1, 1 << 64))[: n - k + 1])
    bits = max(22, int(n).bit_length())
    mask = U((1 << bits) - 1)
    least = K.window_min((gram & ~mask) | np.arange(len(gram), dtype=U), WIDTH_LOG2)
    starts = np.flatnonzero(K.within(offsets, n, length)[: len(least)])
    if not len(starts):
        return none, none.view(U), none, none
    named = (least[starts] & mask).astype(np.int64)
    new = np.flatnonzero(np.r_[True, named[1:] != named[:-1]])
    at = named[new]
    return at, gram[at], starts[new], np.diff(np.r_[new, len(named)])


def _distinct(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row of each text key."""
    keys = batch.column("tkey").to_numpy()
    _, first = np.unique(keys, return_index=True)
    return batch if len(first) == len(keys) else batch.take(pa.array(np.sort(first)))


def anchor_sightings(length: int, parts: int):
    def run(batches):
        for batch in batches:
            batch = _distinct(batch)
            keys, found = batch.column("tkey").to_numpy(), []
            for a, b, data, offsets in K.chunks(batch.column("text")):
                at, gram, _, _ = anchors(data, offsets, length)
                doc = np.searchsorted(offsets, at, "right") - 1
                found.append((gram, keys[a:b][doc], at - offsets[doc]))
            if found:
                yield from S.sightings(parts, *(np.concatenate(x) for x in zip(*found, strict=True)))

    return run


def _pack_contexts(parts: int, gram, owner, first, windows, before, known, data, start):
    """Like ``store.packed`` with a run of bytes for each row."""
    part = (gram >> U(20)) % U(parts)
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    blobs = []
    for s, e in zip(cuts, np.r_[cuts[1:], len(part)], strict=True):
        rows = order[s:e]
        columns = (gram[rows], owner[rows], first[rows].astype(np.uint32), windows[rows].astype(np.uint16), before[rows].astype(np.uint16), known[rows].astype(np.uint8))
        size = windows[rows].astype(np.int64) - 1
        blobs.append((np.int64(e - s).tobytes(), *(c.tobytes() for c in columns), start[rows], size))
    return part[cuts], blobs, data


def context_names(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One uint64 for contexts of equal bytes and an equal place of the anchor; equal names are verified byte by byte."""
    name = K.mixed(K.range_hash(K.prefix_hash(data), start, start + size) + before.astype(U) * U(0xD6E8FEB86659FD93) + size.astype(U))
    order = np.argsort(name, kind="stable")
    near = np.flatnonzero(name[order][1:] == name[order][:-1])
    for s in range(0, len(near), 20000):
        a, b = order[near[s : s + 20000]], order[near[s : s + 20000] + 1]
        same = (size[a] == size[b]) & (before[a] == before[b])
        if same.all():
            same = data[K.ranges(start[a], size[a])] == data[K.ranges(start[b], size[b])]
        if not same.all():  # two contents of one hash: another one tells them apart
            return np.array([xxhash.xxh3_64_intdigest(data[x : x + n].tobytes(), int(p)) for x, n, p in zip(start.tolist(), size.tolist(), before.tolist(), strict=True)], U)
    return name


def contexts(length: int, parts: int):
    """For each repeated anchor the bytes of the windows that name it; equal ones of a batch travel once."""

    def run(batches):
        for batch in batches:
            keys, places = batch.column("tkey").to_numpy(), batch.column("places")
            for a, b, data, offsets in K.chunks(batch.column("text")):
                at, gram, first, windows = anchors(data, offsets, length)
                doc = np.searchsorted(offsets, at, "right") - 1
                wanted = [np.frombuffer(places[i].as_py(), np.uint32).astype(np.int64) + offsets[i - a] for i in range(a, b)]
                keep = np.isin(at, np.concatenate(wanted))
                at, gram, first, windows, doc = (x[keep] for x in (at, gram, first, windows, doc))
                if not len(at):
                    continue
                size = windows + length - 1
                whole = context_names(data, first, size, at - first)
                owner, place = keys[a:b][doc], first - offsets[doc]
                # one row of each content; the others of this run are known to repeat
                order = np.lexsort((place, owner, whole))
                w, o, p = whole[order], owner[order], place[order]
                same = np.r_[False, w[1:] == w[:-1]]
                twin = same & np.r_[False, (o[1:] != o[:-1]) | (p[1:] != p[:-1])]
                group = np.cumsum(~same) - 1
                known = np.zeros(int(group[-1]) + 1, bool)
                known[group[twin]] = True
                head = order[~same]
                part, blobs, _ = _pack_contexts(parts, gram[head], owner[head], place[head], windows[head], (at - first)[head], known, data, first[head])
                payloads = [b"".join([*blob[:-2], data[K.ranges(blob[-2], blob[-1] + length)].tobytes()]) for blob in blobs]
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(payloads, pa.binary())], ["part", "payload"])
                if twin.any():
                    rest = order[twin]
                    pairs = np.stack([place[rest], windows[rest]], 1).astype(np.uint32).view(U).reshape(-1)
                    yield from S.aside(parts, S.owned(parts, owner[rest], pairs))

    return run


def common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, at most ``depth``: a binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.full(len(a), depth, np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = K.range_hash(prefix, a, a + mid) == K.range_hash(prefix, b, b + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


def sorted_suffixes(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, bucket: np.ndarray, depth: int) -> np.ndarray:
    """Order that merge-sorts the suffixes at ``start`` within each bucket by their first ``depth`` bytes.

    ``bucket`` is sorted. All merges of a level run at once: a suffix's place is its rank in its own run
    plus its rank in the run beside it, found by binary search.
    """
    n = len(start)
    order = np.arange(n)
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    sizes = np.diff(np.r_[cut, n])
    base, size = np.repeat(cut, sizes), np.repeat(sizes, sizes)
    local = np.arange(n) - base
    width = 1
    while width < sizes.max(initial=0):
        rows = np.flatnonzero(size > width)
        mine, left = local[rows], base[rows]
        run = mine // width
        odd = run & 1
        low = left + (run ^ 1) * width
        end = np.minimum(low + width, left + size[rows])
        ok = low < left + size[rows]
        rows, mine, left, run, odd, low, end = (x[ok] for x in (rows, mine, left, run, odd, low, end))
        rank, high = low.copy(), end.copy()
        own = start[order[rows]]
        while True:
            open_ = np.flatnonzero(rank < high)
            if not len(open_):
                break
            mid = (rank[open_] + high[open_]) >> 1
            x, y = own[open_], start[order[mid]]
            far = common(prefix, x, y, depth)
            tie = far == depth
            at = np.minimum(far, depth - 1)
            # of equal suffixes those of the left run come first
            less = np.where(tie, odd[open_] == 1, data[y + at] < data[x + at])
            rank[open_] = np.where(less, mid + 1, rank[open_])
            high[open_] = np.where(less, high[open_], mid)
        to = left + (run - odd) * width + (mine - run * width) + (rank - low)
        moved = order[rows]
        order[to] = moved
        width *= 2
    return order


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    out = np.empty(len(a), bool)
    span = np.arange(depth)
    for s in range(0, len(a), 20000):
        out[s : s + 20000] = (data[a[s : s + 20000, None] + span] == data[b[s : s + 20000, None] + span]).all(1)
    return out


def twins(data: np.ndarray, start: np.ndarray, bucket: np.ndarray, depth: int) -> np.ndarray:
    """Which of the suffixes at ``start`` has a twin of ``depth`` bytes in its bucket."""
    order = np.argsort(bucket, kind="stable")
    prefix = K.prefix_hash(data)
    found = order[sorted_suffixes(data, prefix, start[order], bucket[order], depth)]
    a, b = found[:-1], found[1:]
    near = np.flatnonzero(bucket[a] == bucket[b])
    near = near[common(prefix, start[a[near]], start[b[near]], depth) == depth]
    near = near[equal_bytes(data, start[a[near]], start[b[near]], depth)]
    out = np.zeros(len(start), bool)
    out[a[near]] = out[b[near]] = True
    return out


def twin_windows(length: int, parts: int):
    """Of ``contexts``: for ``per_owner`` the runs of window starts (first, number, as a uint32 pair) that have a twin."""

    def run(batches):
        here, sure = [], []
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("payload"), strict=True):
                (here if part < parts else sure).append(blob.as_buffer())
        out_owner, out_run = [], []
        columns, texts = [[] for _ in range(6)], []
        for view in here:
            n, at = int(np.frombuffer(view, np.int64, 1)[0]), 8
            for k, t in enumerate((U, np.int64, np.uint32, np.uint16, np.uint16, np.uint8)):
                columns[k].append(np.frombuffer(view, t, n, at))
                at += n * np.dtype(t).itemsize
            texts.append(np.frombuffer(view, np.uint8, offset=at))
        del here
        for view in sure:
            n = int(np.frombuffer(view, np.int64, 1)[0])
            out_owner.append(np.frombuffer(view, np.int64, n, 8 + 8 * n))
            out_run.append(np.frombuffer(view, np.uint32, 2 * n, 8 + 16 * n).reshape(n, 2))
        if columns[0]:
            gram, owner, first, windows, before, known = (np.concatenate(c) for c in columns)
            windows, before = windows.astype(np.int64), before.astype(np.int64)
            size = windows + length - 1
            data = np.concatenate(texts)
            del texts, columns
            at = np.cumsum(size) - size
            order = np.argsort(gram, kind="stable")
            cut = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]])
            total = np.cumsum(size[order])
            a = 0
            while a < len(order):  # whole groups, about STEP bytes at a time
                b = int(np.searchsorted(total, (total[a - 1] if a else 0) + STEP, "right"))
                b = int(cut[k]) if (k := int(np.searchsorted(cut, max(b, a + 1), "left"))) < len(cut) else len(order)
                rows = order[a:b]
                a = b
                own = data[K.ranges(at[rows], size[rows])]
                here_at = np.cumsum(size[rows]) - size[rows]
                whole = context_names(own, here_at, size[rows], before[rows])
                # contents that occur whole in two places
                by = np.lexsort((first[rows], owner[rows], whole))
                w, o, f = whole[by], owner[rows][by], first[rows][by]
                head = np.r_[True, w[1:] != w[:-1]]
                other = np.r_[False, ~head[1:] & ((o[1:] != o[:-1]) | (f[1:] != f[:-1]))]
                group = np.cumsum(head) - 1
                twice = np.zeros(int(group[-1]) + 1, bool)
                twice[group[other]] = True
                twice[group[known[rows][by] > 0]] = True
                full = twice[group]
                out_owner.append(o[full])
                out_run.append(np.stack([f[full], windows[rows][by][full].astype(np.uint32)], 1))
                # one row of each content, in groups that have several
                lead = by[head]
                g = gram[rows][lead]
                several = np.unique(g, return_counts=True)
                many = np.isin(g, several[0][several[1] > 1])
                lead, done = lead[many], twice[many]
                if not len(lead) or done.all():
                    continue
                count = windows[rows][lead]
                start = K.ranges(here_at[lead], count)
                row = np.repeat(np.arange(len(lead)), count)
                offset = before[rows][lead][row] - (start - here_at[lead][row])
                bucket = K.mixed(gram[rows][lead][row]) + offset.astype(U)
                hit = twins(own, start, bucket, length) & ~done[row]
                hit = np.flatnonzero(hit)
                if len(hit):
                    pos = first[rows][lead][row[hit]] + (start[hit] - here_at[lead][row[hit]]).astype(np.uint32)
                    out_owner.append(owner[rows][lead][row[hit]])
                    out_run.append(np.stack([pos, np.ones(len(pos), np.uint32)], 1))
        if out_owner:
            pairs = np.ascontiguousarray(np.concatenate(out_run).astype(np.uint32)).view(np.uint64).reshape(-1)
            yield from S.owned(parts, np.concatenate(out_owner), pairs)

    return run


def covered(runs: np.ndarray, length: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered spans of runs of window starts (first, number)."""
    runs = runs.astype(np.int64)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1] - 1 + length, -1)
    inside = np.cumsum(edge[:n]) > 0
    step = np.diff(np.r_[False, inside, False].astype(np.int8))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _removed(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for key, text, runs in zip(batch.column("tkey").to_pylist(), batch.column("text"), batch.column("runs"), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                pairs = np.frombuffer(runs.as_py(), np.uint32).reshape(-1, 2)
                s, e = covered(pairs, length, len(data))
                kept = b"".join(data[x:y] for x, y in zip(np.r_[0, e], np.r_[s, len(data)], strict=True))
                rows.append((key, int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["tkey", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 200, id_column: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_bytes, n_removed, n_spans and the sha256 of what stays (``with_text``: also ``kept``).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in any text of
    ``docs``. Null texts are empty; texts shorter than ``length`` stay whole; each of several equal rows
    loses what the other holds; ids may repeat or be null. ``kept`` is decoded with replacement
    characters where a cut splits a character. Other columns are left out; an empty table gives an empty one.
    """
    if length < (1 << WIDTH_LOG2) + 8:
        raise ValueError("length must be at least 136 bytes")
    spark = docs.sparkSession
    parts = S.n_partitions(spark)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), whole.alias("text")).withColumns({"tkey": F.xxhash64("text"), "n_bytes": F.octet_length("text").cast("bigint")})
    base = S.written(rows.select("id", "tkey", "n_bytes", F.sha2("text", 256).alias("sha256")))
    long_ = F.col("n_bytes") >= length
    lead = base.where(long_).groupBy("tkey", "n_bytes", "sha256").agg(F.min("id").alias("lead"), F.count("*").alias("copies"))
    seen = S.exchanged(rows.where(long_).select("tkey", "text").mapInArrow(S.lean(S.short(anchor_sightings(length, parts), 10_000, 24 << 20)), S.PACKED), parts)
    places = S.written(S.per_owner(seen.mapInArrow(S.lean(S.repeated_places(parts)), S.PACKED), parts, np.uint32, ("owner", "places")))
    del seen
    S.settled(spark)
    wanted = places.join(lead, places.owner == lead.tkey).select("owner", "lead", F.col("n_bytes").alias("size"), "copies", "places")
    some = S.key_filter(rows.where(long_), places.select(F.col("owner").alias("tkey")), "tkey")
    same = (F.col("tkey") == F.col("owner")) & (F.col("n_bytes") == F.col("size")) & F.col("id").eqNullSafe(F.col("lead"))
    found = S.written(some.join(wanted, same).select("tkey", "text", "copies", "places"))
    S.settled(spark)
    around = S.exchanged(found.select("tkey", "text", "places").mapInArrow(S.lean(S.short(contexts(length, parts), 10_000, 24 << 20)), S.PACKED), parts)
    runs = S.written(S.per_owner(around.mapInArrow(S.lean(twin_windows(length, parts)), S.PACKED), parts, np.uint64, ("owner", "runs")))
    cut = found.where("copies = 1").select("tkey", "text").join(runs, F.col("tkey") == F.col("owner")).select("tkey", "text", "runs")
    cut = cut.mapInArrow(S.lean(S.short(_removed(length), 10_000, 24 << 20)), "tkey bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")
    cut = S.written(cut if with_text else cut.drop("kept"))
    S.dropped(places, found, runs)
    copied = lead.where("copies > 1").select("tkey", "n_bytes", "sha256", F.lit(True).alias("copied"))
    out = base.join(copied, ["tkey", "n_bytes", "sha256"], "left").join(cut, "tkey", "left")
    gone = F.coalesce("copied", F.lit(False))
    none = F.sha2(F.lit("").cast("binary"), 256)
    columns = [
        F.col("id").alias(id_column),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, none).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    ]
    if not with_text:
        return out.select(*columns)
    texts = rows.select(F.col("tkey").alias("k"), F.col("text").alias("whole")).dropDuplicates(["k"])
    return out.join(texts, F.col("tkey") == F.col("k")).select(*columns, F.when(gone, "").otherwise(F.coalesce("kept", "whole")).alias("kept"))
