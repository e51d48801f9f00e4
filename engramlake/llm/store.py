"""Where intermediate tables go, and how rows travel in packed form.

Intermediate results are Parquet tables under the folder that
``spark.checkpoint.dir`` names, which driver and executors share, so a lost
executor costs the re-run of its tasks only.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

PACKED = "part int, payload binary"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a private one only in local mode, where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="engramlake-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def lean(f: Callable) -> Callable:
    """The same function of batches; its worker, which others will use, gives free memory back at the end."""

    def run(batches):
        yield from f(batches)
        trimmed()

    return run


def trimmed() -> None:
    """Give this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def runs(texts: list[str], many: int, chars: int) -> Iterator[list[str]]:
    """The texts in order, at most ``many`` and about ``chars`` characters at a time; a longer text is a run of its own."""
    some, size = [], 0
    for t in texts:
        if some and (len(some) >= many or size + len(t) > chars):
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def sliced(rows: pa.Array | pa.RecordBatch, many: int, size: int, column: str | None = None) -> Iterator:
    """Slices of at most ``many`` rows whose texts (of ``column``) have about ``size`` bytes; a longer text is a slice of its own."""
    texts = rows if column is None else rows.column(column)
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right"))
        b = min(max(b, a + 1), a + many)
        yield rows.slice(a, b - a)
        a = b


def short(f: Callable, rows: int = 2000, size: int = 8 << 20, column: str = "text") -> Callable:
    """The same function of batches, given slices of them: what it holds at once doesn't depend on the session's batch size."""

    def run(batches):
        return f(x for b in batches for x in sliced(b, rows, size, column))

    return run


def written(df: DataFrame, small: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there.

    ``small``: a table of far fewer rows than the input goes to a sixteenth of the session's partitions, to save files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/engramlake/{uuid.uuid4().hex}"
    few = df.coalesce(max(1, n_partitions(spark) // 16)) if small else df
    few.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.engramlake_path = path
    return out


def kept(df: DataFrame) -> DataFrame:
    """Compute ``df`` now and keep its rows on the executors; what a lost executor held is computed again from its lineage."""
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def dropped(*frames: DataFrame) -> None:
    """Let go of tables of ``written`` or ``kept`` that nothing will read again."""
    for df in frames:
        if not hasattr(df, "engramlake_path"):
            df.unpersist()
            continue
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.engramlake_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nothing refers to any more."""
    for _ in range(2):  # the first pass lets the JVM know which frames are gone
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def n_partitions(spark: SparkSession) -> int:
    """Tasks of a packed shuffle: the session's own number."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def packed(parts: int, keys: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Deal rows of fixed-width columns to ``parts`` by the uint64 ``keys`` (column 0): one binary per part.

    Spark then moves a few hundred binaries instead of millions of rows.
    """
    if not len(keys):
        return
    part = (keys >> np.uint64(20)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16) if parts <= 65535 else part, kind="stable")
    part = part[order]
    columns = [c[order] for c in (keys, *columns)]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = np.r_[starts[1:], len(part)]
    blobs = [b"".join([np.int64(e - s).tobytes(), *(c[s:e].tobytes() for c in columns)]) for s, e in zip(starts, ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "payload"])


def unpacked(batches: Iterator[pa.RecordBatch], *dtypes: type) -> list[np.ndarray]:
    """The columns of all payloads of a task, concatenated."""
    found: list[list[np.ndarray]] = [[np.empty(0, t)] for t in dtypes]
    for batch in batches:
        for blob in batch.column("payload"):
            view = blob.as_buffer()
            n, at = int(np.frombuffer(view, np.int64, 1)[0]), 8
            for k, t in enumerate(dtypes):
                found[k].append(np.frombuffer(view, t, n, at))
                at += n * np.dtype(t).itemsize
    return [np.concatenate(x) for x in found]


def exchanged(rows: DataFrame, parts: int) -> DataFrame:
    """Packed rows, all of one part in one task."""
    return rows.repartition(parts, "part")


def listed(keys: np.ndarray, values: np.ndarray, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Rows (key, binary of its values): ``values`` grouped by ``keys``."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    offsets = np.r_[starts, len(keys)].astype(np.int64) * values.dtype.itemsize
    for a in range(0, len(starts), 20000):
        b = min(a + 20000, len(starts))
        data = np.ascontiguousarray(values).view(np.uint8).reshape(-1)[offsets[a] : offsets[b]]
        own = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((offsets[a : b + 1] - offsets[a]).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(keys[starts[a:b]].view(np.int64)), own], list(names))


def owned(parts: int, owner: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Values on their way to their owner (int64): packed by its hash."""
    yield from packed(parts, owner.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), owner, value)


def per_owner(rows: DataFrame, parts: int, dtype: type, names: tuple[str, str]) -> DataFrame:
    """One row (owner, binary of all its values) of what ``owned`` sent."""

    def run(batches):
        _, owner, value = unpacked(batches, np.uint64, np.int64, dtype)
        yield from listed(owner, value, names)

    return exchanged(rows, parts).mapInArrow(lean(run), f"{names[0]} bigint, {names[1]} binary")


class KeyFilter:
    """A Bloom filter of at most ``bits_most`` bits (16 MB) over a bigint column of a table.

    False positives only cost work; a join decides afterwards.
    """

    def __init__(self, keys: DataFrame, bits_most: int = 1 << 27):
        bits = 1 << 16
        while bits < min(bits_most, 16 * keys.count()):
            bits *= 2

        def marked(batches):
            seen = np.zeros(bits // 8, np.uint8)
            for b in batches:
                for at in places_of(b.column(0), bits):
                    np.bitwise_or.at(seen, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([seen.tobytes()], pa.binary())], ["bits"])

        # at most 8 bit sets, each of a fixed size, reach the driver
        sets = [np.frombuffer(r.bits, np.uint8) for r in keys.coalesce(8).mapInArrow(marked, "bits binary").collect()]
        self.bits = bits
        self.table = keys.sparkSession.sparkContext.broadcast(np.bitwise_or.reduce(sets).tobytes() if sets else bytes(bits // 8))

    def may_hold(self, column: pa.Array) -> np.ndarray:
        seen = np.frombuffer(self.table.value, np.uint8)
        hits = [(seen[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 for at in places_of(column, self.bits)]
        return np.bitwise_and.reduce(hits).astype(bool)

    def rows(self, df: DataFrame, key: str, then: Callable | None = None, schema: str | None = None) -> DataFrame:
        """Rows of ``df`` whose ``key`` may be in the table; with ``then``, what that makes of their batches in the same worker."""

        def run(batches):
            some = (b.filter(pa.array(self.may_hold(b.column(key)))) for b in batches)
            yield from then(b for b in some if len(b)) if then else some

        return df.mapInArrow(lean(run), schema or df.schema)


def places_of(column: pa.Array, bits: int) -> list[np.ndarray]:
    x = column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return [(x >> np.uint64(shift)) & np.uint64(bits - 1) for shift in (0, 27)]


def key_filter(docs: DataFrame, keys: DataFrame, key: str, then: Callable | None = None, schema: str | None = None) -> DataFrame:
    return KeyFilter(keys.select(key)).rows(docs, key, then, schema)


KNOWN = np.uint32(1 << 31)


def aside(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows under part numbers from ``parts`` on: they share an exchange with others."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy() + parts), b.column(1)], b.schema.names)


def both_kinds(parts: int, batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    """Rows below part number ``parts``, and those sent ``aside``."""
    here, sure = [], []
    for b in batches:
        part = b.column("part").to_numpy()
        for rows, mask in ((here, part < parts), (sure, part >= parts)):
            if mask.any():
                rows.append(b.filter(pa.array(mask)))
    return here, sure


def sightings(parts: int, key: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Where each ``key`` (uint64) was seen, pre-aggregated: one row a key, however often this batch holds it.

    Keys seen twice here are known to repeat; their other places need no exchange by key, and travel
    dealt by owner, to the parts from ``parts`` on. (owner, place) pairs are distinct.
    """
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    key, owner, place = key[order], owner[order], place[order].astype(np.uint32)
    first = np.r_[True, key[1:] != key[:-1]]
    again = np.r_[~first[1:], False]
    yield from packed(parts, key[first], owner[first], np.where(again[first], place[first] | KNOWN, place[first]))
    if not first.all():
        yield from aside(parts, owned(parts, owner[~first], place[~first]))


def repeated_places(parts: int) -> Callable:
    """Of ``sightings``: for ``per_owner`` the places (uint32) of every key that was seen in two places."""

    def run(batches):
        here, sure = both_kinds(parts, batches)
        key, owner, place = unpacked(here, np.uint64, np.int64, np.uint32)
        _, o, p = unpacked(sure, np.uint64, np.int64, np.uint32)
        if len(key):
            order = np.argsort(key, kind="stable")
            key, owner, place = key[order], owner[order], place[order]
            known, place = (place & KNOWN) > 0, place & ~KNOWN
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            low, high = np.minimum.reduceat, np.maximum.reduceat
            twice = (low(owner, starts) != high(owner, starts)) | (low(place, starts) != high(place, starts)) | high(known, starts)
            mask = np.repeat(twice, np.diff(np.r_[starts, len(key)]))
            o, p = np.r_[owner[mask], o], np.r_[place[mask], p]
        yield from owned(parts, o, p)

    return run
