"""Lexical retrieval packing.

Documents become token ids and an end id, and are cut and packed into sequences. A document fills
whole sequences of its own first; what is left of it is packed with lexical neighbours: a BM25 index, in shards, is
asked with all terms of a seed document and returns its unused neighbours, best first, which greedily fill the
seed's sequence. The last one is cut where the sequence is full; its rest seeds the next.

1. Texts are encoded once and written, with how many documents hold each id, their number and mean length:
   weights are those of the whole table, not of a shard.
2. Documents are routed to shards by what they say: by two of their ids, chosen by weighted MinHash in favour of rare
   ids, so documents that share rare ids tend to meet. Ranges of (id, id, row) deal them to tasks; a group of copies
   or a frequent id spreads over as many tasks as it fills.
3. A shard is a run of such rows, bounded in documents and ids, so a task's memory has a bound. Each shard pads its last
   sequence only.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import kernels as K
from engramlake.llm import store as S

#: Most documents and ids of a shard, and neighbours that a seed gets at a time.
SHARD_DOCS, SHARD_IDS, NEIGHBOURS = 8192, 24 << 20, 32
#: A term that more than one document in so many holds has a row of weights for all documents instead of postings.
DENSE = 4
K1, B = 1.5, 0.75
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_workers: dict = {}


class Stats:
    """Documents, their mean length, and how many hold each id; of a table or of some documents."""

    def __init__(self, n: int, total: int, df: np.ndarray):
        self.n, self.mean, self.df = n, max(total / max(n, 1), 1.0), df

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Stats:
        terms = np.concatenate([np.unique(d) for d in docs]) if docs else np.empty(0, np.int64)
        return cls(len(docs), sum(len(d) for d in docs), np.bincount(terms.astype(np.int64)))

    def idf(self, many: int) -> np.ndarray:
        df = np.zeros(many)
        df[: len(self.df)] = self.df[:many]
        return np.log((self.n - df + 0.5) / (df + 0.5) + 1.0)


class Index:
    """BM25 over whole documents' ids, without the id ``mark`` that ends all of them."""

    def __init__(self, docs: list[np.ndarray], mark: int | None = None, stats: Stats | None = None):
        stats = stats or Stats.of(docs)
        found = [np.unique(d, return_counts=True) for d in docs]
        owner = np.repeat(np.arange(len(docs)), [len(t) for t, _ in found])
        term = np.concatenate([t for t, _ in found]).astype(np.int64) if found else np.empty(0, np.int64)
        tf = np.concatenate([n for _, n in found]).astype(np.float32) if found else np.empty(0, np.float32)
        if mark is not None:
            owner, tf, term = owner[term != mark], tf[term != mark], term[term != mark]
        order = np.argsort(term.astype(np.uint32), kind="stable")
        term, self.owner, tf = term[order], owner[order], tf[order]
        self.n = len(docs)
        self.first = np.searchsorted(term, np.arange(int(term[-1]) + 2 if len(term) else 1))
        size = np.array([len(d) for d in docs], np.float32)
        idf = stats.idf(max(len(self.first) - 1, 1)).astype(np.float32)
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.owner] / stats.mean)) if len(term) else tf
        self.weight = self.weight.astype(np.float64)  # as bincount wants it
        held = np.diff(self.first)
        common = np.flatnonzero(held * DENSE > max(len(docs), 1))
        self.place = np.full(len(held), -1)
        self.place[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(docs)), np.float32)
        for k, t in enumerate(common.tolist()):
            s, e = self.first[t], self.first[t + 1]
            self.dense[k, self.owner[s:e]] = self.weight[s:e]

    def best(self, seed: np.ndarray, alive: np.ndarray, many: int) -> np.ndarray:
        """Unused documents by falling BM25 score for all of the seed's terms, ties by row; only such that share one."""
        terms = np.unique(seed).astype(np.int64)
        terms = terms[terms < len(self.place)]
        place = self.place[terms]
        few = terms[place < 0]
        size = self.first[few + 1] - self.first[few]
        posting = K.ranges(self.first[few], size)
        scores = np.bincount(self.owner[posting], weights=self.weight[posting], minlength=self.n).astype(np.float64)
        if (place >= 0).any():
            asked = np.zeros(len(self.dense), np.float32)
            asked[place[place >= 0]] = 1
            scores += asked @ self.dense
        rows = np.flatnonzero((scores > 0) & alive)
        if len(rows) > many:  # and all that tie with the last of them
            found = scores[rows]
            rows = rows[found >= np.partition(found, -many)[-many]]
        return rows[np.lexsort((rows, -scores[rows]))][:many]


def packed_shard(ids: list[np.ndarray], window: int, mark: int | None = None, stats: Stats | None = None) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (row, start, length, sequence, offset) of a shard's documents, and the number of sequences. ``mark`` is no term."""
    pieces, sequence = [], 0
    size = np.array([len(x) for x in ids], np.int64)
    done = size // window * window
    for r in np.flatnonzero(done).tolist():
        for s in range(0, int(done[r]), window):
            pieces.append((r, s, window, sequence, 0))
            sequence += 1
    alive = size > done
    index = Index(ids, mark, stats)
    # long remainders seed first; a cut one goes on at once
    queue = np.flatnonzero(alive)
    queue = queue[np.lexsort((queue, done[queue] - size[queue]))].tolist()
    at, rest = 0, None

    def longest() -> int:
        nonlocal at
        while not alive[queue[at]]:
            at += 1
        return queue[at]

    waiting = len(queue)
    while waiting or rest is not None:
        seed, start = rest or (longest(), int(done[queue[at]]))
        rest, used, line, row = None, 0, [], seed
        while True:
            if alive[row]:
                alive[row] = False
                waiting -= 1
            take = min(int(size[row]) - start, window - used)
            pieces.append((row, start, take, sequence, used))
            used += take
            if start + take < size[row]:
                rest = (row, start + take)
            if used == window or not waiting:
                break
            # the seed's next neighbours; if nothing that is left shares a term, the longest
            line = line or index.best(ids[seed], alive, NEIGHBOURS).tolist() or [longest()]
            row = line.pop(0)
            start = int(done[row])
        sequence += 1
    return pieces, sequence


def _route(ids: np.ndarray, mark: int) -> tuple[int, int]:
    """Two of the distinct ids by weighted MinHash: of documents that share rare ids many agree on them.

    Merges of a byte-pair vocabulary come by frequency, so a large id is a rare one; -1 where there is none.
    """
    terms = ids[ids != mark].astype(np.uint64)
    if not len(terms):
        return -1, -1
    chance = ((K.mixed(terms + np.uint64(K.BASE)) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
    rank = -np.log(chance) / np.log(terms + 2.0) ** 2
    if len(terms) == 1:
        return int(terms[0]), -1
    a, b = np.argpartition(rank, 1)[:2]
    return (int(terms[a]), int(terms[b])) if rank[a] <= rank[b] else (int(terms[b]), int(terms[a]))


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, id_column: str, text: str) -> DataFrame:
    """Rows (doc_id, row, ids, a, b) of documents, ids as little-endian uint32 and (a, b) their route, and rows (n, total, df) of what a task counted."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    key = uuid.uuid4().hex

    def run(batches):
        from pyspark import TaskContext

        from engramlake.llm.bpe import Ids

        if key not in _workers:
            _workers.clear()
            _workers[key] = Ids(definition.value)
        encode = _workers[key]
        row, n, total, df = TaskContext.get().partitionId() << 40, 0, 0, np.zeros(1, np.int64)
        for batch in batches:
            found = []
            for t in batch.column(1):
                ids = np.append(encode(t.as_py()), np.uint32(end_id)).astype("<u4")
                terms = np.unique(ids)
                if terms[-1] >= len(df):
                    df = np.r_[df, np.zeros(max(int(terms[-1]) + 1 - len(df), len(df)), np.int64)]
                df[terms] += 1
                found.append((ids.tobytes(), *_route(terms, end_id)))
                total += len(ids)
            m = len(found)
            n += m
            ids, a, b = zip(*found, strict=True) if found else ((), (), ())
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.arange(row, row + m)), pa.array(ids, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none, none, pa.nulls(m, pa.binary())], names)
            row += m
        if n:
            counted = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*counted, pa.array([n]), pa.array([total]), pa.array([df.tobytes()], pa.binary())], names)

    schema = "doc_id bigint, row bigint, ids binary, a bigint, b bigint, n bigint, total bigint, df binary"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return S.written(rows.mapInArrow(S.lean(S.short(run)), schema))


def _table_stats(counted: DataFrame) -> Stats:
    """Of all documents: what the tasks counted, added up on executors; at most eight vectors of the vocabulary's size reach the driver."""

    def added(batches):
        n, total, df = 0, 0, np.zeros(1, np.int64)
        for b in batches:
            n, total = n + sum(b.column(0).to_pylist()), total + sum(b.column(1).to_pylist())
            for x in b.column(2):
                own = np.frombuffer(x.as_buffer(), np.int64)
                df, own = (df, own) if len(df) >= len(own) else (own.copy(), df)
                df[: len(own)] += own
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([df.tobytes()], pa.binary())], ["n", "total", "df"])

    sums = counted.where("n is not null").select("n", "total", "df").coalesce(8).mapInArrow(added, "n bigint, total bigint, df binary").collect()
    own = [np.frombuffer(r.df, np.int64) for r in sums]
    df = np.zeros(max((len(x) for x in own), default=1), np.int64)
    for x in own:
        df[: len(x)] += x
    return Stats(sum(r.n for r in sums), sum(r.total for r in sums), df)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, window: int = 2048, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` packed into sequences of at most ``window`` ids; ``with_ids`` adds the piece's ids.

    A document is its text's ids (no special tokens added) and ``end_id``. Null texts are empty: their
    end id alone. Null ids and repeated rows are packed like others, each on its own. sequence_id is unique in the result,
    offset gapless from 0 in each sequence. Other columns are left out; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    table = encoded(docs, tokenizer_path, end_id, id_column, text)
    stats = spark.sparkContext.broadcast(_table_stats(table))  # bounded by the vocabulary
    names = [*(x.split()[0] for x in SCHEMA.split(", ")), *(["ids"] if with_ids else [])]

    def run(batches):
        from pyspark import TaskContext

        sequences, own, rows, total = TaskContext.get().partitionId() << 32, [], [], 0

        def flushed():
            nonlocal sequences
            pieces, n = packed_shard(rows, window, end_id, stats.value)
            r, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
            bits = [rows[a][b : b + c].tobytes() for a, b, c, _, _ in pieces]
            columns = [pa.array(own, pa.int64()).take(pa.array(r)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in bits], pa.int64()), pa.array(np.array([len(x) for x in rows], np.int64)[r]), pa.array(sequence + sequences), pa.array(offset)]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in bits], pa.list_(pa.int32())))
            sequences += n
            for a in range(0, len(pieces), 10000):
                yield pa.RecordBatch.from_arrays([c.slice(a, 10000) for c in columns], names)

        for batch in batches:
            for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                own.append(name)
                rows.append(np.frombuffer(x.as_py(), "<u4"))
                total += len(rows[-1])
                if len(rows) >= SHARD_DOCS or total >= SHARD_IDS:
                    yield from flushed()
                    own, rows, total = [], [], 0
        if rows:
            yield from flushed()

    dealt = table.where("ids is not null").select("doc_id", "ids", "a", "b", "row").repartitionByRange(S.n_partitions(spark), "a", "b", "row").sortWithinPartitions("a", "b", "row")
    return dealt.mapInArrow(S.lean(run), SCHEMA + (", ids array<int>" if with_ids else ""))
