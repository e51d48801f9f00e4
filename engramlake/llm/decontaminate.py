"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a text with at most e edits, cut into e + 1 pieces, has a piece that occurs
unchanged. One automaton finds all pieces of all items in a single pass over a text; every hit
proposes a place of its item, which Myers' bit-parallel edit distance verifies.
Texts and items are compared in lower case with runs of white space as one space.

Items are a stated query set: they go out in blocks of at most BLOCK_CHARS characters, one pass a block.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import store as S

#: Characters of benchmark items that one pass holds in memory, and the share of an item's characters that may be edited.
BLOCK_CHARS, ERROR_RATE = 16 << 20, 0.08
SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint"
_workers: dict = {}


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text``, and where the first such substring ends."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | minus
        d0 = (((eq & plus) + plus) ^ plus) | x
        up = minus | (full & ~(d0 | plus))
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(d0 | up)) & full
        minus = up & d0 & full
        if score < best:
            best, at = score, j
    return best, at


class Pieces:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * rate)) for i, t in items if t]
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, edits) in enumerate(self.items):
            cuts = [len(t) * j // (edits + 1) for j in range(edits + 2)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if e > s:
                    at.setdefault(t[s:e], []).append((k, e))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, places)
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the best occurrence of each item in a normalized text, the first of equal ones."""
        if not self.any:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, set[int]] = {}
        for end, places in self.automaton.iter(text):
            for k, e in places:
                _, item, edits = self.items[k]
                if k in best and best[k][0] == 0:
                    continue
                start = end + 1 - e
                seen = tried.setdefault(k, set())
                if start in seen:
                    continue
                seen.add(start)
                if start >= 0 and text.startswith(item, start):
                    best[k] = (0, start, start + len(item))
                    continue
                a, b = max(start - edits, 0), start + len(item) + edits
                # places one or two steps aside lie in the same window
                window = text[a : max(b, 0)]
                cost, stop = myers(item, window)
                if cost <= edits and (k not in best or cost < best[k][0]):
                    # the same alignment read backwards gives its start
                    _, length = myers(item[::-1], window[:stop][::-1])
                    best[k] = (cost, a + stop - length, a + stop)
        return [(self.items[k][0], s, e, cost) for k, (cost, s, e) in sorted(best.items())]


def contaminated(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, start, end, edits): each benchmark item that a text holds with at most ``error_rate`` edits a character.

    start and end count characters of the normalized text. Null and empty texts and items match nothing;
    repeated rows are reported as often as they occur, repeated items once a row of them. Ids may be null.
    An empty table on either side gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    rows = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_chars) * 2) if size > block_chars else 1
    own = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = None
    for block in range(blocks):
        # bounded: a block holds about half of block_chars on average
        some = rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).orderBy("i", "t").collect()
        held = spark.sparkContext.broadcast([(r.i, normalized(r.t)) for r in some])
        found = own.mapInArrow(S.short(_matcher(held, uuid.uuid4().hex, error_rate)), SCHEMA)
        out = found if out is None else out.union(found)
    return out


def _matcher(held, key: str, rate: float):
    def run(batches):
        if key not in _workers:
            _workers.clear()
            _workers[key] = Pieces(held.value, rate)
        find = _workers[key].find
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc, *hit) for hit in find(normalized(text.as_py()))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in SCHEMA.split(", ")])

    return run
