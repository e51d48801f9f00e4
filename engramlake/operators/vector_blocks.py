"""Scores of vectors against a bounded block of queries, by matrix products in the Python workers.

The rules are those of ``functions.vectors``: a cosine is 0 for other lengths or a zero vector; a null vector or element gives null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores that are held at once, and the digits that ranks go by.
HELD, DIGITS = 1 << 21, 6


class Vectors:
    """A column of vectors as a matrix for each length; ``void`` marks null vectors, ``odd`` those with a null inside."""

    def __init__(self, column):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().cast(pa.float64())
        end = np.cumsum(np.maximum(size, 0))
        self.n, self.void, self.odd = len(size), size < 0, np.zeros(len(size), bool)
        if flat.null_count:
            self.odd[np.searchsorted(end, np.flatnonzero(flat.is_null().to_numpy(zero_copy_only=False)), side="right")] = True
            flat = pc.fill_null(flat, 0.0)
        own = flat.to_numpy(zero_copy_only=False)
        self.groups = {}
        for width in np.unique(size[size >= 0]).tolist():
            at = np.flatnonzero(size == width)
            self.groups[width] = at, own[(end[at] - width)[:, None] + np.arange(width)]

    def unit(self) -> Vectors:
        for width, (at, m) in self.groups.items():
            norm = np.sqrt((m * m).sum(1))
            self.groups[width] = at, m / np.where(norm == 0, 1, norm)[:, None]
        return self


def scores(queries: Vectors, rows: Vectors, measure: str) -> tuple[np.ndarray, np.ndarray | None]:
    """A row for each query and a column for each vector, and where the score is null (None: nowhere). Cosines take unit vectors."""
    whole = next(iter(queries.groups), None)
    if len(queries.groups) == len(rows.groups) == 1 and whole in rows.groups and not (queries.void.any() or rows.void.any()):
        out, null = queries.groups[whole][1] @ rows.groups[whole][1].T, None
    else:
        out = np.zeros((queries.n, rows.n))
        null = queries.void[:, None] | rows.void[None, :] if measure == "cosine" else np.ones(out.shape, bool)
        for width, (at, m) in queries.groups.items():
            if width in rows.groups:
                to, own = rows.groups[width]
                out[np.ix_(at, to)] = m @ own.T
                null[np.ix_(at, to)] = False
    if queries.odd.any() or rows.odd.any():
        null = np.zeros(out.shape, bool) if null is None else null
        for width, (at, _) in queries.groups.items():
            if width in rows.groups:
                to = rows.groups[width][0]
                null[np.ix_(at, to)] = queries.odd[at][:, None] | rows.odd[to][None, :]
    return out, null


def _column(batch, name: str) -> Vectors:
    return Vectors(batch.column(batch.schema.get_field_index(name)))


def best(batches: Iterator[pa.RecordBatch], ids: pa.Array, asked: Vectors, k: int, measure: str, positive: bool = False, probed: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The ``k`` best rows (id, v) of each query in one task, as (query_id, id, score); ``probed`` (query, cell) limits a query to its cells.

    What each query holds so far bounds what comes later, so that few scores are sorted.
    """
    n = asked.n
    at, key, row, value, none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
    least, last = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
    step, kind = 256, pa.int64()
    for batch in batches:
        kind, done = batch.schema.field("id").type, 0
        while done < batch.num_rows:
            part = batch.slice(done, step)
            done, step = done + step, max(64, min(step * 2, HELD // max(n, 1)))
            own = _column(part, "v")
            s, null = scores(asked, own.unit() if measure == "cosine" else own, measure)
            # a NaN comes before all numbers and a null after them
            rank = np.where(np.isnan(s), np.inf, s) if np.isnan(s).any() else s
            rank = rank if null is None else np.where(null, -np.inf, rank)
            keep = rank >= (least - 2.0 * 10.0**-DIGITS)[:, None]
            keep = keep & (rank > 0) if positive else keep
            keep = keep & probed[:, part.column(part.schema.get_field_index("cell")).to_numpy()] if probed is not None else keep
            q, r = np.nonzero(keep)
            rounded, i = np.round(rank[q, r], DIGITS), part.column(part.schema.get_field_index("id")).to_numpy()[r]
            ahead = (rounded > least[q]) | ((rounded == least[q]) & (i < last[q]))
            q, r, rounded, i = q[ahead], r[ahead], rounded[ahead], i[ahead]
            at, key, row = np.concatenate([at, q]), np.concatenate([key, rounded]), np.concatenate([row, i])
            value, none = np.concatenate([value, s[q, r]]), np.concatenate([none, np.zeros(len(q), bool) if null is None else null[q, r]])
            order = np.lexsort((row, -key, at))
            place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
            order = order[place < k]
            at, key, row, value, none = at[order], key[order], row[order], value[order], none[order]
            size = np.bincount(at, minlength=n)
            full = np.flatnonzero(size == k)
            ends = np.cumsum(size)[full] - 1
            least[full], last[full] = key[ends], row[ends]
    for a in range(0, len(at), 1 << 17):
        b = slice(a, a + (1 << 17))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[b])), pa.array(row[b]).cast(kind), pa.array(value[b], mask=none[b])], ["query_id", "id", "score"])


def mixed(batches: Iterator[pa.RecordBatch], ids: pa.Array, asked: Vectors, share: float) -> Iterator[pa.RecordBatch]:
    """Every query with every row (id, v, score): ``share`` of the cosine and the rest of the score, rounded."""
    step = max(1, (1 << 17) // max(asked.n, 1))
    for batch in batches:
        for done in range(0, batch.num_rows, step):
            part = batch.slice(done, step)
            s, null = scores(asked, _column(part, "v").unit(), "cosine")
            own = part.column(part.schema.get_field_index("score"))
            plus = pc.fill_null(own, 0.0).to_numpy(zero_copy_only=False)
            mask = np.broadcast_to(own.is_null().to_numpy(zero_copy_only=False), s.shape)
            mask = mask if null is None else mask | null
            out = np.round(share * s + (1 - share) * plus, DIGITS).reshape(-1)
            at, to = np.repeat(np.arange(asked.n), part.num_rows), np.tile(np.arange(part.num_rows), asked.n)
            for a in range(0, len(at), 1 << 17):
                b = slice(a, a + (1 << 17))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[b])), part.column(part.schema.get_field_index("id")).take(pa.array(to[b])), pa.array(out[b], mask=mask.reshape(-1)[b])], ["query_id", "id", "score"])
