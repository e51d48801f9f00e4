"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are byte n-grams of the lower-cased text, so stems count inside words; those that labelled
examples show to be associated with the label are kept. Inverse document frequencies of the kept
terms are counted over all documents. Examples stand in an inverted index in blocks that store each term's
largest weight: a query bounds every block's cosine first and opens blocks only while
their bound exceeds the k-th best cosine so far, so its neighbours are exact. Their
votes, weighted by cosine, are calibrated on leave-one-out votes of the examples.

Only the fit uses a bounded sample of labelled rows (``EXAMPLES``); frequencies and scores use all rows and whole texts.
"""

from __future__ import annotations

import pickle
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm import kernels as K
from engramlake.llm import store

U = np.uint64
#: Labelled rows and terms that the model holds, n-gram lengths, neighbours, examples of a block, least chi-square of a term.
EXAMPLES, TERMS, LENGTHS, NEIGHBOURS, BLOCK, CHI_SQUARE = 6000, 4096, (4, 5, 6), 31, 64, 20.0
#: Least log odds of a term's association with either label, and the power of a cosine that weighs its vote.
LOG_ODDS, POWER = 1.0, 2.0
#: Weight of the base rate among the votes.
PRIOR_WEIGHT = 0.2
#: Bytes of text that a worker turns into vectors at once.
STEP_BYTES = 1 << 19
_workers: dict = {}


def grams(data: np.ndarray, offsets: np.ndarray):
    """Hashes and start positions of all n-grams of several texts, length by length; none crosses a text's border."""
    data = K.lowered(data)
    prefix, inverse = K.prefix_hash(data), K.powers(len(data) + 1, pow(K.BASE, -1, 1 << 64))
    for n in LENGTHS:
        m = len(data) - n + 1
        if m > 0:
            yield n, (prefix[n:] - prefix[:-n]) * inverse[:m] * U(0xD6E8FEB86659FD93) + U(n)


class Terms:
    """Finds kept terms: a bit table of hash heads first, then the exact hash."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.head = np.zeros(1 << 20, bool)
        self.head[(self.hashes >> U(44)).astype(np.int64)] = True

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, occurrences) of kept terms, sorted by text and term."""
        docs, terms = [], []
        for n, h in grams(data, offsets):
            at = np.flatnonzero(self.head[(h >> U(44)).astype(np.int64)])
            h = h[at]
            term = np.searchsorted(self.hashes, h)
            ok = self.hashes[np.minimum(term, len(self.hashes) - 1)] == h if len(self.hashes) else np.zeros(len(h), bool)
            at, term = at[ok], term[ok]
            doc = np.searchsorted(offsets, at, "right") - 1
            ok = at + n <= offsets[doc + 1]
            docs.append(doc[ok])
            terms.append(term[ok])
        if not docs:
            none = np.empty(0, np.int64)
            return none, none, none
        width = max(len(self.hashes), 1)
        key, count = np.unique(np.concatenate(docs) * width + np.concatenate(terms), return_counts=True)
        return key // width, key % width, count


class Examples:
    """Block-max inverted index of unit vectors, and calibrated votes."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_terms: int, prior: float):
        self.labels, self.prior, self.n = labels.astype(np.float64), prior, len(vectors)
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.empty(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.empty(0)
        row = np.repeat(np.arange(self.n), [len(v[0]) for v in vectors]) if vectors else np.empty(0, np.int64)
        self.n_blocks = -(-self.n // BLOCK) or 1
        order = np.lexsort((row, term, row // BLOCK))
        self.row, self.weight = row[order], weight[order]
        key = (row // BLOCK * n_terms + term)[order]
        # where a term's postings in a block begin, and their largest weight
        self.first = np.searchsorted(key, np.arange(self.n_blocks * n_terms + 1)).reshape(-1)
        self.most = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self.most, (key % n_terms, key // n_terms), self.weight)
        self.n_terms = n_terms
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def nearest(self, term: np.ndarray, weight: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The NEIGHBOURS examples of largest cosine above 0 and their cosines; ties by row."""
        if not len(term):
            return np.empty(0, np.int64), np.empty(0)
        bound = weight @ self.most[term]
        best = int(np.argmax(bound))
        rows, scores = self._opened(np.array([best]), term, weight, skip)
        least = -np.partition(-scores, NEIGHBOURS - 1)[NEIGHBOURS - 1] if len(rows) >= NEIGHBOURS else 0.0
        # every other block whose bound doesn't rule it out
        more = np.flatnonzero((bound > 0) & (bound >= least - 1e-9))
        more = more[more != best]
        if len(more):
            r, s = self._opened(more, term, weight, skip)
            rows, scores = np.r_[rows, r], np.r_[scores, s]
        if len(rows) > 4 * NEIGHBOURS:
            least = -np.partition(-scores, NEIGHBOURS - 1)[NEIGHBOURS - 1]
            near = scores >= least - 1e-9
            rows, scores = rows[near], scores[near]
        top = np.lexsort((rows, -np.round(scores, 12)))[:NEIGHBOURS]
        return rows[top], scores[top]

    def _opened(self, blocks: np.ndarray, term: np.ndarray, weight: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """All examples of some blocks that share a term, and their cosines."""
        at = (blocks[:, None] * self.n_terms + term).reshape(-1)
        size = self.first[at + 1] - self.first[at]
        posting = K.ranges(self.first[at], size)
        total = np.bincount(self.row[posting], weights=self.weight[posting] * np.repeat(np.tile(weight, len(blocks)), size), minlength=1)
        rows = np.flatnonzero(total > 0)
        rows = rows[rows != skip]
        return rows, total[rows]

    def vote(self, term: np.ndarray, weight: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray]:
        rows, cosine = self.nearest(term, weight, skip)
        cosine = cosine**POWER
        total = cosine.sum() + PRIOR_WEIGHT
        return float((cosine @ self.labels[rows] + PRIOR_WEIGHT * self.prior) / total), rows

    def calibrate(self, votes: np.ndarray) -> None:
        """Isotonic fit (pool adjacent violators) of labels on leave-one-out votes, each pool smoothed by the prior."""
        order = np.argsort(votes, kind="stable")
        x, y = votes[order], self.labels[order]
        pools: list[list[float]] = []  # first and last vote, sum, count
        for v, t in zip(x.tolist(), y.tolist(), strict=True):
            pools.append([v, v, t, 1.0])
            while len(pools) > 1 and (pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3] or pools[-2][1] == pools[-1][0]):
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        ends = np.array([x for p in pools for x in p[:2]])
        rate = np.array([(p[2] + self.prior) / (p[3] + 1) for p in pools for _ in range(2)])
        self.steps = ends, np.maximum.accumulate(rate)

    def score(self, vote: float) -> float:
        if self.steps is None or not len(self.steps[0]):
            return self.prior
        ends, rate = self.steps
        # between pools a vote is interpolated; a trace of the vote keeps the order inside a pool
        return float(min(max(0.999 * np.interp(vote, ends, rate) + 0.001 * vote, 0.0), 1.0))


def unit_vectors(doc: np.ndarray, term: np.ndarray, count: np.ndarray, n: int, idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    weight = (1 + np.log(count)) * idf[term]
    cut = np.searchsorted(doc, np.arange(n + 1))
    out = []
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        norm = np.sqrt((weight[s:e] ** 2).sum())
        out.append((term[s:e], weight[s:e] / norm if e > s else weight[s:e]))
    return out


def _associated(batches):
    """Rows (term hash, toxic texts, other texts) of a batch of examples."""
    for batch in batches:
        label, found = batch.column("label").to_numpy(), []
        for a, b, data, offsets in K.chunks(batch.column("text"), STEP_BYTES):
            for n, h in grams(data, offsets):
                doc = np.searchsorted(offsets, np.arange(len(h)), "right") - 1
                ok = np.arange(len(h)) + n <= offsets[doc + 1]
                order = np.lexsort((doc[ok], h[ok]))
                h_, d = h[ok][order], doc[ok][order]
                new = np.r_[True, (h_[1:] != h_[:-1]) | (d[1:] != d[:-1])] if len(h_) else np.empty(0, bool)
                found.append((h_[new], label[a:b][d[new]]))
        if found:
            h, y = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            h, y = h[order], y[order]
            cut = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
            if len(cut):
                ones, all_ = np.add.reduceat(y.astype(np.int64), cut), np.diff(np.r_[cut, len(h)])
                for a in range(0, len(cut), 100000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[cut[a : a + 100000]].view(np.int64)), pa.array(ones[a : a + 100000]), pa.array((all_ - ones)[a : a + 100000])], ["term", "n1", "n0"])


class Model:
    """What the executors need, of a size bounded by EXAMPLES and TERMS."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray, vectors: list, labels: np.ndarray, ids: np.ndarray):
        self.terms, self.idf, self.ids = Terms(hashes), idf, ids
        self.prior = float((labels.sum() + 1) / (len(labels) + 2))
        self.examples = Examples(vectors, labels, max(len(hashes), 1), self.prior)
        self.examples.calibrate(np.array([self.examples.vote(*v, skip=i)[0] for i, v in enumerate(vectors)]))

    def scores(self, column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        out, evidence = np.empty(len(column)), []
        for i, v in enumerate(vectors_of(column, self.terms, self.idf)):
            vote, rows = self.examples.vote(*v)
            out[i] = self.examples.score(vote)
            evidence.append(rows)
        return out, evidence


def vectors_of(column: pa.Array, terms: Terms, idf: np.ndarray):
    """The unit vector of each text."""
    for a, b, data, offsets in K.chunks(column, STEP_BYTES):
        if len(terms.hashes):
            yield from unit_vectors(*terms.counts(data, offsets), b - a, idf)
        else:
            yield from [(np.empty(0, np.int64), np.empty(0))] * (b - a)


def held_out(id_column: str):
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, id_column: str = "doc_id", text: str = "text", label: str = "toxic") -> bytes:
    """A pickled ``Model`` of at most ``examples`` labelled rows that aren't held out, chosen by the hash of their id.

    Of several rows of one id the least text teaches. Texts stay on the executors: terms, frequencies and vectors are made there, and
    one task of a bounded size makes the model.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_column).alias("i"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("i").isNotNull() & ~held_out("i"))
    known = known.groupBy("i").agg((F.max("label") > 0).cast("int").alias("label"))
    rows = docs.select(F.col(id_column).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the ids are chosen first, so only their texts are gathered
    picked = known.join(rows.select("i").distinct(), "i", "left_semi").orderBy(F.xxhash64("i"), "i").limit(examples)
    chosen = store.written(rows.join(F.broadcast(picked), "i").groupBy("i").agg(F.min("text").alias("text"), F.max("label").alias("label")).repartition(8, "i"))
    sizes = {r.label: r.n for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    terms = np.empty(0, U)
    if n1 and n0:
        seen = chosen.select("text", "label").mapInArrow(store.lean(_associated), "term bigint, n1 bigint, n0 bigint").groupBy("term").agg(F.sum("n1").alias("a"), F.sum("n0").alias("b")).where("a + b >= 3")
        n = float(n1 + n0)
        chi = F.expr(f"pow(a * ({n0}D - b) - b * ({n1}D - a), 2) * {n}D / ({float(n1) * n0}D * (a + b) * ({n}D - a - b + 1e-9D))")
        odds = F.expr(f"ln((a + 0.5D) / {n1 + 1}) - ln((b + 0.5D) / {n0 + 1})")
        best = seen.withColumn("chi", chi).where((F.col("chi") >= CHI_SQUARE) & (F.abs(odds) >= LOG_ODDS)).orderBy(F.desc("chi"), "term").limit(TERMS).collect()
        terms = np.sort(np.array([r.term for r in best], np.int64).view(U))
    held = spark.sparkContext.broadcast(terms)

    def frequency(batches):
        kept, df, n = Terms(held.value), np.zeros(len(held.value), np.int64), 0
        for batch in batches:
            n += len(batch)
            for _, _, data, offsets in K.chunks(batch.column(0), STEP_BYTES):
                _, term, _ = kept.counts(data, offsets)
                df += np.bincount(term, minlength=len(df))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, used]), pa.array(np.r_[n, df[used]])], ["term", "n"])

    idf = np.ones(len(terms))
    if len(terms):
        counts = {r.term: r.n for r in rows.select("text").mapInArrow(store.lean(frequency), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        idf = np.array([np.log((1 + counts[-1]) / (1 + counts.get(i, 0))) + 1 for i in range(len(terms))])

    def vectors(batches):
        own = Terms(held.value)
        for batch in batches:
            found = list(vectors_of(batch.column("text"), own, idf))
            yield pa.RecordBatch.from_arrays([batch.column("i").cast(pa.string()), batch.column("label"), pa.array([t.astype(np.int32) for t, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float64()))], ["i", "label", "terms", "weights"])

    def made(batches):
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("i", "label")), *([np.array(x.values) for x in b.column(c)] for c in ("terms", "weights")), strict=True)]
        rows.sort(key=lambda r: (len(r[0]), r[0]))
        model = Model(held.value, idf, [(t.astype(np.int64), w) for _, _, t, w in rows], np.array([y > 0 for _, y, _, _ in rows], bool), np.array([r[0] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    one = chosen.select("i", "text", "label").mapInArrow(store.lean(vectors), "i string, label int, terms array<int>, weights array<double>").coalesce(1).mapInArrow(store.lean(made), "model binary").collect()
    store.dropped(chosen)
    return bytes(one[0].model) if one else pickle.dumps(Model(terms, idf, [], np.empty(0, bool), np.empty(0, str)))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_column: str = "doc_id", text: str = "text", examples: int = EXAMPLES, evidence: bool = False) -> DataFrame:
    """``docs`` with held_out, score (0 to 1), predicted (1 if score >= ``threshold``); ``evidence``: ids of the nearest examples.

    A null or empty text, or one without any kept term, has no neighbours and gets the calibrated base rate. Labels that
    are null, and those of null ids, teach nothing; of contradicting labels of one id the toxic one counts; without
    labels of both kinds every score is the base rate. Null ids aren't held out. Repeated rows are scored one by one;
    columns of ``docs`` named like the new ones are replaced; an empty table gives an empty one.
    """
    held, key = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, examples, id_column, text)), uuid.uuid4().hex
    kind = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.string()))])

    @F.arrow_udf("struct<score: double, evidence: array<string>>")
    def scored(texts: pa.Array) -> pa.Array:
        if key not in _workers:
            _workers.clear()
            _workers[key] = pickle.loads(held.value)
        own = _workers[key]
        scores, rows = own.scores(texts)
        near = pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32), pa.array(own.ids[np.concatenate(rows)].tolist() if rows else [], pa.string())) if evidence else pa.array([[]] * len(rows), pa.list_(pa.string()))
        store.trimmed()
        return pa.StructArray.from_arrays([pa.array(scores), near], fields=list(kind))

    out = docs.withColumn("held_out", held_out(id_column)).withColumn("_scored", scored(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumns({"score": F.col("_scored.score"), **({"evidence": F.col("_scored.evidence").cast(T.ArrayType(docs.schema[id_column].dataType))} if evidence else {})}).drop("_scored")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
