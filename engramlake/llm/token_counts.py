"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table from frequent pre-tokens to their number of
tokens; tier two a cache of each Python worker, filled by the tokenizer.
Pre-tokens never leave the task that reads their text: no shuffle.
"""

from __future__ import annotations

import json
import os
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm import store as S

#: Rows that the table of frequent pre-tokens is made from, its entries, and characters of a worker's cache.
SAMPLE_DOCS, TABLE_SIZE, CACHE_CHARS = 2000, 30_000, 1 << 20
#: Texts, and their bytes, that a worker handles at once.
STEP_TEXTS, STEP_BYTES = 64, 1 << 20
#: The pre-tokenizer of byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_workers: dict[str, TokenLengths] = {}


class TokenLengths:
    """Token counts of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, tokenizer_json: str, frequent: dict[str, int]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # any other kind of file is counted whole, text by text
        self.split = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.find = regex.compile(PATTERN).findall
        plain = [t["content"] for t in spec.get("added_tokens") or [] if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        self.split = self.split and len(plain) == len(spec.get("added_tokens") or [])
        # an added token inside a text is one token
        self.added = regex.compile("|".join(map(regex.escape, sorted(plain, key=len, reverse=True)))) if plain else None
        self.frequent, self.cache, self.held = frequent, {}, 0

    def encoded(self, texts: list[str]) -> list[int]:
        """Numbers of tokens, by the tokenizer, some at a time; a long text is a run of its own."""
        out: list[int] = []
        for some in S.runs(texts, 2 * STEP_TEXTS, STEP_BYTES // 8):
            out += [len(x.ids) for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def lengths(self, pieces: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens; those in neither tier are encoded together."""
        words = set().union(*pieces).difference(self.frequent)
        missing = words.difference(self.cache)
        if self.held > CACHE_CHARS:  # what this call needs is looked up again
            self.cache, self.held = {}, 0
            missing = words
        todo = list(missing)
        self.cache.update(zip(todo, self.encoded(todo), strict=True))
        self.held += sum(map(len, todo))
        frequent, cache = self.frequent, self.cache
        return [sum([frequent[w] if w in frequent else cache[w] for w in piece]) for piece in pieces]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.split:
            return self.encoded(texts)
        out: list[int] = []
        for some in S.runs(texts, STEP_TEXTS, STEP_BYTES):
            more = [0] * len(some)
            pieces = [self.find(t) for t in some]
            if self.added is not None:
                for i, t in enumerate(some):
                    if n := len(self.added.findall(t)):
                        pieces[i], more[i] = [w for part in self.added.split(t) for w in self.find(part)], n
            out += [n + m for n, m in zip(self.lengths(pieces), more, strict=True)]
        return out


def frequent_lengths(docs: DataFrame, text: str, tokenizer_json: str, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> dict[str, int]:
    """Token counts of at most ``table_size`` pre-tokens that occur most in about ``sample_docs`` rows.

    The table only saves time: a pre-token that isn't in it is encoded.
    """
    n = docs.count()

    def counted(batches):
        import regex

        find, seen = regex.compile(PATTERN).findall, Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(find(t.as_py()))
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["word", "n"])

    rows = docs.sample(min(1.0, sample_docs / max(n, 1)), seed=17).select(F.coalesce(text, F.lit("")).alias("text"))
    top = rows.mapInArrow(S.lean(counted), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(table_size).collect()
    counts = TokenLengths(tokenizer_json, {})
    words = [r.word for r in top]
    return dict(zip(words, counts.lengths([[w] for w in words]), strict=True)) if counts.split else {}


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``); other columns stay as they are.

    A null text counts as empty: 0 bytes and tokens. Repeated rows are counted one by one; an empty
    table gives an empty one. Columns of ``docs`` named like the new ones are replaced.
    ``tokenizer_path`` is read on the driver; the tokenizer's definition goes out as a broadcast of a fixed size.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast((definition, frequent_lengths(docs, text, definition)))
    key = uuid.uuid4().hex

    @F.arrow_udf("bigint")
    def n_tokens(texts: pa.Array) -> pa.Array:
        if key not in _workers:
            _workers.clear()
            _workers[key] = TokenLengths(*table.value)
        found: list[int] = []
        for some in S.sliced(texts, STEP_TEXTS, STEP_BYTES):
            found += _workers[key].counts(some.to_pylist())
        S.trimmed()
        return pa.array(found, pa.int64())

    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"n_bytes": F.octet_length(whole).cast("bigint"), "n_tokens": n_tokens(whole)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


__all__ = ["count_tokens", "frequent_lengths", "TokenLengths"]
