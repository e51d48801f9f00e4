"""The llm operators against brute force, on small fixtures with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from engramlake.llm import chat_format, components, decontaminate, kernels, line_dedup, ngram_join, order_minhash, packing, queries, recompression, store, suffix_dedup, token_counts, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n", "a", "word", "naïve café — 日本語 текст 🎉", "<|endoftext|> inside <|endoftext|>", "x" * 3000, "a b " * 200, "don't   stop\t\tnow\r\n"]


def frame(spark, texts, start=0):
    rows = [(start + i, t, 7, "tkey") for i, t in enumerate(texts)]
    # extra columns whose names clash with the operators' own
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes int, places string")


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(3)
    vocab = ["".join(chance.choice("abcdeé") for _ in range(chance.randint(1, 7))) for _ in range(150)]
    passage = " ".join(chance.choice(vocab) for _ in range(70))
    out = list(ODD)
    for _ in range(60):
        t = [chance.choice(vocab) for _ in range(chance.randint(1, 150))]
        out.append(("\n" if chance.random() < 0.3 else " ").join(t) if chance.random() < 0.7 else " ".join(t) + ". " + passage + " " + chance.choice(vocab))
    for k in range(20):  # exact and near copies
        base = out[-1 - k].split(" ")
        if len(base) > 3:
            base[chance.randrange(len(base))] = "edited"
        out += [out[-1 - k], " ".join(base)]
    return [*out, None, "", passage, passage + passage]


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def test_token_counts(spark, texts):
    exact = Tokenizer.from_file(BPE)
    rows = token_counts.count_tokens(frame(spark, texts), BPE).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit, r.places) for r in rows} == {
        i: (len((t or "").encode()), n := len(exact.encode(t or "", add_special_tokens=False).ids), n > 1024, "tkey") for i, t in enumerate(texts)
    }
    assert token_counts.count_tokens(empty(spark), BPE).count() == 0


def test_token_cache_overflow(monkeypatch, texts):
    monkeypatch.setattr(token_counts, "CACHE_CHARS", 30)
    monkeypatch.setattr(token_counts, "STEP_TEXTS", 3)
    monkeypatch.setattr(token_counts, "STEP_BYTES", 200)
    counts = token_counts.TokenLengths(open(BPE, encoding="utf-8").read(), {})
    exact = Tokenizer.from_file(BPE)
    plain = [t or "" for t in texts]
    assert counts.counts(plain) == [len(exact.encode(t, add_special_tokens=False).ids) for t in plain]


def covered_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        yield d, gone


@pytest.mark.parametrize("length", [136, 200])
def test_suffix_dedup(spark, texts, length):
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts), length, with_text=True).collect()}
    for i, (d, gone) in enumerate(covered_bytes(texts, length)):
        rest = bytes(np.frombuffer(d, np.uint8)[~gone])
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        r = rows[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
        assert r.kept == rest.decode("utf-8", "replace")
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_suffixes_are_sorted():
    chance = np.random.default_rng(1)
    data = chance.integers(97, 99, 400).astype(np.uint8)
    start, bucket = np.arange(300), np.sort(chance.integers(0, 4, 300))
    order = suffix_dedup.sorted_suffixes(data, kernels.prefix_hash(data), start, bucket, 40)
    for b in range(4):
        own = [bytes(data[s : s + 40]) for s in start[order[bucket == b]]]
        assert own == sorted(own) and len(own) == (bucket == b).sum()


def test_recompression(spark, texts):
    rows = {r.doc_id: r for r in recompression.remove_repeats(frame(spark, texts), with_text=True).collect()}
    seen = set()
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            window = tuple(words[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        rest = b" ".join(w for w, g in zip(words, gone) if not g)
        r = rows[i]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) == (len(words), sum(gone), hashlib.sha256(rest).hexdigest(), rest.decode())
    assert recompression.remove_repeats(empty(spark)).count() == 0


def thue_morse(n):
    """A word over a and b, and its complement: polynomial hashes mod 2**64 take long ones for equal."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ("".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_long_words_and_lines_that_prefix_hashes_confuse(spark, n):
    a, b = thue_morse(n)
    head = " ".join(f"w{i}" for i in range(19))
    rows = recompression.remove_repeats(frame(spark, [f"{head} {a}", f"{head} {b}"])).collect()
    assert [r.n_removed for r in rows] == [0, 0]
    rows = ngram_join.near_duplicates(frame(spark, [f"p q r s {a}", f"p q r s {b}", a, b])).collect()
    assert all(r.component_id == r.doc_id for r in rows)
    rows = suffix_dedup.remove_repeats(frame(spark, [f"1{a}2", f"3{b}4"])).collect()
    want = [int(gone.sum()) for _, gone in covered_bytes([f"1{a}2", f"3{b}4"], 200)]
    assert sorted(r.n_removed for r in rows) == sorted(want)


@pytest.mark.parametrize("n", [1024, 4096])
def test_named_tells_long_sequences_apart(n):
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse(n))
    data = np.r_[a, b, a]
    at = np.array([0, n, 2 * n])
    x, y, z = kernels.word_hashes(data, at, at + n)
    assert x == z != y


def test_equal_names_of_contexts_are_verified(monkeypatch):
    data = np.frombuffer(b"abcdabcxabcd", np.uint8)
    monkeypatch.setattr(kernels, "mixed", lambda x: x * np.uint64(0))
    x, y, z = suffix_dedup.context_names(data, np.array([0, 4, 8]), np.array([4, 4, 4]), np.array([1, 1, 1]))
    assert x == z != y


def test_equal_windows_have_equal_representatives():
    chance = random.Random(5)
    for _ in range(60):
        size = chance.choice([1, 2, 3, 50])
        docs = [[chance.randint(1, size) for _ in range(chance.randint(0, 70))] + [1, 2] * chance.randint(0, 20) for _ in range(3)]
        docs.append(docs[0][3:40] + docs[1][:30])
        offsets = np.r_[0, np.cumsum([len(d) for d in docs])]
        word = kernels.mixed(np.array([x for d in docs for x in d], np.uint64)) if offsets[-1] else np.empty(0, np.uint64)
        n = max(len(word) - 19, 0)
        whole = kernels.range_hash(kernels.prefix_hash(word), np.arange(n), np.arange(n) + 20)
        start, name, place = recompression.representatives(word, offsets, 20, whole)
        groups = defaultdict(set)
        for s, m, p in zip(start.tolist(), name.tolist(), place.tolist()):
            groups[tuple(word[s : s + 20].tolist())].add((m, p - s))
        assert all(len(g) == 1 for g in groups.values())


def jaccard_components(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def shingles(text, k=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def test_ngram_join(spark, texts):
    rows = {r.doc_id: r for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    assert [(rows[i].n_shingles, rows[i].component_id) for i in range(len(texts))] == list(zip([len(s) for s in sets], jaccard_components(sets, 80)))
    assert ngram_join.near_duplicates(empty(spark)).count() == 0


def test_ngram_join_of_a_hot_group(spark):
    """Many near copies, and many texts that share a passage: hot signatures on both sides of the threshold."""
    chance = random.Random(9)
    base = [f"w{chance.randrange(5000)}" for _ in range(120)]
    shared = [f"s{i}" for i in range(40)]
    texts = []
    for i in range(120):
        own = list(base)
        for _ in range(chance.randint(0, 4)):
            own[chance.randrange(len(own))] = f"e{chance.randrange(9999)}"
        texts.append(" ".join(own))
        texts.append(" ".join([*(f"u{i}_{j}" for j in range(chance.randint(20, 90))), *shared]))
    rows = {r.doc_id: r for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    assert [rows[i].component_id for i in range(len(texts))] == jaccard_components(sets, 80)


def test_ngram_join_counts_all_links(spark, monkeypatch):
    """n_links of a family of near copies that share hot signatures, of its blocks, and of sets beside it."""
    monkeypatch.setattr(ngram_join, "COUNT_SETS", 40, raising=False)
    chance = random.Random(17)
    texts = []
    for family, copies in ((0, 150), (1, 60), (2, 3)):
        base = [f"f{family}_{chance.randrange(5000)}" for _ in range(110)]
        for _ in range(copies):
            own = list(base)
            for _ in range(chance.randint(0, 4)):
                own[chance.randrange(len(own))] = f"e{chance.randrange(9999)}"
            texts.append(" ".join(own))
    texts += texts[:5]
    rows = {r.doc_id: r for r in ngram_join.near_duplicates(frame(spark, texts)).collect()}
    sets = [frozenset(shingles(t)) for t in texts]
    other = set(sets)
    want = [sum(s != o and 100 * len(s & o) >= 80 * len(s | o) for o in other) for s in sets]
    assert [rows[i].n_links for i in range(len(texts))] == want


def test_common_counts_like_sets():
    chance = np.random.default_rng(5)
    sides = [[np.unique(chance.integers(0, top, chance.integers(0, 60)).astype(np.uint64)) for top in (30, 30, 400, 5000) * 9] for _ in range(2)]
    h, at, g, bt = (x for side in sides for x in (np.concatenate(side), np.r_[0, np.cumsum([len(s) for s in side])]))
    want = [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]
    assert ngram_join._common(h, at, g, bt).tolist() == want


@pytest.mark.parametrize("size", range(4, 60, 5))
def test_signatures_lose_no_pair(size):
    """Sets at the threshold share a signature, in every band."""
    chance = np.random.default_rng(size)
    for _ in range(30):
        a = np.unique(chance.integers(0, 2**63, size).astype(np.uint64))
        drop = int(0.2 * len(a))
        b = np.sort(np.r_[a[drop // 2 :], chance.integers(0, 2**63, max(drop - drop // 2, 1) if size % 2 else 0).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        own = defaultdict(set)
        for sig, row, _ in ngram_join.signatures(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), 80):
            for s, r in zip(sig.tolist(), row.tolist()):
                own[r].add(s)
        assert (len(a) == len(b) == both) or own[0] & own[1]


def test_line_dedup(spark):
    chance = random.Random(4)
    line = lambda n: "".join(chance.choice("abcdefgh ") for _ in range(n)).strip()
    common = [line(60) for _ in range(6)]
    texts = [None, "", "short", "short", "\n"]
    for _ in range(60):
        own = [line(chance.randint(5, 90)) for _ in range(chance.randint(1, 5))] + ([chance.choice(common)] if chance.random() < 0.5 else [])
        if chance.random() < 0.4:
            x = list(chance.choice(common))
            x[chance.randrange(len(x))] = "Z"
            own.insert(0, "  " + "".join(x) + " ")
        texts.append("\n".join(own))
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(frame(spark, texts), with_text=True).collect()}
    places = [(i, n, x.strip()) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if len(x.strip()) >= 15]
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for _, _, x in places]
    roots = jaccard_components(sets, 80)
    gone = defaultdict(set)
    for (i, n, _), r, k in zip(places, roots, range(len(places))):
        if r != k:
            gone[i].add(n)
    for i, t in enumerate(texts):
        kept = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i])
        assert (rows[i].n_lines, rows[i].n_removed, rows[i].kept) == ((t or "").count("\n") + 1, len(gone[i]), kept)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_of_short_lines(spark, tmp_path):
    """Repeats of lines under 15 characters go in the query, near copies from five characters on; blank lines stay."""
    chance = random.Random(12)
    short = ["Les.", "a", "日本語", "こんにちは世界", "}", "four5", *("".join(chance.choice("abcdefgh") for _ in range(13)) for _ in range(6))]
    texts = [None, "", "\n \n"]
    for _ in range(40):
        own = [chance.choice(short) for _ in range(chance.randint(0, 4))] + ["", f"line {chance.random()} alone"]
        if chance.random() < 0.4:
            own.insert(0, f" {chance.choice(short[6:])}{chance.choice('xyz')}")
        chance.shuffle(own)
        texts.append("\n".join(own))
    frame(spark, texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    places = [(i, n, x.strip()) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n")) if x.strip()]
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} or {x} for _, _, x in places]
    gone = defaultdict(set)
    for k, r in enumerate(jaccard_components(sets, 80)):
        if r != k:
            gone[places[k][0]].add(places[k][1])
    for i, t in enumerate(texts):
        kept = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone[i])
        assert (rows[i].n_removed, rows[i].kept_sha256) == (len(gone[i]), hashlib.sha256(kept.encode()).hexdigest())


def test_toxicity(spark):
    chance = random.Random(8)
    words = ["".join(chance.choice("aeioulrst") for _ in range(6)) for _ in range(80)]
    texts, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        t = [chance.choice(words) for _ in range(40)] + (["zorgblatt", "qwyxfool"] if bad else [])
        chance.shuffle(t)
        texts.append(" ".join(t))
        labels.append((i, int(bad)))
    texts += ["", None]
    labels += [(600, None), (None, 1)]
    docs = frame(spark, texts)
    table = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    rows = {r.doc_id: r for r in toxicity.score(docs, table, evidence=True).collect()}
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(602))
    held = [i for i in range(600) if rows[i].held_out]
    assert all(rows[i].predicted == (i % 5 == 0) for i in held)
    assert all(e % 5 == 0 and not rows[e].held_out for i in held if i % 5 == 0 for e in rows[i].evidence)
    assert rows[600].predicted == rows[601].predicted == 0 and 0 <= rows[600].score <= 1
    assert all(r.score == 0.5 for r in toxicity.score(docs, table.where("false")).collect())
    assert toxicity.score(docs.where("false"), table).count() == 0


def test_nearest_examples_are_exact():
    chance = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        t = np.sort(chance.choice(40, chance.integers(0, 6), replace=False))
        w = chance.random(len(t))
        vectors.append((t, w / np.sqrt((w**2).sum()) if len(t) else w))
    index = toxicity.Examples(vectors, np.zeros(500), 40, 0.1)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 500, 7):
        rows, cosine = index.nearest(*vectors[i])
        all_ = dense @ dense[i]
        order = [r for r in np.lexsort((np.arange(500), -np.round(all_, 12))) if all_[r] > 0][: toxicity.NEIGHBOURS]
        assert rows.tolist() == order and np.allclose(cosine, all_[order])


def test_order_minhash(spark, texts):
    rows = {r.doc_id: r for r in order_minhash.edited_fingerprints(frame(spark, texts)).collect()}
    prints = {}
    for i, t in enumerate(texts):
        own, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(own, r.fingerprint) == r.fingerprint and prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and (r.near_edited == 1 or own != edited) and (r.near_next == 1 or own != after)
    assert order_minhash.edited_fingerprints(empty(spark)).count() == 0


def murmur_of_longs(*values):
    """32-bit Murmur3 of 64-bit numbers one after the other, each seeded with the hash before it."""
    low, turn = 0xFFFFFFFF, lambda x, r: (x << r | x >> (32 - r)) & 0xFFFFFFFF
    h = 42
    for v in values:
        for part in (v & low, v >> 32 & low):
            h = (turn(h ^ turn(part * 0xCC9E2D51 & low, 15) * 0x1B873593 & low, 13) * 5 + 0xE6546B64) & low
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & low
        h = (h ^ h >> 13) * 0xC2B2AE35 & low
        h ^= h >> 16
    return h


def test_order_minhash_is_that_of_its_definition(spark, texts):
    """Fingerprints and likenesses from the least two elements of each slot's own order, sought one slot at a time."""

    def chained(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v, h)
        return h

    def fingerprint(text):
        words = [w.encode() for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        kmers = [chained(*words[i : i + 2]) for i in range(len(words) - 1)] if len(words) > 1 else [chained(text.encode())] if text else []
        seen, elements = Counter(), []
        for at, k in enumerate(kmers):
            seen[k] += 1
            elements.append((chained(k.to_bytes(8, "little"), seen[k].to_bytes(4, "little")), at))
        out = ""
        for s in range(32 if elements else 0):
            least = sorted(elements, key=lambda e: (e[0] - (s << 59)) % (1 << 64))[:2]
            out += f"{murmur_of_longs(*[e for e, _ in sorted(least, key=lambda e: e[1])]):08x}"
        return out

    def likeness(a, b):
        return 1.0 if not a and not b else sum(a[i : i + 8] == b[i : i + 8] != "" for i in range(0, 256, 8)) / 32

    rows = {r.doc_id: r for r in order_minhash.edited_fingerprints(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        own, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(own) // 2
        a, b, c = fingerprint(own), fingerprint(own[: len(own) - half] + after[:half]), fingerprint(after)
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (a, b)
        assert (rows[i].near_edited, rows[i].near_next) == (likeness(a, b), likeness(a, c))


def test_order_minhash_sees_order(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join(words[100:] + words[:100]), " ".join(words[:-4] + ["x"] * 4)]
    rows = order_minhash.slots(frame(spark, texts).select("doc_id", "text"), ["doc_id"], "text")
    a, b = rows.select(F.col("doc_id").alias("a"), F.col("slots").alias("x")), rows.select(F.col("doc_id").alias("b"), F.col("slots").alias("y"))
    near = {(r.a, r.b): r.s for r in a.crossJoin(b).select("a", "b", order_minhash.likeness("x", "y").alias("s")).collect()}
    assert near[0, 0] == 1 and near[0, 2] > 0.8 > near[0, 1]


def test_chat_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "a\\|<\\\\|nl|>", "", None, "line\nbreak", "<|nl|>", "日本<|"]
    rows = [(c, t, ["user", "assistant", "sys\ntem<|im_end|>", None][(c + t) % 4], x) for c in range(4) for t, x in enumerate(said)] + [(9, 0, "user", "a"), (9, 0, "user", "a"), (None, 0, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(turns)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, own in by.items():
        own = sorted(own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert found[c].n_turns == len(own)
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    whole = {r.conv_id: r.formatted for r in chat_format.format_conversations(turns).collect()}
    assert {c: len(x) for c, x in whole.items()} == {c: r.formatted_chars for c, r in found.items()}
    assert chat_format.digests(chat_format.format_turns(turns.where("false"))).count() == 0


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row), row.index(min(row))


def test_myers_is_exact():
    chance = random.Random(1)
    for _ in range(300):
        p, t = ("".join(chance.choice("abc") for _ in range(chance.randint(a, 30))) for a in (1, 0))
        assert decontaminate.myers(p, t) == distance(p, t)


def test_decontamination(spark):
    chance = random.Random(6)
    line = lambda n: " ".join("".join(chance.choice("abcdefghij") for _ in range(chance.randint(2, 8))) for _ in range(n))
    items = [line(20) for _ in range(12)] + [None, "", "ab"]
    texts = [None, "", line(5)]
    for k in range(60):
        item = list(items[k % 12])
        for _ in range(chance.randint(0, 14)):
            at = chance.randrange(len(item))
            item[at : at + 1] = chance.choice([[], ["q"], [item[at], "q"]])
        texts.append(f"{line(30)}  {''.join(item).upper() if k % 3 else ''.join(item)}\n{line(30)}" if k % 4 else line(60))
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = decontaminate.contaminated(frame(spark, texts), table, error_rate=0.08).collect()
    plain, asked = [decontaminate.normalized(t or "") for t in texts], [decontaminate.normalized(t or "") for t in items]
    expected = {(i, k): d for i, t in enumerate(plain) for k, q in enumerate(asked) if q and (d := distance(q, t)[0]) <= int(len(q) * 0.08)}
    assert {(r.doc_id, r.item_id): r.edits for r in rows} == expected
    for r in rows:
        assert distance(asked[r.item_id], plain[r.doc_id][r.start : r.end])[0] == r.edits
    few = decontaminate.contaminated(frame(spark, texts), table, error_rate=0.08, block_chars=300)
    assert {(r.doc_id, r.item_id): r.edits for r in few.collect()} == expected
    assert decontaminate.contaminated(frame(spark, texts), table.where("false")).count() == 0


def check_pieces(rows, texts, window):
    exact = Tokenizer.from_file(BPE)
    by, lines = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        lines[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(texts):
        ids, at = [*exact.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in lines.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return lines


def test_packing(spark, texts):
    lines = check_pieces(packing.pack(frame(spark, texts).coalesce(1), BPE, window=64).collect(), texts, 64)
    assert sum(sum(n for _, n in x) < 64 for x in lines.values()) <= 4  # a shard for each of four tasks, each with one last sequence
    check_pieces(packing.pack(frame(spark, texts).repartition(3), BPE, window=64).collect(), texts, 64)
    assert packing.pack(empty(spark), BPE).count() == 0


def bm25(docs, seed, row, mark):
    """The score of document ``row`` for all terms of ``seed``, by the textbook."""
    bags = [Counter(x for x in d.tolist() if x != mark) for d in docs]
    mean, total = sum(len(d) for d in docs) / len(docs), 0.0
    for t in sorted(set(seed.tolist()) - {mark}):
        if tf := bags[row][t]:
            df = sum(t in b for b in bags)
            total += np.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(docs[row]) / mean))
    return total


def test_packing_asks_with_all_terms():
    """Long seeds, whose rarest terms' holders are used, and terms rare and common: the best of all unused documents."""
    chance = np.random.default_rng(8)
    docs = [np.r_[chance.zipf(1.3, chance.integers(40, 160)) % 400 + 2, 1].astype(np.uint32) for _ in range(60)]
    alive = np.ones(len(docs), bool)
    index = packing.Index(docs, 1)
    for seed in range(0, 60, 4):
        alive[seed] = False
        got = index.best(docs[seed], alive, 8)
        scores = {r: bm25(docs, docs[seed], r, 1) for r in np.flatnonzero(alive).tolist()}
        want = sorted(scores.values(), reverse=True)[:8]
        assert np.allclose([scores[r] for r in got.tolist()], [x for x in want if x > 0], atol=1e-3)
        alive[got[:2]] = False
    # the only holders of a long seed's 30 rare terms are used; another shares its common ones, a third nothing but the end
    rare, usual = np.arange(100, 130), np.arange(10, 50)
    docs = [np.r_[rare, usual, 1], np.r_[rare, 1], np.r_[usual, 1], np.r_[np.arange(300, 310), 1], np.r_[usual, 1], np.r_[usual, 1]]
    docs = [d.astype(np.uint32) for d in docs]
    assert packing.Index(docs, 1).best(docs[0], np.array([False, False, True, True, False, False]), 8).tolist() == [2]


def test_packing_prefers_neighbours():
    docs = [np.array([t] * 10 + [90 + i], np.uint32) for i, t in enumerate([5, 6, 7, 5, 6, 7])]
    pieces, _ = packing.packed_shard(docs, 22)
    groups = defaultdict(set)
    for row, _, _, sequence, _ in pieces:
        groups[sequence].add(row)
    assert sorted(map(sorted, groups.values())) == [[0, 3], [1, 4], [2, 5]]


def test_packing_fills_a_window_with_its_own_neighbours():
    """The second neighbour is the seed's, not its first neighbour's; a long document's neighbours are found by all of its text."""
    seed = np.array([*range(10, 40), 50, 51], np.uint32)
    near = np.array([*range(10, 20), *range(60, 70)], np.uint32)
    like_near = np.array([*range(60, 70), *range(70, 80)], np.uint32)
    like_seed = np.array([*range(30, 40), 50, 51, *range(80, 88)], np.uint32)
    pieces, _ = packing.packed_shard([seed, near, like_near, like_seed], 72)
    assert {r for r, _, _, sequence, _ in pieces if sequence == 0} == {0, 1, 3}
    long_ = np.r_[np.arange(100, 130), np.arange(200, 205)].astype(np.uint32)
    other, same = np.arange(300, 315, dtype=np.uint32), np.arange(100, 110, dtype=np.uint32)
    pieces, _ = packing.packed_shard([long_, other, same], 30)
    first = {r: q for r, _, _, q, _ in pieces if r != 0}
    rest = next(q for r, s, _, q, _ in pieces if r == 0 and s == 30)
    assert len(first) == 2 and rest in {q for r, _, _, q, _ in pieces if r == 2}


def test_packing_weights_are_those_of_the_table(spark, texts):
    table = packing.encoded(frame(spark, texts).repartition(3), BPE, 1, "doc_id", "text")
    stats, exact = packing._table_stats(table), Tokenizer.from_file(BPE)
    ids = [[*exact.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    df = Counter(x for d in ids for x in set(d))
    assert (stats.n, stats.mean) == (len(ids), sum(map(len, ids)) / len(ids))
    assert {t: int(n) for t, n in enumerate(stats.df) if n} == df


def test_key_filter_and_folder(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    kept = {r.k for r in store.key_filter(rows, rows.where("k % 7 = 0"), "k").collect()}
    assert {k for k in range(0, 1000, 7)} <= kept and len(kept) < 400
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        rows = queries.queries()[name](spark, sf).toPandas()
        expected = con.sql(sql).df()
        columns = sorted(rows.columns)
        assert columns == sorted(expected.columns)
        assert sorted(map(tuple, rows[columns].astype(str).values)) == sorted(map(tuple, expected[columns].astype(str).values))


def test_components_take_no_rounds_where_one_task_can_join_them(spark, monkeypatch):
    chance = np.random.default_rng(21)
    # chains, stars and what joins them; loops, repeated and null ends
    pairs = [(int(a), int(b)) for a, b in chance.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (2000, 2001), (2001, 2000), (None, 3), (-5, 4)]
    root = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in pairs:
        if a in root and b in root and a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    want = sorted((x, top(x)) for x in root)
    edges = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(5)
    jobs = spark.sparkContext.statusTracker()
    for most, rounds in ((1 << 21, False), (40, True)):
        monkeypatch.setattr(components, "HELD", most)
        spark.sparkContext.setJobGroup(f"components {most}", "")
        assert sorted((r.node, r.root) for r in components.components(edges).collect()) == want
        # before, each round was a plan of joins and a count of its own
        assert (len(jobs.getJobIdsForGroup(f"components {most}")) > 12) == rounds
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
