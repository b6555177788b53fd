"""Phrase mining, removal of repeats and ranked search against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from metaquarry.llm import bag_search, phrases, run_index
from tests.llm import edge

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# --- phrases --------------------------------------------------------------------------------


def brute_phrases(rows, min_count, top, absorb=80):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for n in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= min_count}
        most = Counter()
        for g, a in found.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    most[g[i : i + n]] = max(most[g[i : i + n]], a)
        rank = []
        for g, a in found.items():
            if 100 * most[g] < absorb * a:
                cuts = [(2_000_000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                rank.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        n = sum(a for g, a in counts.items() if len(g) == 1)
        for i, (s, a, p, left, right) in enumerate(sorted(rank)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def mined(df, **options):
    found = phrases.collocations(df, "text", "lang", **options).collect()
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found)


def test_phrases_on_awkward_rows(spark):
    rows = [r for r in edge.ROWS if r[0] != 9]  # the long row has no phrase twice
    rows += [(20, "A b\x00c \xa0d, a b\x00c \xa0d; été Été a\tb  c a b c\x0bA B C.", "fr", "x", 1)] * 2
    want = brute_phrases([(r[1], r[2]) for r in rows], 2, 40)
    assert mined(edge.documents(spark, rows), min_count=2, top=40) == want
    assert {w[0] for w in want} >= {"en", "fr", "und"} - {"und"}
    assert mined(edge.documents(spark, rows).limit(0), min_count=2, top=40) == []


def test_phrases_without_language_and_long_rows(spark, monkeypatch):
    """Texts read in small pieces, summaries that overflow, one language with most rows."""
    rng = random.Random(5)
    words = [f"w{min(int(rng.expovariate(0.1)), 60)}" for _ in range(6_000)]
    rows = [(" ".join(words), None), (" ".join(words[:50]), "en"), (None, "en")] + [("w1 w2 w3 w4.", None)] * 40
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = brute_phrases(rows, 30, 100)
    assert len(want) > 20
    assert mined(df, top=100) == want


def test_long_text_in_pieces():
    text = " ".join(f"w{i % 700}" for i in range(3_000)) + ". end"
    pdf = pd.DataFrame({"lang": ["en"], "text": [text.encode()]})
    whole, parts = Counter(), Counter()
    for size, out in ((1 << 20, whole), (300, parts)):
        for _, words, new in phrases.chunks(iter([pdf]), size):
            for n in range(1, 5):
                out.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1) if i + n > new)
    assert whole == parts


@pytest.mark.parametrize("seed", range(5))
def test_frequent_keys_survive_any_merge(seed):
    rng = np.random.default_rng(seed)
    keys = rng.zipf(1.3, 30_000).clip(max=5_000).astype(np.uint64)
    threshold = 30
    capacity = len(keys) // threshold + 1
    total = phrases.Summary(capacity // 2)
    parts = np.array_split(keys, 7)
    total.capacity = capacity
    for part in parts:
        inner = phrases.Summary(capacity)
        inner.merge(*phrases.add_up(part, np.ones(len(part), np.int64)))
        total.merge(inner.keys, inner.counts, inner.error)
    assert len(total.keys) <= capacity and total.error < threshold
    counts = Counter(keys.tolist())
    kept = set(total.survivors(threshold).tolist())
    assert {k for k, n in counts.items() if n >= threshold} <= kept
    held = dict(zip(total.keys.tolist(), total.counts.tolist(), strict=True))
    assert all(n - total.error <= held.get(k, 0) <= n for k, n in counts.items())


def test_tight_summaries_still_give_exact_phrases(spark, monkeypatch):
    """Few partitions and a small bitmap: summaries overflow, more passes on, results stay."""
    monkeypatch.setattr(phrases, "MIN_PARTS", 1)
    monkeypatch.setattr(phrases, "GRAM_BITS", 15)
    rng = random.Random(6)
    rows = [(" ".join(f"w{int(rng.expovariate(0.15))}" for _ in range(40)), "en") for _ in range(300)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert mined(df, top=50) == brute_phrases(rows, 30, 50)


# --- repeats --------------------------------------------------------------------------------


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t) + 1)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def removed(df, **options):
    out = []
    for r in run_index.remove_repeats(df, "doc_id", "text", **options).collect():
        spans = list(zip(r["starts"], r["ends"], strict=True))
        assert spans == sorted(spans) and sum(e - s for s, e in spans) == r["n_bytes"] - len(r["kept"])
        kept = hashlib.sha256(r["kept"]).hexdigest()
        out.append((r["doc_id"] if "doc_id" in r else r["doc"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(spans), kept))
    return Counter(out)


def check_repeats(spark, texts, length, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = Counter((i, *r) for i, r in enumerate(brute_repeats(texts, length)))
    assert removed(df, length=length, **options) == want


def test_repeats_on_awkward_rows(spark):
    rows = edge.ROWS + [(None, "é" * 300, "fr", "a", 1), (30, "x" + "é" * 150, None, None, 1), (31, "\0" * 450, None, None, 1)]
    want = Counter((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 200), strict=True))
    assert removed(edge.documents(spark, rows)) == want
    assert not removed(edge.documents(spark, rows).limit(0))


@pytest.mark.parametrize("length, group_bytes", [(20, 1 << 20), (20, 60), (60, 400), (200, 2_000)])
def test_repeats_in_hot_groups(spark, length, group_bytes):
    """One passage in most texts, between different neighbours; groups split down to windows."""
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcde") for _ in range(6))
    hot = " ".join(word() for _ in range(length // 7)) + "é"
    texts = [f"{word()} {word()}{hot[rng.randrange(3):]}{word()} {word()} {word()}" * rng.choice((1, 1, 2)) for _ in range(60)]
    texts += ["ab" * 200, "ab" * 150 + "c", "a" * 500, None, "", hot, hot, " ".join(word() for _ in range(300))]
    check_repeats(spark, texts, length, group_bytes=group_bytes, block_bytes=500)


def test_repeats_in_long_texts(spark, monkeypatch):
    """A passage across the border of two pieces of a text."""
    rng = random.Random(1)
    blob = "".join(rng.choice("abcdefgh ") for _ in range(2 * run_index.PIECE_BYTES + 5_000))
    at = run_index.PIECE_BYTES
    texts = [blob, "x" * 30 + blob[at - 150 : at + 130] + "y" * 30, blob[at + 190 : at + 380]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc"]: list(zip(r["starts"], r["ends"], strict=True)) for r in run_index.remove_repeats(df, "doc_id", "text").collect()}
    assert got == {0: [(at - 150, at + 130)], 1: [(30, 310)], 2: []}


@pytest.mark.parametrize("seed", range(6))
def test_run_index(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 97 + 1 + seed, 300).astype(np.uint8)
    text = np.concatenate([base, base[20:250], rng.integers(0, 256, 50).astype(np.uint8), base, [255]]).astype(np.uint8)
    index = run_index.RunIndex(text)
    raw = text.tobytes()
    suffixes = sorted(range(len(raw)), key=lambda i: raw[i:])
    bwt = [256 if i == 0 else raw[i - 1] for i in suffixes]
    assert np.repeat(index.heads, index.lengths).tolist() == bwt
    assert len(index.heads) == 1 + sum(a != b for a, b in zip(bwt, bwt[1:]))
    lcp = lambda i, j: next((k for k in range(len(raw)) if raw[i + k : i + k + 1] != raw[j + k : j + k + 1] or max(i, j) + k >= len(raw)), 0)
    want = np.zeros(len(raw), int)
    for i, j in zip(suffixes, suffixes[1:]):
        want[i], want[j] = max(want[i], lcp(i, j)), max(want[j], lcp(i, j))
    assert index.statistics().tolist() == want.tolist()


# --- search ---------------------------------------------------------------------------------


def brute_search(docs, items, k):
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall(lower(text)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // words
            score = 0
            for t in terms & set(b):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * b[t] // (1_000 * b[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (s, null, i) in enumerate(sorted(found)[:k]):
            out.append((item, rank + 1, None if null else i, -s))
    return Counter(out)


@pytest.mark.parametrize("k, pairs", [(50, 200_000), (3, 4)])
def test_search_on_awkward_rows(spark, k, pairs):
    items = [(1, "word1 the OF"), (1, "word2"), (2, None), (3, "?!"), (4, "null ID text"), (None, "one-two été"), (5, "zzz")]
    items += [(6, "ünïcödé one"), (7, " ".join(f"word{i}" for i in range(60)))]
    ask = spark.createDataFrame(items, "item_id long, text string")
    ask = ask.withColumns({c: edge.F.lit(1) for c in ("item", "term", "score", "doc")})
    docs = edge.documents(spark)
    found = bag_search.search(docs, "doc_id", "text", ask, "item_id", "text", k, pairs).collect()
    assert Counter((r["item"], r["rank"], r["doc"], r["score"]) for r in found) == brute_search(
        [(r[0], r[1]) for r in edge.ROWS], items, k
    )
    none = docs.limit(0)
    assert bag_search.search(none, "doc_id", "text", ask, "item_id", "text").count() == 0
    assert bag_search.search(docs, "doc_id", "text", ask.limit(0), "item_id", "text").count() == 0


def test_search_with_many_copies(spark):
    """Classes with more members than are asked for, spread over tasks, and equal scores."""
    rng = random.Random(2)
    docs = [(i, "alpha beta" if i % 3 else f"alpha {rng.choice('xyz')} beta") for i in range(400)]
    docs += [(None, "alpha beta")] * 60 + [(7, "beta alpha")]
    items = [(1, "alpha"), (2, "beta x"), (3, "gamma")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    ask = spark.createDataFrame(items, "item_id long, text string")
    for k in (5, 50, 300):
        found = bag_search.search(df, "doc_id", "text", ask, "item_id", "text", k).collect()
        assert Counter((r["item"], r["rank"], r["doc"], r["score"]) for r in found) == brute_search(docs, items, k)
