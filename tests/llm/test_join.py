"""The n-gram join against all pairs, and components against a union of sets."""

import random
import re

import numpy as np
import pytest

from metaquarry.llm import components, ngram_join, shingles
from tests.llm import edge

SF = "/root/testdata/sf0.001"


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) >= width:
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
    return {tuple(words)} if words else set()


def brute(rows, width, percent):
    ids = sorted({i for i, _ in rows if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(i, shingle_set(t, width)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(
        ((i, len(shingle_set(t, width)), find(i) if i is not None else None) for i, t in rows),
        key=lambda r: (r[0] is None, r),
    )


def joined(df, width, percent):
    out = ngram_join.jaccard_components(df, "doc_id", "text", width, percent).collect()
    return sorted((tuple(r) for r in out), key=lambda r: (r[0] is None, r))


def test_awkward_rows(spark):
    docs = edge.documents(spark)
    assert joined(docs, 4, 85) == brute([r[:2] for r in edge.ROWS], 4, 85)
    assert joined(docs.limit(0), 4, 85) == []


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (1, 60)])
def test_against_all_pairs(spark, width, percent):
    """Random edits of a few texts, so that many pairs lie close to the threshold."""
    rng = random.Random(width)
    texts = [[f"w{rng.randint(0, 300)}" for _ in range(rng.randint(3, 90))] for _ in range(6)]
    rows = []
    for i in range(160):
        words = list(rng.choice(texts))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], ["new"], [f"x{i}"], [words[at]] * 2])
            words = words or ["w"]
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(df, width, percent) == brute(rows, width, percent)


def test_one_large_group_of_near_copies(spark):
    """Long shards: every member has an edit of its own, links form a chain of groups."""
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        words[(i * 7) % 120] = f"e{i}"
        if i % 3 == 0:
            words[(i * 11 + 5) % 120] = f"f{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert joined(df, 4, 85) == brute(rows, 4, 85)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert joined(docs, 4, 85) == brute(rows, 4, 85)


def test_cross_pairs_of_a_long_shard():
    rng = np.random.default_rng(3)
    n = 200
    c = {
        "token": np.zeros(n, np.int64),
        "hi": np.arange(n),
        "lo": np.arange(n),
        "n": np.sort(rng.integers(50, 70, n)),
        "place": rng.integers(0, 8, n),
        "component": rng.choice([1, 1, 1, 1, 2, 3], n),
    }
    want = {
        (i, j)
        for i in range(n)
        for j in range(i + 1, n)
        if c["component"][i] != c["component"][j] and ngram_join._possible(c, np.array([i]), np.array([j]), 85)[0]
    }
    got = {(int(i), int(j)) for a, b in ngram_join._cross_pairs(c, 85) for i, j in zip(a, b, strict=True)}
    assert got == want
    short = {k: v[:40] for k, v in c.items()}
    got = {(int(i), int(j)) for a, b in ngram_join._cross_pairs(short, 85) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i, j in want if j < 40}


def test_trie_shares_paths():
    rng = np.random.default_rng(5)
    anchor = rng.integers(0, 2**63, 400).astype(np.uint64)
    trie = ngram_join._Trie(anchor)
    members = [np.concatenate((anchor[: 400 - k], rng.integers(0, 2**63, k).astype(np.uint64))) for k in range(0, 80, 3)]
    for m in sorted(members, key=lambda m: m.tobytes()):
        both = len(np.intersect1d(anchor, m))
        assert trie.linked(m, 85) == (100 * both >= 85 * (len(anchor) + len(m) - both))


def test_shingles_do_not_depend_on_the_batch():
    texts = ["", "a", "A b", "a B c d", "é ü 𝒳 a b c", "x " * 50, edge.LONG]
    raw = [t.encode() for t in texts]
    together = shingles.shingle_sets(raw, 4)
    for t, r, got in zip(texts, raw, together, strict=True):
        assert (shingles.shingle_sets([r], 4)[0] == got).all()
        assert len(got) == len(shingle_set(t, 4))
    assert (together[2] == shingles.shingle_sets([b"a  B\n"], 4)[0]).all()


def test_components(spark):
    rng = random.Random(1)
    order = rng.sample(range(1000), 300)
    links = list(zip(order, order[1:], strict=False)) + [(2000, 2001), (2001, 2000), (5000, 5001), (5002, 5001)]
    got = components.connected(spark.createDataFrame(links, "a long, b long")).collect()
    want = {n: min(order) for n in order} | {2000: 2000, 2001: 2000, 5000: 5000, 5001: 5000, 5002: 5000}
    assert {r["node"]: r["component"] for r in got} == want
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
