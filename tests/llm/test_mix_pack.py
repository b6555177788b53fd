"""Mixing and packing: exact totals, exact round trips, awkward rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from metaquarry.llm import mixing, packing
from tests.llm import edge


def targets(sizes):
    """Water-filling by repeated resharing, as the contract words it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    done, left = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in done]
        if not rest:
            return done
        per = left / sum(weight[s] for s in rest)
        over = [s for s in rest if per * weight[s] > 3 * sizes[s]]
        if not over:
            return done | {s: per * weight[s] for s in rest}
        for s in over:
            done[s], left = 3.0 * sizes[s], left - 3 * sizes[s]


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"a": 1, "b": 1000, "c": 3, None: 50},
        {"a": 0, "b": 7},
        {"é": 10, "z": 5, "𝒳": 900, "A": 1, None: 1},
        {"a": 5},
    ],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = targets(sizes)
    assert set(got) == set(want)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_of_awkward_rows(spark):
    docs = edge.documents(spark)
    rows = mixing.mix_sources(docs, "doc_id", "text", "source").collect()
    assert len(rows) == len(edge.ROWS)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in edge.ROWS]
    assert sorted(r["size"] for r in rows) == sorted(size)
    totals = Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        totals[r["source"]] += r["taken"]
    by = Counter()
    for r, n in zip(edge.ROWS, size, strict=True):
        by[r[3]] += n
    want = targets(dict(by))
    for s, t in want.items():
        assert abs(totals[s] - t) <= 4  # slots of one word
        assert all(abs(r["target"] - t) < 1e-6 and r["source_size"] == by[s] for r in rows if r["source"] == s)
    again = mixing.mix_sources(docs.repartition(7), "doc_id", "text", "source").collect()
    names = ("doc_id", "size", "target", "taken")
    assert Counter(tuple(r[c] for c in names) for r in rows) == Counter(tuple(r[c] for c in names) for r in again)
    assert mixing.mix_sources(docs.limit(0), "doc_id", "text", "source").count() == 0


def test_schedule_spreads_sources(spark):
    """In every stretch of the mix a source has about its share of the slots."""
    rows = [("a", 6000 * 256, 6000 * 256), ("b", 3000 * 256, 3000 * 256), (None, 1000 * 256, 1000 * 256)]
    df = spark.createDataFrame(rows, "source string, size long, quota long")
    slots = mixing.schedule(df, 256).collect()
    counts = defaultdict(list)
    for r in slots:
        counts[r["line"]["source"]].append((r["slot"], r["rank"]))
    assert sum(map(len, counts.values())) == 10_000
    assert all(abs(len(counts[s]) - n) <= 3 for s, n in (("a", 6000), ("b", 3000), (None, 1000)))
    for s, share in (("a", 0.6), ("b", 0.3), (None, 0.1)):
        own = sorted(counts[s])
        assert [rank for _, rank in own] == list(range(len(own)))
        for upto in range(500, 10_001, 500):
            assert abs(sum(slot < upto for slot, _ in own) - share * upto) < 8


def test_the_points_decide(spark, monkeypatch):
    """Another sequence of points gives another mix, and a document's slots hold its words."""
    docs = spark.createDataFrame([(i, "w " * (i % 7), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 100)
    monkeypatch.setattr(mixing, "DOCUMENT_SLOTS", 1)
    rows = mixing.mix_sources(docs, "doc_id", "text", "source").collect()
    quotas = [(s, int(t + 0.5)) for s, t in {(r["source"], r["target"]) for r in rows}]
    block = mixing.slot_words(sum(q for _, q in quotas), 257)
    slots = {(r["line"]["source"], r["rank"]): r["slot"] for r in mixing.schedule(
        spark.createDataFrame(quotas, "source string, quota long"), block
    ).collect()}
    assert block > 1
    held = Counter(s for s, _ in slots)
    for s, t in {(r["source"], r["target"]) for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in own) == min(held[s] * block, 3 * own[0]["source_size"])
        assert abs(sum(r["taken"] for r in own) - t) <= 4 * block
    for r in rows:
        assert r["first_slot"] == (slots[r["source"], r["row"] // block] if r["taken"] else None)
        words = [r["row"] + k * r["source_size"] + w for k in range(3) for w in range(r["size"])]
        mine = {w // block for w in words if w < min(held[r["source"]] * block, 3 * r["source_size"])}
        assert r["n_slots"] >= len(mine) and (r["n_slots"] > 0) == (r["taken"] > 0)
    monkeypatch.setattr(mixing, "GOLDEN", 0.5)
    other = mixing.mix_sources(docs, "doc_id", "text", "source").collect()
    key = lambda rows: sorted((r["doc_id"], r["taken"], r["first_slot"] or -1) for r in rows)
    assert key(other) != key(rows)


def test_round_robin_carries_deficits():
    totals = np.array([70_001, 3, 20_000, 9_996])
    whole = int(totals.sum())
    count = -(-whole // 1000)
    dealt = packing.round_robin(totals, 1000, count, whole - (count - 1) * 1000)
    assert (dealt >= 0).all() and (dealt.sum(0) == totals).all() and (dealt[:-1].sum(1) == 1000).all()
    fair = np.arange(1, count + 1)[:, None] * 1000 * totals[None] / whole
    assert np.abs(np.cumsum(dealt, 0)[:-1] - fair[:-1]).max() < 2


def check_pieces(rows, docs, length):
    """Every id in one piece, sequences without gaps; gives the sequences' fills."""
    left = Counter()
    for d in docs:
        left[(d[0], len(d[1]))] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[(r["doc_id"], r["doc_tokens"])].append(r)
        sequences[r["sequence_id"]].append(r)
    ids = {(d[0], len(d[1])): d[1] for d in docs}
    for key, copies in left.items():
        covered = Counter()
        for r in pieces[key]:
            part = np.array(ids[key][r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and len(part) == r["length"] > 0
            covered.update(range(r["start"], r["start"] + r["length"]))
        assert set(covered.values()) == {copies} and len(covered) == key[1]
    assert set(pieces) == set(left)
    fills = []
    for _, own in sorted(sequences.items()):
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        fills.append(at)
    assert sorted(sequences) == list(range(len(fills)))
    return fills


def test_pack_awkward_rows(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    table = edge.ROWS + [(70, "hello <|endoftext|> world", "en", "a", 1), (71, "<|endoftext|><|endoftext|>x <|endoftext", "en", "a", 1)]
    assert tokenizer.encode(table[-2][1], add_special_tokens=False).ids == [31373, 220, 50256, 995]
    docs = edge.documents(spark, table)
    rows = packing.pack(docs, "doc_id", "text", "source", packing.tokenizer_path(), 256, 4).collect()
    # copies under one id have one text here, so an id and a length name a document
    want = [
        (r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1])
        for r in table
    ]
    fills = check_pieces(rows, want, 256)
    assert sum(fills) == sum(len(d[1]) for d in want)
    assert all(f == 256 or f & (f - 1) == 0 for f in fills)
    assert packing.pack(docs.limit(0), "doc_id", "text", "source", packing.tokenizer_path()).count() == 0


def test_ids_of_parts_are_the_ids_of_the_whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    texts = [
        "it's  we'll   don't", " lead", "trail  ", "a\n b", "x. y, z! 1 2 a1 b2", "<|endoftext|> a <|endoftext|>",
        "é è ü   x", "tab\t x\r\n y", "𝒳 a 𝒳", "", " ", "ab's 's s", "1 'll", "a 'b", "ÿ ÿ × ÷ a",
    ]
    encoder = packing.Encoder(packing.tokenizer_path())
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        want = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert np.frombuffer(raw, encoder.kind).tolist() == want, text


def test_windows_keep_the_mixture(spark):
    rows = [(i, "the cat sat on a mat " * (5 + i % 7), "en", "abc"[min(2, i % 6)], 1) for i in range(400)]
    docs = spark.createDataFrame(rows, edge.SCHEMA)
    got = packing.pack(docs, "doc_id", "text", "source", packing.tokenizer_path(), 128, 8).toPandas()
    whole = got.groupby("source")["length"].sum() / got["length"].sum()
    windows = got.assign(w=got["sequence_id"] // 8).groupby(["w", "source"])["length"].sum().unstack(fill_value=0)
    full = windows[windows.sum(axis=1) == 1024]
    assert len(full) > 5
    assert ((full.div(1024) - whole).abs() < 0.01).all().all()
