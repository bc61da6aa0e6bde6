from __future__ import annotations

import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gleanery.llm import packing as pk
from gleanery.llm import token_counts as tc


def by_words():
    return pk.token_count(F.col("text"))


def naive(sizes, sources, clusters, capacity, same_source):
    """The tightest compatible bin by looking at all bins; ties go to the oldest."""
    bins, out = [], []
    for s, a, c in zip(sizes, sources, clusters):
        best = None
        for b, (room, src, cl) in enumerate(bins):
            fits = room >= s and room > 0 and src[a] < same_source and (not c or c not in cl)
            if fits and (best is None or room < bins[best][0]):
                best = b
        if best is None:
            best = len(bins)
            bins.append([capacity, Counter(), set()])
        bins[best][0] -= s
        bins[best][1][a] += 1
        bins[best][2].add(c)
        out.append(best)
    return out


@pytest.mark.parametrize("same_source", [1, 2, 4])
def test_best_fit_against_all_bins(same_source):
    rng = random.Random(same_source)
    for _ in range(30):
        n = rng.randrange(1, 120)
        sizes = sorted((rng.choice((0, 1, 10, rng.randrange(101), 99)) for _ in range(n)), reverse=True)
        sources = [1 << rng.choice((0, 0, 0, 1, 2, 70)) for _ in range(n)]
        clusters = [rng.choice((0, 0, 1, 2, 1 << 80)) for _ in range(n)]
        assert pk.best_fit(sizes, sources, clusters, 100, same_source) == naive(sizes, sources, clusters, 100, same_source)


def check(rows, frame, capacity, same_source):
    out = frame.collect()
    words = Counter()
    for i, t, *_ in rows:
        words[i] += len((t or "").split())
    got = Counter()
    bins = defaultdict(list)
    for r in out:
        got[r.doc_id] += r.n_tokens
        bins[r.bin_id].append(r)
    assert +got == +words and {r.doc_id for r in out} == {r[0] for r in rows}
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= capacity
        assert max(Counter(r.source for r in b).values()) <= same_source
        assert sorted(r.place for r in b) == list(range(len(b)))
    return out, bins


def test_pack_keeps_everything(spark, docs):
    rng = random.Random(7)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice((0, 1, 5, 30, 64, 200)))), "src0" if i % 3 else f"src{i % 9}") for i in range(300)]
    rows += [(1000 + i, "copy of one text", f"src{i}") for i in range(40)]
    frame = pk.pack(docs(rows), by_words(), capacity=64, same_source=2, shard_pieces=100)
    out, bins = check(rows, frame, 64, 2)
    copies = {r.doc_id: r.bin_id for r in out if r.doc_id >= 1000}
    assert len(set(copies.values())) == 40
    again = {(r.doc_id, r.piece): r.place for r in pk.pack(docs(rows), by_words(), capacity=64, same_source=2, shard_pieces=100).collect()}
    assert again == {(r.doc_id, r.piece): r.place for r in out}


def test_odd_rows(spark, docs):
    rows = [(None, None, None), (1, "", None), (2, "a b", None), (2, "a b", None), (3, "x " * 5000, "s"), (None, "q", "s")]
    out, bins = check(rows, pk.pack(docs(rows), by_words()), 2048, 4)
    assert sorted((r.piece, r.n_tokens) for r in out if r.doc_id == 3) == [(0, 2048), (1, 2048), (2, 904)]
    twice = [r.bin_id for r in out if r.doc_id == 2]
    assert len(set(twice)) == 2


@pytest.mark.skipif(not os.path.exists(tc.VOCABULARY), reason="no vocabulary file")
def test_bins_hold_encoded_tokens(spark, docs, tmp_path):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(("Ofthstrent### ", "ß", "a ", "\n" * 1200, "12345 ")) for _ in range(rng.randrange(900))), f"s{i % 5}") for i in range(80)] + [(99, None), (100, "")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    with open(tc.VOCABULARY, "rb") as f:
        encoding = tc.encoder(f.read())
    want, got, bins = {i: len(encoding.encode_ordinary(t or "")) for i, t, *_ in rows}, Counter(), Counter()
    for r in pk.op9_best_fit_packing(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.n_tokens
        bins[r.bin_id] += r.n_tokens
    assert got == want and max(bins.values()) <= 2048


def test_empty(spark, docs):
    assert pk.pack(docs([])).collect() == []


def test_exact_multiple(spark, docs):
    rows = [(1, "x " * 128, "s")]
    out, bins = check(rows, pk.pack(docs(rows), by_words(), capacity=64), 64, 4)
    assert len(out) == 2 and len(bins) == 2
