from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import ngram_join as nj
from gleanery.llm.shingles import shingle_sets, word_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_sets(texts):
    out = []
    for t in texts:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(ids, sets):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        low[find(i)] = min(low.get(find(i), x), x)
    return [low[find(i)] for i in range(len(ids))]


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(n):
        if i % 4 == 0 or not rows:
            t = [rng.choice(words) for _ in range(rng.choice((1, 4, 5, 6, 30, 120, 300)))]
        elif i % 4 == 1:
            t = common + [rng.choice(words) for _ in range(rng.choice((5, 10, 80)))]
        else:
            t = list(rng.choice(rows))
            for _ in range(rng.choice((0, 1, 2, 5))):
                t[rng.randrange(len(t))] = rng.choice(words)
        rows.append(t)
    return [" ".join(t) for t in rows]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"block_docs": 3}), (3, {"sketch_bits": 10, "block_shingles": 500})])
def test_against_brute_force(spark, docs, seed, options):
    texts = corpus(seed)
    ids = [1000 - i for i in range(len(texts))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.link_documents(docs(list(zip(ids, texts))), **options).collect()}
    sets = brute_sets(texts)
    assert got == {i: (len(s), c) for i, s, c in zip(ids, sets, brute_components(ids, sets))}


def test_odd_rows(spark, docs):
    long = " ".join(f"x{i % 70000}" for i in range(150_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (None, "one two"), (6, long), (7, long + " end"), (7, long + " end"), (8, "É b c d e"), (9, "é b c d e"), (5, "other words are here now")]
    got = sorted((tuple(r) for r in nj.link_documents(docs(rows)).collect()), key=repr)
    n = 70000 + 0
    big = len(brute_sets([long])[0])
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, None), (6, big, 6), (7, big + 1, 6), (7, big + 1, 6), (8, 1, 8), (9, 1, 9), (5, 1, 5)]
    assert n and got == sorted(want, key=repr)


def test_empty(spark, docs):
    assert nj.link_documents(docs([])).collect() == []
    assert nj.link_documents(docs([(1, None)])).collect() == [(1, 0, 1)]


def test_sql(spark, docs, same):
    d = docs([(i, t) for i, t in enumerate(corpus(5, 80))] + [(900, None), (901, "")])
    same(nj.link_documents(d), nj.ORACLE["op5_ngram_join"], documents=d)


def test_stage_keeps_one_of_each(spark, docs):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (1, "A b c d e f"), (2, "other words"), (None, "q"), (5, None), (6, ""), (2, "a b c d e f")]
    d = docs(rows)
    out = nj.stage(spark, d, "")
    assert out.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "A b c d e f"), (2, "other words"), (None, "q"), (5, None), (6, "")], key=repr)


def test_merge_skip_counts():
    rng = random.Random(4)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randrange(12))) for _ in range(rng.randrange(1, 9))]
        for least in (1, 2, 3, 5):
            want = {}
            for x in lists:
                for e in x:
                    want[e] = want.get(e, 0) + 1
            assert dict(nj.merge_skip(lists, least)) == {e: c for e, c in want.items() if c >= least}


def test_divide_skip_overlaps():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    index = nj.Lists(sets, np.arange(40))
    for q in sets:
        for least in (1, 3, 10, 20):
            want = {i: len(np.intersect1d(q, s)) for i, s in enumerate(sets)}
            assert dict(nj.divide_skip(q, index, least)) == {i: n for i, n in want.items() if n >= least}


def test_windows_don_t_cross_texts():
    texts = ["a b c d e f", "g", None, "", "a b c d e f", "h i j k l"]
    got = [(n, len(h)) for n, h in word_windows(pa.array([t if t is None else t.encode() for t in texts], pa.binary()))]
    assert got == [(6, 2), (1, 1), (0, 0), (0, 0), (6, 2), (5, 1)]
    sets = list(shingle_sets(pa.array([b"a b c d e f", b"A B c d e f"], pa.binary())))
    assert (sets[0] == sets[1]).all()
    sliced = pa.array([b"zz zz", b"a b c d e f", None, b"q"], pa.binary()).slice(1, 2)
    assert [len(h) for _, h in word_windows(sliced)] == [2, 0]


def test_sketch_in_a_tree(spark, docs, monkeypatch):
    """Counters summed lane by lane give the components that one sum gives."""
    texts = corpus(7, 90)
    d = docs(list(enumerate(texts))).repartition(6)
    want = sorted(map(tuple, nj.link_documents(d, sketch_bits=12).collect()))
    monkeypatch.setattr(nj, "_LANE", 2)
    assert sorted(map(tuple, nj.link_documents(d, sketch_bits=12).collect())) == want
    assert nj._packed(np.array([1, 2**40], dtype=np.int64)) == nj._packed(np.array([1, 2**32 - 1], dtype=np.int64))


def blocks_of(texts, size, bits=16):
    """The sets by name, and each leader's members, with postings told in batches of that many rows."""
    column = pa.array([t.encode() for t in texts], pa.binary())
    sets = {nj.set_name(s): s for s in shingle_sets(column)}
    counts = np.zeros(1 << bits, dtype=np.uint16)
    for s in sets.values():
        np.add.at(counts, nj._bucket(s, bits), 1)
    posted = nj._post(iter([pa.RecordBatch.from_arrays([column], ["text"])]), 5, bits, 80, counts)
    rows = pa.Table.from_batches(list(posted)).sort_by([(k, "ascending") for k in ("token", "n", "sig")]).combine_chunks()
    blocks = {}
    for b in nj._led(iter(rows.to_batches(max_chunksize=size))):
        for leader, sig, n in zip(*(b.column(k).to_pylist() for k in ("leader", "sig", "n"))):
            assert n == len(sets[sig])
            blocks.setdefault(leader, set()).add(sig)
    return sets, blocks


def linked(a, b):
    both = len(np.intersect1d(a, b))
    return 100 * both >= 80 * (len(a) + len(b) - both)


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_blocks_join_what_links_join(size):
    sets, blocks = blocks_of(corpus(11), size)
    names = list(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            if linked(sets[a], sets[b]):
                assert any(a in m and b in m for m in blocks.values())


def test_near_copies_that_cannot_link_meet_no_block():
    """Sets of one size with a seventh of their own shingles share enough rare ones to be posted together, but can't link."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(400)]
    near, far = ([list(base) for _ in range(60)] for _ in range(2))
    for group, places in ((near, 2), (far, 12)):
        for k, t in enumerate(group):
            for at in rng.sample(range(0, 390, 6), places):
                t[at] = f"own{k}-{at}-{places}"
    sets, blocks = blocks_of([" ".join(t) for t in near + far], 1 << 20, 20)
    names = list(sets)
    assert not any(linked(sets[a], sets[b]) for a in names[60:] for b in names if a != b)
    assert set.union(*blocks.values()) == set(names[:60])


def test_least_overlap_by_sizes():
    for n in range(1, 40):
        for m in range(1, 40):
            want = [o for o in range(min(n, m) + 1) if 100 * o >= 80 * (n + m - o)]
            assert nj.in_common(n, m) == min(want, default=nj.in_common(n, m)) and (want or nj.in_common(n, m) > min(n, m))
            assert (nj.farthest(n, np.array([0])) >= m)[0] == (180 * n >= 80 * (n + m))
