from __future__ import annotations

import itertools

import numpy as np
import pytest

from gleanery.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, rep int, cell string, h1 string"


def brute(ids, vectors, labels, least=0.98):
    """Components and link counts by comparing all pairs, in double precision."""
    n = len(ids)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if labels[i] is None or labels[i] != labels[j] or len(vectors[i]) != len(vectors[j]):
            continue
        a, b = (np.asarray(v, dtype=np.float64) for v in (vectors[i], vectors[j]))
        if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    low = {}
    for i in range(n):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: (links[i], low[find(i)]) for i in range(n)}


def cloud(seed, n=300, groups=12, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    out = []
    for i in range(n):
        v = rng.standard_normal(dim) if i % 3 == 0 else centres[i % groups] + rng.standard_normal(dim) * 0.011
        out.append(np.float32(v / np.linalg.norm(v)))
    return [out[i // 2 * 2] if i % 10 == 1 else v for i, v in enumerate(out)]


def frame(spark, ids, vectors, labels):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], label, 1, "c", "h") for i, v, label in zip(ids, vectors, labels)], SCHEMA)


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 8)])
def test_against_brute_force(spark, seed, block):
    vectors = cloud(seed)
    ids, labels = [1000 - i for i in range(len(vectors))], [i % 2 for i in range(len(vectors))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.link_vectors(frame(spark, ids, vectors, labels), block=block).collect()}
    want = brute(ids, vectors, labels)
    found, true = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert true > 1000 and found >= 0.98 * true
    assert all(got[i][0] <= want[i][0] for i in ids)  # no link below the bound
    assert sum(got[i] == want[i] for i in ids) >= 0.95 * len(ids)


def test_odd_rows(spark):
    one = [1.0] + [0.0] * 7
    vectors = [one, one, None, [], [0.0] * 8, [float("nan")] * 8, [None] + one[1:], [float("inf")] * 8, one, one, one, [2.0] + one[1:], [1.0, 0.0], [1.0, 0.0], one, [1e-30] + one[1:]]
    ids = [5, 3, 6, 7, 8, 9, 10, 11, 12, None, 3, 4, 13, 14, 15, 16]
    labels = [1, 1, 1, 1, 1, 1, 1, 1, None, 1, 1, 1, 1, 1, 2, 1]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.link_vectors(frame(spark, ids, vectors, labels)).collect()), key=repr)
    want = [(5, 4, 3, False), (3, 4, 3, True), (3, 4, 3, True), (4, 4, 3, False), (16, 4, 3, False), (12, 0, 12, True), (None, 0, None, False), (13, 1, 13, True), (14, 1, 13, False), (15, 0, 15, True)]
    want += [(i, 0, i, True) for i in (6, 7, 8, 9, 10, 11)]
    assert got == sorted(want, key=repr)


def test_sql(spark, same):
    vectors = cloud(3, 120)
    vectors[5], vectors[6], vectors[7] = None, [], [0.0] * 64
    f = frame(spark, list(range(120)), vectors, [None if i == 9 else i % 2 for i in range(120)])
    same(ed.link_vectors(f, how=(16, 1, 9.0)), ed.ORACLE["op10_embedding_dedup"], embeddings=f)


def test_empty(spark):
    assert ed.link_vectors(frame(spark, [], [], [])).collect() == []


def test_lattice():
    roots = ed.e8_roots()
    assert roots.shape == (240, 8) and np.allclose((roots**2).sum(axis=1), 2)
    rng = np.random.default_rng(0)
    x = rng.uniform(-3, 3, (500, 8))
    p = ed.decode_e8(x)
    twice = np.rint(p * 2).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(axis=1) & (np.rint(p.sum(axis=1)) % 2 == 0)).all()
    for step in roots:  # no neighbouring point is nearer
        assert (((x - p) ** 2).sum(axis=1) <= ((x - p - step) ** 2).sum(axis=1) + 1e-9).all()
    assert (ed.decode_e8(p) == p).all()


@pytest.mark.parametrize(("dim", "n"), [(64, 5_000), (64, 20_000), (64, 80_000), (64, 160_000), (768, 5_000)])
def test_work_a_vector_stays_flat(dim, n):
    """Of random vectors few meet, however many there are, and pairs at the bound still do."""
    tables, points, scale = how = ed.settings(n)
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, dim), dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a = x[:1000].astype(np.float64)
    y = rng.standard_normal(a.shape)
    y -= (a * y).sum(axis=1, keepdims=True) * a
    c = rng.uniform(0.98, 0.99, (len(a), 1))
    y = c * a + np.sqrt(1 - c * c) * y / np.linalg.norm(y, axis=1, keepdims=True)
    lattice = ed.Lattice(dim, tables, 3, points, scale, 8)
    cells, others = lattice.cells(x, np.zeros(n, dtype=np.int64)), lattice.cells(y, np.zeros(len(y), dtype=np.int64))
    near = cells[:1000]
    assert ((near == others[:, :, :1]).any(axis=2) | (others == near[:, :, :1]).any(axis=2)).any(axis=1).mean() >= 0.98
    met = 0
    for t in range(tables):
        own, names = np.sort(cells[:, t, 0]), cells[:, t].ravel()
        met += int((np.searchsorted(own, names, side="right") - np.searchsorted(own, names)).sum()) - n
    assert met / n < 6, how


def test_settings_grow_with_the_logarithm():
    names = [ed.settings(10.0**k)[0] for k in range(2, 13)]
    assert names == sorted(names) and names[-1] < 60
    assert ed.settings(0.0)[0] <= ed.settings(100.0)[0]
