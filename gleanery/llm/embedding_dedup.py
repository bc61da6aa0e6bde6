"""Embedding near-duplicates by lattice hashing: random projections decoded to E8 points in several tables.

A table projects unit vectors to `points` times eight dimensions, shifts and scales them, and decodes each eight to the
nearest point of the E8 lattice; the points together are the vector's cell. A vector lies in its own cell and probes the
neighbouring cells nearest to it, a step of one point each; two vectors of one label meet where one's own cell is the
other's own or probed cell. Their cosine is then verified in double precision. A pair that meets in several cells counts
in the first alone, so tasks give sums and spanning links and no list of pairs.

``settings`` chooses points, scale and tables from the number of vectors: more of them get finer cells, so that a vector
meets about as many strangers in any table size, and as many tables as keep the chance of missing a pair.

Equal vectors are one row with a multiplicity from the start. Cells with one vector are dropped before vectors move.
A cell of over `block` vectors is dealt into salted parts, and every two parts meet in one task: n_links counts every
link, so vectors that share a cell must be compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import connected_components, table, whole_groups, written


@lru_cache(maxsize=1)
def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to the neighbouring cells."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1, 1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((-1, 1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum: round, and where the sum is odd round the worst the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 = D8 and D8 + 1/2."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(closer[:, None], b, a)


class Lattice:
    """The tables' projections for vectors of one length."""

    def __init__(self, dim: int, tables: int, probes: int, points: int, scale: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        width = max(dim, 8)
        # Scaled so that a coordinate varies by scale / 8 whatever the length of the vectors.
        self.planes = [np.stack([np.linalg.qr(rng.standard_normal((width, 8)))[0][:dim] * scale * np.sqrt(width / 64) for _ in range(points)]) for _ in range(tables)]
        self.shifts = rng.random((tables, points, 8)) * 2
        self.mixers = (rng.integers(1, 2**62, (tables, points * 8 + 1)) * 2 + 1).astype(np.int64)
        self.probes = probes

    def cells(self, unit: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + probes) names of cells, the vector's own first; salt sets labels and lengths apart."""
        out = np.empty((len(unit), len(self.planes), 1 + self.probes), dtype=np.int64)
        twice_roots = np.rint(e8_roots() * 2).astype(np.int64)
        for t, (planes, shifts, mixer) in enumerate(zip(self.planes, self.shifts, self.mixers, strict=True)):
            x = np.einsum("nd,pde->npe", unit, planes, optimize=True) + shifts
            own = decode_e8(x.reshape(-1, 8)).reshape(x.shape)
            # A step's name is a term that is added to the own cell's.
            steps = (twice_roots @ mixer[:-1].reshape(-1, 8).T).T.ravel()
            closeness = ((x - own) @ e8_roots().T).reshape(len(unit), -1)
            near, rows = np.empty((len(unit), self.probes), dtype=np.int64), np.arange(len(unit))
            for k in range(self.probes):
                near[:, k] = closeness.argmax(axis=1)
                closeness[rows, near[:, k]] = -np.inf
            name = (np.rint(own * 2).astype(np.int64).reshape(len(unit), -1) * mixer[:-1]).sum(axis=1) + salt * mixer[-1]
            name = np.concatenate([name[:, None], name[:, None] + steps[near]], axis=1)
            name ^= name >> 29
            out[:, t, :] = name * np.int64(0x1B873593CC9E2D51 | 1)
        return out


@lru_cache(maxsize=64)
def _odds(least: float, probes: int, points: int, scale: float, trials: int = 2000) -> tuple[float, float]:
    """The chances that a table lets a pair of cosine `least` meet, and that two random vectors share a cell, by trial."""
    rng = np.random.default_rng([points, int(scale * 100)])
    x, y = rng.standard_normal((2, trials, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * y / np.linalg.norm(y, axis=1)[:, None]
    lattice, none = Lattice(64, 1, probes, points, scale, 1), np.zeros(trials, dtype=np.int64)
    a, b = lattice.cells(x, none)[:, 0], lattice.cells(y, none)[:, 0]
    meet = (a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)
    other = Lattice(8, 1, 0, 1, scale, 2)
    other.planes[0][0] = np.eye(8) * scale / 8
    _, times = np.unique(other.cells(rng.standard_normal((20_000, 8)), np.zeros(20_000, dtype=np.int64)), return_counts=True)
    one = float((times * (times - 1.0)).sum()) / (20_000 * 19_999.0)
    return float(meet.mean()), one**points


def settings(n: float, least: float = 0.98, probes: int = 3, recall: float = 0.998) -> tuple[int, int, float]:
    """(tables, points, scale) for n vectors: the fewest cell names and chance meetings a vector, at this chance of a pair to meet.

    Both chances are tried out on the driver with a few thousand random pairs of the least cosine, at a cost that
    doesn't hang on n.
    """
    best, how = np.inf, (8, 1, 4.0)
    for points in range(1, 9):
        for scale in (4.0, 5.0, 6.0):
            meet, strangers = _odds(least, probes, points, scale)
            tables = 1 + int(np.ceil(np.log(1 - recall) / np.log(1 - min(max(meet, 1e-3), 0.95))))
            if tables * (1 + probes) >= best:  # wider scales and more points need more tables still
                break
            cost = tables * (1 + probes + (1 + 2 * probes) * strangers * n)
            if cost < best:
                best, how = cost, (tables, points, scale)
        if scale == 4.0 and tables * (1 + probes) >= best:
            break
    return how


_LATTICES: dict[tuple, Lattice] = {}


def _lattice(dim: int, how: tuple) -> Lattice:
    if (dim, *how) not in _LATTICES:
        _LATTICES[dim, *how] = Lattice(dim, *how)
    return _LATTICES[dim, *how]


def _vectors(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values.to_numpy(zero_copy_only=False), dtype=np.float64) for x in column]


def _codes(vectors: list[np.ndarray], labels: np.ndarray, how: tuple) -> tuple[list[np.ndarray], np.ndarray]:
    """Unit vectors and their cells, whatever mix of lengths comes."""
    tables, probes, *_ = how
    codes, units = np.empty((len(vectors), tables, 1 + probes), dtype=np.int64), [None] * len(vectors)
    dims = np.array([len(v) for v in vectors])
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        x = np.stack([vectors[i] for i in at])
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        codes[at] = _lattice(int(dim), how).cells(x, labels[at].astype(np.int64) * 1_000_003 + dim)
        for i, u in zip(at, x, strict=True):
            units[i] = u
    return units, codes


def _place(batches: Iterator[pa.RecordBatch], how: tuple) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        _, codes = _codes(_vectors(b.column("embedding")), b.column("label").to_numpy(), how)
        n, tables, width = codes.shape
        rep = np.repeat(b.column("rep").to_numpy(), tables * width)
        own = np.tile(np.arange(width) == 0, n * tables)
        yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()), pa.array(rep), pa.array(own)], ["cell", "rep", "own"])


def _meet(batches: Iterator[pa.RecordBatch], how: tuple, least: float, step: int = 512) -> Iterator[pa.RecordBatch]:
    for t, starts in whole_groups(batches, "block"):
        units, codes = _codes(_vectors(t.column("embedding")), t.column("label").to_numpy(), how)
        rep, times, cell, part, diagonal = (t.column(k).to_numpy() for k in ("rep", "times", "cell", "part", "diagonal"))
        dims = np.array([len(u) for u in units])
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi - lo < 2:
                continue
            at = lo + np.argsort(rep[lo:hi], kind="stable")
            at = at[(cell[at] == cell[lo]) & (dims[at] == dims[lo])]  # more than one cell or length only where 64-bit names clash
            x, c = np.stack([units[i] for i in at]), codes[at]
            links, label = np.zeros(len(at), dtype=np.int64), np.arange(len(at))
            firsts, seconds = [], []
            for a in range(0, len(at), step):
                i, j = np.nonzero(x[a : a + step] @ x[a:].T >= least)
                i, j = i + a, j + a
                ok = (i < j) & (rep[at[i]] != rep[at[j]])
                if not diagonal[lo]:
                    ok &= part[at[i]] != part[at[j]]
                i, j = i[ok], j[ok]
                if len(i):
                    first = _first_meeting(c, i, j) == cell[lo]
                    firsts.append(i[first])
                    seconds.append(j[first])
            if not firsts:
                continue
            i, j = np.concatenate(firsts), np.concatenate(seconds)
            np.add.at(links, i, times[at[j]])
            np.add.at(links, j, times[at[i]])
            while len(i):
                before = label.copy()
                np.minimum.at(label, i, label[j])
                np.minimum.at(label, j, label[i])
                label = label[label]
                if (label == before).all():
                    break
            some = links > 0
            out.append((rep[at[some]], rep[at[label[some]]], links[some]))
        a, b, n = (np.concatenate(c) if out else np.empty(0, dtype=np.int64) for c in (zip(*out, strict=True) if out else ((), (), ())))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])


def _first_meeting(c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cell in which each pair meets first; a name that no cell has for pairs that don't meet."""
    out = np.full(len(i), np.iinfo(np.int64).min)
    left = np.arange(len(i))
    for t in range(c.shape[1]):
        ci, cj = c[i[left], t], c[j[left], t]
        one, two = (cj == ci[:, :1]).any(axis=1), (ci == cj[:, :1]).any(axis=1)
        out[left] = np.where(one, ci[:, 0], np.where(two, cj[:, 0], out[left]))
        left = left[~(one | two)]
        if not len(left):
            break
    return out


def link_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    least: float = 0.98,
    probes: int = 3,
    how: tuple[int, int, float] | None = None,
    seed: int = 8,
    block: int = 4096,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Every row is indexed. Vectors link when their labels and lengths are equal, they meet in a cell (see ``settings`` for the chance), and their cosine in
    double precision is at least `least`. n_links counts other rows linked directly; component_id is the smallest id
    reachable; kept says that it is the row's own. A row whose id or label is null, or whose vector is null, empty, zero or
    holds a null or non-finite number, links with nothing (a null id has a null component and isn't kept). Equal vectors
    of one label link with each other. Rows that repeat an id count as rows and share its component. Further columns are
    not read. An empty table gives an empty result.
    how is (tables, points, scale); without it ``settings`` chooses them by the number of distinct vectors of a label that
    a vector of that label has beside it on average. Vectors of any length are projected whole.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    sound = F.coalesce(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & sound, F.lit(False))
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"), sound.alias("sound"))
    key = [F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2")]
    rows = own.where("sound").select("vec_id", "label", "embedding", *key)
    reps = written(rows.groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep_id"), F.count("*").alias("times"), F.first("embedding").alias("embedding")).withColumn("rep", F.monotonically_increasing_id()), "vectors")
    if how is None:
        labels = reps.groupBy("label").agg(F.count("*").cast("double").alias("n"))
        n = labels.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]  # one number
        how = settings(n or 1.0, least, probes)
    how = (how[0], probes, *how[1:], seed)
    placed = written(reps.select("rep", "label", "embedding").mapInArrow(lambda it: _place(it, how), "cell long, rep long, own boolean"), "cells")
    parts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("own").alias("owners")).where("n > 1 and owners > 0").select("cell", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    blocks = placed.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).select("cell", "rep", "parts", "part", other.alias("other"))
    name = F.when(F.col("parts") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")))
    wanted = blocks.groupBy("rep").agg(F.collect_set(F.struct(name.alias("block"), "cell", "part", (F.col("part") == F.col("other")).alias("diagonal"))).alias("blocks"))
    met = (
        reps.join(wanted, "rep")
        .select("rep", "label", "times", "embedding", F.explode("blocks").alias("m"))
        .select("rep", "label", "times", "embedding", "m.*")
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(lambda it: _meet(it, how, least), "a long, b long, n long")
    )
    met = written(met, "links")
    counts = met.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    names = reps.select("rep", "rep_id", "times", "label", "h1", "h2").join(counts, "rep", "left")
    ends = met.select("a", "b").distinct().join(reps.select(F.col("rep").alias("a"), F.col("rep_id").alias("ida")), "a").join(reps.select(F.col("rep").alias("b"), F.col("rep_id").alias("idb")), "b")
    found = connected_components(ends.select(F.col("ida").alias("a"), F.col("idb").alias("b")))
    names = names.join(found, F.col("rep_id") == F.col("node"), "left")
    names = names.select("label", "h1", "h2", (F.col("times") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep_id").alias("component_id"))
    linked = rows.drop("embedding").join(names, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = own.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors by components of cosine links of 0.98 or more within a label."""
    return link_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op10_embedding_dedup": op10_embedding_dedup}
#: All pairs of a label: what the search is held against.
ORACLE = {
    "op10_embedding_dedup": """
with recursive v as materialized (select vec_id, label, embedding::double[] as e from embeddings),
s as materialized (select *, list_inner_product(e, e) as norm from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
  and len(list_filter(e, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from s a join s b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / sqrt(a.norm * b.norm) >= 0.98),
e as materialized (select a, b from l union all select b, a from l),
r as (select vec_id as node, vec_id as root from v union select e.b, r.root from r join e on e.a = r.node),
c as (select node, min(root) as component_id from r group by node),
n as (select a, count(*) as n_links from e group by a)
select vec_id, coalesce(n_links, 0)::bigint as n_links, component_id, component_id = vec_id as kept from v join c on c.node = v.vec_id left join n on n.a = v.vec_id
"""
}
