"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists of word shingles.

Plan of ``link_documents``:

1. One pass over the texts names each document's shingle set and counts shingles in a fixed-size hashed sketch
   (2**sketch_bits counters, summed over all documents). Equal sets are one class from here on.
2. A set of n shingles that reaches a Jaccard of 0.8 with another shares at least T = ceil(0.8 n) of its n shingles,
   so the two share one of their n - T + 1 rarest. Rarity is (sketch count, hash): any order that is the same for all
   documents keeps this exact; the sketch only keeps frequent shingles out. Each class posts its rarest shingles.
   Of a pair's common shingles the first in that order is at a place of its own in each of the two sets, and bounds what
   they share; so each posting has the largest size that it can link with.
3. Sorted by shingle and size, each posting list streams through a task in constant memory, and is cut where no set
   before can link with the next. The list's first class leads it; (leader, class) pairs go on. Classes that can link with
   none of a list's sizes by this shingle are left out: those of a group's near copies that link with nothing would each
   query the whole group. Lists with the same leader form one block, so copies meet once and not once a shingle.
4. Blocks are searched with DivideSkip (Li, Lu, Lu 2008) over inverted lists of whole sets: the longest lists are left
   out of the heap merge and binary-probed for what the merge of the short ones finds; overlaps are exact. A class that
   was linked leaves the lists, so a group of copies takes about one query and not all its pairs. A query's T is that of
   the smallest set it can still meet.
   A block over `block_docs` classes or `block_shingles` shingles is dealt into salted parts. Each part meets the first one
   and so itself; what that leaves outside the block's largest component, its strays, then meets every part. Two classes
   that are in different components are never both in the largest, so no pair is lost, memory stays bounded, and a
   group of copies costs its parts times one and its strays' parts, not the square of its parts.
5. Links (a spanning set of them) go to ``connected_components``.

Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.common import connected_components, table, whole_groups, written
from gleanery.llm.shingles import mixed, set_name, shingle_sets
from gleanery.sources.scratch import new_path

#: Sketch counters travel in rows of this many.
_CHUNK = 1 << 16
#: Counters of this many partitions go to one sum at a time.
_LANE = 512


def required(n: int, percent: int = 80) -> int:
    """The fewest shingles that a set of n shares with any set at that Jaccard similarity."""
    return -(-percent * n // 100)


def in_common(n: int, m: int, percent: int = 80) -> int:
    """The fewest shingles that sets of n and m share at that Jaccard similarity."""
    return -(-percent * (n + m) // (100 + percent))


def _bucket(shingles: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(shingles) >> np.uint64(64 - bits)).astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << bits, dtype=np.uint32)
    names = ["doc_id", "text_hash", "n_shingles", "sig", "chunk", "counts"]
    for batch in batches:
        ns, sigs, waiting, held = [], [], [], 0
        for s in shingle_sets(batch.column("text"), width):
            ns.append(len(s))
            sigs.append(set_name(s) if len(s) else None)
            waiting.append(_bucket(s, bits))
            held += len(s)
            if held > _CHUNK:
                np.add.at(counts, np.concatenate(waiting), 1)
                waiting, held = [], 0
        if waiting:
            np.add.at(counts, np.concatenate(waiting), 1)
        none = pa.nulls(len(ns))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(ns, pa.int64()), pa.array(sigs, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names)
    if counts.any():
        rows = counts.reshape(-1, min(_CHUNK, len(counts)))
        none = pa.nulls(len(rows)).cast(pa.int64())
        packed = [_packed(r) for r in rows]
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(len(rows)), pa.int32()), pa.array(packed, pa.binary())], names)


def _packed(x: np.ndarray) -> bytes:
    """Counters as bytes, the bytes of one place together; sums beyond four bytes stay at the largest number."""
    return zlib.compress(np.ascontiguousarray(np.minimum(x, 2**32 - 1).astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _sums(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, b in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            x = np.ascontiguousarray(np.frombuffer(zlib.decompress(b), dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)
            sums[k] = sums[k] + x if k in sums else x
    return sums


def _add_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counters' sums over a lane of tasks, a row for each chunk."""
    sums = _sums(batches)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(x) for x in sums.values()], pa.binary())], ["chunk", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The logarithms of the counters' sums, a row for each chunk: two bytes a counter, whatever the input."""
    sums = _sums(batches)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(np.log2(x + 1.0) * 1024).astype(np.uint16).tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])


def rarest(shingles: np.ndarray, counts: np.ndarray, bits: int, percent: int) -> np.ndarray:
    """The n - T + 1 first shingles of a set in the order (sketch count, hash)."""
    keep = len(shingles) - required(len(shingles), percent) + 1
    key = counts[_bucket(shingles, bits)]
    if keep < len(shingles):
        near = key <= np.partition(key, keep - 1)[keep - 1]
        shingles, key = shingles[near], key[near]
    return shingles[np.argsort(key, kind="stable")[:keep]]  # shingles are sorted by hash


def farthest(n: int, places: np.ndarray, percent: int = 80) -> np.ndarray:
    """The largest set that one of n can link with when their first common shingle has that place among its n.

    Common shingles are then among the n - place last ones, and (100 + percent) * overlap >= percent * (n + size) for a link.
    """
    return (100 + percent) * (n - places) // percent - n


def _post(batches: Iterator[pa.RecordBatch], width: int, bits: int, percent: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen, tokens, sigs, ns, most = set(), [], [], [], []
        held = 0
        for s in shingle_sets(batch.column("text"), width):
            if not len(s) or (name := set_name(s)) in seen:
                continue
            seen.add(name)
            t = rarest(s, counts, bits, percent)
            tokens.append(t.view(np.int64))
            sigs.append(np.full(len(t), name, dtype=np.int64))
            ns.append(np.full(len(t), len(s), dtype=np.int32))
            most.append(farthest(len(s), np.arange(len(t)), percent).astype(np.int32))
            held += len(t)
            if held > 200_000:
                yield _postings(tokens, sigs, ns, most)
                tokens, sigs, ns, most, held = [], [], [], [], 0
        if held:
            yield _postings(tokens, sigs, ns, most)


def _postings(*columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["token", "sig", "n", "most"])


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From postings sorted by (token, n, sig): (leader, sig, n) for the members of lists with two or more classes.

    `most` is the largest size that a posting's class can link with by this shingle. A list ends where the next set is
    larger than that of any set before it, and its leader is the first class that can link with its own size or a larger one. A
    class that can only link with smaller sets than the leader's is left out. What is kept between batches is one row.
    """
    last = None  # token, sig, n, largest most of the token so far, leader, leader's n
    for batch in batches:
        t, s, n, most = (batch.column(k).to_numpy() for k in ("token", "sig", "n", "most"))
        n, most = n.astype(np.int64), most.astype(np.int64)
        if last is not None:
            t, s, n, most = (np.concatenate([[x], y]) for x, y in zip(last, (t, s, n, most)))  # noqa: B905
        new = np.ones(len(t), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        t, s, n, most = t[new], s[new], n[new], most[new]
        if not len(t):
            continue
        same = t[1:] == t[:-1]
        token = np.concatenate([[0], np.cumsum(~same)]) << 32
        reach = np.maximum.accumulate(token + most) - token
        before = np.full(len(t), -1)
        before[1:][same] = reach[:-1][same]
        first = (most >= n) & (n > before)
        if last is not None:
            first[0] = False
        at = np.maximum.accumulate(np.where(first, np.arange(len(t)), -1))
        lead, lead_n = (np.where(at >= 0, x[at], 0 if last is None else last[k]) for x, k in ((s, 4), (n, 5)))
        member = (n <= before) & (most >= lead_n)  # never a first one, nor the row of the batch before
        last = t[-1], s[-1], n[-1], reach[-1], lead[-1], lead_n[-1]
        led = np.concatenate([lead[member]] * 2), np.concatenate([s[member], lead[member]]), np.concatenate([n[member], lead_n[member]])
        if len(led[0]):
            order = np.lexsort((led[1], led[0]))
            leader, sig, size = (x[order] for x in led)
            keep = np.ones(len(order), dtype=bool)
            keep[1:] = (leader[1:] != leader[:-1]) | (sig[1:] != sig[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(leader[keep]), pa.array(sig[keep]), pa.array(size[keep].astype(np.int32))], ["leader", "sig", "n"])


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """(element, number of lists with it) for elements in at least `least` of the sorted lists, by a heap that skips.

    When the smallest element is in too few lists, least - 1 lists are taken off and moved on to the then smallest element:
    nothing before it can be in enough lists.
    """
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= least:
        low, out = heap[0][0], []
        while heap and heap[0][0] == low:
            out.append(heapq.heappop(heap))
        if len(out) >= least:
            yield low, len(out)
            for _, k, p in out:
                if p + 1 < len(lists[k]):
                    heapq.heappush(heap, (lists[k][p + 1], k, p + 1))
            continue
        while heap and len(out) < least - 1:
            out.append(heapq.heappop(heap))
        if not heap:
            return
        target = max(heap[0][0], low + 1)
        for _, k, p in out:
            p = bisect_left(lists[k], target, p)
            if p < len(lists[k]):
                heapq.heappush(heap, (lists[k][p], k, p))


class Lists:
    """Inverted lists of some of a block's sets, given by their places: list -> sorted places of the sets that hold its shingle."""

    def __init__(self, sets: list[np.ndarray], alive: np.ndarray):
        self.n = len(sets)
        sizes = np.array([len(sets[i]) for i in alive])
        where = np.repeat(alive, sizes)
        shingle = np.concatenate([sets[i] for i in alive]) if len(alive) else np.empty(0, dtype=np.uint64)
        order = np.lexsort((where, shingle))
        shingle, self.where = shingle[order], where[order]
        self.starts = np.concatenate([[0], np.flatnonzero(shingle[1:] != shingle[:-1]) + 1, [len(shingle)]]) if len(shingle) else np.zeros(1, dtype=np.int64)
        self.shingles = shingle[self.starts[:-1]]
        self.lengths = np.diff(self.starts)
        self.keys = np.repeat(np.arange(len(self.lengths)), self.lengths) * self.n + self.where

    def find(self, query: np.ndarray) -> np.ndarray:
        """The lists of the query's shingles."""
        if not len(self.shingles):
            return np.empty(0, dtype=np.int64)
        at = np.searchsorted(self.shingles, query)
        at[at == len(self.shingles)] = 0
        return at[self.shingles[at] == query]

    def probe(self, lists: np.ndarray, place: int) -> int:
        """In how many of the lists the set at `place` is, by binary search."""
        want = lists * self.n + place
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return int((self.keys[at] == want).sum())


def divide_skip(query: np.ndarray, index: Lists, least: int, mu: float = 0.01) -> Iterator[tuple[int, int]]:
    """(place, overlap) of the indexed sets that share at least `least` shingles with the query."""
    own = index.find(query)
    if len(own) < least:
        return
    own = own[np.argsort(index.lengths[own], kind="stable")]
    n_long = min(int(least / (mu * math.log2(index.lengths[own[-1]] + 1) + 1)), least - 1)
    short, long_ = own[: len(own) - n_long], own[len(own) - n_long :]
    lists = [index.where[index.starts[k] : index.starts[k + 1]].tolist() for k in short]
    for place, found in merge_skip(lists, least - n_long):
        overlap = found + (index.probe(long_, place) if n_long else 0)
        if overlap >= least:
            yield place, overlap


def search_block(sets: list[np.ndarray], percent: int = 80) -> list[tuple[int, int]]:
    """Links that join the same sets as all links between sets with 100 * overlap >= percent * union do.

    Each set queries the lists once. What it links to leaves them: it queries next, so no further link to it could join
    anything new. Lists are built anew when half of their sets have left.
    """
    sizes = [len(s) for s in sets]
    alive = np.ones(len(sets), dtype=bool)
    left = len(sets)
    index, built = Lists(sets, np.flatnonzero(alive)), left
    min_after = np.minimum.accumulate(np.array(sizes[::-1], dtype=np.int64))[::-1].tolist()  # all that a seed can still meet come after it
    links = []
    for seed in range(len(sets)):
        if not alive[seed]:
            continue
        alive[seed] = False
        left -= 1
        queue, fewest = [seed], min_after[seed]
        while queue and left:
            x = queue.pop()
            if left <= built // 2 and built > 8:
                index, built = Lists(sets, np.flatnonzero(alive)), left
            least = max(required(sizes[x], percent), in_common(sizes[x], fewest, percent))
            for y, overlap in divide_skip(sets[x], index, least):
                if alive[y] and 100 * overlap >= percent * (sizes[x] + sizes[y] - overlap):
                    alive[y] = False
                    left -= 1
                    links.append((x, y))
                    queue.append(y)
        if not left:
            break
    return links


def search_strays(sets: list[np.ndarray], stray: list[bool], components: list[int], percent: int = 80) -> list[tuple[int, int]]:
    """Links from any set to a stray of another component, as many as join what all such links join."""
    index = Lists(sets, np.flatnonzero(stray))
    fewest = min((len(s) for s, x in zip(sets, stray, strict=True) if x), default=0)
    root = {c: c for c in components}

    def find(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    links = []
    for x, s in enumerate(sets):
        for y, overlap in divide_skip(s, index, max(required(len(s), percent), in_common(len(s), fewest, percent))):
            a, b = find(components[x]), find(components[y])
            if a != b and 100 * overlap >= percent * (len(s) + len(sets[y]) - overlap):
                root[a] = b
                links.append((x, y))
    return links


def _search_strays(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for t, starts in whole_groups(batches, "block"):
        ids, want, stray, component = (t.column(k).to_pylist() for k in ("doc_id", "sig", "stray", "component"))
        found = shingle_sets(t.column("text"), width)
        a, b = [], []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            own: dict[int, list] = {}
            for i, s in zip(range(lo, hi), found):  # noqa: B905
                if want[i] in own:
                    own[want[i]][2] |= stray[i]
                elif len(s) and set_name(s) == want[i]:
                    own[want[i]] = [ids[i], s, stray[i], component[i]]
            names, sets, strays, components = zip(*own.values(), strict=True) if own else ((), (), (), ())
            for x, y in search_strays(list(sets), list(strays), list(components), percent):
                a.append(names[x])
                b.append(names[y])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _search(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for t, starts in whole_groups(batches, "block"):
        ids, want = t.column("doc_id").to_pylist(), t.column("sig").to_pylist()
        found = shingle_sets(t.column("text"), width)
        a, b = [], []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            own: dict[int, tuple[int, np.ndarray]] = {}
            for i, s in zip(range(lo, hi), found):  # noqa: B905
                if want[i] not in own and len(s) and set_name(s) == want[i]:  # a doc_id that comes twice brings other texts too
                    own[want[i]] = ids[i], s
            ordered = sorted(own.values(), key=lambda x: len(x[1]))
            for part in chains(ordered, percent):
                for x, y in search_block([s for _, s in part], percent):
                    a.append(part[x][0])
                    b.append(part[y][0])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def chains(ordered: list[tuple[int, np.ndarray]], percent: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Parts of two or more sets, cut where the next set is too large for any set before it."""
    part: list[tuple[int, np.ndarray]] = []
    for x in ordered:
        if part and percent * len(x[1]) > 100 * len(part[-1][1]):
            if len(part) > 1:
                yield part
            part = []
        part.append(x)
    if len(part) > 1:
        yield part


def _linked(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    sketch_bits: int = 22,
    block_docs: int = 2048,
    block_shingles: int = 2_000_000,
) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id) for each row of docs."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    signed = own.mapInArrow(lambda it: _sign(it, width, sketch_bits), "doc_id long, text_hash long, n_shingles long, sig long, chunk int, counts binary")
    path = new_path(spark, "signatures")
    signed.write.parquet(path)
    signed = spark.read.schema(signed.schema).parquet(path)
    sketch = signed.where("chunk is not null").select("chunk", "counts")
    if (lanes := sketch.rdd.getNumPartitions() // _LANE) > 1:  # many tasks' counters are summed in a tree
        lane = F.pmod(F.spark_partition_id(), F.lit(lanes)).alias("lane")
        sketch = sketch.select("chunk", "counts", lane).repartition("chunk", "lane").drop("lane").mapInArrow(_add_some, "chunk int, counts binary")
    sketch = sketch.repartition("chunk").mapInArrow(_add_up, "chunk int, counts binary")
    counts = np.zeros(1 << sketch_bits, dtype=np.uint16)  # what the driver gets has this size whatever the input
    for chunk, sums in sketch.collect():
        x = np.frombuffer(sums, dtype=np.uint16)
        counts[chunk * len(x) : (chunk + 1) * len(x)] = x
    rows = signed.where("chunk is null").select("doc_id", "text_hash", "n_shingles", "sig")
    classes = rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))

    shared = spark.sparkContext.broadcast(counts)
    post: Callable = lambda it: _post(it, width, sketch_bits, percent, shared.value)
    members = (
        own.where("doc_id is not null").select("text").mapInArrow(post, "token long, sig long, n int, most int").repartition("token").sortWithinPartitions("token", "n", "sig").mapInArrow(_led, "leader long, sig long, n int")
    )
    members = written(members.groupBy("leader", "sig").agg(F.max("n").alias("n")), "members")
    def parts_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int").alias("parts"))

    def with_texts(blocks: DataFrame, *more: str) -> DataFrame:
        """The blocks' classes with a text each, dealt out by block; a text is shuffled once, then to the blocks it is in."""
        wanted = blocks.groupBy("rep", "sig").agg(F.collect_set(F.struct("block", *more)).alias("blocks"))
        met = own.join(wanted, F.col("doc_id") == F.col("rep")).select("doc_id", "sig", "text", F.explode("blocks").alias("m"))
        return met.select("doc_id", "sig", "text", "m.*").repartition("block").sortWithinPartitions("block")

    parts = parts_of(members)
    last = F.col("parts") - 1
    # Block (0, p) holds all of both parts, so no part has a block of its own unless it is the only one.
    others = F.when((F.col("mine") == 0) & (F.col("parts") > 1), F.sequence(F.lit(1), last)).otherwise(F.array(F.lit(0)))
    members = members.join(parts, "leader").withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int")).join(classes, "sig")
    dealt = members.select("rep", "sig", "leader", "parts", "mine", F.explode(others).alias("other"))
    block = F.when(F.col("parts") == 1, F.col("leader")).otherwise(F.xxhash64("leader", F.least("mine", "other"), F.greatest("mine", "other")))
    links = written(with_texts(dealt.withColumn("block", block)).mapInArrow(lambda it: _search(it, width, percent), "a long, b long"), "links")
    found = connected_components(links)

    if parts.where("parts > 1").limit(1).count():
        big = members.where("parts > 1").join(found, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep")).drop("node")
        big = written(big, "large-blocks")
        main = big.groupBy("leader", "component").agg(F.count("*").alias("size")).groupBy("leader").agg(F.max_by("component", F.struct("size", "component")).alias("main"))
        strays = big.join(main, "leader").where("component <> main").drop("main")
        rounds = parts_of(strays).withColumnRenamed("parts", "rounds")
        to_all = strays.join(rounds, "leader").select("leader", "rep", "sig", "component", F.lit(True).alias("stray"), F.pmod(F.xxhash64("sig", F.lit(7)), F.col("rounds")).cast("int").alias("round"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
        all_ = big.join(rounds, "leader").select("leader", "rep", "sig", "component", F.lit(False).alias("stray"), F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("round"), F.col("mine").alias("part"))
        met = to_all.union(all_).withColumn("block", F.xxhash64("leader", "round", "part"))
        more = with_texts(met, "stray", "component").mapInArrow(lambda it: _search_strays(it, width, percent), "a long, b long")
        found = connected_components(links.union(more))

    classes = classes.join(found, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("sig is null or doc_id is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.where("doc_id is not null").join(classes, "sig").select("doc_id", "text_hash", "n_shingles", "component_id").union(alone)


def link_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Rows link when the Jaccard similarity of their shingle sets is at least percent / 100; component_id is the smallest
    id reachable. A null, empty or blank text has no shingles and links with nothing, not even its like. A row with a
    null id has a null component_id and links with nothing. Repeated rows each get a row; an id that comes with several
    texts gets a row for each. Further columns are not read. An empty table gives an empty result.
    """
    return _linked(docs, **options).drop("text_hash")


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by components of 5-word-shingle Jaccard links of 0.8 or more."""
    return link_documents(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; documents without an id stay.

    Of rows that repeat both id and text one stays, the first by its other columns.
    """
    kept = _linked(docs).where("doc_id = component_id").select("doc_id", "text_hash").distinct()
    hashed = docs.where("doc_id is not null").withColumn("text_hash_", F.xxhash64("text"))
    kept = kept.select(F.col("doc_id").alias("doc_id_"), F.col("text_hash").alias("kept_hash_"))
    same = (F.col("doc_id") == F.col("doc_id_")) & (F.col("text_hash_") == F.col("kept_hash_"))
    order = Window.partitionBy("doc_id", "text_hash_").orderBy(*(F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")))
    first = hashed.join(kept, same, "left_semi").withColumn("repeat_", F.row_number().over(order)).where("repeat_ = 1")
    return first.select(*docs.columns).union(docs.where("doc_id is null"))


QUERIES = {"op5_ngram_join": op5_ngram_join}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE = {
    "op5_ngram_join": rf"""
with recursive w as (select doc_id, coalesce({_WORDS}, []) as ws from documents),
s as materialized (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
      else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
g as materialized (select doc_id, len(sh) as n, unnest(sh) as sh from s),
l as materialized (select a.doc_id as a, b.doc_id as b from g a join g b on a.sh = b.sh and a.doc_id < b.doc_id
      and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as materialized (select a, b from l union all select b, a from l),
r as (select doc_id as node, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.node)
select s.doc_id, len(s.sh)::bigint as n_shingles, c.root as component_id
from s join (select node, min(root) as root from r group by node) c on c.node = s.doc_id
"""
}
