"""Best-fit packing under conflicts: residual-ordered bins carry source and duplicate-cluster bitmaps.

Documents longer than a bin are cut into full bins and a rest; nothing is dropped. Pieces are dealt by a hash of their
document into shards of about `shard_pieces`, whatever their source, so a source with a third of all rows is spread
evenly; a shard is packed by one task, longest piece first. For a piece the bins with room are taken in order of their
residual, tightest first, and the search goes on to the successor until a bin has neither the piece's cluster nor
`same_source` pieces of its source; else a new bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table, whole_groups, written
from gleanery.llm.token_counts import encoded_lengths

_OUT = ["shard", "doc_id", "piece", "n_tokens", "source", "bin", "place"]


def token_count(text: Column) -> Column:
    """Words of a text between ASCII white space; 0 without one. """
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+")))


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, same_source: int) -> list[int]:
    """The bin of each piece; sizes come longest first. sources and clusters are bitmaps of one bit, or of none.

    A bin's source bitmaps are layered: layer k has the bits of sources that it holds more than k times. Bins that are
    open wait in a list ordered by (residual, bin); a search begins at the first bin with room and never looks back.
    """
    room: list[tuple[int, int]] = []
    layers: list[list[int]] = []
    held: list[int] = []
    out = []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        for at in range(bisect_left(room, (size, -1)), len(room)):
            residual, b = room[at]
            if not (held[b] & c or layers[b][-1] & s):
                del room[at]
                break
        else:
            residual, b = capacity, len(held)
            held.append(0)
            layers.append([0] * same_source)
        held[b] |= c
        for k in range(same_source):
            if not layers[b][k] & s:
                layers[b][k] |= s
                break
        if residual > size:
            insort(room, (residual - size, b))
        out.append(b)
    return out


def _source_masks(sources: list) -> list[int]:
    seen: dict = {}
    return [1 << seen.setdefault(v, len(seen)) for v in sources]


def _cluster_masks(clusters: list) -> list[int]:
    """A bit for each cluster that comes more than once; 0 for the others, which conflict with nothing."""
    times = Counter(clusters)
    seen: dict = {}
    return [1 << seen.setdefault(c, len(seen)) if times[c] > 1 else 0 for c in clusters]


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, same_source: int) -> Iterator[pa.RecordBatch]:
    for t, starts in whole_groups(batches, "shard"):
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            g = t.slice(lo, hi - lo).sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
            bins = best_fit(g.column("n_tokens").to_pylist(), _source_masks(g.column("source").to_pylist()), _cluster_masks(g.column("cluster").to_pylist()), capacity, same_source)
            order = np.argsort(bins, kind="stable")
            place = np.empty(len(bins), dtype=np.int64)
            sorted_bins = np.array(bins)[order]
            first = np.concatenate([[0], np.flatnonzero(sorted_bins[1:] != sorted_bins[:-1]) + 1])
            place[order] = np.arange(len(bins)) - np.repeat(first, np.diff([*first, len(bins)]))
            yield pa.RecordBatch.from_arrays([*(g.column(k).combine_chunks() for k in _OUT[:5]), pa.array(bins, pa.int64()), pa.array(place)], _OUT)


def pack(
    docs: DataFrame,
    tokens: Column | None = None,
    vocabulary: str | None = None,
    cluster: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    capacity: int = 2048,
    same_source: int = 4,
    shard_pieces: int = 5_000,
) -> DataFrame:
    """(doc_id, piece, n_tokens, source, bin_id, place): a row for each piece of each document.

    tokens defaults to the exact encoded length of text under vocabulary (see ``token_counts``), cluster to a hash of the
    whole text, so exact copies never share a bin. A document without tokens (a null or empty text) is a piece of no
    length in some bin; one of any length is cut into as many full bins as it fills. A null source is a source of its own, null ids are packed
    like any other; repeated rows are copies of each other. Ties go by id and piece. Further columns are not read.
    An empty table gives an empty result.
    """
    cluster = F.xxhash64("text") if cluster is None else cluster
    narrow = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.cast("long").alias("cluster")]
    own = encoded_lengths(docs, vocabulary, carry=narrow).withColumnRenamed("length", "n") if tokens is None else docs.select(*narrow, tokens.cast("long").alias("n"))
    own = written(own, "lengths")
    full = (F.col("n") / capacity).cast("long")
    rest = F.col("n") - full * capacity
    # A full piece fills a bin by itself, so only rests are searched for.
    heads = own.where(full > 0).select("doc_id", "source", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
    heads = heads.select("doc_id", "piece", F.lit(capacity).cast("long").alias("n_tokens"), "source", F.lit(0).cast("long").alias("place"))
    rests = own.where((rest > 0) | (F.col("n") == 0)).select("doc_id", full.alias("piece"), rest.alias("n_tokens"), "source", "cluster")
    shards = max(1, -(-rests.count() // shard_pieces))
    rests = rests.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", F.lit(17)), F.lit(shards)))
    run = lambda it: _pack(it, capacity, same_source)
    packed = rests.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "shard long, doc_id long, piece long, n_tokens long, source string, bin long, place long")
    # Bins of rests have even numbers, full bins odd ones.
    mixed_id = (F.col("bin") * shards + F.col("shard")) * 2
    lone = F.monotonically_increasing_id() * 2 + 1
    return packed.select("doc_id", "piece", "n_tokens", "source", mixed_id.alias("bin_id"), "place").union(heads.select("doc_id", "piece", "n_tokens", "source", lone.alias("bin_id"), "place"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in bins of 2,048 encoded tokens, at most four of a source and no two copies in a bin."""
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in bins, the last stage's result. Odd rows are packed as ``pack`` says."""
    return pack(docs)


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLE: dict[str, str] = {}
