"""Exact token counts: a histogram of encoded lengths whose suffix sums answer totals, quantiles and truncated totals."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gleanery.llm.common import table, written

#: Fixed value: how the public byte-level vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths are summed in blocks of this many first.
BLOCK = 1024


#: Runs of white space (as the vocabulary's pattern sees it) so long that its look-ahead would have to step back far.
_LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    """The encoder of a rank file's content; made once for each Python worker."""
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def encoded_length(encoding, text: str | None) -> int:
    """The exact number of tokens of a whole text, of any length; 0 for a null or empty one.

    A run of white space is one piece to the pattern, but for its last character where more text follows: that stays
    with what follows. So long runs are cut out at these bounds and merged as the pieces that they are, and the pattern
    never has to step back over them.
    """
    if not text:
        return 0
    n = at = 0
    for run in _LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def shipped_encoder(spark: SparkSession, vocabulary: str | None = None) -> Callable:
    """A function for tasks that gives the encoder of a rank file which only the driver needs to have.

    vocabulary defaults to the setting spark.gleanery.vocabulary, and that to VOCABULARY. The file, a vocabulary's ranks,
    is sent to the executors whole: its size hangs on the vocabulary, not on the corpus.
    """
    with open(vocabulary or spark.conf.get("spark.gleanery.vocabulary", VOCABULARY), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    return lambda: encoder(sent.value)


def encoded_lengths(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", carry: Sequence[Column | str] = ()) -> DataFrame:
    """(*carry, length) of each row's whole text in tokens; 0 for a null or empty text.

    Lone surrogates can't be in a Spark string; other odd characters are encoded by their bytes.
    """
    get = shipped_encoder(docs.sparkSession, vocabulary)
    rows = docs.select(*carry, F.col(text_col).cast("string").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = get()
        for b in batches:
            yield b.drop_columns(["text_"]).append_column("length", pa.array((encoded_length(encoding, t.as_py()) for t in b.column("text_")), pa.int64()))

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("length", LongType())]))


def histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs): exact counts, summed before the shuffle."""
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """hist with, for each length L: docs_longer, tokens_longer, tokens_upto, total_docs, total_tokens, truncated_tokens.

    truncated_tokens is what a context limit of L leaves of all documents: tokens_upto + L * docs_longer. Lengths are
    summed in blocks of `block`, then blocks are summed over; no task has more than a block's or all blocks' rows.
    """
    h = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("b", F.floor(F.col("length") / block))
    blocks = h.groupBy("b").agg(F.sum("n_docs").alias("bd"), F.sum("n_tokens").alias("bt"))
    later = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    blocks = blocks.select("b", zero(F.sum("bd").over(later)).alias("bd"), zero(F.sum("bt").over(later)).alias("bt"), F.sum("bd").over(whole).alias("total_docs"), F.sum("bt").over(whole).alias("total_tokens"))
    inside = Window.partitionBy("b").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(blocks, "b").select(
        "length",
        "n_docs",
        (zero(F.sum("n_docs").over(inside)) + F.col("bd")).alias("docs_longer"),
        (zero(F.sum("n_tokens").over(inside)) + F.col("bt")).alias("tokens_longer"),
        "total_docs",
        "total_tokens",
    )
    upto = F.col("total_tokens") - F.col("tokens_longer")
    return out.withColumn("tokens_upto", upto).withColumn("truncated_tokens", upto + F.col("length") * F.col("docs_longer"))


def truncated_total(sums: DataFrame, limit: int) -> int:
    """What is left of all documents when each is cut to `limit` tokens, for any limit; 0 for an empty table."""
    row = sums.where(F.col("length") <= limit).orderBy(F.desc("length")).select("tokens_upto", "docs_longer").first()
    if row is None:
        row = sums.select(F.lit(0), "total_docs").first() or (0, 0)
    return int(row[0] + limit * row[1])


def quantile(sums: DataFrame, q: float) -> int | None:
    """The smallest length that a share q of the documents doesn't exceed; None for an empty table."""
    row = sums.where(F.col("total_docs") - F.col("docs_longer") >= F.ceil(F.lit(q) * F.col("total_docs"))).orderBy("length").select("length").first()
    return None if row is None else int(row[0])


def token_histogram(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """The histogram of docs with its suffix sums: a row for each encoded length that occurs.

    Null and empty texts count as documents of length 0; repeated rows count each; very long texts, and long runs of one
    character in them, are counted exactly. Other columns are not read. An empty table gives an empty result.
    """
    return suffix_sums(written(histogram(encoded_lengths(docs, vocabulary, text_col)), "lengths"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded lengths of all whole documents, with the totals of every context limit."""
    return token_histogram(table(spark, sf_dir, "documents"))


QUERIES = {"op4_token_counts": op4_token_counts}
ORACLE: dict[str, str] = {}
