"""Host-level quality rules: failures by domain, rates shrunk with an empirical beta prior, verdicts joined back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table, written
from gleanery.llm.shingles import word_windows

_SPACE = b" \t\n\x0b\x0c\r"
_SPACE_AND_TAILS = _SPACE + bytes(range(0x80, 0xC0))
#: The characters that count as symbols.
_SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(windows: np.ndarray, n_words: int, width: int = 5) -> int:
    """Words that stand in a window which comes twice or more, the first time included."""
    if n_words <= width:
        return 0
    _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
    if len(times) == len(windows):
        return 0
    at = np.flatnonzero(times[inverse] > 1)
    cover = np.bincount(at, minlength=n_words + 1) - np.bincount(at + width, minlength=n_words + 1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(_SPACE)]
    return len(lines) - len(set(lines))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x, (n, h) in zip(batch.column("text"), word_windows(batch.column("text"), lower=False), strict=True):
            text = x.as_py() or b""
            symbols = len(text) - len(text.translate(None, _SYMBOLS))
            rows.append((n, len(text.translate(None, _SPACE_AND_TAILS)), symbols, duplicate_lines(text), repeated_words(h, n)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "host", *_COUNTS])


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(mean, weight) of the beta distribution that hosts (n_docs, n_failed) draw their failure rates from.

    A host's own rate strays from its true one by sampling alone, the more the fewer its documents. So the spread of
    true rates is what the spread between hosts has beyond the spread within them (analysis of variance for proportions
    with unequal numbers): rho = (between - within) / (between + (n0 - 1) within), and weight = 1 / rho - 1 documents,
    held between 0.01 and 10,000. The mean weighs a host by n / (1 + (n - 1) rho), as far as its documents tell about
    hosts, so no host decides it by size. Where hosts don't differ beyond chance, or no host has two documents, so that
    nothing can be told apart, they are pooled: the weight is 10,000. Fewer than two hosts, or none or only failures,
    give the even prior of mean 0.5 and weight 2. Two aggregates of one row each, whatever the number of hosts.
    """
    rate = F.col("n_failed") / F.col("n_docs")
    k, docs, failed, squares, inner, fails = hosts.agg(
        F.count("*"), F.sum("n_docs"), F.sum("n_failed"), F.sum(F.col("n_docs").cast("double") * F.col("n_docs")), F.sum(F.col("n_docs") * rate * (1 - rate)), F.sum(F.col("n_failed") * rate)
    ).first()
    if k < 2 or not 0 < failed < docs:
        return 0.5, 2.0
    rho = 0.0
    if docs > k:
        between = max(fails - failed * failed / docs, 0.0) / (k - 1)
        within = inner / (docs - k)
        n0 = (docs - squares / docs) / (k - 1)
        rho = max((between - within) / (between + (n0 - 1) * within), 0.0)
    share = F.col("n_docs") / (1 + (F.col("n_docs") - 1) * rho)
    mean = hosts.agg(F.sum(share * rate) / F.sum(share)).first()[0]
    return mean, min(max(1 / rho - 1, 0.01), 10_000.0) if rho > 0 else 10_000.0


def host_rates(rows: DataFrame, host: str = "host", failed: str = "failed") -> DataFrame:
    """(host, n_docs, n_failed, rate): each host's failure rate, shrunk towards ``beta_prior``.

    Rows without a host are left out. The counts are summed before the shuffle, so one host with a third of all rows is
    no heavier than another.
    """
    hosts = rows.where(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    hosts = written(hosts, "host-counts")
    mean, weight = beta_prior(hosts)
    return hosts.withColumn("rate", (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight))


def judge_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    repeat_percent: int = 20,
    symbol_percent: int = 10,
    dup_lines_per_100: int = 5,
    host_limit: float = 0.5,
) -> DataFrame:
    """A row for each row of docs: doc_id, the counts, base_failed, rule_failed, host_rate, kept.

    base_failed: under min_words words, or more than repeat_percent of them in repeated windows. rule_failed: that, or
    more symbols than symbol_percent of the word characters, or more than dup_lines_per_100 repeated lines to 100 words.
    A host whose shrunk rate of rule_failed is over host_limit fails as a whole.
    kept: not base_failed and the host does not fail. A null or empty text has no words and so fails; a null host has no
    verdict (host_rate null) and fails nobody. Texts of any length are counted whole. Repeated rows and null ids are judged like any other row. Further columns
    are not read. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("binary").alias("text"))
    rows = own.mapInArrow(_count, "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS))
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > symbol_percent * F.col("word_chars")) | (100 * F.col("n_dup_lines") > dup_lines_per_100 * F.col("n_words"))
    rows = written(rows.withColumn("base_failed", base).withColumn("rule_failed", F.col("base_failed") | soft), "quality")
    # Written, the verdicts have a known size: few hosts are broadcast without dealing rows out by host, many are joined.
    verdicts = written(host_rates(rows, failed="rule_failed").select(F.col("host").alias("host_"), F.col("rate").alias("host_rate")), "hosts")
    joined = rows.join(verdicts, F.col("host") == F.col("host_"), "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_rate") > host_limit, F.lit(False))
    return joined.select("doc_id", *_COUNTS, "base_failed", "rule_failed", "host_rate", kept.alias("kept"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts, the base rule and the host's verdict for every whole document."""
    return judge_documents(table(spark, sf_dir, "documents")).drop("host_rate")


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE = {
    "op7_quality_rules": r"""
with w as materialized (select row_number() over () as row, doc_id, source as host, coalesce(text, '') as text,
  coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
g as (select row, i, array_to_string(ws[i:i + 4], ' ') as gram from w, unnest(range(1, greatest(len(ws) - 3, 1))) u(i)),
d as (select row, i from (select row, i, count(*) over (partition by row, gram) as times from g) where times > 1),
r as (select row, count(distinct i + k)::bigint as n_repeat_words from d, unnest([0, 1, 2, 3, 4]) u(k) group by row),
n as (select row, unnest(string_split(text, chr(10))) as line from w),
l as (select row, (count(*) - count(distinct line))::bigint as n_dup_lines from n where regexp_matches(line, '[^\x20\x09-\x0D]') group by row),
c as materialized (select w.row, doc_id, host, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join r using (row) left join l using (row)),
f as materialized (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words or 100 * n_symbols > 10 * word_chars or 100 * n_dup_lines > 5 * n_words as rule_failed from c),
h as materialized (select host, count(*) as n_docs, sum(rule_failed::int) as n_failed from f where host is not null group by host),
m as (select count(*) as k, sum(n_docs) as docs, sum(n_failed) as failed, sum(n_docs * n_docs::double) as squares,
  sum(n_failed * (1 - n_failed / n_docs::double)) / (docs - k) as within, (sum(n_failed * n_failed / n_docs::double) - failed * failed / docs::double) / (k - 1) as between from h),
o as (select *, k >= 2 and failed > 0 and failed < docs as told, case when docs > k then greatest((between - within) / (between + ((docs - squares / docs) / (k - 1) - 1) * within), 0) else 0 end as rho from m),
q as (select sum(n_failed / (1 + (n_docs - 1) * rho)) / sum(n_docs / (1 + (n_docs - 1) * rho)) as mean from h, o where told),
p as (select case when told then mean else 0.5 end as mean, case when not told then 2 when rho > 0 then least(greatest(1 / rho - 1, 0.01), 10000) else 10000 end as weight from o, q),
v as (select host, (n_failed + mean * weight) / (n_docs + weight) as rate from h, p)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule_failed,
  not base_failed and not coalesce(rate > 0.5, false) as kept
from f left join v on f.host = v.host
"""
}
