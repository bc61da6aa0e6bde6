"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Tokens are summed by cell (source, language, topic), where a value that the targets don't name counts as "other". So
there are at most as many cells as the targets' sizes multiplied, whatever the corpus, and raking them on the driver is
bounded by the caller's parameters. How often each document is drawn follows from its cell's weight: a document of a
cell that the targets ask for more often than it is there is drawn several times.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table, written
from gleanery.llm.packing import token_count

OTHER = "other"
#: The query's targets: the hot source is held to a quarter of all tokens, the other nineteen share alike.
TARGETS = {
    "source": {"src0": 0.24, **{f"src{i}": 0.75 / 19 for i in range(1, 20)}, OTHER: 0.01},
    "lang": {"en": 0.62, "de": 0.14, "fr": 0.14, "es": 0.09, OTHER: 0.01},
    "topic": {"legal": 0.02, "technical": 0.02, "contact": 0.03, "general": 0.93},
}
#: The query's topics: the first of which a text holds a word; else general.
TOPICS = (("legal", ("License", "license", "All rights reserved", "all rights reserved")), ("technical", ("password", "token", "AKIA")), ("contact", ("@",)))


def topic_of(text: Column) -> Column:
    out = F.lit("general")
    for name, words in reversed(TOPICS):
        for w in words:
            out = F.when(F.contains(text, F.lit(w)), name).otherwise(out)
    return out


@dataclass
class Raked:
    """Each cell's factor, and each margin's value with its target share (null without one) and the share that the factors give it."""

    factors: dict[tuple[str, ...], float]
    margins: list[tuple[str, str, float | None, float]]

    def reached(self, within: float = 1e-6) -> set[tuple[str, str]]:
        """The (margin, value) whose target the factors reach."""
        return {(d, v) for d, v, want, have in self.margins if want is not None and abs(want - have) <= within}


def rake(cells: dict[tuple[str, ...], float], targets: Mapping[str, Mapping[str, float]], rounds: int = 100, within: float = 1e-12) -> Raked:
    """Factors such that cell totals times factors have the targets' shares in every margin, as nearly as the cells allow.

    Every round scales the cells to one margin after the other. Target values without tokens are left out and the rest
    of that margin scaled up; cells whose value has no target share get none; a margin with no tokens under any target
    stays as it is. Targets that contradict one another end after `rounds`; the result's margins tell which were missed.
    """
    keys = sorted(k for k, v in cells.items() if v > 0)
    total = np.array([cells[k] for k in keys])
    share = fitted = total / total.sum() if len(keys) else total
    margins = []
    for axis, (dim, shares) in enumerate(targets.items()):
        names = {n: i for i, n in enumerate(sorted({k[axis] for k in keys}))}
        want = np.array([shares.get(n, 0.0) for n in names])
        margins.append((dim, list(names), np.array([names[k[axis]] for k in keys], dtype=np.int64), want / want.sum() if want.sum() > 0 else None))
    for _ in range(rounds):
        before = fitted
        for _, _, where, want in margins:
            if want is not None:
                have = np.bincount(where, weights=fitted, minlength=len(want))
                fitted = fitted * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[where]
        if np.abs(fitted - before).max(initial=0.0) < within:
            break
    told = []
    for dim, names, where, want in margins:
        have = np.bincount(where, weights=fitted, minlength=len(names)).tolist()
        told += [(dim, n, None if want is None else float(want[i]), have[i]) for i, n in enumerate(names)]
    return Raked(dict(zip(keys, (fitted / share).tolist(), strict=True)), told)


def chances(factors: Mapping[tuple[str, ...], float], keep: float, most: int | None) -> dict[tuple[str, ...], float]:
    """Expected copies c * factor of each cell's documents, with one c for all cells, so the margins stay as they were raked.

    c is `keep`, or less where a cell would otherwise have more than `most` copies. Factors leave the total as it is, so
    the expected tokens are the share c of all.
    """
    top = max(factors.values(), default=0.0)
    c = keep if most is None or keep * top <= most else most / top
    return {k: c * f if most is None else min(float(most), c * f) for k, f in factors.items()}


def draw(doc_id: Column, seed: str) -> Column:
    """A number from 0 to 1 that hangs on the id and the seed alone, so a task that runs again draws the same."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(16**12)


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]],
    dims: Mapping[str, Column],
    tokens: Column,
    id_col: str = "doc_id",
    keep: float = 0.85,
    most: int | None = None,
    seed: str = "mix",
    carry: list[str] | None = None,
) -> DataFrame:
    """(doc, cell, tokens, weight, chance, copies, on_target) for each row: doc is a struct of the row's own columns, or those of carry.

    With carry the narrow rows are written to the shared folder, so texts are read once; without it they are read for
    the cells and again for the result.

    dims gives a column for each margin of targets; a null or a value without a target counts as "other". weight is the
    raked factor of the row's cell, chance the expected copies c * weight, copies what is drawn: the whole part of chance,
    and one more with the rest as its probability. So expected margins are the raked ones: nothing is cut off at 1. c is
    `keep`, the expected share of all tokens, or where `most` copies of a row is the limit the largest c that holds it
    (most=1: plain sampling without repeats, which must leave out much where a target is far above its share).
    on_target: the raking reached the targets of all of the row's margins; where it did not, for targets that contradict
    one another or cells that no document is in, a warning is given too.
    A document without tokens has its cell's chance, or 1 where the cell has no tokens. Rows with the same id share one
    draw; a null id is an id like another. Very long texts are documents like others. An empty table gives an empty
    result.
    """
    named = {d: F.when(c.isin(list(targets[d])), c).otherwise(F.lit(OTHER)) for d, c in dims.items()}
    rows = docs.select(F.struct(*(carry or docs.columns)).alias("doc"), F.struct(*(c.alias(d) for d, c in named.items())).alias("cell"), tokens.cast("long").alias("tokens"))
    rows = written(rows, "mix") if carry else rows
    cells = {tuple(r["cell"]): float(r["tokens"]) for r in rows.groupBy("cell").agg(F.sum("tokens").alias("tokens")).collect()}
    raked = rake(cells, targets)
    reached, found = raked.reached(), chances(raked.factors, keep, most)
    if missed := [(d, v) for d, v, _, _ in raked.margins if (d, v) not in reached]:
        warnings.warn(f"targets not reached: {missed}", stacklevel=2)
    table_ = [(dict(zip(dims, k, strict=True)), raked.factors[k], found[k], all(m in reached for m in zip(dims, k, strict=True))) for k in raked.factors]
    kinds = ", ".join(f"{d}: string" for d in dims)
    weights = docs.sparkSession.createDataFrame(table_, f"cell struct<{kinds}>, weight double, chance double, on_target boolean")
    # At most as many rows as the targets have cells.
    joined = rows.join(F.broadcast(weights), "cell", "left")
    chance = F.coalesce("chance", F.lit(1.0))
    once_more = (draw(F.col(f"doc.{id_col}"), seed) < chance - F.floor(chance)).cast("long")
    return joined.select(
        "doc", "cell", "tokens", F.coalesce("weight", F.lit(1.0)).alias("weight"), chance.alias("chance"), (F.floor(chance).cast("long") + once_more).alias("copies"), F.coalesce("on_target", F.lit(False)).alias("on_target")
    )


def margins(mixed: DataFrame, dims: list[str]) -> DataFrame:
    """(dim, value, share, expected, drawn) of a mixed table: shares of tokens before, in expectation, and as drawn."""
    each = mixed.select(F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(f"cell.{d}").alias("value")) for d in dims))).alias("m"), "tokens", (F.col("tokens") * F.col("chance")).alias("e"), (F.col("tokens") * F.col("copies")).alias("d"))
    sums = each.groupBy("m.dim", "m.value").agg(F.sum("tokens").alias("t"), F.sum("e").alias("e"), F.sum("d").alias("d"))
    whole = sums.groupBy("dim").agg(*(F.sum(c).alias(f"all_{c}") for c in "ted"))
    return sums.join(whole, "dim").select("dim", "value", (F.col("t") / F.col("all_t")).alias("share"), (F.col("e") / F.col("all_e")).alias("expected"), (F.col("d") / F.col("all_d")).alias("drawn"))


def mix_documents(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.coalesce(F.col("text"), F.lit("")))}
    return mix(docs, TARGETS, dims, token_count(F.col("text")), carry=carry)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, tokens, calibrated chance and how often it is drawn."""
    out = mix_documents(table(spark, sf_dir, "documents"), carry=["doc_id"])
    cell = [f"cell.{d}" for d in TARGETS]
    return out.select("doc.doc_id", *cell, F.col("tokens").alias("n_tokens"), F.round("weight", 6).alias("weight"), F.round("chance", 6).alias("chance"), "copies", (F.col("copies") > 0).alias("kept"), "on_target")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are drawn, as many rows of each as its copies, so that the targets are met without leaving out most of the rest.

    Null and empty texts have no tokens and their cell's chance; a null source or language counts as "other"; rows with
    the same id are drawn together; texts of any length are weighed whole.
    """
    drawn = mix_documents(docs).where("copies > 0")
    return drawn.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


QUERIES = {"op3_source_mixing": op3_source_mixing}


def _oracle(rounds: int = 100, keep: float = 0.85) -> str:
    """The same in SQL: raking as a recursion over margins by turns."""
    wants = ", ".join(f"('{d}', '{v}', {share!r}::double)" for d, shares in TARGETS.items() for v, share in shares.items())
    named = {d: f"case when {d} in ({', '.join(repr(v) for v in shares)}) then {d} else '{OTHER}' end as {d}" for d, shares in TARGETS.items() if d != "topic"}
    topic = " ".join(f"when {' or '.join(f"contains(text, '{w}')" for w in words)} then '{name}'" for name, words in TOPICS)
    step = " ".join(f"when {i} then w * (select x.share from want x where x.dim = '{d}' and x.value = {d}) / sum(w) over (partition by {d})" for i, d in enumerate(TARGETS))
    off = " and ".join(f"abs(sum(w) over (partition by {d}) - (select x.share from want x where x.dim = '{d}' and x.value = {d})) <= 1e-6" for d in TARGETS)
    return rf"""
with recursive d as materialized (select doc_id, source, lang, coalesce(text, '') as text from documents),
r as materialized (select doc_id, {named["source"]}, {named["lang"]}, case {topic} else 'general' end as topic,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as n_tokens from d),
cells as materialized (select source, lang, topic, sum(n_tokens)::double as tokens from r group by all having sum(n_tokens) > 0),
target(dim, value, share) as (values {wants}),
want as materialized (select dim, value, share / sum(share) over (partition by dim) as share from target t where exists (select 1 from cells c
  where t.value = case t.dim when 'source' then c.source when 'lang' then c.lang else c.topic end)),
fit as (select 0 as i, source, lang, topic, tokens / sum(tokens) over () as w from cells
  union all select i + 1, source, lang, topic, case i % {len(TARGETS)} {step} end from fit where i < {rounds * len(TARGETS)}),
p as (select source, lang, topic, w / (tokens / sum(tokens) over ()) as weight, {off} as on_target from fit join cells using (source, lang, topic) where i = {rounds * len(TARGETS)}),
q as (select doc_id, r.source, r.lang, r.topic, n_tokens, coalesce(weight, 1) as weight, coalesce({keep} * weight, 1) as chance, coalesce(on_target, false) as on_target,
  ('0x' || substr(sha256('mix:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint / {float(16**12)!r} as u
  from r left join p on p.source = r.source and p.lang = r.lang and p.topic = r.topic),
c as (select *, floor(chance)::bigint + (u < chance - floor(chance))::int as copies from q)
select doc_id, source, lang, topic, n_tokens, round(weight, 6) as weight, round(chance, 6) as chance, copies, copies > 0 as kept, on_target from c
"""


ORACLE = {"op3_source_mixing": _oracle()}
