"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in every whole text, hashed, and counted by distinct repositories and owners over the corpus.
A value that many owners hold in many repositories is a widely copied example. One that few owners hold, or many in few
repositories that they share, and that doesn't look like a placeholder, is a live-looking credential; in many
repositories of few owners it is a live one in reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.binding import let
from gleanery.llm.common import table, written


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base patterns. Their order is the order of kinds at one start.
ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: (kind, pattern, group of the value, fewest characters of it, a cheaper test that holds wherever a long enough match is).
BASE_KINDS = (
    ("assign", ASSIGN, 2, 8, lambda t: t.rlike(ASSIGN)),
    ("access", ACCESS, 0, 16, lambda t: F.contains(t, F.lit("AKIA"))),
    ("hex", HEX, 0, 32, lambda t: t.rlike("[0-9a-f]{32}")),
)
#: Kinds that the method adds where their values belong to few owners.
MORE_KINDS = (
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, lambda t: F.contains(t, F.lit("gh")) & t.rlike("gh[pousr]_[A-Za-z0-9]{36}")),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, lambda t: F.contains(t, F.lit("eyJ"))),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*", 0, 30, lambda t: F.contains(t, F.lit("PRIVATE KEY-----"))),
)

#: Matches are worked on in lists of this many, so that spans are not copied once for every match after them.
_LIST = 64
_SPAN = "struct<start:int,rank:int,kind:string,end:int,hash:string,shaped:boolean>"
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|x{4}|your|1234567"


def _found(text: Column, kind: str, rank: int, pattern: str, group: int, least: int, test) -> Column:
    """The kind's spans: leftmost non-overlapping matches whose value is long enough. Offsets count code points.

    The pieces between matches come from split(); a match starts where the pieces and matches before it end.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.transform(pieces, F.length).alias("gap"), matches.alias("match"), values.alias("value"))
    size = lambda x: x["gap"] + F.coalesce(F.length(x["match"]), F.lit(0))

    def passed(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = acc["at"] + size(x)
        shaped = ~x["value"].rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.split(x["value"], ""))) >= 6)
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(x["value"], 256).alias("hash"), shaped.alias("shaped")
        ).cast(_SPAN)
        spans = F.when(F.length(x["value"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def of_list(few: Column, at: Column) -> Column:
        return F.aggregate(few, F.struct(at.alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans")), step, lambda acc: acc["spans"])

    def of_lists(lists: Column) -> Column:
        sizes = F.transform(lists, lambda few: F.aggregate(few, F.lit(0), lambda n, x: n + size(x)))
        starts = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), passed, lambda acc: acc["starts"])
        return F.flatten(F.zip_with(lists, starts, of_list))

    def of_rows(rows: Column) -> Column:
        return let(F.transform(F.sequence(F.lit(1), F.size(rows), F.lit(_LIST)), lambda at: F.slice(rows, at, _LIST)), of_lists)

    return F.when(test(text), let(rows, of_rows)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def candidates(text: Column) -> Column:
    """All candidate spans of a text, by start and then kind."""
    kinds = [*BASE_KINDS, *MORE_KINDS]
    return F.array_sort(F.concat(*(_found(text, k, i, p, g, n, test) for i, (k, p, g, n, test) in enumerate(kinds))))


def ownership(spans: DataFrame, owner: str = "owner", repo: str = "repo") -> DataFrame:
    """(hash, n_owners, n_repos): by how many distinct owners and repositories each candidate value is held."""
    return spans.groupBy("hash").agg(F.count_distinct(owner).alias("n_owners"), F.count_distinct(repo).alias("n_repos"))


def judged(rows: DataFrame, live_owners: int = 2, live_repos: int = 2) -> DataFrame:
    """From rows (row, owner, repo, found): (row, spans) with each span's verdict: example, reused, live or placeholder.

    A value of more than live_owners owners and more than live_repos repositories is an example. Of the others those
    shaped like a credential are live; in more than live_repos repositories (so of few owners) they are reused. A null
    owner or repository counts as none.
    """
    spans = rows.select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s.*")
    counts = ownership(spans)
    many = F.col("n_repos") > live_repos
    verdict = F.when((F.col("n_owners") > live_owners) & many, "example").when(~F.col("shaped"), "placeholder").when(many, "reused").otherwise("live")
    joined = spans.join(counts, "hash").withColumn("verdict", verdict)
    own = F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end", "verdict", "n_owners", "n_repos")))
    return joined.groupBy("row").agg(own.alias("spans"))


def _live(span: Column) -> Column:
    return span["verdict"].isin("live", "reused")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, live_owners: int = 2, live_repos: int = 2) -> DataFrame:
    """A row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_reused, n_example, details.

    The base kinds' spans are always listed; those of the method's kinds where they are live or reused. owner and repo default to
    the source, and the source with the language. A null or empty text has no spans, and base_sha256 is that of the
    empty string; a text of any length, with any number of matches, is scanned whole. Repeated rows and null ids are
    scanned like any other row. Further columns are not read. An empty table gives an empty result.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), owner.alias("owner"), repo.alias("repo"), candidates(text).alias("found"))
    rows = written(rows, "secrets")
    out = rows.join(judged(rows.where(F.size("found") > 0), live_owners, live_repos), "row", "left")
    base = F.filter("found", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    told = F.filter("spans", lambda s: (s["rank"] < len(BASE_KINDS)) | _live(s))
    verdicts = lambda v: F.coalesce(F.size(F.filter("spans", lambda s: s["verdict"] == v)), F.lit(0)).cast("long").alias(f"n_{v}")
    return out.select(
        "doc_id",
        *(count(k[0]) for k in BASE_KINDS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        F.coalesce(_listed(told), F.lit("")).alias("spans"),
        verdicts("live"),
        verdicts("reused"),
        verdicts("example"),
        F.col("spans").alias("details"),
    )


def redact(
    docs: DataFrame,
    text_col: str = "text",
    owner: Column | None = None,
    repo: Column | None = None,
    live_owners: int = 2,
    live_repos: int = 2,
    mark: str = "[SECRET]",
    n_chars_col: str | None = "n_chars",
) -> DataFrame:
    """docs with every live or reused span of every text replaced by mark (overlapping spans by one), and n_chars counted anew.

    Rows, columns and their order of columns stay; widely copied examples and placeholders stay as they are, and so do
    null and empty texts. Repeated rows are each replaced in. Texts are scanned once: rows are written with what was found.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", "source", "lang") if repo is None else repo
    every = docs.select(F.struct(*docs.columns).alias("doc"), owner.alias("owner"), repo.alias("repo"), candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("found"))
    every = written(every.withColumn("row", F.when(F.size("found") > 0, F.monotonically_increasing_id())), "secrets")
    hot = every.where("row is not null")
    live = judged(hot.select("row", "owner", "repo", "found"), live_owners, live_repos).select("row", F.filter("spans", _live).alias("spans")).where(F.size("spans") > 0)
    text = F.col(f"doc.{text_col}")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    # Only rows with a span to replace have a row number to meet by; texts without one don't move.
    done = hot.join(live, "row", "left").withColumn("clean", F.when(F.size("spans") > 0, clean).otherwise(text))
    columns = {c: F.col("doc").getField(c) for c in docs.columns}
    new = dict(columns) | {text_col: F.col("clean")}
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.when(F.size("spans") > 0, F.length("clean").cast(docs.schema[n_chars_col].dataType)).otherwise(columns[n_chars_col])
    return every.where("row is null").select(*(c.alias(n) for n, c in columns.items())).union(done.select(*(c.alias(n) for n, c in new.items())))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document, with the corpus's verdicts on them."""
    return scan_secrets(table(spark, sf_dir, "documents")).drop("details")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are taken out of the texts; every document stays. Odd rows stay as ``redact`` says."""
    return redact(docs)


QUERIES = {"op8_secret_scan": op8_secret_scan}


def _oracle() -> str:
    parts = []
    for rank, (kind, pattern, group, least, _) in enumerate([*BASE_KINDS, *MORE_KINDS]):
        p = pattern.replace("'", "''")
        parts.append(f"""select row, owner, repo, {rank} as rank, '{kind}' as kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(
  start := coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
  len := length(m[i]), value := v[i]))) as x from (select row, owner, repo, string_split_regex(text, '{p}') as s, regexp_extract_all(text, '{p}') as m,
  regexp_extract_all(text, '{p}', {group}) as v from d)""")
    least = " ".join(f"when {i} then {k[3]}" for i, k in enumerate([*BASE_KINDS, *MORE_KINDS]))
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter ({}), '')"
    n = len(BASE_KINDS)
    return f"""
with d as materialized (select row_number() over () as row, doc_id, source as owner, concat_ws('/', source, lang) as repo, coalesce(text, '') as text from documents),
a as ({" union all ".join(parts)}),
s as materialized (select row, owner, repo, rank, kind, x.start::bigint as start, (x.start + x.len)::bigint as stop, x.value as value from a
  where length(x.value) >= case rank {least} end),
o as (select value, count(distinct owner) as n_owners, count(distinct repo) as n_repos from s group by value),
j as (select s.*, case when n_owners > 2 and n_repos > 2 then 'example' when regexp_matches(value, '{PLACEHOLDER}')
  or len(list_distinct(string_split(value, ''))) < 6 then 'placeholder' when n_repos > 2 then 'reused' else 'live' end as verdict from s join o using (value)),
r as (select row, {", ".join(f"count(*) filter (kind = '{k[0]}') as n_{k[0]}" for k in BASE_KINDS)}, {listed.format(f"rank < {n}")} as base,
  {listed.format(f"rank < {n} or verdict in ('live', 'reused')")} as spans, count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'reused') as n_reused, count(*) filter (verdict = 'example') as n_example from j group by row)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0)::bigint as n_live, coalesce(n_reused, 0)::bigint as n_reused,
  coalesce(n_example, 0)::bigint as n_example
from d left join r using (row)
"""


ORACLE = {"op8_secret_scan": _oracle()}
