"""License scans by diagonal voting, in DataFrame functions only.

Every rolling word k-gram of every text is hashed, and the hashes are joined to the places of the same k-gram in the
license templates, by hash and then by the words; hashes that no template has are left out before rows are made of the
rest. A hit at text place p and template place t votes for diagonal p - t. Votes are summed for each (document,
template, diagonal); neighbouring diagonals (words put in or left out) form a band, whatever stands between them in the
text, and what follows one another in a band is a span. A span is verified by the share of the template's words that its
hits cover and by its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm.common import table, written

#: Phrases that count wherever they stand, with their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Words of common public license notices, as the scan sees words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

K, COVER, SLACK, GAP = 3, 0.75, 8, 8
#: Templates with more k-grams than this are joined without leaving hashes out first.
MOST_HASHES = 10_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(WORD), F.lit(0))


def _places(words: Column, line: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, words from 0; looked for only in texts that hold the phrase."""
    want = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - len(want))

    def here(i: Column) -> Column:
        test = F.get(words, i) == want[0]
        for k, w in enumerate(want[1:], 1):
            test = test & (F.get(words, i + k) == w)
        return test

    return F.when(F.contains(line, F.lit(f" {phrase} ")), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def _gram(words: Column, i: Column, k: int) -> list[Column]:
    return [F.get(words, i + j) for j in range(k)]


_PLACED = ("start", "end", "score", "template")


def _better(t: Column) -> Column:
    """Whether t overlaps the row's span and fits better: by its score, then its length, then its template's place."""
    length = t["end"] - t["start"] - (F.col("end") - F.col("start"))
    order = F.when(t["score"] != F.col("score"), t["score"] > F.col("score")).when(length != 0, length > 0).otherwise(t["template"] < F.col("template"))
    return (t["start"] < F.col("end")) & (t["end"] > F.col("start")) & order


def template_grams(spark: SparkSession, templates: tuple = TEMPLATES, k: int = K) -> DataFrame:
    """(h, gram, template, label, at, size): the k-grams of the templates, each with its template's number of words."""
    rows = []
    for number, (label, text) in enumerate(templates):
        w = text.split()
        rows += [(w[i : i + k], number, label, i, len(w)) for i in range(len(w) - k + 1)]
    return spark.createDataFrame(rows, "gram array<string>, template int, label string, at int, size int").withColumn("h", F.xxhash64(*_gram(F.col("gram"), F.lit(0), k)))


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple = TEMPLATES, k: int = K, cover: float = COVER, slack: int = SLACK, gap: int = GAP
) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans lists the verified template spans as (label, start, end, score), words from 0, end exclusive; score is the
    best of theirs, else 0: the template's words that stand in matching k-grams, of the template's or the span's words,
    whichever are more. At least the share `cover` of the template's words must so stand. Diagonals are neighbours
    up to `slack` apart, half the template's words at most; what is more than `gap` words away begins a new span. A span
    gives way to an overlapping one that fits better. A null
    or empty text has no words, no labels and null places; texts of any length are scanned whole. Repeated rows and null
    ids are scanned like any other row. Further columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    grams = template_grams(spark, templates, k)
    known = sorted({r["h"] for r in grams.select("h").collect()})  # as many as the caller's templates have
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _words(F.col(text_col)).alias("words"))
    own = own.withColumn("line", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    words, line = F.col("words"), F.col("line")
    found = {label: _places(words, line, phrase) for phrase, label in BASE_PHRASES}
    rolling = F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.struct(i.alias("p"), F.xxhash64(*_gram(words, i, k)).alias("h"))))
    if len(known) <= MOST_HASHES:
        rolling = F.filter(rolling, lambda g: g["h"].isin(known))
    hits = F.transform(rolling, lambda g: F.struct(g["p"].alias("p"), g["h"].alias("h"), F.slice(words, g["p"] + 1, k).alias("gram")))
    own = own.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"), *(p.alias(f"at_{i}") for i, p in enumerate(found.values())))
    places = [F.col(f"at_{i}") for i in range(len(found))]
    everywhere = F.concat(*places)
    own = own.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "n_words",
        F.size(everywhere).cast("long").alias("n_base"),
        F.array_min(everywhere).cast("long").alias("first_word"),
        F.array_max(everywhere).cast("long").alias("last_word"),
        F.array_compact(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, found, strict=True)))).alias("base"),
        "hits",
    )
    own = written(own, "grams")
    met = own.select("row", F.explode("hits").alias("g")).select("row", "g.p", "g.h", "g.gram").join(grams, ["h", "gram"])
    votes = met.groupBy("row", "template", (F.col("p") - F.col("at")).alias("diagonal")).agg(
        F.min("p").alias("start"), (F.max("p") + k).alias("end"), F.collect_set("at").alias("ats"), F.first("label").alias("label"), F.first("size").alias("size")
    )
    until_here = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > F.least(F.lit(slack), F.floor(F.col("size") / 2))
    bands = votes.withColumn("far", F.coalesce(far.cast("int"), F.lit(0))).withColumn("band", F.sum("far").over(until_here(by_diagonal)))
    by_place = Window.partitionBy("row", "template", "band").orderBy("start", "diagonal")
    apart = F.col("start") - F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)) > gap
    runs = bands.withColumn("apart", F.coalesce(apart.cast("int"), F.lit(0))).withColumn("run", F.sum("apart").over(until_here(by_place)))
    # A band has at most as many diagonals as a template's hits, so what is gathered for a run is bounded by the templates.
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("ats")), lambda a: F.sequence(a, a + k - 1)))))
    spans = runs.groupBy("row", "template", "band", "run").agg(covered.alias("covered"), F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label"), F.first("size").alias("size"))
    spans = spans.where((F.col("covered") / F.col("size") >= cover) & (F.col("end") - F.col("start") <= F.col("size") + 2 * slack))
    spans = spans.withColumn("score", F.col("covered") / F.greatest(F.col("size"), F.col("end") - F.col("start")))
    # Overlapping spans stand within twice the longest span of each other, so few are gathered however many a text has.
    longest = max((len(text.split()) for _, text in templates), default=0) + 2 * slack
    spans = spans.withColumn("near", F.collect_list(F.struct(*_PLACED)).over(Window.partitionBy("row").orderBy("start").rangeBetween(-longest, longest)))
    spans = spans.where(~F.exists("near", _better))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("label", "start", "end", "score"))).alias("spans"))
    whole = own.drop("hits").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<label:string,start:int,end:int,score:double>>")))
    return whole.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.col("spans.label"))), ",").alias("labels"),
        F.coalesce(F.array_max("spans.score"), F.lit(0.0)).alias("score"),
        "spans",
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and verified template spans of every whole document."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op6_license_scan": op6_license_scan}


def _oracle() -> str:
    grams = []
    for number, (label, text) in enumerate(TEMPLATES):
        w = text.split()
        grams += [f"({number}, '{label}', {i}, {len(w)}, '{' '.join(w[i : i + K])}')" for i in range(len(w) - K + 1)]
    places = []
    for phrase, label in BASE_PHRASES:
        w = phrase.split()
        test = " and ".join(f"ws[i + {k + 1}] = '{x}'" for k, x in enumerate(w))
        places.append(f"select row, '{label}' as label, i from w, unnest(range(0, greatest(n - {len(w) - 1}, 0))) u(i) where {test}")
    return f"""
with t(template, label, tpos, size, gram) as (values {", ".join(grams)}),
w as materialized (select row_number() over () as row, doc_id, ws, len(ws)::bigint as n from (select doc_id,
  coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) as ws from documents)),
b as materialized ({" union all ".join(places)}),
bs as (select row, count(*)::bigint as n_base, min(i)::bigint as first_word, max(i)::bigint as last_word, list(distinct label) as labels from b group by row),
g as (select row, i as p, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] as gram from w, unnest(range(0, greatest(n - {K - 1}, 0))) u(i)),
v as (select row, template, any_value(label) as label, any_value(size) as size, p - tpos as diagonal, list(tpos) as ats, min(p) as start, max(p) + {K} as stop
  from g join t using (gram) group by row, template, p - tpos),
r as (select *, sum(far) over (partition by row, template order by diagonal rows unbounded preceding) as band from
  (select *, case when diagonal - lag(diagonal) over (partition by row, template order by diagonal) > least({SLACK}, size // 2) then 1 else 0 end as far from v)),
q as (select *, sum(apart) over (partition by row, template, band order by start, diagonal rows unbounded preceding) as run from
  (select *, case when start - max(stop) over (partition by row, template, band order by start, diagonal rows between unbounded preceding and 1 preceding) > {GAP} then 1 else 0 end as apart from r)),
z as (select row, label, template, min(start) as a, max(stop) as b, count(distinct tpos + k) / greatest(any_value(size), max(stop) - min(start))::double as score from (select *, unnest(ats) as tpos from q), unnest(range({K})) u(k) group by row, template, label, band, run
  having count(distinct tpos + k) / any_value(size)::double >= {COVER} and max(stop) - min(start) <= any_value(size) + {2 * SLACK}),
s as (select * from z where not exists (select 1 from z t where t.row = z.row and t.a < z.b and t.b > z.a and (t.score, t.b - t.a, -t.template) > (z.score, z.b - z.a, -z.template))),
ss as (select row, list(distinct label) as labels, max(score) as score from s group by row)
select doc_id, n as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(bs.labels), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(ss.labels, [])))), ','), '') as labels,
  coalesce(ss.score, 0)::double as score
from w left join bs using (row) left join ss using (row)
"""


ORACLE = {"op6_license_scan": _oracle()}
