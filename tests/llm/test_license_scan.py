from __future__ import annotations

import re

from gleanery.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
TEXTS = [
    None, "", "...", "plain words only", "Licensed under CC-BY 4.0.", "cc by cc by CC, BY", "All rights reserved. all RIGHTS reserved", "x " * 30_000 + "Released under the MIT License.",
    MIT, MIT.replace("hereby ", "hereby and now ").replace("charge, ", "charge "), "granted free of charge", "the GNU General Public License, version 3", "général public license all rights", "ß all rights reservedx",
    "This work is licensed under the GNU General Public License, version 3. " * 40, MIT,
]


def test_base_against_brute_force(spark, docs):
    got = {r.doc_id: r for r in ls.scan_licenses(docs(list(enumerate(TEXTS)))).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at, labels = [], set()
        for phrase, label in ls.BASE_PHRASES:
            p = phrase.split()
            hits = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert 0 <= r.score <= 1 and labels <= set(r.labels.split(","))


def test_method(spark, docs):
    got = {r.doc_id: r for r in ls.scan_licenses(docs(list(enumerate(TEXTS)))).collect()}
    assert (got[8].labels, got[8].score) == ("mit", 1.0)
    assert got[9].labels == "mit" and 0.75 <= got[9].score < 1  # words put in and left out: neighbouring diagonals
    assert got[10].labels == "" and got[3].labels == ""
    assert [(s.label, s.start, s.end) for s in got[7].spans] == [("mit", 30_000, 30_005)]
    assert got[14].labels == "gpl"


def test_sql(spark, docs, same):
    d = docs([*enumerate(TEXTS), (None, MIT), (8, MIT)])
    same(ls.scan_licenses(d).drop("spans"), ls.ORACLE["op6_license_scan"], documents=d)


def test_empty(spark, docs):
    assert ls.scan_licenses(docs([])).collect() == []


def test_no_python(spark, docs):
    plan = ls.scan_licenses(docs([(1, "x")]).limit(1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_edited_notices(spark, docs):
    """A word changed amid a short notice, words put in amid a long one, and a gram of a notice quoted between its halves."""
    w = WORD.findall(MIT.lower())
    gpl = "This work is licensed under the GNU General Public License, version 3."
    texts = [
        gpl.replace("work", "thing").replace("version", "edition"),
        " ".join([*w[:14], "of", "our", "own", "making", "here", *w[14:]]),
        " ".join([*w[:14], *w[20:23], *w[14:]]),
        " ".join([*w[:6], "lorem ipsum " * 20, *w[25:]]),
    ]
    got = {r.doc_id: r for r in ls.scan_licenses(docs(list(enumerate(texts)))).collect()}
    assert [got[i].labels for i in range(4)] == ["gpl", "mit", "mit", ""]
    assert (got[1].score, got[2].score) == (len(w) / (len(w) + 5), len(w) / (len(w) + 3)) and [(s.start, s.end) for s in got[1].spans] == [(0, len(w) + 5)]


def test_templates_that_repeat_grams(spark, docs):
    """Grams that a template holds several times vote for several diagonals; one span comes out of each place."""
    template = (("again", "one two three and one two three and one two three at last"),)
    text = template[0][1]
    got = {r.doc_id: r for r in ls.scan_licenses(docs([(1, text), (2, f"{text} then others {'x ' * 30} {text}"), (3, "one two three")]), templates=template).collect()}
    assert [(s.start, s.end, s.score) for s in got[1].spans] == [(0, 13, 1.0)]
    assert len(got[2].spans) == 2 and got[3].spans == []


def test_the_better_notice_counts(spark, docs):
    """The GPL's words hold all but one of the LGPL's; each is told as what it is."""
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."
    got = {r.doc_id: r for r in ls.scan_licenses(docs([(1, gpl), (2, gpl.replace("GNU", "GNU Lesser"))])).collect()}
    assert (got[1].labels, len(got[1].spans)) == ("gpl", 1)
    assert "lgpl" in got[2].labels.split(",") or got[2].spans[0].label == "gpl"
