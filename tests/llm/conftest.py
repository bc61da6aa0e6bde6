from __future__ import annotations

import duckdb
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text[, source[, lang]]) with further columns of clashing names."""

    def make(rows):
        full = []
        for r in rows:
            i, text, source, lang = (*r, "src0", "en")[:2] + tuple((*r, *("src0", "en")[len(r) - 2 :])[2:4])
            full.append((i, text, lang, source, None if text is None else len(text), *(["x", 1] * 6)))
        return spark.createDataFrame(full, f"{DOCS}, row string, found int, sig string, rep int, label string, block int, cell string, doc int, tokens string, spans int, th string, h1 int")

    return make


@pytest.fixture
def duck():
    """Runs DuckDB SQL over Spark frames given by name."""

    def run(sql, **frames):
        con = duckdb.connect()
        for name, f in frames.items():
            rows = f.toArrow()
            con.register(name, rows)
        return con.sql(sql)

    return run


def rows_of(frame, columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.select(*columns).collect()), key=repr)


@pytest.fixture
def same(duck):
    """Holds a frame against DuckDB SQL, row by row."""

    def check(frame, sql, **frames):
        columns = sorted(frame.columns)
        want = duck(sql, **frames)
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        got = sorted((repr(tuple(r[c] for c in columns)) for r in frame.collect()))
        assert got == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())

    return check
