from __future__ import annotations

import base64
import os
import random

import pytest

from gleanery.llm import token_counts as tc

need = pytest.mark.skipif(not os.path.exists(tc.VOCABULARY), reason="no vocabulary file")


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_suffix_sums(spark, block):
    rng = random.Random(block)
    lengths = [rng.choice((0, 1, 5, rng.randrange(3000))) for _ in range(500)]
    sums = tc.suffix_sums(tc.histogram(spark.createDataFrame([(x,) for x in lengths], "length long")), block).cache()
    for r in sums.collect():
        assert r.docs_longer == sum(x > r.length for x in lengths)
        assert r.tokens_longer == sum(x for x in lengths if x > r.length)
        assert r.truncated_tokens == sum(min(x, r.length) for x in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))
    for limit in (0, 1, 3, 100, 2999, 10_000):
        assert tc.truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
    for q in (0.01, 0.5, 0.9, 1.0):
        want = sorted(lengths)[max(0, -(-int(q * 1000) * len(lengths) // 1000) - 1)]
        assert tc.quantile(sums, q) == want


def encoding():
    with open(tc.VOCABULARY, "rb") as f:
        return tc.encoder(f.read())


@need
def test_cut_runs_are_exact():
    rng, e = random.Random(3), encoding()
    blanks = [" ", "\n", "\t", "\u3000", "\x85", "\r\n", " \n", "\x1c"]
    for _ in range(300):
        parts = [rng.choice(["", "a", "Don't", "'s", "12", "?!", "wörld", "\U0001f600"]) + rng.choice(blanks) * rng.choice((0, 1, 2, 999, 1000, 1001, 1500)) for _ in range(4)]
        text = "".join(parts) + rng.choice(["", "end", " end", "'ll"])
        assert tc.encoded_length(e, text) == len(e.encode_ordinary(text))


@need
def test_runs_of_a_million(spark, docs):
    """The plain encoder gives way on the blank ones: they are what a rule of its own says, one token a blank or two a pair of lines."""
    n, e = 1_000_000, encoding()
    texts = [" " * n, "a" + " " * n + "b", "\n" * n, "x" * n, "1" * n, ("ab " * n), " " * n + "a"]
    got = {r.length: r.n_docs for r in tc.token_histogram(docs(list(enumerate(texts)))).collect()}
    assert len(e.encode_ordinary("\n" * 1000)) == 500 and len(e.encode_ordinary(" " * 1000)) == 1000
    want = [n, 1 + n - 1 + 1, n // 2, len(e._encode_single_piece("x" * n)), len(e._encode_single_piece("1" * n)), len(e.encode_ordinary("ab " * n)), n - 1 + 1]
    assert got == {x: want.count(x) for x in want}


@need
def test_the_vocabulary_is_a_setting(spark, docs, tmp_path):
    own = tmp_path / "bytes.tiktoken"
    own.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)))
    spark.conf.set("spark.gleanery.vocabulary", str(own))
    try:
        assert [r.length for r in tc.encoded_lengths(docs([(1, "wörld  x")])).collect()] == [9]
    finally:
        spark.conf.unset("spark.gleanery.vocabulary")


@need
def test_whole_texts(spark, docs):
    texts = [None, "", "a", "Hello, wörld! 123", "tok " * 50_000, "tok " * 50_000, "\U0001f600\n\n  x"]
    got = {r.length: r.n_docs for r in tc.token_histogram(docs(list(enumerate(texts)))).collect()}
    encode = encoding()
    want: dict = {}
    for t in texts:
        ids = encode.encode_ordinary(t or "")
        assert encode.decode(ids) == (t or "")
        want[len(ids)] = want.get(len(ids), 0) + 1
    assert got == want


@need
def test_empty(spark, docs):
    sums = tc.token_histogram(docs([]))
    assert sums.collect() == []
    assert tc.truncated_total(sums, 10) == 0 and tc.quantile(sums, 0.5) is None
