from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from gleanery.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"w{i}" for i in range(40))
TEXTS = [None, "", " \n\t", "one", BASE, BASE + "\n" + BASE, "a b c d e " * 9, "###### $$ %% " * 10, "x\nx\n\nx\n \n \nx y", "é ü ñ\x0bö\x0cq\rr " * 12, "a a a a a a", BASE * 2000, "q r " * 11]


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(max(0, len(w) - 4))]
    times = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_counts_against_brute_force(spark, docs):
    got = {r.doc_id: r for r in qr.judge_documents(docs(list(enumerate(TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (t or '')[:80]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)


def test_host_verdicts(spark, docs):
    good = [(i, f"{BASE} n{i}", f"good{i % 7}") for i in range(140)]
    bad = [(1000 + i, "spam " * 30 if i % 10 else f"{BASE} b{i}", "bad") for i in range(200)]
    small = [(3000, "few", "tiny"), (3001, f"{BASE} x", "tiny"), (4000, f"{BASE} y", None)]
    got = {r.doc_id: r for r in qr.judge_documents(docs(good + bad + small)).collect()}
    assert all(got[i].kept for i, *_ in good)
    assert not any(got[i].kept for i, *_ in bad)  # clean pages of a bad host go with it
    assert got[4000].kept and got[4000].host_rate is None
    assert not got[3000].kept and got[3001].kept  # one failure of two is drawn to the prior


def test_sql(spark, docs, same):
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(TEXTS) if len(t or "") < 100_000] + [(5, BASE, None), (None, "x", "s1"), (5, BASE, None)]
    d = docs(rows)
    same(qr.judge_documents(d).drop("host_rate"), qr.ORACLE["op7_quality_rules"], documents=d)


def test_empty(spark, docs):
    assert qr.judge_documents(docs([])).collect() == []


@pytest.mark.parametrize("rates", [[(5, 5)], [(0, 10), (0, 4)], [(10, 10), (4, 4)]])
def test_prior_at_its_edges(spark, rates):
    rows = [(f"h{k}", i < f) for k, (f, n) in enumerate(rates) for i in range(n)]
    got = qr.host_rates(spark.createDataFrame(rows, "host string, failed boolean")).collect()
    assert len(got) == len(rates) and all(0 < r.rate < 1 for r in got)


def rates_of(spark, hosts):
    rows = [(f"h{k}", i < f) for k, (f, n) in enumerate(hosts) for i in range(n)]
    return {r.host: r.rate for r in qr.host_rates(spark.createDataFrame(rows, "host string, failed boolean")).collect()}


def test_many_hosts_of_one_document(spark):
    """Their rates of 0 and 1 say nothing of how hosts differ: the large hosts do, and the small ones are drawn to the mean."""
    rng = random.Random(7)
    small = [(int(rng.random() < 0.1), 1) for _ in range(3000)]
    large = [(sum(rng.random() < 0.1 for _ in range(200)), 200) for _ in range(20)]
    rates = rates_of(spark, small + large)
    assert all(0.05 < rates[f"h{k}"] < 0.2 for k in range(len(small)))
    alone = rates_of(spark, small)
    assert max(alone.values()) - min(alone.values()) < 0.01


def test_prior_of_known_spread(spark):
    """Hosts drawn from a beta distribution give back its mean and weight, though most have one or two documents."""
    rng = random.Random(11)
    sizes = [rng.choice((1, 1, 1, 2, 3, 5, 8, 40)) for _ in range(6000)]
    hosts = []
    for n in sizes:
        p = rng.betavariate(2.0, 6.0)
        hosts.append((n, sum(rng.random() < p for _ in range(n))))
    mean, weight = qr.beta_prior(spark.createDataFrame(hosts, "n_docs long, n_failed long"))
    assert mean == pytest.approx(0.25, abs=0.02) and weight == pytest.approx(8, rel=0.2)
