from __future__ import annotations

import random
import re

import numpy as np
import pytest

from gleanery.llm import toxicity as tx


def make(rng, n, first):
    rows, labels = [], []
    for i in range(first, first + n):
        words = [rng.choice(("the", "of", "plain", "word", "oat", "tea", "cup")) + rng.choice(("", "a", "b")) for _ in range(rng.randrange(5, 200))]
        bad = i % 4 == 0
        for _ in range(rng.randrange(1, 6) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(("Zorg", "blarg!", "snarl,"))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out(spark, docs):
    rng = random.Random(1)
    rows, labels = make(rng, 400, 0)
    more, truth = make(rng, 200, 1000)
    model = tx.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(model.words) >= {b"zorg", b"blarg", b"snarl"}
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in tx.score(docs(more), model).collect()}
    wrong = [i for i, _, y in truth if got[i].toxic != bool(y)]
    assert len(wrong) <= 2
    assert all(0 <= r.severity <= 1 and r.grade == int(r.severity >= 0.5) for r in got.values())


def test_odd_rows(spark, docs):
    rows, labels = make(random.Random(2), 80, 0)
    labels += [(None, 1, 1), (3, 1, None), (0, 1, 0), (77777, 1, 1)]
    model = tx.fit(docs([*rows, (None, "x"), (0, rows[0][1])]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    odd = docs([(1, None), (2, ""), (None, "zorg zorg zorg"), (3, "zorg " * 50_000), (3, "zorg " * 50_000)])
    got = [(r.doc_id, r.toxic) for r in tx.score(odd, model).collect()]
    assert got == [(1, False), (2, False), (None, True), (3, True), (3, True)]


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1)]])
def test_too_little_to_learn(spark, docs, labels):
    model = tx.fit(docs([(1, "a b c")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    toxic = [r.toxic for r in tx.score(docs([(2, "a"), (3, None)]), model).collect()]
    assert toxic == [labels == [(1, 1, 1)]] * 2
    assert tx.score(docs([]), model).collect() == []


def test_shared_weights_recover_an_order():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 3))
    eta = x @ np.array([1.5, -1.0, 0.0])
    grades = (rng.logistic(size=4000) + eta)[:, None] > np.array([-1.0, 0.5, 2.0])
    w, t = tx.fit_cumulative_link([(np.arange(3), r) for r in x], 3, grades.sum(axis=1), 4, l2=1e-6)
    assert np.allclose(w, [1.5, -1.0, 0.0], atol=0.15) and np.allclose(t, [-1.0, 0.5, 2.0], atol=0.2)


def graded(rng, n, first, grades):
    """Documents whose number of telling words rises with the grade, and their labels."""
    rows, labels = [], []
    for i in range(first, first + n):
        g = rng.randrange(len(grades))
        words = [rng.choice(("the", "of", "plain", "word", "oat", "tea", "cup")) + rng.choice(("", "a", "b")) for _ in range(rng.randrange(40, 80))]
        for _ in range(g * 4 + (rng.randrange(3) if g else 0)):
            words[rng.randrange(len(words))] = rng.choice(("Zorg", "blarg!", "snarl,"))
        rows.append((i, " ".join(words)))
        labels.append((i, grades[g]))
    return rows, labels


def test_grades_of_the_labels(spark, docs):
    """Grades of any value and number come back on held-out documents, and severities rise with them."""
    rng, grades = random.Random(6), [0, 1, 2, 5]
    rows, labels = graded(rng, 600, 0, grades)
    more, truth = graded(rng, 300, 1000, grades)
    model = tx.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, level int"), grade_col="level")
    assert model.grades.tolist() == grades and len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in tx.score(docs(more), model).collect()}
    assert sum(got[i].grade == g for i, g in truth) > 0.85 * len(truth)
    assert all(r.toxic == (r.grade >= 1) and 0 <= r.severity <= 5 for r in got.values())
    means = [np.mean([got[i].severity for i, g in truth if g == k]) for k in grades]
    assert [min(grades, key=lambda g: abs(g - m)) for m in means] == grades  # each grade's mean severity is nearest to it


def test_repeated_ids_are_one_document(spark, docs):
    rows, labels = make(random.Random(4), 60, 0)
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once, often = tx.fit(docs(rows), frame), tx.fit(docs(rows + [rows[0]] * 500), frame)
    assert once.words == often.words and np.allclose(once.weights, often.weights)


def plain_severities(rows, labels):
    """{doc_id: chance of being toxic} for (doc_id, text) rows and 0/1 labels: words, features and fit in plain code, by another optimiser."""

    def features(text):
        out = {}
        for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower()):
            for f in (w, w[:5] + "*"):
                out[f] = out.get(f, 0) + 1
        return out

    counted = {i: features(t) for i, t in rows}
    y = {i: g for i, g in labels.items() if i in counted}
    n, n1 = len(y), sum(y.values())
    chosen = []
    for f in sorted({f for i in y for f in counted[i]}):
        a, b = sum(y[i] for i in y if f in counted[i]), sum(1 - y[i] for i in y if f in counted[i])
        share = (a + b) / n
        if a + b >= 3 and share < 1 and abs(a / n1 - b / (n - n1)) / (share * (1 - share) * (1 / n1 + 1 / (n - n1))) ** 0.5 >= 5:
            chosen.append(f)
    dense = lambda i: np.array([*(1 + np.log(counted[i][f]) if f in counted[i] else 0.0 for f in chosen), 1.0])
    x, t = np.array([dense(i) for i in y]), np.array(list(y.values()))
    w = np.zeros(len(chosen) + 1)
    for _ in range(400):  # damped steps on the logistic loss with the same penalty
        p = 1 / (1 + np.exp(-x @ w))
        penalty = np.array([1e-5] * len(chosen) + [0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x / n + np.diag(penalty + 1e-9)
        w -= 0.5 * np.linalg.solve(hess, x.T @ (p - t) / n + penalty * w)
    return {i: 1 / (1 + np.exp(-(dense(i) @ w))) for i, _ in rows}


def test_the_query_against_plain_code(spark, docs, tmp_path):
    rows, labels = make(random.Random(8), 300, 0)
    rows += [(900, None), (901, ""), (902, "zorg tea")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in tx.op1_toxicity(spark, str(tmp_path)).collect()}
    want = plain_severities(rows, {i: g for i, _, g in labels})
    assert len(got) == len(rows)
    for i, _ in rows:
        assert got[i].severity == pytest.approx(want[i], abs=2e-3)
        assert got[i].grade == int(want[i] >= 0.5) and got[i].toxic == (want[i] >= 0.5)
