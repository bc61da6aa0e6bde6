"""The pipeline on a small corpus: each stage does its part on what the one before kept."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from test_ngram_join import brute_components, brute_sets
from test_packing import naive
from test_toxicity import plain_severities

import corpus_pipeline
from gleanery.llm import packing, secret_scan, source_mixing, token_counts


def make(spark, tmp_path):
    rng = random.Random(3)
    words = [a + b for a in ("oat", "tea", "rye", "cup", "mill") for b in ("", "s", "er", "ing", "ly", "ish")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels = [], []
    for i in range(300):
        t = text(rng.randrange(20, 120))
        if i % 5 == 0:
            t = f"zorg {t} snarl {t[:20]} zorg"
        docs.append((i, t))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(500, docs[1][1]), (501, docs[2][1] + " tail"), (502, "password=Own3rOnly99xQ " + text(30)), (503, None), (504, "")]
    rows = [(i, t, "en", f"src{i % 20}", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return docs


def test_pipeline(spark, tmp_path):
    rows = make(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else None
    clean = {i for i, t in rows if not (t or "").startswith("zorg")}
    assert set(kept["toxicity"]) == clean
    assert set(kept["ngram_jaccard_join"]) == clean - {500, 501}
    assert set(kept["secret_scan"]) == clean - {500, 501} and kept["secret_scan"][502].startswith("[SECRET] ")
    mixed = set(kept["source_mixing"])
    assert mixed <= clean and len(mixed) > 0.6 * len(clean)
    packed = {r.doc_id for r in docs.collect()}
    assert packed == mixed
    whole = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "n_tokens").collect()))
    assert whole == sorted(map(tuple, docs.select("doc_id", "piece", "n_tokens").collect()))
    assert packing.QUERIES


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "secret_scan", "source_mixing", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def plain_secrets(rows):
    """{doc_id: text} with live and reused values replaced, from (doc_id, text, source, lang)."""
    kinds, found = [*secret_scan.BASE_KINDS, *secret_scan.MORE_KINDS], []
    for i, text, source, lang in rows:
        for _, pattern, group, least, _ in kinds:
            found += [(i, m.start(), m.end(), m[group], source, f"{source}/{lang}") for m in re.finditer(pattern, text or "", re.ASCII) if len(m[group]) >= least]
    owners, repos = defaultdict(set), defaultdict(set)
    for *_, value, source, repo in found:
        owners[value].add(source)
        repos[value].add(repo)
    out = {}
    for i, text, *_ in rows:
        spans = sorted((a, b) for j, a, b, v, *_ in found if j == i and not (len(owners[v]) > 2 and len(repos[v]) > 2) and not re.search(secret_scan.PLACEHOLDER, v) and len(set(v)) >= 6)
        at, new = 0, ""
        for a, b in spans:
            new += text[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        out[i] = new + text[at:] if spans else text
    return out


def plain_mix(rows, targets, keep=0.85):
    """{doc_id: how often it is drawn} from (doc_id, text, source, lang)."""
    known = lambda d, v: v if v in targets[d] else "other"

    def topic(text):
        return next((name for name, words in source_mixing.TOPICS if any(w in (text or "") for w in words)), "general")

    cell = {i: (known("source", source), known("lang", lang), topic(text)) for i, text, source, lang in rows}
    tokens = Counter()
    for i, text, *_ in rows:
        tokens[cell[i]] += len((text or "").split())
    weight = {c: float(n) for c, n in tokens.items() if n}
    for _ in range(300):
        for axis, shares in enumerate(targets.values()):
            have = Counter()
            for c, v in weight.items():
                have[c[axis]] += v
            whole = sum(shares[v] for v in have)
            weight = {c: v * shares[c[axis]] / whole / have[c[axis]] for c, v in weight.items()}
    factor = {c: v * sum(tokens.values()) / tokens[c] for c, v in weight.items()}
    out = {}
    for i, *_ in rows:
        wanted = keep * factor[cell[i]] if cell[i] in factor else 1.0
        draw = int(hashlib.sha256(f"mix:{i}".encode()).hexdigest()[:12], 16) / 16**12
        out[i] = int(wanted) + (draw < wanted - int(wanted))
    return out


@pytest.mark.skipif(not os.path.exists(token_counts.VOCABULARY), reason="no vocabulary file")
def test_run_against_plain_code(spark, docs, tmp_path):
    """run() once more without any of its operators: the model, the components, the secrets, the draws and the bins."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], {}
    for i in range(260):
        text = [rng.choice(words) for _ in range(rng.choice((3, 20, 60, 400)))]
        if i % 5 == 0:
            text[rng.randrange(len(text))] = rng.choice(("zorg", "blarg", "snarl"))
        if i % 7 == 0:
            text.insert(2, rng.choice(("password=Zx81Qw77Kp02Lm", f"token = {rng.randrange(10**12):012d}Ab", "mail me@x.y", "Licensed under the MIT License")))
        if i % 6 == 1:
            text = rows[rng.randrange(len(rows))][1].split(" ")
            text = text + ["more"] if len(text) > 30 and i % 12 == 1 else text
        rows.append((i, " ".join(text), f"src{rng.choice((0, 0, 1, 2, 3, 30))}", rng.choice(("en", "de", "xx"))))
        if i % 3:
            labels[i] = int(any(w in text for w in ("zorg", "blarg", "snarl")))
    rows += [(900, None, "src1", "en"), (901, "", "src2", "de")]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, g) for i, g in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    severity = plain_severities([(i, t) for i, t, *_ in rows], labels)
    kept = [r for r in rows if severity[r[0]] < 0.5]
    assert 150 < len(kept) < len(rows)
    first = brute_components([r[0] for r in kept], brute_sets([r[1] for r in kept]))
    alone = [r for r, c in zip(kept, first) if r[0] == c]
    assert len(alone) < len(kept)
    clean = plain_secrets(alone)
    assert sum("[SECRET]" in (t or "") for t in clean.values()) > 3
    alone = [(i, clean[i], source, lang) for i, _, source, lang in alone]
    drawn = plain_mix(alone, source_mixing.TARGETS)
    assert min(drawn.values()) == 0 and max(drawn.values()) > 1
    with open(token_counts.VOCABULARY, "rb") as f:
        encoding = token_counts.encoder(f.read())
    pieces, full = [], []
    for i, text, source, _ in alone:
        for _ in range(drawn[i]):
            n = len(encoding.encode_ordinary(text or ""))
            full += [(i, k, 2048) for k in range(n // 2048)]
            pieces += [(i, n // 2048, n % 2048, source, text)] if n % 2048 or not n else []
    pieces.sort(key=lambda p: (-p[2], p[0], p[1]))
    names = {s: k for k, s in enumerate(dict.fromkeys(p[3] for p in pieces))}
    times = Counter(p[4] for p in pieces)
    texts = {t: k for k, t in enumerate(dict.fromkeys(p[4] for p in pieces), 1)}
    bins = naive([p[2] for p in pieces], [1 << names[p[3]] for p in pieces], [1 << texts[p[4]] if times[p[4]] > 1 else 0 for p in pieces], 2048, 4)
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in got) == sorted([p[:3] for p in pieces] + full)
    together = lambda named: sorted(sorted(v) for v in named.values())
    want_bins, got_bins = defaultdict(list), defaultdict(list)
    for p, b in zip(pieces, bins):
        want_bins[b].append(p[:2])
    for r in got:
        if (r.doc_id, r.piece, 2048) not in full:
            got_bins[r.bin_id].append((r.doc_id, r.piece))
    assert together(got_bins) == together(want_bins)
