"""Whitening against numpy, importance resampling against plain Python, the line classifier against enumeration and held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.llm import importance, line_crf, whitening
from pitwise.llm.queries import queries
from pitwise.llm.words import chunks

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def vectors_of(spark, rows):
    t = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, x string, n int")
    return t.repartition(3)


def exact(kept):
    """(n, deviations, eigenvalues, eigenvectors, centred rows, trace) by numpy and exact integers."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in kept]
    n, s = len(x), [sum(c) for c in zip(*x)]
    numerators = [[n * c - t for c, t in zip(row, s)] for row in x]
    r = np.array(numerators, float) / n
    v = r.T @ r / n
    e, u = np.linalg.eigh(v)
    return n, [sum(c * c for c in row) for row in numerators], e[::-1], u[:, ::-1], r, np.trace(v)


def check_whitening(rows, kept, k):
    n, deviations, e, u, r, trace = exact([v for _, v in kept])
    got = sorted(((x.vec_id is not None, x.vec_id, x.component, x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in rows.collect()), key=lambda x: x[:3])
    want = sorted(((i is not None, i, c + 1, j) for j, (i, _) in enumerate(kept) for c in range(k)), key=lambda x: x[:3])
    assert [x[:3] for x in got] == [x[:3] for x in want]
    sign = {}
    for (_, _, c, m, deviation, whitened, explained, error), (*_, j) in zip(got, want):
        assert (m, deviation) == (n, deviations[j] if deviations[j] < 1 << 63 else None)
        mine = r[j] @ u[:, c - 1] / math.sqrt(e[c - 1])
        if abs(mine) > 1e-3:
            sign.setdefault(c, math.copysign(1, mine * whitened))
        assert whitened == pytest.approx(sign.get(c, 1) * mine, abs=1e-7)
        assert explained == pytest.approx(e[c - 1] / trace, rel=1e-6) and error < 1e-6


def test_whitening_is_that_of_numpy_and_leaves_out_what_has_no_covariance(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(120, 12)) * np.linspace(3, 0.5, 12)
    kept = [(i if i % 10 else None, [float(c) for c in v]) for i, v in enumerate(base)]
    kept = [(i, v) for i, v in kept if i is not None] + [(1000, [5.0] * 12)] * 3
    odd = [(2000, None), (2001, []), (2002, [1.0] * 11 + [None]), (2003, [1.0] * 11 + [NAN]), (2004, [INF] + [0.0] * 11), (2005, [1.0] * 3), (2006, [1e300] + [0.0] * 11)]
    check_whitening(whitening.whiten(vectors_of(spark, kept + odd)), kept, 8)
    check_whitening(whitening.whiten(vectors_of(spark, kept), components=3, block=2), kept, 3)


def test_whitening_of_flat_equal_huge_and_missing_vectors(spark):
    flat = [(i, [float(i % 7), 2.0 * (i % 7), 3.0, float(i % 5)]) for i in range(60)]  # two dimensions' worth
    check_whitening(whitening.whiten(vectors_of(spark, flat)), flat, 2)
    none = [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, []), (2, [])], [(1, None)]]
    for rows in none:
        got = whitening.whiten(vectors_of(spark, rows))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0
    huge = [(i, [float((i * 37) % 7) * 2.0**40, float(i)]) for i in range(40)]
    n, deviations, *_ = exact([v for _, v in huge])
    got = {x.vec_id: x.deviation for x in whitening.whiten(vectors_of(spark, huge)).collect()}
    assert got == {i: d if d < 1 << 63 else None for (i, _), d in zip(huge, deviations)} and None in got.values()


def test_lanczos_starts_again_after_a_breakdown_and_stops_by_residual():
    r = np.random.default_rng(2)
    q, _ = np.linalg.qr(r.normal(size=(60, 60)))
    for values in ([5.0] * 30 + [1.0] * 30, [0.0] * 60, [9.0, 9.0, 9.0] + [0.0] * 57, list(np.linspace(60, 1, 60))):
        a = q @ np.diag(values) @ q.T
        found = whitening.block_lanczos(lambda b, a=a: a @ b, 60, 5, block=3)
        want = sorted(values, reverse=True)[:5]
        assert np.allclose(found.values, want, atol=1e-9) and np.allclose(found.vectors.T @ found.vectors, np.eye(5), atol=1e-9)
        assert np.allclose(a @ found.vectors, found.vectors * found.values, atol=1e-8)
    steep = q @ np.diag(2.0 ** -np.arange(60)) @ q.T
    assert whitening.block_lanczos(lambda b: steep @ b, 60, 2, block=2).passes < 20


def features(text):
    raw = (text or "").encode().translate(brute.FOLD)
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)
    return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, items):
    docs, t = [(i, *features(x)) for i, x in rows], Counter(b for x in items for b in features(x)[1])
    s = Counter(b for *_, f in docs for b in f)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out = []
    for i, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    entered = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0]))
    for place, x in enumerate(entered[: 5 * len(entered) // 100]):
        x[4] = place + 1
    return Counter(tuple(x) for x in out)


def test_resampling_matches_plain_python(spark):
    r = np.random.default_rng(3)
    say = lambda n: " ".join(r.choice(["The", "of", "ünï", "x1", "9", "Öl", "and-so", "A.b", "\U0001f600"], n))
    rows = [(i, say(int(n))) for i, n in enumerate(r.integers(0, 60, 150))] + [(None, say(30)), (None, None), (7, ""), (8, " ,;\n"), (9, "x"), (9, "x y"), (10, "ÀB c"), (11, say(200_000))]
    rows += [(5, rows[5][1])] * 3 + [(None, rows[150][1])] * 40
    items = [say(20), None, "", "nowhere else of ünï"]
    docs = spark.createDataFrame([(i, t, "k", 1, 2, "w") for i, t in rows], "doc_id long, text string, k string, row int, pos int, weight string").repartition(4)
    target = spark.createDataFrame([(i, t, 0) for i, t in enumerate(items)], "item_id long, text string, bucket int")
    got = importance.resample(docs, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    assert Counter(map(tuple, got.collect())) == resampled(rows, items)
    assert Counter(map(tuple, importance.resample(docs, target.limit(0)).collect())) == resampled(rows, [])
    assert importance.resample(docs.limit(0), target).count() == 0


def test_resampling_query_over_whole_tables(spark):
    read = lambda name: spark.read.parquet(f"{SF}/{name}.parquet").collect()
    want = resampled([(r.doc_id, r.text) for r in read("documents")], [r.text for r in read("benchmark")])
    assert Counter(map(tuple, queries()["op13_importance_resampling"](spark, SF).collect())) == Counter(w[:5] for w in want.elements())


def test_marginals_are_those_of_all_labellings():
    r = np.random.default_rng(1)
    sizes = [1, 3, 2, 6, 1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    first = np.zeros(at[-1], bool)
    first[at[:-1]] = True
    for scale in (1, 200):
        chain, logits = line_crf.Chain(np.zeros(1), r.normal(size=2), r.normal(size=(2, 2))), r.normal(size=at[-1]) * scale
        good, steps, total = chain.marginals(logits, first)
        want, want_steps, logs = [], np.zeros((2, 2)), 0.0
        for o, n in zip(at, sizes):
            labellings = list(itertools.product((0, 1), repeat=n))
            scores = np.array([chain.start[y[0]] + sum(logits[o + i] * y[i] for i in range(n)) + sum(chain.steps[y[i], y[i + 1]] for i in range(n - 1)) for y in labellings])
            p = np.exp(scores - scores.max())
            logs += scores.max() + math.log(p.sum())
            p /= p.sum()
            want += list(p @ np.array(labellings))
            for y, w in zip(labellings, p):
                for a, b in itertools.pairwise(y):
                    want_steps[a, b] += w
        assert np.allclose(good, want) and np.allclose(steps, want_steps) and total == pytest.approx(logs)


def test_lines_are_those_of_the_text(spark):
    texts = ["one two\nTHREE", None, "", "\n", "a\n\nb", "x | y\n", "ß"]
    import pyarrow as pa

    (chunk,) = chunks(pa.array(texts, pa.string()))
    lines = line_crf.lines_of(chunk)
    assert np.diff(lines.at).tolist() == [len((t or "").split("\n")) for t in texts]
    assert lines.chars.tolist() == [float(len(re.sub(r"\s", "", x))) for t in texts for x in (t or "").split("\n")]


def test_held_out_labels_are_told_and_never_learnt_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in queries()["op12_line_crf_quality"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    told = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(q == r.predicted for q, r in told) >= 0.95 * len(told)
    turned = labels.withColumn("quality", F.when(line_crf.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = line_crf.score_documents(docs, line_crf.fit(docs, turned)).collect()
    assert all(abs(r.score - got[r.doc_id].score) < 1e-9 for r in again)


def test_scores_of_odd_tables(spark):
    junk, prose = "zz### yy%%% ###\n" * 6, "some words that are said in a row\nand others\n" * 3
    rows = [(i, junk if i % 3 == 0 else prose) for i in range(60)] + [(None, None), (None, prose), (1, ""), (2, "\n\n"), (3, "x " * 600_000), (4, prose), (4, prose)]
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, score double, held_out boolean").repartition(3)
    labels = [(i, int(i % 3 != 0)) for i in range(60)] + [(None, 1), (5, None), (6, 1), (6, 0), (61, 1)]
    known = spark.createDataFrame([(i, q, "x") for i, q in labels], "doc_id long, quality int, text string")
    model = line_crf.fit(docs, known)
    got = line_crf.score_documents(docs, model).collect()
    assert len(got) == len(rows) and all(r.predicted == (r.doc_id % 3 != 0) for r in got if r.doc_id is not None and r.doc_id > 4)
    assert all(r.held_out for r in got if r.doc_id is None) and len({r.score for r in got if r.doc_id == 4}) == 1
    assert line_crf.fit(docs, known.limit(0)) is None and line_crf.fit(docs.limit(0), known) is None
    assert {r.score for r in line_crf.score_documents(docs, None).collect()} == {0.5}
    assert all(r.score > 0.5 for r in line_crf.score_documents(docs.filter("doc_id > 9"), line_crf.fit(docs.filter("doc_id % 3 <> 0"), known)).collect() if r.doc_id % 3)
    assert line_crf.score_documents(docs.limit(0), model).count() == 0
    lines = line_crf.line_quality(docs.filter("doc_id = 9"), model).collect()
    assert [r.line for r in lines] == list(range(7)) and all(r.good < 0.5 for r in lines if r.chars)
    assert line_crf.fit(docs, known, max_docs=10) is not None
