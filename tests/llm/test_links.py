from __future__ import annotations

import brute
import numpy as np
from test_operators import ROWS, docs, key, rows_of  # noqa: F401

from pitwise.llm.setjoin import _listed, _sets, near_duplicate_links, t_occurrence_links


def test_every_document_has_all_its_links_in_small_and_in_tiled_clusters(docs):  # noqa: F811
    sets = [brute.shingles(t) for _, t in ROWS]
    links = [sum(i != j and bool(s) and 100 * len(s & o) >= 80 * len(s | o) for j, o in enumerate(sets)) for i, s in enumerate(sets)]
    want = sorted(((d, len(s), n) for (d, _), s, n in zip(ROWS, sets, links)), key=key)
    assert max(links) > 3
    for tile in (1 << 21, 500):
        found = near_duplicate_links(docs, tile_shingles=tile)
        assert rows_of(found, "doc_id", "n_shingles", "n_links") == want
        assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(brute.groups(ROWS), key=key)


def test_a_dense_tile_counts_all_pairs_by_probes_and_by_counting():
    rng = np.random.default_rng(3)
    sets = [np.unique(np.concatenate([np.arange(200), rng.integers(1000, 10**6, rng.integers(0, 60))])) for _ in range(80)]
    sets += [np.unique(rng.choice(np.arange(5000, 5400), 300, replace=False)) for _ in range(40)]
    docs = rng.integers(1, 9, len(sets))
    want = [sum(int(docs[j]) for j, b in enumerate(sets) if j != i and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))) for i, a in enumerate(sets)]
    n = np.array([len(s) for s in sets])
    _, count = t_occurrence_links(np.arange(len(sets)), np.full(len(sets), 2), n, np.concatenate(sets), 80, docs)
    assert count.tolist() == want


def test_two_sides_meet_only_each_other_whether_lists_are_bitmaps_or_merged():
    rng = np.random.default_rng(5)
    base = np.arange(10**6, 10**6 + 120)
    sets = [np.unique(np.concatenate([base[rng.random(120) > 0.08], rng.integers(0, 10**5, rng.integers(0, 15))])) for _ in range(150)]
    sets += [np.unique(rng.integers(0, 300, 40)) for _ in range(150)]  # long lists, few links
    sets += [np.unique(np.append(np.arange(7000 + i // 2 * 60, 7050 + i // 2 * 60), rng.integers(0, 300, 2))) for i in range(60)]  # pairs that share short lists
    side = rng.integers(0, 2, len(sets))
    docs, n = rng.integers(1, 9, len(sets)), np.array([len(s) for s in sets])
    near = [[i != j and side[i] != side[j] and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(map(set, sets))] for i, a in enumerate(map(set, sets))]
    links, count = t_occurrence_links(np.arange(len(sets)), side, n, np.concatenate(sets), 80, docs)
    assert count.tolist() == (np.array(near) @ docs).tolist()
    assert (count[300:] > 0).any() and all(near[a][b] for a, b in links)
    plain, none = t_occurrence_links(np.arange(len(sets)), side, n, np.concatenate(sets), 80)
    assert not none.any() and len(plain) == len(links)


def test_entries_are_dealt_out_once_and_those_of_copies_in_a_task_are_given_off_once(spark):
    rows = [(1, 5, 3), (1, 5, 3), (2, 5, 3), (2, 6, 4), (2, 5, 3), (3, 7, 1), (3, 4, 1), (3, 7, 1)]
    listed = _listed(spark.createDataFrame(rows, "h long, sig long, n long"))
    assert listed._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, listed.collect())) == [(2, 5, 3, 5), (2, 5, 3, 5), (2, 6, 4, 5), (3, 4, 1, 4), (3, 7, 1, 4), (3, 7, 1, 4)]
    texts = spark.createDataFrame([("a b c d e f g",), ("A b c d e f g",), ("b c d e f",), (None,), ("",)], "text string").coalesce(1)
    given = [(r.n, len(r.entries)) for r in _sets(texts, 5, 80, "entries", 5).collect()]
    assert [n for n, _ in given] == [3, 3, 1, 0, 0] and given[0][1] > 0 and [e for _, e in given[1:]] == [0, 1, 0, 0]
