from __future__ import annotations

import brute

from pitwise.llm.decontaminate import find_leaks, without_leaks

ITEM = [f"w{i}" for i in range(24)]
OTHER = " ".join(f"v{i}" for i in range(24))
ROWS = [(None, "a " + " ".join(ITEM[:14])), (None, " ".join(ITEM[10:]) + " z"), (None, " ".join(ITEM)), (None, "clean text of no item here"), (1, " ".join(ITEM[:14])), (1, " ".join(ITEM[10:])), (2, OTHER), (2, "clean again, with the same id"), (3, None)]
ITEMS = [(None, OTHER), (7, " ".join(ITEM)), (7, " ".join(f"u{i}" for i in range(40))), (7, " ".join(ITEM)), (8, None)]


def test_scan_and_shuffle_judge_rows_of_one_id_and_of_none_one_by_one(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = {f for d, t in ROWS for i, q in ITEMS for f in brute.leaks([(d, t)], [(i, q)])}
    assert {f[:2] for f in want} == {(None, 7), (2, None)}
    clean = [(d, t) for d, t in ROWS if not any(brute.leaks([(d, t)], [item]) for item in ITEMS)]
    for bound in (4_000_000, 0):
        found = [tuple(r)[:4] for r in find_leaks(docs, items, broadcast_shingles=bound).collect()]
        assert len(found) == len(want) and set(found) == want
        kept = [tuple(r) for r in without_leaks(docs, items, broadcast_shingles=bound).collect()]
        assert sorted(kept, key=str) == sorted(clean, key=str)
