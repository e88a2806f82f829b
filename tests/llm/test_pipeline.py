from __future__ import annotations

import random
from collections import Counter

import brute
import corpus_pipeline


def test_stages_have_their_effect(spark, tmp_path):
    r = random.Random(3)
    common, rare = ["the", "of", "and", "to", "in", "is"], [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    prose = lambda n: [r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(n)]
    rows = [(i, " ".join(prose(120)), "en", f"s{i % 3}") for i in range(90)]
    copy = rows[10][1].split()
    rows.append((200, " ".join([*copy[:-1], "end"]), "en", "s0"))  # a near copy
    rows += [(300 + i, " ".join("#$%*"[r.randrange(4)] * 3 + r.choice(common) for _ in range(100)), "en", "s1") for i in range(4)]
    rows.append((400, "too short", "en", "s1"))
    item = " ".join(prose(15))
    rows.append((500, " ".join([*prose(60), item, *prose(60)]), "en", "s2"))
    spark.createDataFrame([(*x, len(x[1])) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(f"{tmp_path}/out{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/out{i}")
        seen[name] = [x.doc_id for x in docs.collect()]
        if name != "shard":
            assert docs.columns == before.columns
    assert set(seen["quality"]) == set(range(90)) | {200, 500}
    assert set(seen["near_duplicates"]) == set(range(90)) | {500}
    assert set(seen["decontaminate"]) == set(range(90))
    assert set(seen["mix"]) <= set(range(90)) and len(seen["shard"]) == len(seen["mix"])
    mixed, clean = spark.read.parquet(f"{tmp_path}/out3").collect(), spark.read.parquet(f"{tmp_path}/out2").collect()
    words, source = Counter(), Counter()
    for x in mixed:
        words[x.source] += len(brute.words(x.text))
    for x in clean:
        source[x.source] += len(brute.words(x.text))
    total = sum(source.values())
    assert all(abs(words[s] - total * w / 8) <= 1 for s, w in zip(sorted(source), (5, 2, 1)))
    own = {x.doc_id: brute.words(x.text) for x in clean}
    for x in mixed:  # what a round takes of a document stands in it
        text = b" ".join(own[x.doc_id])
        assert all(w in own[x.doc_id] for w in brute.words(x.text)) and brute.words(x.text)[0] in text


def test_run_gives_shards(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and rows.count() > 50
