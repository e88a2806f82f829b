"""Long texts, empty tables, repeated rows, ties, nulls and columns of clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ROWS, docs, key, rows_of  # noqa: F401

from pitwise.llm import arc, licenses, mixing, quality, rans, scratch
from pitwise.llm.decontaminate import find_leaks, without_leaks
from pitwise.llm.mixing import mixed_documents, words_taken
from pitwise.llm.quality import kept_documents, quality_rules
from pitwise.llm.queries import oracle_sql, queries
from pitwise.llm.setjoin import near_duplicate_groups, one_of_each_group
from pitwise.llm.sharding import shard_by_bytes
from pitwise.llm.substrings import without_repeats

SF = "/root/testdata/sf0.001"
#: Names that the operators use for columns of their own.
CLASHING = ("key", "h", "n", "sig", "half", "mark", "shard", "idx", "size", "entries", "set", "group", "item", "kept", "count", "block", "round", "rule", "score", "template", "at", "places", "copied", "payload_digest", "type")
LONG = " ".join(f"w{i}" for i in range(450_000))  # more than CHUNK_BYTES, and 40,000 distinct and more


def clashing(rows):
    return rows.withColumns({n: F.lit("x") for n in CLASHING})


@pytest.fixture(scope="module")
def odd(spark):
    """Long texts beside ordinary ones, repeated rows, nulls everywhere, and clashing columns."""
    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(["the", "of", "and", "to", *[f"word{i}" for i in range(60)]]) for _ in range(n))
    same = prose(50)
    rows = [(1, LONG, "en", "a"), (2, LONG + " end", "en", "a"), (3, None, None, None), (4, "", "", ""), (5, prose(80), "en", None), (5, None, "en", "b"), (None, same, None, "b"), (None, same, None, "b"), (6, "one two", "", ""), (6, "one two", "", "")]
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return rows, clashing(t).repartition(2)


def test_long_texts_and_clashing_columns_everywhere(spark, odd, tmp_path):
    rows, t = odd
    pairs = [(d, x) for d, x, *_ in rows]
    got = rows_of(near_duplicate_groups(t), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute.groups(pairs), key=key)
    assert one_of_each_group(t).columns == t.columns and kept_documents(t).columns == t.columns
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in without_repeats(t).collect()}
    assert got == {(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute.without_repeats(pairs)}
    items = clashing(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400_000, 400_030))), (None, "one two"), (1, "nowhere at all to be found")], "item_id long, text string"))
    for size in (4_000_000, 0):
        found = sorted(((r.doc_id, r.item_id, r.n_shared) for r in find_leaks(t, items, broadcast_shingles=size).collect()), key=key)
        assert found == [(1, 1, 26), (2, 1, 26), (6, None, 1)]
    left = without_leaks(t, items)
    assert left.columns == t.columns and left.count() == 6
    base = rows_of(quality_rules(t), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert base == sorted(((d, *brute.base_counts(x)) for d, x in pairs), key=key)
    taken = words_taken(t, block_tokens=1000).collect()
    assert Counter((r.doc_id, r["size"]) for r in taken) == Counter((d, len(brute.words(x))) for d, x in pairs) and all(r.taken <= 3 * r["size"] for r in taken)
    assert mixed_documents(t).columns == t.columns
    shards = shard_by_bytes(t).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in shards) == Counter((d, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for d, x in pairs)
    assert licenses.find_licenses(t).count() == 0
    pages = clashing(t.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.col("text").alias("html")))
    back = arc.pages_through_archives(pages).collect()
    assert Counter((r.page_id, r.payload_digest) for r in back) == Counter((d, hashlib.sha256((x or "").encode()).hexdigest()) for d, x in pairs)
    assert {r.page_id for r in back if r.record_type == "revisit"} == {None}


def test_a_long_text_is_cut_into_blocks(spark, odd, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path, (rows, t) = public.path("word_bpe_49k.json"), odd
    got = rans.encode_and_read(t, path, 2).collect()
    whole = tokenizers.Tokenizer.from_file(path)
    ids = lambda x: np.array(whole.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
    want = Counter((d, len(ids(x)), zlib.crc32(ids(x).tobytes())) for d, x, *_ in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    rans.write_ids(t, f"file://{tmp_path}/ids", path, 2)
    blocks = spark.read.parquet(f"file://{tmp_path}/ids").select(F.explode("blocks").alias("b")).select("b.lengths", "b.continued").collect()
    assert max(sum(b.lengths) for b in blocks) <= rans.BLOCK_TOKENS and sum(b.continued for b in blocks) > 10
    assert rans.encode_and_read(t.limit(0), path, 2).count() == 0


def test_words_of_one_hash_are_told_apart(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa

    from pitwise.llm.words import Chunk

    whole = Chunk.word_hashes
    monkeypatch.setattr(Chunk, "word_hashes", lambda self, fold=False: whole(self, fold) % np.uint64(7))
    tokenizer = rans.WordTokenizer(public.path("word_bpe_49k.json"), 2)
    texts = ["alpha beta gamma", "beta " * 3 + "delta; Épsilon don't", "", "x" * 200 + " alpha"]
    for _ in range(2):
        ids, n = next(iter([(i, n) for _, i, n in tokenizer.encode(pa.array(texts))]))
        assert np.split(ids, np.cumsum(n)[:-1])[1].tolist() == tokenizer.tokenizer.encode(texts[1], add_special_tokens=False).ids + [2]
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tokenizer.tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_empty_tables_and_tables_of_nulls(spark, docs):  # noqa: F811
    none, items = docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_leaks(none, items).count() == without_leaks(none, items).count() == find_leaks(docs, items.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in near_duplicate_groups(nulls).collect()] == [(None, 0, None)] * 3
    assert {(r.n_words, r.n_removed) for r in without_repeats(nulls).collect()} == {(0, 0)}
    assert {(r["size"], r.target, r.taken) for r in words_taken(nulls).collect()} == {(0, 0.0, 0)}
    assert {(r.base_failed, r.kept) for r in quality_rules(nulls).collect()} == {(True, False)}
    assert sorted(r["size"] for r in shard_by_bytes(nulls).collect()) == [16] * 3 and licenses.find_licenses(nulls).count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path):
    _, t = odd
    chars = t.withColumn("n_chars", F.length("text").cast("long"))
    for name, rows in (("odd", chars), ("none", chars.limit(0))):
        where = f"{tmp_path}/{name}"
        rows.write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame([(None, None), (1, "one two"), (1, "one two")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
        made = spark.read.parquet(f"{where}/documents.parquet")
        for i, (step, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, made, where)
            if step != "shard":
                assert out.columns == rows.columns
            out.write.parquet(f"{where}/{i}")
            made = spark.read.parquet(f"{where}/{i}")
        assert (made.count() == 0) == (name == "none")


# --- against brute force ---------------------------------------------------------------------


def water_filled(sizes, weights, cap=3):
    """Targets of {source: (size, weight)}: shares by weight, stopped at ``cap`` times the size."""
    total, target, free = sum(s for s, _ in sizes.values()), {}, dict(sizes)
    while True:
        left = total - sum(target.values())
        among = sum(w for _, w in free.values())
        over = {n for n, (s, w) in free.items() if left * w / among > cap * s} if among else set()
        if not over:
            return target | {n: left * w / among for n, (_, w) in free.items()}
        for n in over:
            target[n] = float(cap * free.pop(n)[0])


def test_mix_against_its_slots_in_plain_python(spark, docs):  # noqa: F811
    block = 16
    rows = [(d, t, ["s1", "s2", None, "s3"][i % 4]) for i, (d, t) in enumerate(ROWS)]
    got = words_taken(docs, block_tokens=block, shard_tokens=64).collect()
    streams, size = defaultdict(list), Counter()
    text_hash = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    for d, t, s in rows:
        streams[s].append((d is not None, d, text_hash[t], len(brute.words(t))))
        size[s] += len(brute.words(t))
    names = sorted((s for s in streams if s is not None)) + [None]
    targets = water_filled({s: (size[s], (5, 2, 1)[i % 3]) for i, s in enumerate(names)}, None)
    assert all(math.isclose(r.target, targets[r.source], rel_tol=1e-12) and r.source_size == size[r.source] for r in got)
    table = spark.createDataFrame([(s, size[s], targets[s]) for s in names], "source string, source_size long, target double")
    slots = mixing.mix_slots(table, block, 64).collect()
    taken = Counter()
    for s, rounds in ((s, Counter((x.round, x.block) for x in slots if x.source == s)) for s in names):
        assert set(rounds.values()) == {1}  # a block once a round
        mine = [x for x in slots if x.source == s]
        assert sum(x.take for x in mine) == math.floor(targets[s] + 0.5)
        at = 0
        for _, d, h, n in sorted(streams[s], key=lambda x: (x[0], x[1] if x[0] else 0, x[2])):
            for x in mine:
                lo, hi = x.block * block, x.block * block + x.take
                taken[d, s, n] += max(0, min(at + n, hi) - max(at, lo))
            at += n
    have = Counter()
    for r in got:
        have[r.doc_id, r.source, r["size"]] += r.taken
    assert +have == +taken


def test_shards_against_prefix_sums_in_plain_python(docs):  # noqa: F811
    got = shard_by_bytes(docs, shards=7).collect()
    rows = sorted((d is not None, d or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 16) for d, t in ROWS)
    total, before, slots, want = sum(r[3] for r in rows), 0, Counter(), []
    for there, d, crc, n in rows:
        shard = min((2 * before + n) * 7 // (2 * total), 6)
        want.append((d if there else None, n, crc, shard, slots[shard]))
        slots[shard] += 1
        before += n
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_verdicts_against_brute_force(spark):
    r = random.Random(2)
    vocabulary = {"en": ["the", "of", "and", *[f"e{chr(97 + i % 26)}{i}" for i in range(200)]], "": ["und", "der", *[f"d{i}" for i in range(200)]], None: ["le", "la", "les", *[f"f{i}é" for i in range(200)]], "few": ["x"]}
    rows = []
    for i in range(160):
        lang = ["en", "", None][i % 3]
        text = " ".join(r.choice(vocabulary[lang][:3]) if r.random() < 0.4 else r.choice(vocabulary[lang]) for _ in range(r.randrange(10, 160)))
        rows.append((i, text, lang))
    rows += [(1000 + i, " ".join(r.choice(vocabulary[""]) for _ in range(100)), None) for i in range(3)]
    rows += [(2000 + i, " ".join(r.choice("#$%|") * 3 + r.choice("abc") for _ in range(90)), "en") for i in range(3)] + [(3000, " ".join(f"u{i}" for i in range(90)), "few"), (3001, None, "few")]
    word = lambda t: brute.words(t, True)

    def classes(t):
        c = Counter()
        for ch in b" ".join(brute.words(t)).decode():
            if ch != " " or False:
                b = ch.encode()[0]
                c["lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "stop" if b in quality.STOPS else "symbol" if b in quality.SYMBOLS else "beyond" if b >= 0x80 else "other"] += 1
        return c

    def distance(p, q):
        p, q = ({k: v / max(sum(x.values()), 1) for k, v in x.items()} for x in (p, q))
        bits = lambda a, b: sum(v * math.log2(v / ((v + b.get(k, 0)) / 2)) for k, v in a.items() if v)
        return math.sqrt(max(0.0, (bits(p, q) + bits(q, p)) / 2))

    reference = {}
    for lang in {x[2] for x in rows}:
        good = [t for _, t, x in rows if x == lang and not brute.base_counts(t)[-1]]
        count = Counter(w for t in good for w in word(t))
        total = sum(count.values())
        common = {w for w, n in count.items() if n >= 0.002 * total}
        if total >= 2000 and common:
            reference[lang] = (sum(map(classes, good), Counter()), Counter({w: count[w] for w in common}) + Counter({None: total - sum(count[w] for w in common)}), common)
    assert set(reference) == {"en", "", None}
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"n": F.lit(1), "total": F.lit(2)})
    for bound in (quality.BROADCAST_ROWS, 0):
        verdicts = Counter()
        for x in quality_rules(t, broadcast_rows=bound).collect():
            _, text, lang = next(y for y in rows if y[0] == x.doc_id)
            kept = not brute.base_counts(text)[-1]
            if lang in reference:
                c, w, common = reference[lang]
                n, own = len(word(text)), classes(text)
                char, dist = distance(own, c), distance(Counter(a if a in common else None for a in word(text)), w)
                assert abs(x.char_distance - char) < 1e-6 and abs(x.word_distance - dist) < 1e-6, (x, char, dist)
                kept &= not (sum(own.values()) >= 150 and char > 0.3) and not (n >= 50 and dist > 0.27 + 1 / math.sqrt(n))
            else:
                assert x.char_distance is None and x.word_distance is None
            assert x.kept == kept, x
            verdicts[x.doc_id >= 1000, x.kept] += 1
        assert verdicts[False, True] > 30 and verdicts[True, False] >= 6


def test_scratch_refuses_a_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"
        applicationId = "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="share"):
        scratch.shared_dir(Session())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    asked, made = con.sql(oracle_sql()[name]), queries()[name](spark, SF)
    assert sorted(asked.columns) == sorted(made.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    theirs = sorted((tuple(plain(x) for x in r) for r in asked.select(", ".join(made.columns)).fetchall()), key=key)
    assert sorted((tuple(plain(x) for x in r) for r in made.collect()), key=key) == theirs


def test_rows_of_one_id_whose_texts_agree_in_half_their_hash_keep_their_own_words(spark):
    """Two texts found by search whose xxhash64 agree in the low 32 bits, with null ids and with a repeated one, beside a third that shares a window."""
    r = random.Random(3)
    shared = [f"s{i}" for i in range(40)]
    base = spark.range(400_000).select(F.concat(F.lit("lead "), F.col("id").cast("string"), F.lit(" x" * 60)).alias("text"), "id")
    low = base.withColumn("low", F.xxhash64("text").bitwiseAND(0xFFFFFFFF))
    pair = low.groupBy("low").agg(F.collect_list("id").alias("ids")).filter("size(ids) > 1").orderBy("low").first().ids[:2]
    one, other = (f"lead {i}" + " x" * 60 for i in pair)
    rest = " ".join(shared) + " " + " ".join(f"t{r.random()}" for _ in range(100))
    for ids in ((None, None, None), (1, 1, 1), (1, 2, None)):
        rows = list(zip(ids, (one, other, rest))) + [(5, " ".join(shared)), (ids[0], one + " and more " + " ".join(shared[:36]))]
        got = without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept) for x in got.collect()), key=key)
        assert got == sorted(brute.without_repeats(rows), key=key)
