"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arc import pages_through_archives
from .decontaminate import find_leaks
from .importance import resample
from .licenses import find_licenses
from .line_crf import fit, score_documents
from .mixing import words_taken
from .quality import quality_rules
from .rans import encode_and_read
from .setjoin import near_duplicate_links
from .sharding import shard_by_bytes
from .substrings import without_repeats
from .url_filter import filter_urls, labelled_urls, train
from .whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), train(labelled_urls(spark)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages_through_archives(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_links(table(spark, sf_dir, "documents"))


def ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_links(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_taken(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _shingles(name: str, table: str, key: str) -> str:
    return f"""{name}_w AS (SELECT {key}, {_WORDS.format(_FOLD)} AS w FROM {table}),
{name} AS (SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM {name}_w)),
{name}_n AS (SELECT {key}, count(*) AS n FROM {name} GROUP BY 1)"""


OP2 = f"""
WITH {_shingles("d", "documents", "doc_id")}, {_shingles("b", "benchmark", "item_id")},
m AS (SELECT d.doc_id, b.item_id, count(*) AS n_shared FROM d JOIN b ON d.s = b.s GROUP BY 1, 2)
SELECT doc_id, m.item_id, b_n.n AS n_item, n_shared, n_shared / b_n.n AS containment FROM m JOIN b_n ON b_n.item_id = m.item_id WHERE 10 * n_shared >= 8 * b_n.n
"""

OP4 = f"""
WITH RECURSIVE {_shingles("d", "documents", "doc_id")},
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM d x JOIN d y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN d_n x ON x.doc_id = a JOIN d_n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, least) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.doc_id WHERE r.least < e.b)
SELECT r.doc_id, coalesce(any_value(d_n.n), 0) AS n_shingles, min(least) AS component_id, coalesce(any_value(c.n), 0) AS n_links
FROM r LEFT JOIN d_n ON d_n.doc_id = r.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) c ON c.a = r.doc_id GROUP BY 1
"""

OP10 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM p), g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM c WHERE n >= 2),
u AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM w),
k AS (SELECT u.doc_id, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY u.j) FILTER (WHERE g.j IS NULL) AS kept FROM u LEFT JOIN g ON g.doc_id = u.doc_id AND g.j = u.j GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

#: The table of CRC-32 by its rule, and the checksum of bytes written in hexadecimal as ``x``.
_CRC_TABLE = "t AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], CAST(range(8) AS BIGINT[])), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)))"
_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, len(x) + 1, 2), lambda i: CAST((strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1 AS BIGINT))), lambda a, y: xor(a >> 8, crc[(xor(a, y) & 255) + 1])), 4294967295)"

OP7 = f"""
WITH {_CRC_TABLE}, b AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, hex(encode(coalesce(text, ''))) AS x, crc FROM documents CROSS JOIN t), c AS (SELECT doc_id, size, {_CRC} AS text_crc32 FROM b),
o AS (SELECT *, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total, row_number() OVER w AS i FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)), s AS (SELECT *, CAST(least((2 * before + size) * 40 // (2 * total), 39) AS INTEGER) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY i) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

#: Every feature's checksum once, then counts, gains and draws.
OP13 = rf"""
WITH {_CRC_TABLE},
x AS (SELECT 0 AS side, doc_id, row_number() OVER () AS k, text FROM documents UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
w AS (SELECT side, doc_id, k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM x),
g AS (SELECT side, k, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT side, k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w CROSS JOIN (VALUES (1), (2), (3)) v(n))),
c AS (SELECT side, k, g, count(*) AS c FROM g GROUP BY 1, 2, 3), u AS (SELECT DISTINCT g FROM c),
h AS (SELECT g, hex(encode(g)) AS x, t.crc AS crc FROM u CROSS JOIN t),
b AS (SELECT g, {_CRC} % 10000 AS b FROM h),
f AS (SELECT side, k, b, sum(c) AS c FROM c JOIN b USING (g) GROUP BY 1, 2, 3),
n AS (SELECT b, sum(c) FILTER (WHERE side = 0) AS s, coalesce(sum(c) FILTER (WHERE side = 1), 0) AS t FROM f GROUP BY 1),
a AS (SELECT sum(s) AS s, sum(t) AS t FROM n),
y AS (SELECT b, CAST(floor(1000 * ln(CAST(n.t + 1 AS DOUBLE) * CAST(a.s + 10000 AS DOUBLE) / (CAST(n.s + 1 AS DOUBLE) * CAST(a.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM n, a WHERE n.s IS NOT NULL),
d AS (SELECT k, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * gain) AS BIGINT) AS weight FROM f JOIN y USING (b) WHERE side = 0 GROUP BY 1),
e AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) AS words, list_reduce(list_concat([0], list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('42:' || doc_id), i, 1)) - 1)), lambda p, q: p * 16 + q) AS h FROM w LEFT JOIN d USING (k) WHERE side = 0),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE words >= 20) OVER () AS entered FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * entered // 100 THEN place END AS rank FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_decontamination": op2_decontamination,
        "op3_arc_to_warc": op3_arc_to_warc,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "ngram_jaccard_links": ngram_jaccard_links,
        "op5_license_scan": op5_license_scan,
        "op6_mixing": op6_mixing,
        "op7_sharding": op7_sharding,
        "op8_rans_token_ids": op8_rans_token_ids,
        "op9_quality_rules": op9_quality_rules,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_line_crf_quality": op12_line_crf_quality,
        "op13_importance_resampling": op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2, "op3_arc_to_warc": OP3, "op4_ngram_jaccard": OP4, "ngram_jaccard_links": OP4, "op7_sharding": OP7, "op10_substring_dedup": OP10, "op13_importance_resampling": OP13}
