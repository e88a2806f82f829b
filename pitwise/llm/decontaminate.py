"""Benchmark items inside documents: size-partitioned MinHash containment search.

An item is in a document if the document's set of ``k``-word shingles (A-Z lower
cased) holds at least ``threshold`` of the item's. Against a document thousands of
times its size an item has almost no Jaccard similarity, so signatures of one fixed
length would miss it. The sketch of an item is therefore its *bottom-m* MinHash, the
``m`` smallest of its shingle hashes, where ``m = q - ceil(threshold * q) + 1``
follows from its size ``q``: a document that holds enough of the item lacks fewer
than ``m`` of its shingles, so it holds one of any ``m``, and no match is missed.
Items are partitioned by size (powers of two). A partition has its own table of sketch
hashes and its own bound, the largest of them, above which a document's hashes are not
looked up in it; what it retrieves are single items. Each retrieved (document, item)
is then verified exactly, by the whole shingle sets.

A benchmark of at most ``broadcast_shingles`` shingles (8 bytes each) is broadcast
and documents are searched and verified in one scan without a shuffle; a larger one
is joined with the documents' hashes through shuffles instead. Both give the same
rows.

Defined results: null texts and texts without words match nothing; an item of fewer
than ``k`` words matches documents with just these words; documents and items are
those of equal id and text, so rows that share an id (or have none) are judged one by
one; equal results are given once; empty tables give no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut
from .setjoin import _keyed
from .words import Chunk, chunks, shingle_sets, window_hashes, window_starts

K = 5
THRESHOLD = 0.8
BROADCAST_SHINGLES = 4_000_000


def needed(q: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Shingles that a match needs of an item's ``q`` (free of float noise)."""
    return -(-(np.asarray(q) * round(threshold * 10_000)) // 10_000)


def _sets(rows: DataFrame, k: int, name: str) -> DataFrame:
    """``name, h``: every distinct shingle hash of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                h, n = shingle_sets(chunk, k)
                doc = np.repeat(np.arange(chunk.docs), n) + chunk.row
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(h)], names=[name, "h"])

    return rows.mapInArrow(run, f"{name} {rows.schema[name].dataType.simpleString()}, h long")


class Sketches:
    """All items, as arrays: their sets, and their sketches partitioned by size."""

    def __init__(self, item: np.ndarray, h: np.ndarray, threshold: float):
        order = np.lexsort((h, item))
        item, self.h = item[order], h[order]  # whole sets, item by item, ascending
        self.ids, self.first, self.q = np.unique(item, return_index=True, return_counts=True)
        self.need = needed(self.q, threshold)
        m = self.q - self.need + 1
        number = np.repeat(np.arange(len(self.q)), self.q)
        sketched = np.arange(len(h)) - self.first[number] < m[number]
        part = np.log2(self.q).astype(int)
        #: by size partition: sketch hashes, ascending, and the numbers of their items
        self.parts = []
        for p in np.unique(part):
            own = np.flatnonzero(sketched & (part[number] == p))
            own = own[np.argsort(self.h[own], kind="stable")]
            self.parts.append((self.h[own], number[own]))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.h[sketched].view(np.uint64) >> np.uint64(44)] = True

    def retrieved(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct (document, number of an item) of which a sketch hash is among the
        documents' hashes, by document."""
        maybe = np.flatnonzero(self.bits[h.view(np.uint64) >> np.uint64(44)])
        h, doc, docs, items = h[maybe], doc[maybe], [], []
        for sketch, item in self.parts:
            able = h <= sketch[-1]
            own, of = h[able], doc[able]
            lo = np.searchsorted(sketch, own, "left")
            n = np.searchsorted(sketch, own, "right") - lo
            docs.append(np.repeat(of, n))
            items.append(item[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)])
        pairs = np.unique(np.concatenate(docs) * len(self.q) + np.concatenate(items))
        return pairs // len(self.q), pairs % len(self.q)

    def shared(self, own: np.ndarray, item: int) -> int:
        """How many of an item's shingles are in a document's set (ascending)."""
        wanted = self.h[self.first[item] : self.first[item] + self.q[item]]
        at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
        return int(np.count_nonzero(own[at] == wanted))


def _raw_hashes(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes with repeats, and their documents; short texts count whole."""
    w = chunk.word_hashes(fold=True)
    at, n = window_starts(chunk.word_at, k)
    h = window_hashes(w, k)[at] if len(at) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(chunk.docs), n)
    for d in np.flatnonzero((chunk.n_words > 0) & (chunk.n_words < k)):
        own = w[chunk.word_at[d] : chunk.word_at[d + 1]]
        h, doc = np.append(h, window_hashes(own, len(own))), np.append(doc, d)
    return h.view(np.int64), doc


def find_leaks(
    docs: DataFrame, items: DataFrame, k: int = K, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES,
    id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` of every contained item."""
    found = _find(_keyed(docs, id_col, text_col), items, k, threshold, broadcast_shingles, item_col, text_col)
    return found.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")).distinct()


def _find(docs: DataFrame, items: DataFrame, k: int, threshold: float, broadcast_shingles: int, item_col: str, text_col: str) -> DataFrame:
    """``key, doc_id, item_id, n_item, n_shared``, of ``key, doc_id, text``."""
    named = _keyed(items, item_col, text_col).select(F.col("key").alias("item"), F.col("doc_id").alias("item_id"), "text")
    sets = _sets(named.select("item", "text"), k, "item").distinct()
    if sets.limit(broadcast_shingles + 1).count() <= broadcast_shingles:
        found = _by_scan(docs, sets, k, threshold)
    else:
        found = _by_shuffle(docs, sets, k, threshold)
    return found.join(named.select("item", "item_id").distinct(), "item").select("key", "doc_id", "item_id", "n_item", "n_shared")


def _by_scan(docs: DataFrame, sets: DataFrame, k: int, threshold: float) -> DataFrame:
    table = sets.toPandas()  # within the checked bound
    schema = f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, item long, n_item long, n_shared long"
    if table.empty:
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(Sketches(table.item.to_numpy(np.int64), table.h.to_numpy(np.int64), threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = shared.value
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                h, doc = _raw_hashes(chunk, k)
                long = len(doc) - np.count_nonzero((chunk.n_words > 0) & (chunk.n_words < k))  # short texts follow the others
                rows, item, n, before, own = [], [], [], -1, h[:0]
                for d, i in zip(*sketches.retrieved(h, doc)):
                    if d != before:
                        before, own = d, np.unique(h[doc == d] if chunk.n_words[d] < k else h[np.searchsorted(doc[:long], d) : np.searchsorted(doc[:long], d, "right")])
                    held = sketches.shared(own, i)
                    if held >= sketches.need[i]:
                        rows.append(d + chunk.row)
                        item.append(i)
                        n.append(held)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(sketches.ids[np.array(item, int)]), pa.array(sketches.q[np.array(item, int)]), pa.array(n, pa.int64())],
                    names=["key", "doc_id", "item", "n_item", "n_shared"],
                )

    return docs.mapInArrow(run, schema).distinct()


def _by_shuffle(docs: DataFrame, sets: DataFrame, k: int, threshold: float) -> DataFrame:
    from pyspark.sql import Window

    per = 10_000
    sized = sets.withColumn("n_item", F.count("*").over(Window.partitionBy("item")))  # one item's shingles
    need = F.expr(f"(n_item * {round(threshold * per)} + {per - 1}) div {per}")
    place = F.row_number().over(Window.partitionBy("item").orderBy("h"))
    sketch = sized.withColumn("place", place).filter(F.col("place") <= F.col("n_item") - need + 1)
    largest = sketch.agg(F.max("h")).first()[0]
    texts = docs.select("key", "text")
    met = _sets(texts, k, "key").filter(F.col("h") <= F.lit(largest)).join(sketch.select("h", "item"), "h").select("key", "item").distinct()
    met = cut(met, "retrieved")
    own = _sets(texts.join(met.select("key").distinct(), "key", "left_semi"), k, "key").distinct()
    shared = met.join(sized, "item").join(own, ["key", "h"]).groupBy("key", "item", "n_item").agg(F.count("*").alias("n_shared")).filter(F.col("n_shared") >= need)
    return shared.join(docs.select("key", "doc_id").distinct(), "key").select("key", "doc_id", "item", "n_item", "n_shared")


def without_leaks(
    docs: DataFrame, items: DataFrame, broadcast_ids: int = 1_000_000, k: int = K, threshold: float = THRESHOLD, broadcast_shingles: int = BROADCAST_SHINGLES,
    id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
) -> DataFrame:
    """The documents that hold no item, all columns as they are. The keys (of id and
    text) to drop are broadcast if there are no more than ``broadcast_ids``, else joined
    by shuffles."""
    found = _find(_keyed(docs, id_col, text_col), items, k, threshold, broadcast_shingles, item_col, text_col)
    leaks = cut(found.select(F.col("key").alias("__key")).distinct(), "leaks")
    few = leaks.limit(broadcast_ids + 1).count() <= broadcast_ids
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))  # as in _keyed
    return docs.join(F.broadcast(leaks) if few else leaks, key == F.col("__key"), "left_anti")
