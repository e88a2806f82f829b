"""Removal of word windows that occur more than once, found by difference-cover anchors.

A window is ``window`` consecutive words of one document. ``COVER`` is a perfect
difference cover modulo ``PERIOD``: for any two places there is one shift below
``PERIOD`` that brings both to a place in the cover. So two equal windows, wherever
they start, share an *anchor*: ``window - PERIOD + 1`` words that begin at a cover
place of both documents. Only anchors (``len(COVER) / PERIOD`` of the places) are
hashed and counted over the corpus. Around those that occur twice the match is
extended: every window that holds one is hashed whole and counted, and the windows
that occur twice or more are removed. No pair of documents is ever made, so a group
of any size costs what its rows cost; hot keys meet map-side counts and joins that
Spark can split. Texts that are equal as a whole are told first, by hashes of 96 bits
and their length: of theirs every window occurs elsewhere, so only one of each such group
is extended, for the sake of others that share a part with it.

Defined results: a null text has no words; documents shorter than a window keep
everything; repeated rows are each other's copies; a null id is an id, and rows of one id (or none) are told apart by 96 bits of hashes of id and text; a very long text is
cut nowhere and hashed in one piece; no rows give none; other columns are not looked at. Windows are compared by 96-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, forget
from .words import Chunk, chunks, mix, window_hashes, window_starts

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)

_LOW = np.uint64(0xFFFFFFFF)


def _marks(crc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The text's crc32 above, the place in the document below."""
    return (crc.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)).view(np.int64)


def _anchors(chunk: Chunk, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and place of every anchor of the documents that have a window."""
    k = window - PERIOD + 1
    at, n = window_starts(chunk.word_at, k)
    doc = np.repeat(np.arange(chunk.docs), n)
    place = at - chunk.word_at[doc]
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True
    keep = cover[place % PERIOD] & (chunk.n_words[doc] >= window)
    at, doc, place = at[keep], doc[keep], place[keep]
    return window_hashes(chunk.word_hashes(), k)[at].view(np.int64) if len(at) else np.zeros(0, np.int64), doc, place


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key, crc, starts, copied``: for each document with windows that start
    elsewhere too, the places where they start; or that its whole text has a copy.
    ``docs`` has ``key, crc, text``: 64 bits of a hash of id and text, and the text's crc32,
    by which rows are told apart whatever their ids are; rows alike in both are equal."""
    if window < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words at least")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = batch.column(1).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(2)):
                h, doc, place = _anchors(chunk, window)
                doc = doc + chunk.row
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(pa.array(doc)), pa.array(_marks(crc[doc], place))], names=["h", "key", "mark"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = batch.column(1).to_numpy(zero_copy_only=False)
            places = batch.column(3)
            for chunk in chunks(batch.column(2)):
                own = places.slice(chunk.row, chunk.docs)
                n_places = own.value_lengths().to_numpy(zero_copy_only=False)
                p = own.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(chunk.docs), n_places)
                # windows that hold the anchor at p start at p - PERIOD + 1 .. p
                size = chunk.word_at[-1] + 1
                step = np.zeros(size, np.int64)
                np.add.at(step, chunk.word_at[doc] + np.maximum(p - PERIOD + 1, 0), 1)
                np.add.at(step, chunk.word_at[doc] + p + 1, -1)
                near = np.cumsum(step) > 0
                at, n = window_starts(chunk.word_at, window)
                of = np.repeat(np.arange(chunk.docs), n)
                at, of = at[near[at]], of[near[at]]
                words = chunk.word_hashes()
                h = window_hashes(words, window)[at] if len(at) else np.zeros(0, np.uint64)
                more = (window_hashes(mix(words), window)[at] & _LOW).astype(np.uint32).view(np.int32) if len(at) else np.zeros(0, np.int32)
                doc = of + chunk.row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(more), batch.column(0).take(pa.array(doc)), pa.array(_marks(crc[doc], at - chunk.word_at[of]))], names=["h", "more", "key", "mark"]
                )

    whole = docs.select("key", "crc", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("bytes"))
    whole = whole.filter(F.col("bytes") >= 2 * window - 1)  # shorter texts have no window
    classes = cut(whole.groupBy("hash", "crc", "bytes").agg(F.min("key").alias("key"), F.count("*").alias("rows")), "texts")
    hashed = docs.mapInArrow(anchors, "h long, key long, mark long")
    found = cut(_places(hashed.join(hashed.groupBy("h").count().filter("count >= 2").select("h"), "h"), "places"), "anchors")
    one = classes.select("key", "crc", (F.col("rows") > 1).alias("copied")).join(found, ["key", "crc"]).select("key", "crc", "copied", "places")
    one = cut(one, "anchors-of-one")
    forget(found)
    near = docs.join(one, ["key", "crc"]).select("key", "crc", "text", "places", "copied")
    twice = near.mapInArrow(windows, _WINDOWS).groupBy("h", "more").count().filter("count >= 2").select("h", "more")
    own = near.filter("not copied").mapInArrow(windows, _WINDOWS)
    starts = cut(_places(own.join(twice, ["h", "more"]), "starts"), "windows")
    forget(one)
    copied = whole.join(classes.filter("rows > 1").select("hash", "crc", "bytes"), ["hash", "crc", "bytes"]).select("key", "crc").distinct()
    copied = cut(copied.withColumn("starts", F.lit(None).cast("array<int>")).withColumn("copied", F.lit(True)), "copies")
    forget(classes)
    return starts.withColumn("copied", F.lit(False)).unionByName(copied)


_WINDOWS = "h long, more int, key long, mark long"


def _places(rows: DataFrame, name: str) -> DataFrame:
    own = rows.select("key", F.shiftrightunsigned("mark", 32).alias("crc"), F.col("mark").bitwiseAND(0xFFFFFFFF).cast("int").alias("place"))
    return own.groupBy("key", "crc").agg(F.collect_set("place").alias(name))


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` (the kept words joined by one space) and
    ``kept_sha256`` of it, for each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).alias("crc"), F.col(text_col).alias("text"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = ([], [], [], [])
                for text, starts, copied in zip(part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist()):
                    words = (text or "").encode().split()
                    step = np.zeros(len(words) + 1, np.int64)
                    if copied and len(words) >= window:
                        covered, kept = np.ones(len(words), bool), b""
                    elif starts.is_valid:
                        s = starts.values.to_numpy(zero_copy_only=False)
                        np.add.at(step, s, 1)
                        np.add.at(step, s + window, -1)
                        covered = np.cumsum(step[:-1]) > 0
                        kept = b" ".join([words[i] for i in np.flatnonzero(~covered)])
                    else:
                        covered, kept = step[:-1], b" ".join(words)
                    for held, x in zip(out, (len(words), int(np.count_nonzero(covered)), kept, hashlib.sha256(kept).hexdigest())):
                        held.append(x)
                types = (pa.int64(), pa.int64(), pa.string(), pa.string())
                kept_text = [k.decode() for k in out[2]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip((out[0], out[1], kept_text, out[3]), types))], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    joined = rows.join(repeated_windows(rows.drop("doc_id"), window), ["key", "crc"], "left").select("doc_id", "text", "starts", "copied")
    return joined.mapInArrow(remove, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string, kept_sha256 string")
