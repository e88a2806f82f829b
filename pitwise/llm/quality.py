"""Quality rules: base counts, then divergence from language references.

A document's *character-class* histogram (``CLASSES``) and *common-word* histogram
(one bin for each common word of its language, one for all other words) are
compared with those of its language by the Jensen-Shannon distance (square root of
the divergence in bits, so between 0 and 1). The references are sums over every
document of the language that passes the base rule: one pass counts, a second
judges. A word is common if it makes up ``common_share`` of the language's words,
so a language has at most ``1 / common_share`` of them. Languages of fewer than
``min_reference_words`` words judge nobody and have no reference. References of up to
``broadcast_rows`` rows are broadcast (checked); more, as where every document claims a
language of its own, are joined with the documents by language instead. Both give the
same rows.

Short texts give noisy histograms, so each test has a guard: the character test
needs ``min_chars`` word characters, the word test ``min_words`` words, and a
language of fewer than ``min_reference_words`` words judges nobody. The distance
that mere sampling gives falls as one over the root of the number of words, so the
word test allows ``max_word_distance + word_noise / sqrt(n_words)``.

Defined results: a null text has no words (so it fails the base rule); a null
language is a language of its own; repeated rows each get a result; no rows give
none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut
from .words import Chunk, chunks, mix, window_hashes, window_starts

CLASSES = ("lower", "upper", "digit", "stop", "symbol", "other_ascii", "beyond_ascii")
#: The symbols and sentence marks that have a class of their own.
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?'\"()-"

COMMON_SHARE = 0.002
MIN_WORDS = 50
MIN_CHARS = 150
MIN_REFERENCE_WORDS = 2_000
BROADCAST_ROWS = 500_000  # some 1,000 languages
MAX_CHAR_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.27
WORD_NOISE = 1.0

_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(STOPS)] = 3
_CLASS[list(SYMBOLS)] = 4
_CLASS[0xC0:] = 6
_CLASS[0x80:0xC0] = 7  # continuation bytes are no characters
_CLASS[[0x20, *range(0x09, 0x0E)]] = 7

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
_WORD_BITS = 62


def class_counts(chunk: Chunk) -> np.ndarray:
    """Documents x classes."""
    doc = np.repeat(np.arange(chunk.docs, dtype=np.int64), np.diff(chunk.byte_at))
    return np.bincount(doc * 8 + _CLASS[chunk.data], minlength=chunk.docs * 8).reshape(-1, 8)[:, :7]


def duplicate_lines(chunk: Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    out = np.zeros(chunk.docs, np.int64)
    raw = chunk.data.tobytes()
    for d in range(chunk.docs):
        seen = set()
        for line in raw[chunk.byte_at[d] : chunk.byte_at[d + 1]].split(b"\n"):
            if not line.strip(b" \t\x0b\x0c\r"):
                continue
            out[d] += line in seen
            seen.add(line)
    return out


def repeated_words(chunk: Chunk, words: np.ndarray, k: int = 8) -> np.ndarray:
    """Words inside ``k``-word windows that occur twice or more in their document."""
    at, n = window_starts(chunk.word_at, k)
    if not len(at):
        return np.zeros(chunk.docs, np.int64)
    doc = np.repeat(np.arange(chunk.docs), n)
    key = mix(window_hashes(words, k)[at] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at[again], 1)
    np.add.at(step, at[again] + k, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(chunk.doc_of_word()[covered], minlength=chunk.docs)


def _base(chunk: Chunk) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    words, classes = chunk.word_hashes(), class_counts(chunk)
    n, repeat = chunk.n_words, repeated_words(chunk, words)
    base = {
        "n_words": n,
        "word_chars": classes.sum(1),
        "n_symbols": classes[:, CLASSES.index("symbol")],
        "n_dup_lines": duplicate_lines(chunk),
        "n_repeat_words": repeat,
        "base_failed": (n < 20) | (100 * repeat > 30 * n),
    }
    return base, classes, words


def _tally(batches: Iterator[pa.RecordBatch], flush: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, count): kind 0 counts characters by class, 1 words by hash."""
    held: dict = {}

    def drain():
        for lang, (classes, parts) in held.items():
            if parts:
                keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                counts = np.bincount(where, np.concatenate([c for _, c in parts])).astype(np.int64)
                yield _rows(lang, 1, keys, counts)
            yield _rows(lang, 0, np.arange(len(CLASSES)), classes)
        held.clear()

    size = 0
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for chunk in chunks(batch.column(1)):
            base, classes, _ = _base(chunk)
            folded = chunk.word_hashes(fold=True) >> np.uint64(64 - _WORD_BITS)
            own = langs[chunk.row : chunk.row + chunk.docs]
            good, of = ~base["base_failed"], chunk.doc_of_word()
            for lang in set(own[good]):
                mine = good & (own == lang)
                kept = held.setdefault(lang, [np.zeros(len(CLASSES), np.int64), []])
                kept[0] += classes[mine].sum(0)
                u, c = np.unique(folded[mine[of]].view(np.int64), return_counts=True)
                kept[1].append((u, c))
                size += len(u)
            if size > flush:
                yield from drain()
                size = 0
    yield from drain()


def _rows(lang, kind, keys, counts) -> pa.RecordBatch:
    n = len(keys)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array(np.full(n, kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))],
        names=["lang", "kind", "key", "n"],
    )


def _language(lang_col: str) -> Column:
    """The language with a letter before it, so that null is one that no name equals."""
    return F.when(F.col(lang_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(lang_col)))


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", common_share: float = COMMON_SHARE, min_reference_words: int = MIN_REFERENCE_WORDS) -> DataFrame:
    """``lang, kind, key, n, total``: each language's character classes (kind 0)
    and common words (kind 1, by hash), with the language's sum over all words. ``lang`` is
    ``n`` for null and the name after an ``s`` for others."""
    counts = docs.select(_language(lang_col).alias("lang"), F.col(text_col)).mapInArrow(_tally, "lang string, kind int, key long, n long")
    counts = counts.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).filter("lang is not null and kind is not null")  # none is; so both uses below are one exchange
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    words = F.max(F.when(F.col("kind") == 1, F.col("total"))).over(Window.partitionBy("lang"))  # two rows a language
    common = counts.join(totals.withColumn("words", words).filter(F.col("words") >= min_reference_words).drop("words"), ["lang", "kind"])
    return common.filter((F.col("kind") == 0) | (F.col("n") >= common_share * F.col("total"))).select("lang", "kind", "key", "n", "total")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` from the distribution ``q``."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    m = (p + q) / 2

    def bits(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(1)

    return np.sqrt(np.clip((bits(p) + bits(np.broadcast_to(q, p.shape))) / 2, 0, 1))


class Judge:
    """The references as arrays, and the distances of a chunk's documents."""

    def __init__(self, table: pd.DataFrame):
        self.langs = {}
        for lang, rows in table.groupby("lang"):
            c, w = rows[rows.kind == 0].sort_values("key"), rows[rows.kind == 1].sort_values("key")
            if len(w):
                words = int(w.total.iloc[0])
                share = np.append(w.n.to_numpy(), words - w.n.sum()) / words
                self.langs[lang] = (c.n.to_numpy() / max(c.n.sum(), 1), w.key.to_numpy(), share)

    def distances(self, chunk: Chunk, langs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character and word distance of each document, not a number without a reference."""
        char, word = np.full(chunk.docs, np.nan), np.full(chunk.docs, np.nan)
        folded = (chunk.word_hashes(fold=True) >> np.uint64(64 - _WORD_BITS)).view(np.int64)
        of = chunk.doc_of_word()
        for lang in set(langs) & set(self.langs):
            of_classes, keys, share = self.langs[lang]
            mine = np.flatnonzero(langs == lang)
            char[mine] = distance(classes[mine], of_classes)
            place = np.full(chunk.docs, -1)
            place[mine] = np.arange(len(mine))
            at = place[of] >= 0
            bin_ = np.minimum(np.searchsorted(keys, folded[at]), len(keys) - 1)
            bin_ = np.where(keys[bin_] == folded[at], bin_, len(keys))
            hist = np.bincount(place[of][at] * (len(keys) + 1) + bin_, minlength=len(mine) * (len(keys) + 1))
            word[mine] = distance(hist.reshape(len(mine), -1), share)
        return char, word


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    lang_col: str = "lang",
    text_col: str = "text",
    common_share: float = COMMON_SHARE,
    min_words: int = MIN_WORDS,
    min_chars: int = MIN_CHARS,
    min_reference_words: int = MIN_REFERENCE_WORDS,
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    word_noise: float = WORD_NOISE,
    broadcast_rows: int = BROADCAST_ROWS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """A row for each document: its id, the base counts, ``kept``, and ``char_distance``
    and ``word_distance`` (null where the language has no reference). ``carry`` names
    further columns to hand on unchanged."""
    known = cut(references(docs, lang_col, text_col, common_share, min_reference_words), "references")
    few = known.limit(broadcast_rows + 1).count() <= broadcast_rows
    carried = list(dict.fromkeys([id_col, *carry]))
    needed = list(dict.fromkeys([*carried, text_col]))
    rows = docs.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(needed)], _language(lang_col).alias("__lang"))
    text_at, lang_at = needed.index(text_col), len(needed)
    if few:
        judge = docs.sparkSession.sparkContext.broadcast(Judge(known.toPandas()))
    else:  # a row a language, to lie beside each of its documents
        packed = known.groupBy("lang").agg(F.collect_list(F.struct("kind", "key", "n", "total")).alias("__known"))
        rows = rows.join(packed, F.col("__lang") == F.col("lang"), "left").drop("lang")

    def own_judge(batch: pa.RecordBatch) -> Judge:
        if few:
            return judge.value
        langs = batch.column(lang_at).to_pylist()
        first = {lang: i for i, lang in reversed(list(enumerate(langs)))}
        held = [(lang, batch.column(lang_at + 1)[i].as_py() or []) for lang, i in first.items()]
        return Judge(pd.DataFrame([{"lang": lang, **x} for lang, some in held for x in some], columns=["lang", "kind", "key", "n", "total"]))

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            current, all_langs = own_judge(batch), np.array(batch.column(lang_at).to_pylist(), object)
            for chunk in chunks(batch.column(text_at)):
                base, classes, _ = _base(chunk)
                char, word = current.distances(chunk, all_langs[chunk.row : chunk.row + chunk.docs], classes)
                odd = (base["word_chars"] >= min_chars) & (char > max_char_distance)  # never of what is not a number
                odd |= (base["n_words"] >= min_words) & (word > max_word_distance + word_noise / np.sqrt(np.maximum(base["n_words"], 1)))
                own = [batch.column(i).slice(chunk.row, chunk.docs) for i in range(len(carried))]
                result = [*base.values(), ~base["base_failed"] & ~odd, *(pa.array(x, from_pandas=True) for x in (char, word))]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x) for x in result)], names=names)

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)
    names = [*carried, *base_names(), "kept", "char_distance", "word_distance"]
    return rows.mapInArrow(rule, f"{schema}, {BASE}, kept boolean, char_distance double, word_distance double")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", **options) -> DataFrame:
    """The documents that the rules keep, all columns as they are."""
    hidden = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*hidden.values())
    judged = quality_rules(rows, hidden[id_col], hidden[lang_col], hidden[text_col], carry=tuple(hidden.values()), **options)
    return judged.filter("kept").select(*[F.col(h).alias(c) for c, h in hidden.items()])


def base_names() -> list[str]:
    return [x.split()[0] for x in BASE.split(", ")]
