"""Quality of documents from a linear-chain conditional random field over their lines.

Each line has ``FEATURES`` of its own (shares of character classes, how its words end,
how much of it is said elsewhere in the document), and sees those of the line before and
after it; a two-state chain (good, bad) adds weights for the first line and for each step
from line to line. Marginals come from forward-backward, worked out for all lines of a
chunk at once: a chain is a product of 2x2 matrices, so both directions are prefix scans
of log2(lines) array steps, and the first line of each document has a matrix of rank one,
which cuts it off from the document before. A document's score is the mean of its lines'
marginals, weighted by their lengths.

The fit takes a bounded sample of labelled documents (``max_docs`` rows, those of the
least hash of their id, each of ``max_bytes`` and ``max_lines`` at most); all lines of a
document have its label. Only their features reach the driver, where penalised likelihood
is climbed by BFGS. All documents are scored, whole, where they are read; nothing is
shuffled.

Defined results: a null text is an empty one, and an empty one is a single empty line; a
null id is held out; labels that are null, or that contradict each other for an id, are
not learnt from; without any to learn from every score is 0.5, and with one class only
the scores lean to it; repeated rows each get a result; equal texts have equal scores; a
text of any length is read whole; no rows give none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Chunk, chunks, mix, window_hashes, window_starts

FEATURES = (
    "length", "word_length", "upper", "digit", "stop", "symbol", "other", "beyond_ascii", "capitals", "odd_ends", "odd_words", "same_as_before", "said_again", "distinct", "empty",
)
FOLDS = 5
THRESHOLD = 0.3
MAX_DOCS = 4_000
MAX_BYTES = 1 << 16
MAX_LINES = 500
PENALTY = 1.0
STEP_PENALTY = 5.0
STEPS = 150

_LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL, _OTHER, _BEYOND, _NONE = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[list(b".,;:?'\"()-")] = _STOP
_CLASS[list(b"#*$%&|<>!@^~=+_\\{}[]")] = _SYMBOL
_CLASS[0xC0:] = _BEYOND
_CLASS[0x80:0xC0] = _NONE  # continuation bytes are no characters
_CLASS[[0x20, *range(0x09, 0x0E)]] = _NONE
_AGAIN = 5  # words in a row that count as said before


@dataclass
class Lines:
    """The lines of a chunk: their features, characters and first of each document (and the end)."""

    features: np.ndarray
    chars: np.ndarray
    at: np.ndarray

    @property
    def first(self) -> np.ndarray:
        out = np.zeros(len(self.chars), bool)
        out[self.at[:-1]] = True
        return out


def _said_again(chunk: Chunk, words: np.ndarray) -> np.ndarray:
    """Words in runs of ``_AGAIN`` that occur twice or more in their document."""
    covered = np.zeros(len(words), bool)
    at, n = window_starts(chunk.word_at, _AGAIN)
    if len(at):
        key = mix(window_hashes(words, _AGAIN)[at] + np.repeat(np.arange(chunk.docs), n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        step = np.zeros(len(words) + 1, np.int64)
        for places in (order[1:][same], order[:-1][same]):
            np.add.at(step, at[places], 1)
            np.add.at(step, at[places] + _AGAIN, -1)
        # a run may be named twice; a cover is a cover
        covered = np.cumsum(step[:-1]) > 0
    return covered


def lines_of(chunk: Chunk) -> Lines:
    data, classes = chunk.data, _CLASS[chunk.data]
    newline = data == 0x0A
    before = np.cumsum(newline) - newline  # newlines before each byte
    doc = np.repeat(np.arange(chunk.docs), np.diff(chunk.byte_at))
    line = before + doc if len(data) else np.zeros(0, np.int64)
    ended = np.concatenate([[0], np.cumsum(newline)])[chunk.byte_at]
    at = ended + np.arange(chunk.docs + 1)
    n = int(at[-1])
    counts = np.bincount(line * 8 + classes, minlength=n * 8).reshape(n, 8)[:, :7].astype(np.float64)
    chars = counts.sum(1)
    starts, ends = chunk.starts, chunk.ends
    of = line[starts] if len(starts) else np.zeros(0, np.int64)

    def share(chosen: np.ndarray) -> np.ndarray:
        return np.bincount(of[chosen], minlength=n) / words

    words = np.maximum(np.bincount(of, minlength=n), 1).astype(np.float64)

    def within(kind: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(classes == kind)])
        return total[ends] - total[starts]

    hashes = chunk.word_hashes(fold=True)
    lower, upper = within(_LOWER), within(_UPPER)
    letters = lower + upper + within(_BEYOND)
    last = classes[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    repeated = np.zeros(len(of), bool)
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    pair = mix(hashes + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, once = np.unique(pair, return_index=True)
    distinct = np.zeros(len(of), bool)
    distinct[once] = True
    size = np.maximum(chars, 1)
    columns = [
        np.log1p(words) * (chars > 0),
        np.minimum(chars / words, 20) / 10,
        *[np.sqrt(counts[:, k] / size) for k in (_UPPER, _DIGIT, _STOP, _SYMBOL, _OTHER, _BEYOND)],
        share((lower == 0) & (upper > 1)),
        share((last == _SYMBOL) | (last == _OTHER)),
        share(letters == 0),
        share(repeated),
        share(_said_again(chunk, hashes)),
        share(distinct),
        (chars == 0).astype(np.float64),
    ]
    return Lines(np.stack(columns, 1).astype(np.float32), chars, at)


def _with_neighbours(features: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of its neighbours (noughts where it has none), and whether it has any."""
    last = np.append(first[1:], True)
    before, after = np.zeros_like(features), np.zeros_like(features)
    before[1:], after[:-1] = features[:-1], features[1:]
    before[first], after[last] = 0, 0
    return np.column_stack([features, before, after, first, last, np.ones(len(features))]).astype(np.float64)


def _products(m: np.ndarray, scale: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Prefix (or suffix) products of 2x2 matrices, ``m`` of shape 4 x lines, each divided
    by its greatest entry, and the logs of what was divided by."""
    m, scale, step, n = m.copy(), scale.copy(), 1, m.shape[1]
    while step < n:
        left, right = m[:, :-step], m[:, step:]
        a, b, c, d = left
        p, q, r, s = right
        made = np.stack([a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s])
        most = made.max(0)
        whole = scale[:-step] + scale[step:] + np.log(most)
        own = slice(0, n - step) if backwards else slice(step, n)
        m[:, own], scale[own] = made / most, whole
        step *= 2
    return m, scale


@dataclass
class Chain:
    """Weights: of features (for good against bad), of the first line's state, of each step (from, to)."""

    weights: np.ndarray
    start: np.ndarray
    steps: np.ndarray

    def marginals(self, logits: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Chance that each line is good; expected steps by (from, to); log of the partition functions' product."""
        n = len(logits)
        if not n:
            return np.zeros(0), np.zeros((2, 2)), 0.0
        top = np.maximum(logits, 0)
        emit = np.stack([np.exp(np.maximum(-top, -300)), np.exp(np.maximum(logits - top, -300))])
        t = np.exp(self.steps)
        step = np.stack([t[0, 0] * emit[0], t[0, 1] * emit[1], t[1, 0] * emit[0], t[1, 1] * emit[1]])
        begin = np.exp(self.start)[:, None] * emit[:, first]
        step[:, first] = np.stack([begin[0], begin[1], begin[0], begin[1]])
        most = step.max(0)
        ahead, scale = _products(step / most, np.log(most), False)
        alpha = np.stack([ahead[0] + ahead[2], ahead[1] + ahead[3]])
        last = np.append(first[1:], True)
        follow = np.ones((4, n))
        inside = np.flatnonzero(~last)
        follow[:, inside] = step[:, inside + 1] / most[inside + 1]
        behind, _ = _products(follow, np.zeros(n), True)
        beta = np.stack([behind[0] + behind[1], behind[2] + behind[3]])
        both = alpha * beta
        good = both[1] / both.sum(0)
        # the sum over a product's entries is that of the documents so far, twice for the first
        total = np.log(alpha[:, -1].sum()) + scale[-1] - np.log(2) + top.sum()
        to = inside + 1
        pair = np.stack([alpha[a, inside] * t[a, b] * emit[b, to] * beta[b, to] for a in (0, 1) for b in (0, 1)])
        return good, (pair / pair.sum(0)).sum(1).reshape(2, 2) if len(to) else np.zeros((2, 2)), float(total)


@dataclass
class LineModel:
    mean: np.ndarray
    spread: np.ndarray
    chain: Chain

    def good(self, lines: Lines) -> np.ndarray:
        x = _with_neighbours(np.clip((lines.features - self.mean) / self.spread, -5, 5), lines.first)
        return self.chain.marginals(x @ self.chain.weights, lines.first)[0]


def _climb(x: np.ndarray, first: np.ndarray, labels: np.ndarray, penalty: float, step_penalty: float, steps: int) -> Chain:
    """Weights of the greatest penalised likelihood, by BFGS with backtracking."""
    k, begins = x.shape[1], np.flatnonzero(first)
    inside = np.flatnonzero(~first)
    seen_steps = np.zeros((2, 2))
    np.add.at(seen_steps, (labels[inside - 1], labels[inside]), 1)
    seen_start = np.bincount(labels[begins], minlength=2)
    ridge = np.full(k + 6, penalty)
    ridge[k - 1] = 0.0  # the constant
    ridge[k:] = step_penalty

    def unpacked(p: np.ndarray) -> Chain:
        return Chain(p[:k], p[k : k + 2], p[k + 2 :].reshape(2, 2))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        chain = unpacked(p)
        logits = x @ chain.weights
        good, expected, total = chain.marginals(logits, first)
        seen = logits[labels == 1].sum() + (seen_start * chain.start).sum() + (seen_steps * chain.steps).sum()
        start = np.array([(1 - good[begins]).sum(), good[begins].sum()])
        slope = np.concatenate([x.T @ (good - labels), start - seen_start, (expected - seen_steps).ravel()]) + ridge * p
        return total - seen + 0.5 * (ridge * p * p).sum(), slope

    p = np.zeros(k + 6)
    value, slope = loss(p)
    inverse = np.eye(k + 6) / max(np.linalg.norm(slope), 1.0)
    for _ in range(steps):
        way = -inverse @ slope
        if slope @ way > -1e-9 * max(1.0, abs(value)):
            break
        size = 1.0
        while True:
            new_value, new_slope = loss(p + size * way)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * size * (slope @ way):
                break
            size /= 2
            if size < 1e-8:
                return unpacked(p)
        moved, turned = size * way, new_slope - slope
        p, value, slope = p + moved, new_value, new_slope
        along = moved @ turned
        if along > 1e-12:
            left = np.eye(k + 6) - np.outer(moved, turned) / along
            inverse = left @ inverse @ left.T + np.outer(moved, moved) / along
    return unpacked(p)


def held_out(id_: Column, folds: int = FOLDS) -> Column:
    """Whether an id's crc32 as text leaves no remainder by ``folds``; those are never learnt from."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(
    docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, max_lines: int = MAX_LINES, penalty: float = PENALTY, step_penalty: float = STEP_PENALTY,
    steps: int = STEPS, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> LineModel | None:
    """The model of a bounded sample of ``labels`` (``id, label``, 1: good) outside the held-out fold; None without any."""
    key = F.col(id_col)
    known = labels.filter(key.isNotNull() & ~held_out(key, folds) & F.col(label_col).isin(0, 1))
    known = known.groupBy(key.alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("most")).filter("label = most")
    chosen = known.select("id", F.col("label").cast("int").alias("label"), F.xxhash64("id").alias("order")).orderBy("order", "id").limit(max_docs)
    texts = docs.select(key.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.octet_length("text") <= max_bytes)
    rows = texts.join(F.broadcast(chosen), "id")  # max_docs rows at most

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                lines, own = lines_of(chunk), slice(chunk.row, chunk.row + chunk.docs)
                small = np.flatnonzero(np.diff(lines.at) <= max_lines)
                packed = [lines.features[lines.at[d] : lines.at[d + 1]].tobytes() for d in small]
                others = [c.slice(own.start, chunk.docs).take(pa.array(small)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), *others], names=["features", "label", "order", "tie"])

    found = rows.select("text", "label", "order", F.xxhash64("text").alias("tie")).mapInArrow(read, "features binary, label int, order long, tie long")
    sample = found.orderBy("order", "tie").limit(max_docs).collect()
    if not sample:
        return None
    parts = [np.frombuffer(r.features, np.float32).reshape(-1, len(FEATURES)) for r in sample]
    sizes = np.array([len(p) for p in parts])
    features, first = np.concatenate(parts), np.zeros(sizes.sum(), bool)
    first[np.cumsum(sizes) - sizes] = True
    mean, spread = features.mean(0), np.maximum(features.std(0), 1e-3)
    x = _with_neighbours(np.clip((features - mean) / spread, -5, 5), first)
    return LineModel(mean, spread, _climb(x, first, np.repeat([r.label for r in sample], sizes), penalty, step_penalty, steps))


def line_quality(docs: DataFrame, model: LineModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, line`` (from 0), ``chars`` and ``good``, the chance that the line is good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                lines = lines_of(chunk)
                sizes = np.diff(lines.at)
                good = model.good(lines) if model else np.full(len(lines.chars), 0.5)
                ids = batch.column(0).slice(chunk.row, chunk.docs).take(pa.array(np.repeat(np.arange(chunk.docs), sizes)))
                place = np.arange(len(good)) - np.repeat(lines.at[:-1], sizes)
                yield pa.RecordBatch.from_arrays([ids, pa.array(place), pa.array(lines.chars.astype(np.int64)), pa.array(good)], names=schema.names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("line", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("good", T.DoubleType())])
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def score_documents(docs: DataFrame, model: LineModel | None, threshold: float = THRESHOLD, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                lines = lines_of(chunk)
                good = model.good(lines) if model else np.full(len(lines.chars), 0.5)
                weight = lines.chars + 1.0  # so that a text of empty lines has a mean
                score = np.add.reduceat(good * weight, lines.at[:-1]) / np.add.reduceat(weight, lines.at[:-1])
                own = [batch.column(i).slice(chunk.row, chunk.docs) for i in range(2)]
                score = np.clip(score, 0, 1)
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=schema.names)

    kinds = {"held_out": T.BooleanType(), "score": T.DoubleType(), "predicted": T.IntegerType()}
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(c, t) for c, t in kinds.items()]])
    return docs.select(F.col(id_col), held_out(F.col(id_col), folds).alias("held_out"), F.col(text_col)).mapInArrow(run, schema)
