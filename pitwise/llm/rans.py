"""Token ids in blocks of a static range asymmetric numeral system (rANS).

Documents in ascending id order are packed into *segments* of about
``segment_tokens`` ids. A segment counts its ids, scales the counts to ``2**SCALE``,
and this one frequency table is shared by all of its blocks. A block holds
``BLOCK_TOKENS`` ids (but for a segment's last), so a long document goes on in the
blocks that follow, and decodes on its own: its ids are dealt round robin to
``LANES`` interleaved coders whose 63-bit states are its checkpoint, a CRC-32 guards
states and words, and the lengths of its documents tell where each begins. Encoding
and decoding step through many blocks at once, one numpy operation for all lanes of
all of them. The corpus is tokenized once.

File format (Parquet, a row a segment, files in ascending id order): ``part,
segment`` (its place), ``n_tokens``, ``table`` (zlib of little-endian uint32
frequencies by id), ``blocks``: ``docs``, ``lengths``, ``continued`` (its first
document began in the block before), ``states`` (little-endian uint64), ``words`` (little-endian uint32) and ``crc32`` of states then words.

Defined results: a null text is the end id alone; rows with equal ids stand in
order of their texts' hashes; null ids come first; a very long text is cut into as many
blocks as it fills and lies in one segment; no rows give no segments; other columns are
not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import new_path
from .words import chunks

SCALE = 17
LANES = 128
BLOCK_TOKENS = 1 << 16
SEGMENT_TOKENS = 1 << 22
CACHED_WORDS = 1 << 20
MAX_CACHED = 64  # bytes

_U = np.uint64
_LOW = _U(1 << 31)  # a state lies in [2**31, 2**63)
_MASK = _U((1 << SCALE) - 1)


_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")  # an apostrophe may begin a suffix
#: A line of letters, then marks; or any other.
_SIMPLE = re.compile(f"^(?:([{_LETTERS}]+)([{re.escape(_MARKS)}]*)|.*)$", re.M)


class _Grown:
    """An array that grows at its end."""

    def __init__(self, dtype, values):
        self.room = np.array(values, dtype)
        self.values = self.room

    def extend(self, more: np.ndarray) -> None:
        n = len(self.values)
        if n + len(more) > len(self.room):
            self.room = np.concatenate([self.values, np.empty(n + len(more), self.room.dtype)])
        self.room[n : n + len(more)] = more
        self.values = self.room[: n + len(more)]

    def extend_parts(self, parts: list[tuple[int, ...]], ends: _Grown) -> None:
        """Append the parts, and where each ends to ``ends``."""
        ends.extend(len(self.values) + np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))))
        self.extend(np.fromiter(chain.from_iterable(parts), self.room.dtype))


def _runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + n[i] - 1`` of all ``i``, one after another."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(starts - (end - n), n)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


class _Table:
    """Places by 64-bit keys: open addressing, a numpy operation for all keys at once."""

    def __init__(self, bits: int):
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.key, self.place = np.zeros(1 << bits, _U), np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h >> self.shift).astype(np.int64)
        out = self.place[at]
        todo = np.flatnonzero((out >= 0) & (self.key[at] != h))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            out[todo] = self.place[at]
            on = (out[todo] >= 0) & (self.key[at] != h[todo])
            todo, at = todo[on], at[on]
        return out

    def add(self, h: np.ndarray, place: np.ndarray) -> None:
        """Keys that are not in the table, each once."""
        at = (h >> self.shift).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.place[at] < 0)
            self.place[at[free]] = place[free]
            won = free[self.place[at[free]] == place[free]]
            self.key[at[won]] = h[won]
            left = np.ones(len(h), bool)
            left[won] = False
            h, place, at = h[left], place[left], (at[left] + 1) & self.mask


class WordTokenizer:
    """Ids of texts by a tokenizer that never joins what ASCII white space parts.

    Each word is encoded once and remembered, until ``CACHED_WORDS`` of them fill the
    memory and it starts anew. Words are found by their hash in a table and compared
    byte by byte with the word remembered. Words of Latin-1 letters, with or without
    marks behind, go straight to the library's model if that gives the ids of its
    whole chain on all pairs of letters and marks; the library encodes all others."""

    _loaded: dict = {}

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_as_chars = [chr(c) for c in range(0xDF)] + [level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)]
        self._renew()
        probes = [a + b for a in _LETTERS for b in _LETTERS + _MARKS] + ["x" + a + b for a in _MARKS for b in _MARKS] + [a.upper() + a + "word" for a in _LETTERS] + ["q" * MAX_CACHED]
        self.simple = self._simple_parts(probes) == self._whole_parts(probes)
        self._renew()

    @classmethod
    def load(cls, path: str, end_id: int) -> WordTokenizer:
        """The one of this worker process."""
        if (path, end_id) not in cls._loaded:
            cls._loaded[path, end_id] = cls(path, end_id)
        return cls._loaded[path, end_id]

    def _renew(self) -> None:
        self.table = _Table(CACHED_WORDS.bit_length() + 1)
        #: ids and bytes of the words by place, and where each ends; place 0 is the end of a text
        self.ids, self.ids_at = _Grown(np.uint32, [self.end_id]), _Grown(np.int64, [0, 1])
        self.bytes, self.bytes_at = _Grown(np.uint8, []), _Grown(np.int64, [0, 0])
        self.bases: dict[str, int] = {"": 0}
        self.base_ids, self.base_at = _Grown(np.uint32, []), _Grown(np.int64, [0, 0])

    def _whole_parts(self, words: list[str]) -> list[tuple[int, ...]]:
        return [tuple(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn_bases(self, parts: list[str]) -> None:
        tokenize = self.tokenizer.model.tokenize
        ids = [tuple([t.id for t in tokenize(p if p.isascii() else p.translate(self.bytes_as_chars))]) for p in parts]
        self.bases.update(zip(parts, range(len(self.base_at.values) - 1, len(self.base_at.values) - 1 + len(parts))))
        self.base_ids.extend_parts(ids, self.base_at)

    def _simple_parts(self, words: list[str]) -> list[tuple[int, ...]]:
        ids, n = self._ids_of(words)
        return [tuple(x.tolist()) for x in np.split(ids, np.cumsum(n)[:-1])]

    def _ids_of(self, words: list[str], simple: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, and the number of each word's."""
        found = _SIMPLE.findall("\n".join(words).lower()) if simple else [("", "")] * len(words)
        bases = self.bases
        self._learn_bases([p for p in {p for pair in found for p in pair} if p not in bases])
        # two parts a word, its letters and its marks; words of another kind have none as yet
        part = np.fromiter((bases[p] for pair in found for p in pair), np.int64, 2 * len(words))
        odd = [i for i, pair in enumerate(found) if not pair[0]]
        at, ids = self.base_at.values, self.base_ids.values
        if odd:
            more, ends = _Grown(np.uint32, ids), _Grown(np.int64, at)
            more.extend_parts(self._whole_parts([words[i] for i in odd]), ends)
            part[2 * np.array(odd)] = np.arange(len(at) - 1, len(at) - 1 + len(odd))
            at, ids = ends.values, more.values
        n = at[part + 1] - at[part]
        return ids[_runs(at[part], n)], n[::2] + n[1::2]

    def _learn(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Places of words that are not remembered, by their first byte and length."""
        own = data[_runs(starts, size)]
        raw, end = own.tobytes(), np.cumsum(size).tolist()
        words = [raw[a:b].decode() for a, b in zip([0, *end], end)]
        ids, n = self._ids_of(words, self.simple)
        first = len(self.ids_at.values) - 1
        self.ids_at.extend(self.ids_at.values[-1] + np.cumsum(n))
        self.ids.extend(ids)
        self.bytes_at.extend(self.bytes_at.values[-1] + np.cumsum(size))
        self.bytes.extend(own)
        return np.arange(first, first + len(words))

    def _equal(self, text: np.ndarray, starts: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the words are those remembered at the places."""
        at, known = self.bytes_at.values, _eights(self.bytes.values)
        equal = at[place + 1] - at[place] == size
        todo, k = np.flatnonzero(equal), 0
        while len(todo):
            unused = np.maximum(8 - (size[todo] - k), 0).astype(_U) * _U(8)
            same = (text[starts[todo] + k] << unused) == (known[at[place[todo]] + k] << unused)
            equal[todo[~same]] = False
            k += 8
            todo = todo[same & (size[todo] > k)]
        return equal

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For some texts at a time: the first one's row, all ids with an end id after
        each text, and the number of each text's ids."""
        for chunk in chunks(column):
            if len(self.ids_at.values) > CACHED_WORDS or len(self.ids.values) > 16 * CACHED_WORDS:
                self._renew()
            starts, size, h = chunk.starts, chunk.ends - chunk.starts, chunk.word_hashes()
            text = _eights(chunk.data)
            place = self.table.find(h).astype(np.int64)
            known = np.flatnonzero(place >= 0)
            clash = known[~self._equal(text, starts[known], size[known], place[known])]
            new = np.flatnonzero((place < 0) & (size <= MAX_CACHED))
            keys, first, of = np.unique(h[new], return_index=True, return_inverse=True)
            if len(new):
                learnt = self._learn(chunk.data, starts[new[first]], size[new[first]])
                room = max(0, 2 * CACHED_WORDS - int(learnt[0]))  # one very long text may have more words than the memory
                self.table.add(keys[:room], learnt[:room].astype(np.int32))
                place[new] = learnt[of]
                clash = np.append(clash, new[~self._equal(text, starts[new], size[new], place[new])])
            alone = np.append(clash, np.flatnonzero((place < 0) & (size > MAX_CACHED)))  # other words of a known hash, and very long ones
            if len(alone):
                place[alone] = self._learn(chunk.data, starts[alone], size[alone])
            place = np.insert(place, chunk.word_at[1:], 0)
            at = self.ids_at.values
            n = at[place + 1] - at[place]
            ends = np.cumsum(n)[chunk.word_at[1:] + np.arange(chunk.docs)]
            yield chunk.row, self.ids.values[_runs(at[place], n)], np.diff(ends, prepend=0)


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to ``2**scale``; every id that occurs keeps one at least."""
    total = counts.sum()
    if not total:
        return np.zeros(len(counts), np.int64)
    if np.count_nonzero(counts) > 1 << scale:
        raise ValueError(f"more than 2**{scale} ids")
    freq = np.where(counts > 0, np.maximum(1, counts * float(1 << scale) / total).astype(np.int64), 0)
    over = int(freq.sum()) - (1 << scale)
    for i in np.argsort(-freq, kind="stable"):
        if over == 0:
            break
        give = over if over < 0 else min(over, int(freq[i]) - 1)
        freq[i] -= give
        over -= give
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(_U)
        self.before = (np.cumsum(freq) - freq).astype(_U)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(states, words) of each block of ids."""
        size = np.array([len(b) for b in blocks])
        steps = -(-int(size.max()) // LANES)
        ids = np.zeros((steps, len(blocks), LANES), np.uint32)
        live = np.zeros(ids.shape, bool)
        for g, b in enumerate(blocks):
            own = -(-len(b) // LANES)
            flat = np.zeros(own * LANES, np.uint32)
            flat[: len(b)] = b
            ids[:own, g] = flat.reshape(own, LANES)
            live[:own, g] = (np.arange(own * LANES) < len(b)).reshape(own, LANES)
        x = np.full((len(blocks), LANES), _LOW)
        given, words = np.zeros(ids.shape, bool), np.zeros(ids.shape, np.uint32)
        for t in range(steps - 1, -1, -1):
            f, c, on = self.freq[ids[t]], self.before[ids[t]], live[t]
            f = np.where(on, f, _U(1))
            spill = on & (x >= f << _U(31 - SCALE + 32))
            given[t] = spill
            words[t] = x.astype(np.uint32)
            x = np.where(spill, x >> _U(32), x)
            whole = x // f
            x = np.where(on, (whole << _U(SCALE)) + (x - whole * f) + c, x)
        return [(x[g], words[:, g][given[:, g]]) for g in range(len(blocks))]

    def decode(self, blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Ids of each (size, states, words)."""
        size = np.array([n for n, _, _ in blocks])
        steps = -(-int(size.max()) // LANES)
        x = np.stack([s for _, s, _ in blocks])
        words = np.concatenate([w for _, _, w in blocks] + [np.zeros(1, np.uint32)]).astype(_U)
        lengths = np.array([len(w) for _, _, w in blocks])
        at = np.cumsum(lengths) - lengths
        out = np.zeros((steps, len(blocks), LANES), np.uint32)
        lane = np.arange(LANES)
        for t in range(steps):
            on = t * LANES + lane < size[:, None]
            low = x & _MASK
            s = self.symbol[low]
            y = self.freq[s] * (x >> _U(SCALE)) + low - self.before[s]
            need = on & (y < _LOW)
            place = at[:, None] + np.cumsum(need, 1) - 1
            y = np.where(need, (y << _U(32)) | words[np.where(need, place, len(words) - 1)], y)
            at += need.sum(1)
            x = np.where(on, y, x)
            out[t] = s
        return [out[:, g].reshape(-1)[:n] for g, n in enumerate(size)]


_SEGMENT = "part int, segment int, n_tokens long, table binary, blocks array<struct<docs:array<long>,lengths:array<int>,continued:boolean,states:binary,words:binary,crc32:long>>"
_BLOCKS = pa.list_(pa.struct([("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("continued", pa.bool_()), ("states", pa.binary()), ("words", pa.binary()), ("crc32", pa.int64())]))
_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("table", pa.binary()), ("blocks", _BLOCKS)])
_TOGETHER = 64  # blocks in one numpy operation


class _Block:
    """Ids of documents, the first of which may have begun in the block before."""

    def __init__(self, continued: bool = False):
        self.docs, self.lengths, self.ids, self.size, self.continued = [], [], [], 0, continued

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.ids.append(ids)
        self.size += len(ids)


def _laid(blocks: list[_Block], doc, ids: np.ndarray) -> None:
    """Add a document to the last block, and what goes beyond ``BLOCK_TOKENS`` to new ones."""
    begun = False
    while True:
        if blocks[-1].size >= BLOCK_TOKENS:
            blocks.append(_Block(continued=begun))
        room = BLOCK_TOKENS - blocks[-1].size
        blocks[-1].add(doc, ids[:room])
        ids, begun = ids[room:], True
        if not len(ids):
            return


def _segment(part: int, number: int, blocks: list[_Block]) -> pa.RecordBatch:
    ids = [np.concatenate(b.ids) for b in blocks]
    counts = np.bincount(np.concatenate(ids))
    freq = scaled(counts)
    coder, out = Coder(freq), []
    for lo in range(0, len(blocks), _TOGETHER):
        for block, (states, words) in zip(blocks[lo : lo + _TOGETHER], coder.encode(ids[lo : lo + _TOGETHER])):
            states, words = states.astype("<u8").tobytes(), words.astype("<u4").tobytes()
            out.append({"docs": block.docs, "lengths": block.lengths, "continued": block.continued, "states": states, "words": words, "crc32": zlib.crc32(words, zlib.crc32(states))})
    row = {"part": part, "segment": number, "n_tokens": int(counts.sum()), "table": zlib.compress(freq.astype("<u4").tobytes()), "blocks": out}
    return pa.RecordBatch.from_pylist([row], _ARROW)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Encode all documents in ascending id order into ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.load(tokenizer_path, end_id)
        part, number, blocks, size = 0, 0, [_Block()], 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for row, ids, n in tokenizer.encode(batch.column(1)):
                end = np.cumsum(n)
                for doc, a, b in zip(batch.column(0).slice(row, len(n)).to_pylist(), (end - n).tolist(), end.tolist()):
                    _laid(blocks, doc, ids[a:b])
                    size += b - a
                    if size >= segment_tokens:
                        yield _segment(part, number, blocks)
                        number, blocks, size = number + 1, [_Block()], 0
        if size:
            yield _segment(part, number, blocks)

    # the range bounds are sampled by the driver, so the texts themselves are no part of them
    order = (id_col, F.xxhash64(text_col))
    ordered = docs.select(id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order, text_col)
    ordered.withColumn("__part", F.spark_partition_id()).mapInArrow(encode, _SEGMENT).write.parquet(path)


def read_ids(spark: SparkSession, path: str, columns: str, document: Callable[[np.ndarray], tuple]) -> DataFrame:
    """Decode the blocks of ``path``, each on its own. A row a document: ``doc_id,
    start`` (ids of all documents before it), ``n_tokens``, and ``columns``, which
    ``document`` makes of its ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = batch.slice(row, 1).to_pylist()[0]
                coder = Coder(np.frombuffer(zlib.decompress(segment["table"]), "<u4").astype(np.int64))
                blocks, found = segment["blocks"], []
                for b in blocks:
                    if zlib.crc32(b["words"], zlib.crc32(b["states"])) != b["crc32"]:
                        raise ValueError(f"a block of segment {segment['segment']} of partition {segment['part']} is damaged")
                for lo in range(0, len(blocks), _TOGETHER):
                    parts = [(sum(b["lengths"]), np.frombuffer(b["states"], "<u8"), np.frombuffer(b["words"], "<u4")) for b in blocks[lo : lo + _TOGETHER]]
                    found += coder.decode(parts)
                whole = []  # documents and the pieces of their ids
                for b, ids in zip(blocks, found):
                    for i, (doc, own) in enumerate(zip(b["docs"], np.split(ids, np.cumsum(b["lengths"])[:-1]))):
                        if i == 0 and b["continued"]:
                            whole[-1][1].append(own)
                        else:
                            whole.append((doc, [own]))
                at, out = segment["__start"], []
                for doc, pieces in whole:
                    own = np.concatenate(pieces)
                    out.append((doc, at, len(own), *document(own)))
                    at += len(own)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    segments = spark.read.schema(_SEGMENT).parquet(path)
    sizes = segments.select("part", "segment", "n_tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("__own"))
    starts = starts.join(parts, "part").select("part", "segment", (F.col("__before") + F.col("__own")).alias("__start"))
    schema = f"doc_id long, start long, n_tokens long, {columns}"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]
    return segments.join(F.broadcast(starts), ["part", "segment"]).mapInArrow(decode, schema)  # a row for each SEGMENT_TOKENS ids


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write all documents, read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, tokenizer_path, end_id)
    return read_ids(docs.sparkSession, path, "ids_crc32 long", lambda ids: (zlib.crc32(ids.astype("<u4").tobytes()),))
