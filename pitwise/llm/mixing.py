"""Mixing sources to target weights over fixed-length blocks of tokens.

Each source's documents, in ``(id, text)`` order, form one stream of words that is
cut into blocks of ``block_tokens`` (the last may be shorter). The mix is a sequence
of *slots* that each take one block of a source. A source has as many slots as its
target needs; how many of them fall to each output shard is one multinomial draw,
and its slots, numbered through the shards, are mapped to blocks by a pseudorandom
permutation (a Feistel network) of the block numbers that changes with every round
through the source. The short last block closes each round, and the last slot takes
only the words that the target still lacks, so every source meets its target to
within a word, and no word is taken more often than ``cap`` times. Slots and
documents then meet in an equi-join on (source, block).

Targets: shares by weight of all words; a target stops at ``cap`` times its source,
the excess being shared out again by weight until none is above (solved at once by
sorting sources by cap over weight). Draws depend on the seed and the source's name
alone, so reruns agree.

Defined results: a null text has no words and is never taken; a null source is a
source of its own, last in order; rows equal in id and text are interchangeable;
with no words at all every target is 0; no rows give none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import let
from .sharding import with_offsets
from .words import chunks

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_TOKENS = 512
SHARD_TOKENS = 1 << 22
SLOTS_A_TASK = 1 << 16
SEED = 20240229


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``size``, its number of words."""
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for chunk in chunks(batch.column(len(kept))):
                n[chunk.row : chunk.row + chunk.docs] = chunk.n_words
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(n)], names=[*kept, "size"])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("size", T.LongType())])
    return docs.select(*kept, text_col).mapInArrow(run, schema)


def permuted(i: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)`` at the places ``i``: a Feistel
    network on the smallest even number of bits that hold ``n``, walked until it
    falls below ``n``."""
    half = np.uint64(max(1, -(-int(n - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.Generator(np.random.Philox(key)).integers(0, 1 << 63, rounds, np.uint64)
    out = i.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32) & mask)
        out[todo] = left << half | right
        todo[todo] = out[todo] >= n
    return out.astype(np.int64)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size`` to those and ``target``; one row a source, so its
    windows see as many rows as there are sources."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    filled = Window.partitionBy(F.lit(0)).orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int")))
    t = t.withColumn("limit", F.col("source_size") * float(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(filled), F.lit(0.0))
    among = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filled), F.lit(0.0))
    t = t.withColumn("level", left / among)
    # below this level nobody stops: the first source, by cap over weight, that the level does not reach
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    return t.select("source", "source_size", F.least(F.col("limit"), level * F.col("weight")).alias("target"))


_SLOTS = "source string, shard long, slot long, round long, block long, take long"


def mix_slots(targets: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """``source, shard, slot, round, block, take``: the slots of the mix."""

    def plan(name, size, target):
        """Number of blocks and of slots, and the words that the last slot takes."""
        blocks = -(-size // block_tokens)
        rounds, rest = divmod(int(np.floor(target + 0.5)), size)
        full, last = divmod(rest, block_tokens)
        return blocks, rounds * blocks + full + (last > 0), last

    def key(name, *more):
        return zlib.crc32(f"{seed}/{'n' if name is None else 's' + name}/{'/'.join(map(str, more))}".encode())

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, size, target, total in zip(f.source, f.source_size, f.target, f.total):
                if not size:
                    continue
                blocks, slots, last = plan(name, size, target)
                shards = max(1, -(-int(total) // shard_tokens))
                rng = np.random.Generator(np.random.Philox(key(name, "shards")))
                counts = rng.multinomial(slots, np.full(shards, 1 / shards))
                first = np.cumsum(counts) - counts
                for lo in range(0, shards, 1 << 16):
                    own = slice(lo, lo + (1 << 16))
                    yield pd.DataFrame({"source": name, "source_size": size, "target": target, "shard": np.arange(shards)[own], "first": first[own], "count": counts[own]})

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, size, target, shard, first, count in zip(f.source, f.source_size, f.target, f.shard, f["first"], f["count"]):
                blocks, slots, last = plan(name, size, target)
                whole = size // block_tokens
                j = np.arange(first, first + count)
                round_, i = j // blocks, j % blocks
                block = i.copy()
                for r in np.unique(round_):
                    at = (round_ == r) & (i < whole)
                    block[at] = permuted(i[at], whole, key(name, "round", r))
                take = np.where(block < whole, block_tokens, size - whole * block_tokens)
                if last:
                    take[j == slots - 1] = last
                yield pd.DataFrame({"source": name, "shard": shard, "slot": j - first, "round": round_, "block": block, "take": take})

    expected = targets.agg(F.sum(F.ceil(F.col("target") / block_tokens))).first()[0] or 0
    t = targets.withColumn("total", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    drawn = t.mapInPandas(draw, "source string, source_size long, target double, shard long, first long, count long")
    return drawn.repartition(-(-int(expected) // SLOTS_A_TASK) or 1, "source", "shard").mapInPandas(fill, _SLOTS)


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS,
    seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Two tables. Documents: ``doc_id, source, text_hash, idx`` (the row's number),
    ``size, source_size, target``. Pieces: ``idx, shard, slot, round, from_word,
    to_word``, what each slot takes of each document."""
    rows = count_words(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")))
    # a source's rows follow each other, so the words before it are the same for all of them
    placed = with_offsets(rows, ["source", "doc_id", "text_hash"], {"at": F.col("size")}, "mixing")
    name = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("at").alias("base"))
    targets = source_targets(sizes.select("source", "source_size"), weights, cap)
    table = targets.join(sizes.select(F.col("source").alias("__s"), "base"), F.col("source").eqNullSafe(F.col("__s")))
    known = placed.withColumn("name", name).join(table.withColumn("name", name).select("name", "source_size", "target", "base"), "name")
    known = known.withColumn("at", F.col("at") - F.col("base"))
    lo, hi = F.expr(f"at div {block_tokens}"), F.expr(f"(at + size - 1) div {block_tokens}")
    parts = known.filter("size > 0").select("name", "idx", "at", "size", F.explode(F.sequence(lo, hi)).alias("block"))
    slots = mix_slots(targets, block_tokens, shard_tokens, seed).withColumn("name", name).drop("source")
    start = F.col("block") * block_tokens
    pieces = parts.join(slots.hint("merge"), ["name", "block"]).select(  # both grow with the corpus
        "idx", "shard", "slot", "round",
        F.greatest(F.lit(0), start - F.col("at")).alias("from_word"),
        F.least(F.col("size"), start + F.col("take") - F.col("at")).alias("to_word"),
    ).filter("from_word < to_word")
    return known.select("doc_id", "source", "text_hash", "idx", "size", "source_size", "target"), pieces


def words_taken(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source`` for each document."""
    known, pieces = mix_sources(docs, **options)
    taken = pieces.groupBy("idx").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return known.join(taken, "idx", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: for each round through its
    source, a row with the words taken of a document in it, joined by one space, and
    ``n_chars``, if there is such a column, set anew. A document that a round takes
    whole keeps its text. Documents of which nothing is taken are left out. Rows equal
    in id, source and text are taken each for itself but share their other columns."""
    known, pieces = mix_sources(docs, **options)
    ranges = pieces.groupBy("idx", "round").agg(F.array_sort(F.collect_list(F.struct("from_word", "to_word"))).alias("__ranges"))

    def key(text_hash):
        return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", text_hash)

    taken = known.join(ranges, "idx").select(key("text_hash").alias("__key"), F.col("size").alias("__size"), "__ranges")
    again = F.lag(F.lit(1)).over(Window.partitionBy("__key").orderBy("__key"))  # of rows equal in id, source and text one stays
    once = docs.withColumn("__key", key(F.xxhash64("text"))).withColumn("__again", again).filter("__again is null")
    joined = once.withColumnRenamed("text", "__text").join(taken, "__key")

    def chosen(words):
        return F.flatten(F.transform("__ranges", lambda r: F.slice(words, (r["from_word"] + 1).cast("int"), (r["to_word"] - r["from_word"]).cast("int"))))

    words = F.filter(F.split(F.regexp_replace("__text", r"[ \t-\r]+", " "), " "), lambda x: x != "")
    got = F.aggregate("__ranges", F.lit(0).cast("long"), lambda a, r: a + r["to_word"] - r["from_word"])
    mixed = joined.withColumn("text", F.when(got == F.col("__size"), F.col("__text")).otherwise(F.concat_ws(" ", let(words, chosen))))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)
