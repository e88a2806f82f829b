"""Importance resampling towards a target distribution, over hashed n-grams.

Words are laid out in a *position table* (``posexplode``), a row a word; the window
function ``lead`` over a document's positions puts the words that follow beside each, so
a row has its n-gram of every order; those are hashed to buckets and written, three small
integers a word. Documents are dealt out once, by a key of id, text and input partition,
and sorted before they are taken apart, so the window needs no further exchange and its
sort meets rows in order. Bucket counts of documents and target give each bucket's
*gain*, the log of the ratio of its smoothed shares; gains (``buckets`` rows at most) are
joined to the table and summed by document. Documents of at least ``min_words`` words
compete for ``percent`` of their number by weight plus Gumbel noise, a hash of seed and
id, which draws without replacement in proportion to the exponential of the weight;
places come from range partitions and prefix sums, not from one sort.

Defined results: a null text has no features and weight 0, like a text without words; a
null id has the noise of the seed alone and comes last among equals; rows equal in all
those columns take neighbouring places in either order; repeated rows each compete; a text
of any length is read whole, its words lying in one task; an empty target has no counts
(its smoothed shares are equal); no rows give none; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, forget
from .sharding import with_offsets

ORDERS = 3
BUCKETS = 10_000
MAX_BUCKETS = 1_000_000  # gains are broadcast
MIN_WORDS = 20
PERCENT = 5
SEED = 42

#: Fixed value: what lies between words, after A-Z are lower-cased.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ngram_buckets(docs: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The position table: ``row, id, b1 .. b<orders>``, a row a word (one without buckets
    where a text has no words); ``row`` tells rows of ``docs`` apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.spark_partition_id().alias("part")).withColumn("k", F.xxhash64("id", "text", "part"))
    # rows of one key are equal, so their numbers are the same whenever the partition is made anew
    placed = keyed.select("k", "id", "text").repartition("k").sortWithinPartitions("k").withColumn("row", F.monotonically_increasing_id())
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = placed.select("k", "row", "id", F.posexplode(F.split(folded, _BETWEEN)).alias("pos", "word"))
    # before the first word and after the last there may be an empty one; one at place 0 stands for its document
    words = words.select("k", "row", "id", "pos", F.nullif("word", F.lit("")).alias("w1")).filter("pos = 0 or w1 is not null")
    along = Window.partitionBy("k", "row").orderBy("pos")
    followed = words.select("row", "id", "w1", *[F.lead("w1", n - 1).over(along).alias(f"w{n}") for n in range(2, orders + 1)])

    def bucket(n: int) -> Column:
        gram = F.col("w1")
        for i in range(2, n + 1):
            gram = F.concat(gram, F.lit(" "), F.col(f"w{i}"))  # null where the text ends before
        return (F.crc32(gram.cast("binary")) % buckets).cast("int")

    return followed.select("row", "id", *[bucket(n).alias(f"b{n}") for n in range(1, orders + 1)])


def _unpivoted(table: DataFrame, orders: int, *ids: str) -> DataFrame:
    return table.unpivot(list(ids), [f"b{n}" for n in range(1, orders + 1)], "order", "bucket").filter("bucket is not null")


def bucket_gains(table: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of the buckets that occur in ``table``."""
    if buckets > MAX_BUCKETS:
        raise ValueError(f"more than {MAX_BUCKETS} buckets")
    s = cut(_unpivoted(table, orders).groupBy("bucket").agg(F.count("*").alias("s")), "counts")
    t = cut(_unpivoted(target, orders).groupBy("bucket").agg(F.count("*").alias("t")), "target-counts")
    all_s, all_t = (float((x.agg(F.sum(c)).first()[0] or 0) + buckets) for x, c in ((s, "s"), (t, "t")))
    share = (F.coalesce("t", F.lit(0)) + 1).cast("double") * all_s / ((F.col("s") + 1).cast("double") * all_t)
    made = cut(s.join(t, "bucket", "left").select("bucket", F.floor(1000 * F.log(share)).alias("gain")), "gains")
    forget(s, t)
    return made


def noise(id_: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """A row for each document: its id, ``n_features``, ``weight``, ``score`` and ``rank``
    (from 1; null if it is not drawn), and ``n_words``."""
    table = cut(ngram_buckets(docs, orders, buckets, id_col, text_col), "positions")
    wanted = ngram_buckets(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), orders, buckets, "id", "text")
    gains = bucket_gains(table, wanted, orders, buckets)
    summed = (
        table.unpivot(["row", "id"], [f"b{n}" for n in range(1, orders + 1)], "order", "bucket")
        .join(F.broadcast(gains), "bucket", "left")  # MAX_BUCKETS rows at most
        .groupBy("row", "id")
        .agg(F.count("bucket").alias("n_features"), F.count(F.when(F.col("order") == "b1", F.col("bucket"))).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    )
    scored = cut(summed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "weights")
    forget(table, gains)
    entered = F.col("n_words") >= min_words
    ordered = scored.select("*", (~entered).alias("apart"), (-F.col("score")).alias("falling"), F.col("id").isNull().alias("unnamed"))
    placed = with_offsets(ordered, ["apart", "falling", "unnamed", "id", "row"], {"entered": entered.cast("long")}, "ranked")
    drawn = ~F.col("apart") & (F.col("idx") < F.expr(f"{percent} * total_entered div 100"))
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(drawn, F.col("idx") + 1).alias("rank"), "n_words")
