"""Jaccard self-join of shingle sets and its groups, by T-occurrence search.

A document's set is its distinct ``k``-word shingles (A-Z lower-cased words, 64-bit
hashes). Two sets link at Jaccard ``threshold`` or more; groups are the connected
components of the links.

1. *Classes.* Documents with equal sets are one class, named by a hash of the set, so
   copies never meet each other.
2. *Sketches.* Linked sets of sizes ``a <= b`` share ``T = ceil(threshold * b)``
   shingles, so the first ``n - T + l`` hashes of both, in hash order, share at least
   ``l``. A class keeps these entries with ``l`` some per cent of ``n``. An entry that no
   other class has is dropped, and so is a class with fewer than ``threshold * l``
   entries left, which no linked pair can have. A first sieve of 5 per cent is cheap and
   leaves near copies and documents that share passages; a second of 40 per cent, over
   what is left, keeps only those that share more than half of what they have.
3. *Clusters.* Classes that share an entry are joined to the least class of that
   entry's list (a star, not pairs), and the components of the stars are clusters:
   links lie inside them.
4. *T-occurrence search* in bounded tiles. A tile holds several small clusters, or two
   blocks of a large one whose sizes can link. For each query set the tile's inverted
   lists are divided (DivideSkip): the short ones are merged and counted, candidates
   that can still reach ``T`` are probed by binary search in the long ones, and pairs
   with the required overlap link. A tile gives off only links that join two groups
   for the first time there, so a group of any density yields no more links than sets.
   Where links are counted, every candidate is verified and a tile also gives off one
   number a set: the documents of the sets that it links with there. Two sets meet in
   one tile only, so the numbers add up, and no pairs are written. Lists that an eighth
   of a tile's sets are on lie as bitmaps there, and sets that could link by those alone
   are probed a block at a time, so groups of thousands of near copies stay cheap.
5. *Components* of the links name the groups.

Defined results: null texts and texts without words have no shingles, link with
nothing and are groups of their own; a text of fewer than ``k`` words is one shingle;
repeated rows each get a result; a null id is never the least of a group unless all
are null; no rows give none; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import cut, forget
from .words import chunks, mix, shingle_sets

K = 5
PERCENT = 80  # of the union
SIEVES = (5, 40)  # per cent
TILE_SHINGLES = 1 << 21
DENSE = 8  # a list that one in so many of the tile's sets is on lies as a bitmap
CELLS = 1 << 21  # of a block of bitmap counts


def _sets(docs: DataFrame, k: int, percent: int, what: str, more: int = 0) -> DataFrame:
    """The columns of ``docs`` (the text last) with, instead of the text, ``n``, ``sig``
    and, if asked for, ``entries`` (the sketch, ``more`` per cent over the least; of the equal
    sets of a task one has it, the others none) or the whole ``set``."""
    carried = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for chunk in chunks(batch.column(len(carried))):
                h, n = shingle_sets(chunk, k)
                first = np.cumsum(n) - n
                own = [batch.column(i).slice(chunk.row, chunk.docs) for i in range(len(carried))]
                if what != "set":
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h.view(np.uint64)))])
                    sig = mix(total[first + n] - total[first] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                    own += [pa.array(n), pa.array(sig, mask=n == 0)]
                if what != "sig":
                    size = n if what == "set" else np.minimum(n, n - -(-n * percent // 100) + np.maximum(1, n * more // 100))
                    if what == "entries":
                        size = np.where([s not in seen and not seen.add(s) for s in sig.tolist()], size, 0)
                    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    own.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(h[at])))
                yield pa.RecordBatch.from_arrays(own, names=names)

    added = {"sig": "n long, sig long", "entries": "n long, sig long, entries array<long>", "set": "set array<long>"}[what]
    names = [*carried, *(x.split()[0] for x in added.split(", "))]
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carried), added])
    return docs.mapInArrow(run, schema)


def _met(entries: DataFrame) -> DataFrame:
    """``h, sig, n``: the entries of ``entries`` lists that two classes or more have, each once."""
    each = entries.select("sig", "n", F.explode("entries").alias("h"))
    return _listed(each).select("h", "sig", "n").distinct()


def _enough(percent: int, more: int) -> Column:
    """Whether a class has as many shared entries as any linked pair shares."""
    return F.col("found") >= F.greatest(F.lit(1), F.expr(f"n * {more * percent} div 10000"))


def _clusters(texts: DataFrame, scanned: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``sig, n, cluster`` of the classes that may link with another; and the texts
    (``key, text``) that the first sieve left, one a class."""
    entries = _sets(texts.select("text"), k, percent, "entries", SIEVES[0])
    met = _met(entries)
    able = met.groupBy("sig", "n").agg(F.count("*").alias("found")).filter(_enough(percent, SIEVES[0])).select("sig")
    # the tables that pick texts grow with the corpus: they are merged, never broadcast
    some = cut(_documents(scanned, able.distinct()), "representatives")
    chosen = cut(texts.join(some.select("key").hint("merge"), "key").select("key", "text"), "chosen")
    entries = _sets(chosen.select("text"), k, percent, "entries", SIEVES[1])
    met = _met(entries)
    left = met.withColumn("found", F.count("*").over(Window.partitionBy("sig", "n"))).filter(_enough(percent, SIEVES[1]))
    stars = cut(_listed(left).select("sig", "n", "hub"), "stars")
    forget(some)
    named = components(stars.filter("sig <> hub").select(F.col("sig").alias("u"), F.col("hub").alias("v")))
    named = named.withColumnRenamed("node", "sig").withColumnRenamed("component", "cluster")
    clusters = cut(stars.select("sig", "n").distinct().join(named, "sig"), "clusters")
    forget(stars)
    return clusters, chosen


def _documents(scanned: DataFrame, classes: DataFrame) -> DataFrame:
    """``sig, key, docs``: a document of each class, and how many it has."""
    return scanned.join(classes, "sig").groupBy("sig").agg(F.min("key").alias("key"), F.count("*").alias("docs"))


def _listed(entries: DataFrame) -> DataFrame:
    """The entries whose list has two classes or more, with the list's least, ``hub``. Entries
    are dealt out by list once: their least and greatest class are read where they lie."""
    whole = Window.partitionBy("h")
    ends = entries.withColumns({"hub": F.min("sig").over(whole), "last": F.max("sig").over(whole)})
    return ends.filter("hub <> last").select("h", "sig", "n", "hub")


def _tiles(classes: DataFrame, tile_shingles: int) -> DataFrame:
    """``sig, tile, side``: where each class is searched. ``side`` 0 and 1 meet only
    each other; 2 meets all of its tile."""
    total = classes.groupBy("cluster").agg(F.sum("n").alias("total"))
    small = F.col("total") <= tile_shingles
    buckets = F.greatest(F.lit(1), F.expr(f"all_small div {tile_shingles} + 1"))
    volume = total.filter(small).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("all_small"))  # one row
    packed = classes.join(total.filter(small), "cluster").join(F.broadcast(volume)).select("sig", F.concat(F.lit("b"), F.pmod(F.xxhash64("cluster"), buckets)).alias("tile"), F.lit(2).alias("side"))
    # sets that link differ in size by a factor of 1.25 at most, so their steps are equal or neighbours
    step = F.floor(F.log("n") / F.log(F.lit(1.25)) + 1e-9).cast("int")
    large = classes.join(total.filter(~small), "cluster").withColumn("step", step)
    blocks = large.groupBy("cluster", "step").agg(F.expr(f"sum(n) div {max(1, tile_shingles // 2)} + 1").alias("blocks"))
    count = blocks.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("step", "blocks"))).alias("blocks"))  # a row for each 25 per cent of size
    large = large.join(count, "cluster").withColumn("block", F.pmod(F.xxhash64("sig"), F.element_at("blocks", F.col("step"))))

    def upto(at):
        return F.sequence(F.lit(0).cast("long"), F.coalesce(F.try_element_at("blocks", at), F.lit(0)) - 1)

    def others(at, tile):
        some = F.coalesce(F.try_element_at("blocks", at), F.lit(0)) > 0
        return F.when(some, F.transform(upto(at), tile)).otherwise(F.array().cast("array<struct<tile:string,side:int>>"))

    def named(s1, b1, s2, b2, side):
        return F.struct(F.concat_ws("/", "cluster", s1, b1, s2, b2).alias("tile"), side.cast("int").alias("side"))

    s, b = F.col("step"), F.col("block")
    same = others(s, lambda o: named(s, F.least(b, o), s, F.greatest(b, o), F.when(o == b, 2).when(b < o, 0).otherwise(1)))
    up = others(s + 1, lambda o: named(s, b, s + 1, o, F.lit(0)))
    down = others(s - 1, lambda o: named(s - 1, o, s, b, F.lit(1)))
    spread = large.select("sig", F.explode(F.concat(same, up, down)).alias("t")).select("sig", "t.tile", "t.side")
    return packed.unionByName(spread)


def merged_counts(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of ascending lists, one after another, and how many lists hold each. The
    stable sort finds the ascending runs and merges them, as a heap over the lists would."""
    merged = np.sort(lists, kind="stable")
    first = np.flatnonzero(np.diff(merged, prepend=-1))
    return merged[first], np.diff(first, append=len(merged))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of some slices, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def _bitmap_links(
    rows: np.ndarray, sizes: np.ndarray, sides: np.ndarray, own: np.ndarray, first: np.ndarray, postings: np.ndarray, starts: np.ndarray, dense: np.ndarray, percent: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of ``rows``: the pairs ``x, y`` (places, ``x < y``) that link. Lists in
    ``dense`` are probed as bitmaps, a block of sets against all later ones at once; the
    others are merged and counted. ``own`` has the lists of each set, from ``first`` on."""
    count, lengths = len(sizes), np.diff(starts)
    held = _ranges(starts[:-1][dense], lengths[dense])
    bits = np.zeros((count, int(dense.sum())), np.float32)  # counts stay far below 2 ** 24
    bits[postings[held], np.repeat(np.arange(bits.shape[1]), lengths[dense])] = 1
    sparse = np.where(dense | (lengths < 2), 0, lengths)
    volume = np.array([sparse[own[first[x] : first[x] + sizes[x]]].sum() for x in rows])
    block = np.cumsum(np.maximum(volume, count)) // CELLS
    for some in np.split(rows, np.flatnonzero(np.diff(block)) + 1):
        low, high = int(some[0]), int(np.searchsorted(sizes, int(sizes[some[-1]]) * 100 // percent, "right"))
        shared = (bits[some] @ bits[low:high].T).astype(np.int64)
        lists = own[_ranges(first[some], sizes[some])]
        at = np.repeat(np.arange(len(some)), sizes[some])
        at, lists = at[sparse[lists] > 0], lists[sparse[lists] > 0]
        met = postings[_ranges(starts[lists], lengths[lists])]
        at = np.repeat(at, lengths[lists])
        within = (met >= low) & (met < high)
        shared += np.bincount(at[within] * (high - low) + met[within] - low, minlength=shared.size).reshape(shared.shape)
        near = 100 * shared >= percent * (sizes[some][:, None] + sizes[low:high] - shared)
        near &= (np.arange(low, high) > some[:, None]) & ((sides[low:high] != sides[some][:, None]) | (sides[low:high] == 2))
        x, y = np.nonzero(near)
        yield some[x], low + y


def t_occurrence_links(
    sig: np.ndarray, side: np.ndarray, n: np.ndarray, values: np.ndarray, percent: int = PERCENT, docs: np.ndarray | None = None
) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join the groups of some sets, with each set's values ascending; and,
    if the sets' ``docs`` are given, how many documents each set links with (else 0). A
    set whose long lists alone may reach the overlap has nothing to merge that would thin
    its candidates: where links are counted, such sets are probed in blocks."""
    first = np.cumsum(n) - n
    order = np.lexsort((sig, n))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    sizes, sides = n[order], side[order]
    # inverted lists: places, ascending, of the sets that hold each value
    owner = np.repeat(place, n)
    by = np.lexsort((owner, values))
    postings, keys = owner[by], values[by]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.append(np.flatnonzero(new), len(keys))
    list_of = np.empty(len(values), np.int64)
    list_of[by] = np.cumsum(new) - 1
    lengths = np.diff(starts)
    flat = (np.cumsum(new) - 1) * len(order) + postings  # ascending
    group = np.arange(len(order))
    held = None if docs is None else docs[order]
    count = np.zeros(len(order), np.int64)

    def root(i):
        while group[i] != i:
            group[i] = i = group[group[i]]
        return i

    def join(x, near):
        for y in near[group[near] != root(x)]:
            a, b = root(x), root(y)
            if a != b:
                group[max(a, b)] = min(a, b)
                links.append((int(sig[order[x]]), int(sig[order[y]])))

    links = []
    todo = np.arange(len(order))
    if held is not None:
        dense = (lengths > 1) & (lengths * DENSE >= len(order))
        on = np.bincount(owner, weights=dense[list_of], minlength=len(order))
        able = on >= -(-sizes * percent // 100)
        for x, y in _bitmap_links(todo[able], sizes, sides, list_of, first[order], postings, starts, dense, percent) if able.any() else ():
            count += np.bincount(x, held[y], len(order)).astype(np.int64) + np.bincount(y, held[x], len(order)).astype(np.int64)
            for one in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1) if len(x) else ():
                join(x[one[0]], y[one])
        todo = todo[~able]
    for x in todo:
        d = order[x]
        own = list_of[first[d] : first[d] + n[d]]
        own = own[lengths[own] > 1]
        t = -(-int(n[d]) * percent // 100)  # candidates are no smaller
        if len(own) < t:
            continue
        own = own[np.argsort(lengths[own], kind="stable")]
        longest = int(lengths[own[-1]])
        long = min(t - 1, int(t / (0.01 * np.log2(longest + 1) + 1)))
        short, long_lists = own[: len(own) - long], own[len(own) - long :]
        last = np.searchsorted(sizes, int(n[d]) * 100 // percent, "right")
        merged = np.concatenate([postings[starts[i] : starts[i + 1]] for i in short])
        found, shared = merged_counts(merged[(merged > x) & (merged < last)])
        able = (shared >= t - long) & ((sides[found] != sides[x]) | (sides[found] == 2))
        found, shared = found[able], shared[able]
        if len(found) and held is None:
            mine = root(x)
            apart = np.array([root(y) != mine for y in found])
            found, shared = found[apart], shared[apart]
        if not len(found):
            continue
        if 4 * len(found) * long < lengths[long_lists].sum():
            probes = (long_lists[:, None] * len(order) + found).ravel()
            at = np.minimum(np.searchsorted(flat, probes), len(flat) - 1)
            shared = shared + (flat[at] == probes).reshape(long, -1).sum(axis=0)
        elif long:  # as many candidates as postings: these are counted too
            whole = np.concatenate([postings[starts[i] : starts[i + 1]] for i in long_lists])
            shared = shared + np.bincount(whole, minlength=len(order))[found]
        near = found[100 * shared >= percent * (sizes[x] + sizes[found] - shared)]
        if held is not None:
            count[x] += held[near].sum()
            count[near] += held[x]
        join(x, near)
    return links, count[place]


def _search(table: pa.Table, percent: int, counted: bool) -> pa.Table:
    """``u, v``: links that join groups; and ``u, links`` for each set, if counted."""
    sets = table.column("set").combine_chunks()
    sig, side = (table.column(c).to_numpy() for c in ("sig", "side"))
    n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = sets.flatten().to_numpy(zero_copy_only=False)
    _, once = np.unique(sig, return_index=True)  # repeated rows of the class's document
    once.sort()
    keep = np.zeros(len(sig), bool)
    keep[once] = True
    docs = table.column("docs").to_numpy()[once] if counted else None
    links, count = t_occurrence_links(sig[once], side[once], n[once], values[np.repeat(keep, n)], percent, docs)
    u, v = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
    joined = pa.table({"u": u, "v": v, "links": pa.nulls(len(u), pa.int64())})
    some = np.flatnonzero(count)
    return pa.concat_tables([joined, pa.table({"u": sig[once][some], "v": pa.nulls(len(some), pa.int64()), "links": count[some]})])


def _grouped(docs: DataFrame, k: int, percent: int, tile_shingles: int, counted: bool = False) -> DataFrame:
    """``key, doc_id, n, group``: ``group`` is null for documents without shingles; and
    ``links``, if counted. ``docs`` has ``key, doc_id, text``."""
    texts = docs.select("key", "text")
    scanned = cut(_sets(texts, k, percent, "sig"), "classes")
    classes, chosen = _clusters(texts, scanned, k, percent)
    where = _tiles(classes, tile_shingles).groupBy("sig").agg(F.collect_list(F.struct("tile", "side")).alias("tiles"))
    one = cut(_documents(scanned, classes.select("sig")).join(where, "sig"), "tiles")
    near = chosen.join(one.hint("merge"), "key").select("sig", "docs", "tiles", "text")
    sets = _sets(near, k, percent, "set").select("sig", "docs", "set", F.explode("tiles").alias("t")).select("sig", "docs", "set", "t.tile", "t.side")
    tiles = sets.groupBy("tile").applyInArrow(lambda tile: _search(tile, percent, counted), "u long, v long, links long")
    if counted:
        tiles = cut(tiles, "links")
    groups = components(tiles.filter("v is not null")).withColumnRenamed("node", "sig")  # done here, so what led to it can go
    forget(classes, one, chosen)
    if counted:  # the other documents of a class, and those of the classes that it links with
        copies = scanned.filter("sig is not null").groupBy("sig").agg((F.count("*") - 1).alias("links")).filter("links > 0")
        linked = copies.unionByName(tiles.filter("v is null").select(F.col("u").alias("sig"), "links")).withColumn("component", F.lit(None).cast("long"))
        groups = linked.unionByName(groups.withColumn("links", F.lit(0).cast("long"))).groupBy("sig").agg(F.max("component").alias("component"), F.sum("links").alias("links"))
    named = scanned.select("key", "n", "sig").distinct().join(groups, "sig", "left")
    more = [F.coalesce("links", F.lit(0).cast("long")).alias("links")] if counted else []
    return docs.select("key", "doc_id").join(named.select("key", "n", F.coalesce("component", "sig").alias("group"), *more), "key")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Equal keys: equal ids and texts."""
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    return docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def near_duplicate_groups(
    docs: DataFrame, k: int = K, percent: int = PERCENT, tile_shingles: int = TILE_SHINGLES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each document; ``component_id`` is the
    least id of its group."""
    return near_duplicate_links(docs, k, percent, tile_shingles, id_col, text_col, counted=False)


def near_duplicate_links(
    docs: DataFrame, k: int = K, percent: int = PERCENT, tile_shingles: int = TILE_SHINGLES, id_col: str = "doc_id", text_col: str = "text", counted: bool = True
) -> DataFrame:
    """The columns of ``near_duplicate_groups`` and ``n_links``, the number of other
    documents (rows) that link with the document, copies among them."""
    grouped = _grouped(_keyed(docs, id_col, text_col), k, percent, tile_shingles, counted)
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("component_id")).filter("group is not null")
    more = [F.col("links").alias("n_links")] if counted else []
    return grouped.join(least, "group", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *more)


def one_of_each_group(docs: DataFrame, k: int = K, percent: int = PERCENT, tile_shingles: int = TILE_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the least id of each group, and all documents without
    shingles; all columns as they are. Of rows equal in id and text one stays."""
    keyed = _keyed(docs, id_col, text_col)
    grouped = _grouped(keyed, k, percent, tile_shingles)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    chosen = grouped.filter("group is not null").groupBy("group").agg(F.min_by("key", order).alias("__key")).select("__key", F.lit(True).alias("__once"))
    alone = grouped.filter("group is null").select(F.col("key").alias("__key"), F.lit(False).alias("__once")).distinct()
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    kept = docs.withColumn("__key", key).join(chosen.unionByName(alone), "__key")
    twin = F.row_number().over(Window.partitionBy("__key").orderBy(F.lit(0)))
    return kept.withColumn("__twin", twin).filter("not __once or __twin = 1").select(*docs.columns)
