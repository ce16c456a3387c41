"""Near-duplicate documents by SimHash: blocks of the fingerprint find close pairs, their bits are then compared."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import hot_keys, join_unique, slices, through_files

#: A fingerprint has this many blocks; pairs with up to `distance` other bits share all but `distance` of them.
BLOCKS = 6

#: A bucket with more fingerprints than this isn't compared in one task but linked by the fingerprints around them.
BUCKET = 65_536


def _fingerprints(texts: list[str], words: int) -> np.ndarray:
    """64 bits for each text: a bit is set if it is in over half the XXH64 (seed 42) of its shingles."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        parts = text.encode().lower().split()  # both touch ASCII only
        line = b" ".join(parts)
        if len(parts) <= words:
            hashes += [digest(line, 42)] if parts else []
            counts.append(1 if parts else 0)
            continue
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes += [digest(line[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
        counts.append(len(parts) - words + 1)
    out, n = np.zeros(len(texts), np.uint64), np.array(counts, np.int64)
    some = np.flatnonzero(n)
    if len(some):
        each = np.array(hashes, np.uint64)
        first = np.cumsum(n[some]) - n[some]
        for at in range(0, len(some), 256):
            part = slice(at, at + 256)
            a, b = first[at], first[part][-1] + n[some[part]][-1]
            bits = np.unpackbits(each[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_in = np.add.reduceat(bits, first[part] - a, axis=0, dtype=np.int64)
            out[some[part]] = np.packbits(2 * set_in > n[some[part]][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint long) of every row; a text without words (null, empty, blank) has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            found = _fingerprints(pc.fill_null(batch.column(text_column), "").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fingerprint"])

    return docs.select(id_column, text_column).mapInArrow(run, "doc_id long, fingerprint long")


def block_keys(fingerprint: Column, distance: int, blocks: int = BLOCKS) -> Column:
    """The keys under which a fingerprint meets all others within `distance`: each choice of the blocks that stay equal."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(number), fingerprint.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def _forest(prints: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that hold the close fingerprints together, as few as do: each one reached is compared with those not yet reached."""
    left, a, b = prints, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            here = queue.pop()
            near = np.bitwise_count(left ^ here) <= distance
            if near.any():
                found = left[near]
                a += [int(here)] * len(found)
                b += found.tolist()
                queue += list(found)
                left = left[~near]
    return a, b


def _links_within(distance: int):  # noqa: ANN202
    """For rows (key, fingerprint) sorted by key: links between close fingerprints under the same key."""

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        a, b = [], []
        small = np.repeat(sizes <= 8, sizes)
        for step in range(1, min(8, int(sizes.max()))):  # few under a key: all pairs, for all keys at once
            same = (keys[step:] == keys[:-step]) & small[step:] & (np.bitwise_count(prints[step:] ^ prints[:-step]) <= distance)
            a.append(prints[:-step][same])
            b.append(prints[step:][same])
        for at in np.flatnonzero(sizes > 8):
            x, y = _forest(np.unique(prints[starts[at] : starts[at] + sizes[at]]), distance)
            a.append(np.array(x, np.uint64))
            b.append(np.array(y, np.uint64))
        x, y = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in (a, b))
        x, y = np.minimum(x, y), np.maximum(x, y)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            prints = np.concatenate([prints, batch.column("fingerprint").to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            done = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if done:
                yield links(keys[:done], prints[:done])
                keys, prints = keys[done:], prints[done:]
        if len(keys):
            yield links(keys, prints)

    return run


def _links_around(prints: DataFrame, distance: int) -> DataFrame:
    """Links of a bucket of any size, in work linear in it: x and y are close if some z is within d//2 bits of x and the rest of d of y.

    All that are near z from either side are linked to the least x that is near it.
    """
    near = distance // 2

    def around(radius: int) -> DataFrame:
        ring = prints.select("fingerprint", F.col("fingerprint").alias("z"), F.lit(0).alias("bit"))
        rings = [ring]
        for _ in range(radius):  # one more bit turned over, above those before
            turned = rings[-1].where("bit < 64").select("fingerprint", "z", F.explode(F.sequence("bit", F.lit(63))).alias("bit"))
            rings.append(turned.select("fingerprint", F.expr("z ^ shiftleft(1L, bit)").alias("z"), (F.col("bit") + 1).alias("bit")))
        for ring in rings[1:]:
            rings[0] = rings[0].union(ring)
        return rings[0].select("fingerprint", "z")

    hubs = around(near).groupBy("z").agg(F.min("fingerprint").alias("hub"))
    met = around(distance - near).join(hubs, "z").select("hub", "fingerprint").where("hub != fingerprint")
    return met.select(F.least("hub", "fingerprint").alias("a"), F.greatest("hub", "fingerprint").alias("b"))


def links(prints: DataFrame, distance: int = 3, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within `distance` bits, though not one for each pair.

    A key is a choice of blocks that stay equal. Buckets of up to `bucket` fingerprints are compared in a task, which
    passes on a spanning forest; larger ones take _links_around.
    """
    # As many tasks as a shuffle has: a fingerprint becomes many keys, so small files of fingerprints make large tasks.
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fingerprint")
    keys = prints.select(F.explode(block_keys(F.col("fingerprint"), distance, blocks)).alias("key"), "fingerprint")
    large = through_files(keys.groupBy("key").count().where(F.col("count") > bucket).select("key"))
    crowded = large.limit(1).count() > 0
    if crowded:
        dense = keys.join(large, "key", "left_semi").select("fingerprint").distinct()
        keys = keys.join(large, "key", "left_anti")
    found = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_links_within(distance), "a long, b long")
    return (found.union(_links_around(dense, distance)) if crowded else found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b) reaches.

    Alternating large-star and small-star steps; each step is a table in the shared folder, and they end when all links
    are stars. A step has one join, and no round is made only to see that nothing changes: with all that a plan brings
    about, exchanges, broadcasts and the threads and code for them, long plans are what takes the driver's memory.
    """
    edges = through_files(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while not _all_stars(edges):
        edges = through_files(_small_star(through_files(_large_star(edges))))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _all_stars(edges: DataFrame) -> bool:
    """Whether each larger end of distinct links (a, b), a > b, has one link and is no smaller end: then b is the smallest that a reaches."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Distinct links, each node's larger neighbours moved to the least of its neighbours and itself."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Distinct links, each node and its smaller neighbours moved to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, blocks: int = BLOCKS, bucket: int = BUCKET, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (long), component_id, the smallest doc_id that links reach.

    Documents link where their fingerprints differ in `distance` bits or fewer; equal fingerprints are linked first,
    so that copies cost nothing further. Texts without words have fingerprint zero and link like any other. Rows with
    a null id get the component of their fingerprint (null if it has no id at all); repeated rows come out as often
    as they went in; an empty table gives no rows; other columns are ignored.
    """
    prints = through_files(fingerprints(docs, words, id_column, text_column))
    distinct = through_files(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    roots = components(links(distinct.select("fingerprint"), distance, blocks, bucket))
    named = distinct.join(roots, distinct.fingerprint == roots.node, "left").select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = named.join(least, "root").select("fingerprint", "component_id")
    return join_unique(prints, names, "fingerprint", hot_keys(distinct, "fingerprint")).select("doc_id", "fingerprint", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, blocks: int = BLOCKS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id; columns stay as they are.

    Rows with a null id stay, and so do all rows of a kept id.
    """
    found = near_duplicates(docs, words, distance, blocks, id_column=id_column, text_column=text_column)
    extra = found.where("doc_id > component_id").select(F.col("doc_id").alias("_extra")).distinct()
    return docs.join(extra, docs[id_column] == extra["_extra"], "left_anti")
