"""Exact Jaccard join of shingle sets: pivots, regions around them, and windows of the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import hot_keys, join_unique, ragged, slices, through_files
from scorewright.llm.near import shingles
from scorewright.llm.simhash import components

#: Words of a shingle, and the least share of all shingles of two texts that both have, in hundredths.
WORDS, PERCENT = 3, 90

#: Partings of the shingles that a text is tried under before it goes to a level's last region, which compares all with all.
SEEDS = 4

#: Members and bytes of text that a region joined in one task has at most; larger ones are split by PIVOTS pivots over SALT parts a round.
LIMIT, LIMIT_BYTES, PIVOTS, SALT = 1024, 64 << 20, 16, 32

#: Ids that go to the texts by broadcast at most (16 bytes each); beyond it texts and ids meet in a shuffle.
BROADCAST = 1_000_000

#: A region that keeps over this share of its members is not split again: its members meet in tiles, tile by tile.
STUCK = 0.8


@cache
def size_classes(percent: int) -> list[int]:
    """First sizes of the classes: sets of which `percent` hundredths can be shared are in one class or in neighbouring ones.

    Three steps of that share make a class: a set is then in one level or two, and together these have the fewest parts.
    """
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100**3 // percent**3)))
    return edges


def levels_of(size: int, percent: int) -> list[tuple[int, int]]:
    """(level, most) of the pairs that a set of this size may be in: the larger one's class, and the most elements in which the two differ."""
    edges = size_classes(percent)
    low, high = (int(np.searchsorted(edges, n, side="right")) - 1 for n in (size, size * 100 // percent))
    out = []
    for level in range(low, high + 1):
        most = 2 * (edges[level + 1] - 1) * (100 - percent) // (100 + percent)  # of |x| + |y| at most this part is in one alone
        if most:  # else they are equal
            out.append((level, most))
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def part_keys(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a set, one of which it shares with every set that agrees with it enough.

    For each level the elements are dealt, by hash, into more parts than two such sets have differences, so that they
    agree in a whole part. One or more parts are spare, for parts that are empty in both; sets with more empty parts
    than that are dealt again by another seed, and after SEEDS of them have one key for all.
    """
    out = []
    for level, most in levels_of(len(elements), percent):
        spare = 1 + most // 400
        parts = most + 1 + spare
        for seed in range(SEEDS):
            part = (_mixed(elements, 2 * seed + 1) >> np.uint64(20)) % np.uint64(parts)
            part = part.astype(np.int64)
            sums = np.zeros(parts, np.uint64)
            np.add.at(sums, part, _mixed(elements, 2 * seed + 2))
            full = np.bincount(part, minlength=parts) > 0
            names = np.arange(parts, dtype=np.uint64) + np.uint64((level * SEEDS + seed) << 40)
            out.append(_mixed(sums ^ _mixed(names, 11), 12)[full])
            if parts - int(full.sum()) <= spare:
                break
        else:
            out.append(_mixed(np.array([level], np.uint64), 13))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _signed(docs: DataFrame, words: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, copy, n, keys) of every row: copy is a 128-bit digest of the set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, 1 << 20):
            sets = [shingles(t, words) for t in pc.fill_null(batch.column(text_column), "").to_pylist()]
            keys = [part_keys(s, percent) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            copies = pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.int64()), copies, pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "copy", "n", "keys"])

    return docs.select(id_column, text_column).mapInArrow(run, "doc_id long, copy binary, n long, keys array<long>")


class _Region:
    """Sets of one region, joined where they are: links that connect what the full join would."""

    def __init__(self, nodes: list[int], sets: list[np.ndarray], percent: int) -> None:
        self.nodes, self.sets, self.percent = nodes, sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.flat = np.concatenate(sets)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.label = np.arange(len(nodes))
        self.links: list[tuple[int, int]] = []
        same: dict[int, int] = {}  # rows with one id are one document
        for i, node in enumerate(nodes):
            self.unite(same.setdefault(node, i), i)

    def unite(self, a: int, b: int) -> None:
        if self.label[a] != self.label[b]:
            self.label[self.label == self.label[b]] = self.label[a]
            if self.nodes[a] != self.nodes[b]:
                self.links.append((self.nodes[a], self.nodes[b]))

    def against(self, one: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements that a set shares with each of the others, and how many are in either."""
        sizes = self.sizes[among]
        flat = self.flat[ragged(self.starts[among], sizes)]
        hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
        both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
        return both, sizes + len(one) - both

    def join(self, among: np.ndarray) -> None:
        """Pivots of `among`, their cells with all that a link could bring there, and these in turn."""
        if len(among) < 2 or (self.label[among] == self.label[among[0]]).all():
            return
        if len(among) <= PIVOTS:
            self.pairs(among, np.zeros((0, len(among))))
            return
        pivots = among[:: -(-len(among) // PIVOTS)]
        far = np.empty((len(pivots), len(among)))
        for row, pivot in enumerate(pivots):
            both, either = self.against(self.sets[pivot], among)
            far[row] = 1 - both / either
            for i in among[both * 100 >= either * self.percent]:
                self.unite(pivot, i)
        cells = far <= far.min(axis=0) + 2 * (1 - self.percent / 100) + 1e-9
        if (self.label[among] == self.label[among[0]]).all():
            return
        if cells.sum(axis=1).max() > STUCK * len(among):
            self.pairs(among, far)
            return
        for cell in cells:
            self.join(among[cell])

    def pairs(self, among: np.ndarray, far: np.ndarray) -> None:
        """All pairs that aren't connected and whose distances to every pivot are within the threshold of each other."""
        reach = 1 - self.percent / 100 + 1e-9
        for k in range(len(among) - 1):
            one, rest = among[k], np.arange(k + 1, len(among))
            rest = rest[self.label[among[rest]] != self.label[one]]
            rest = rest[(np.abs(far[:, rest] - far[:, k : k + 1]) <= reach).all(axis=0)] if len(far) else rest
            small, large = np.minimum(self.sizes[one], self.sizes[among[rest]]), np.maximum(self.sizes[one], self.sizes[among[rest]])
            rest = rest[small * 100 >= large * self.percent]
            if len(rest):
                both, either = self.against(self.sets[one], among[rest])
                for i in among[rest[both * 100 >= either * self.percent]]:
                    self.unite(one, i)


def _joined(words: int, percent: int):  # noqa: ANN202
    """For rows (region, node, text) sorted by region: the links of each region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, nodes, sets = None, [], []

        def links() -> pa.RecordBatch:
            found = []
            if len(nodes) > 1:
                region = _Region(nodes, sets, percent)
                region.join(np.arange(len(nodes)))
                found = region.links
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in slices(batches):
            for region, node, text in zip(*(batch.column(c).to_pylist() for c in ("region", "node", "text")), strict=True):
                if region != here:
                    yield links()
                    here, nodes, sets = region, [], []
                if len(own := shingles(text or "", words)):  # rows that share an id can have other texts, empty ones too
                    nodes.append(node)
                    sets.append(own)
        yield links()

    return run


def _distances(words: int, percent: int):  # noqa: ANN202
    """For rows (region, part, asked, node, text), a region's pivots first in each part: (region, node, linked, cells) of all members.

    linked are the pivots that the node links to, cells those in whose windows it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pivots = None, []
        for batch in slices(batches):
            out = []
            for region, part, asked, node, text in zip(*(batch.column(c).to_pylist() for c in ("region", "part", "asked", "node", "text")), strict=True):
                own = shingles(text or "", words)
                if (region, part) != here:
                    here, pivots = (region, part), []
                if not len(own):
                    continue
                if asked:
                    pivots.append((node, own))
                    continue
                shared = np.array([np.isin(own, p, assume_unique=True).sum() for _, p in pivots])
                either = np.array([len(p) for _, p in pivots]) + len(own) - shared
                far = 1 - shared / either
                linked = [pivots[i][0] for i in np.flatnonzero(shared * 100 >= either * percent)]
                cells = np.flatnonzero(far <= far.min() + 2 * (1 - percent / 100) + 1e-9)
                out.append((region, node, linked, [pivots[i][0] for i in cells]))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["region", "node", "linked", "cells"])

    return run


def _in_tasks(members: DataFrame, words: int, percent: int) -> DataFrame:
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.select("region", "node", "text").repartition(n, "region").sortWithinPartitions("region", "node").mapInArrow(_joined(words, percent), "a long, b long")


def _split(members: DataFrame, large: DataFrame, words: int, percent: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Links of the large regions to their pivots, and the cells (region, node) that are left to join.

    Members are spread over SALT parts, to each of which a region's pivots go. A cell whose members hang together
    already is done. If a cell keeps over STUCK of its region, the region is cut into tiles instead: each member goes
    to the tiles of its own and every other group of `limit` / 2, so that each pair meets in one.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = members.join(large.select("region"), "region", "left_semi")
    least = here.groupBy("region").agg(*(F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("hash"), "node")).alias(f"p{i}") for i in range(PIVOTS)))
    pivots = least.select("region", F.explode(F.array_distinct(F.array(*(f"p{i}.node" for i in range(PIVOTS))))).alias("node"))
    asked = here.join(pivots, ["region", "node"], "left_semi").select("region", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"), F.lit(True).alias("asked"), "node", "text")
    others = here.select("region", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int").alias("part"), F.lit(False).alias("asked"), "node", "text")
    measured = asked.union(others).repartition(n, "region", "part").sortWithinPartitions("region", "part", F.desc("asked")).mapInArrow(_distances(words, percent), "region long, node long, linked array<long>, cells array<long>")
    measured = through_files(measured.distinct())
    links = through_files(measured.select(F.explode("linked").alias("a"), F.col("node").alias("b")).where("a != b").distinct())
    labels = components(links)
    cells = measured.select("region", "node", F.explode("cells").alias("pivot"))
    cells = through_files(cells.join(labels, "node", "left").select("region", F.xxhash64("region", "pivot").alias("cell"), "node", F.coalesce("root", "node").alias("label")))
    open_ = cells.groupBy("region", "cell").agg(F.count("*").alias("size"), F.min("label").alias("one"), F.max("label").alias("other")).where("one != other")
    stuck = open_.groupBy("region").agg(F.max("size").alias("size")).join(large, "region").where(F.col("size") > STUCK * F.col("members"))
    stuck = through_files(stuck.select("region", F.ceil(F.col("members") * 2 / limit).cast("int").alias("groups")))
    next_ = cells.join(open_.select("region", "cell"), ["region", "cell"], "left_semi").join(stuck, "region", "left_anti").select(F.col("cell").alias("region"), "node", F.lit(False).alias("tile"))
    group = F.pmod(F.xxhash64("node"), F.col("groups")).cast("int")
    tiles = here.select("region", "node").join(stuck, "region").select("region", "node", group.alias("own"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("met"))
    tiles = tiles.select(F.xxhash64("region", F.least("own", "met"), F.greatest("own", "met")).alias("region"), "node", F.lit(True).alias("tile"))
    return links, through_files(next_.union(tiles).distinct())


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, limit: int = LIMIT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, the smallest doc_id that links reach.

    A text's set has its distinct shingles of `words` words (ASCII lower case; with fewer words, all of them are one),
    as XXH64; texts link where 100 * |both| >= percent * |either|. Texts without words have an empty set and link with
    nothing; rows with a null id link with nothing and have no component; rows that share an id are one document;
    repeated rows come out as often as they went in; an empty table gives no rows; other columns are ignored.

    Equal sets are one node. Sets that share nothing are all at distance one from each other, where no pivot tells
    them apart; so each pivot's region is what shares a key with it (part_keys: two sets that link have one in
    common), the pivot being the key's smallest node. Within a region pivots make Voronoi cells by exact distance; a set
    also goes to each cell whose pivot is at most twice the threshold farther than its own, as its partners may be
    there. Cells are joined in turn until they are small, or all of their members are connected. Regions over `limit`
    members are split over tasks in the same way.
    """
    signed = through_files(_signed(docs, words, percent, id_column, text_column))
    known = signed.where("doc_id IS NOT NULL AND copy IS NOT NULL")
    distinct = through_files(known.groupBy("copy").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("keys").alias("keys")))
    keys = distinct.select(F.explode("keys").alias("key"), "node")
    met = through_files(keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count("*").alias("size")).where("size > 1"))
    more = keys.join(met.where("size > 2").select("key", "pivot").hint("merge"), "key").select("pivot", "node")  # as many keys as there are near copies: never a table to broadcast
    near = through_files(met.where("size = 2").select("pivot", F.col("last").alias("node")).union(more).where("pivot != node").distinct())
    regions = near.select(F.col("pivot").alias("region"), "node").union(near.select("pivot", "pivot").distinct()).withColumn("tile", F.lit(False))
    texts = docs.select(F.col(id_column).cast("long").alias("node"), F.col(text_column).alias("text"))
    edges = _same_ids(known, distinct)
    while True:
        ids = through_files(regions.select("node").distinct())
        asked = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST else ids, "node", "left_semi")
        members = through_files(asked.join(regions, "node").select("region", "node", "text", "tile").distinct())
        sizes = members.groupBy("region").agg(F.count("*").alias("members"), F.sum(F.octet_length("text")).alias("bytes"), F.max("tile").alias("tile"))
        large = through_files(sizes.where(f"NOT tile AND members > 2 AND (members > {limit} OR bytes > {LIMIT_BYTES})"))
        if not large.limit(1).count():
            edges = edges.union(_in_tasks(members, words, percent))
            break
        found, regions = _split(members, large, words, percent, limit)
        edges = edges.union(_in_tasks(members.join(large, "region", "left_anti"), words, percent)).union(found)
    roots = components(edges)
    names = distinct.join(roots, "node", "left").select("copy", F.coalesce("root", "node").alias("component_id"))
    named = join_unique(known.select("copy", "doc_id", "n"), names, "copy", hot_keys(distinct, "copy")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.union(signed.where("doc_id IS NULL OR copy IS NULL").select("doc_id", "n", "doc_id"))


def _same_ids(known: DataFrame, distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of sets that rows of one id have."""
    several = known.groupBy("doc_id").agg(F.min("copy").alias("one"), F.max("copy").alias("other")).where("one != other").select("doc_id")
    sets = known.join(several, "doc_id").select("doc_id", "copy").join(distinct.select("copy", "node"), "copy")
    return sets.select(F.col("node").alias("a"), F.col("doc_id").alias("b")).where("a != b").distinct()
