"""Near duplicates by SimHash: blocks of a wide fingerprint find close texts, Hamming distance and then the shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.common import hot_keys, join_unique, slices, through_files
from scorewright.llm.simhash import components

#: Words of a shingle, and the least share of all shingles of two texts that both have, in hundredths.
WORDS, PERCENT = 5, 80

#: Bits of the fingerprint, of a block, and of the part whose Hamming distance is checked; and how many of these may differ.
#: Texts at 0.8 differ in a bit with chance 0.1515: they share a block of 180 with chance 0.993 and pass the check with 0.987.
WIDE, BLOCK, CHECK, RADIUS = 4096, 22, 128, 28
BLOCKS = (WIDE - CHECK) // BLOCK

#: Members of a group that all others are compared with first, and parts over which the members of a large group are spread.
PIVOTS, SALT = 8, 32

_RNG = np.random.default_rng(42)
_SIGNS = _RNG.choice(np.array([-1.0, 1.0], np.float32), (3, WIDE))
_HALF = np.array([[1.0]], np.float32)
while len(_HALF) ** 2 < WIDE:
    _HALF = np.block([[_HALF, _HALF], [_HALF, -_HALF]]).astype(np.float32)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 of a text's shingles, sorted; a text of no more than so many words is one shingle."""
    parts = text.encode().lower().split()  # both touch ASCII only
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, 42)] if parts else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def wide_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """WIDE bits (0 or 1) for each set: the signs of as many sums over its shingles, each with random signs of its own.

    A shingle's hash puts it in one of WIDE places with a sign; three rounds of random signs and a Hadamard matrix,
    here the product of its two halves, then mix all places into each sum. Sets whose vectors are at an angle differ
    in that share of half a turn.
    """
    side, out = len(_HALF), np.empty((len(sets), WIDE), np.uint8)
    for at in range(0, len(sets), 256):
        part = sets[at : at + 256]
        flat = np.concatenate(part)
        row = np.repeat(np.arange(len(part)), [len(x) for x in part])
        place = row * WIDE + (flat % np.uint64(WIDE)).astype(np.int64)
        sums = np.bincount(place, np.where(flat >> np.uint64(40) & np.uint64(1), 1.0, -1.0), len(part) * WIDE).astype(np.float32).reshape(len(part), WIDE)
        for signs in _SIGNS:
            for _ in range(2):
                sums = ((sums * signs).reshape(-1, side) @ _HALF / np.float32(side**0.5)).reshape(-1, side, side).transpose(0, 2, 1).reshape(-1, WIDE)
                signs = np.float32(1)
        out[at : at + 256] = sums > 0
    return out


def block_keys(bits: np.ndarray) -> np.ndarray:
    """The blocks of each fingerprint, each with its number above it."""
    weights = (1 << np.arange(BLOCK)).astype(np.float32)
    values = (bits[:, CHECK : CHECK + BLOCKS * BLOCK].reshape(-1, BLOCK).astype(np.float32) @ weights).astype(np.int32)
    return values.reshape(-1, BLOCKS) + (np.arange(BLOCKS, dtype=np.int32) << BLOCK)


def _signed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(doc_id, copy, check_a, check_b, keys) of every row: copy is a 128-bit digest of the shingle set; no keys for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column, 1 << 20):
            sets = [shingles(t) for t in pc.fill_null(batch.column(text_column), "").to_pylist()]
            full = np.array([len(s) > 0 for s in sets])
            bits = np.zeros((len(sets), WIDE), np.uint8)
            if full.any():
                bits[full] = wide_fingerprints([s for s in sets if len(s)])
            check = np.packbits(bits[:, :CHECK], axis=1).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(full * BLOCKS)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(block_keys(bits[full]).ravel()))
            copies = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(id_column).cast(pa.int64()), copies, pa.array(np.ascontiguousarray(check[:, 0])), pa.array(np.ascontiguousarray(check[:, 1])), keys], names=["doc_id", "copy", "check_a", "check_b", "keys"])

    return docs.select(id_column, text_column).mapInArrow(run, "doc_id long, copy binary, check_a long, check_b long, keys array<int>")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (key, check_a, check_b, node) sorted by key: links (a, b) that connect all nodes of a key within RADIUS bits.

    Of a key's nodes each b has one a at most where many meet, and as many as there are others where few do.
    """

    def links(key: np.ndarray, check: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        far = lambda x, y: np.bitwise_count(x ^ y).sum(axis=-1)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        a, b = [], []
        small = np.repeat(sizes <= 8, sizes)
        for step in range(1, min(8, int(sizes.max()))):  # few under a key: all pairs, for all keys at once
            same = np.flatnonzero((key[step:] == key[:-step]) & small[step:])
            same = same[far(check[same], check[same + step]) <= RADIUS]
            a.append(node[same])
            b.append(node[same + step])
        for at in np.flatnonzero(sizes > 8):  # many: each one reached is compared with those not yet reached
            left = np.arange(starts[at], starts[at] + sizes[at])
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    here = queue.pop()
                    hit = far(check[left], check[here]) <= RADIUS
                    found = left[hit]
                    a.append(np.full(len(found), node[here]))
                    b.append(node[found])
                    queue += found.tolist()
                    left = left[~hit]
        x, y = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    key, check, node = np.zeros(0, np.int32), np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy()])
        check = np.concatenate([check, np.stack([batch.column(c).to_numpy().view(np.uint64) for c in ("check_a", "check_b")], axis=1)])
        node = np.concatenate([node, batch.column("node").to_numpy()])
        if len(key) and (done := int(np.searchsorted(key, key[-1]))):  # the last key may go on
            yield links(key[:done], check[:done], node[:done])
            key, check, node = key[done:], check[done:], node[done:]
    if len(key):
        yield links(key, check, node)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (root, part, asked, node, text), sorted so that the asked of a root and part come first: links (a, b) that connect them as all do where a node agrees with an asked one.

    One link for each node, and one more wherever a node is the first to bring two of the asked together.
    """
    here, nodes, sizes, flat = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    asked: list[tuple[int, np.ndarray]] = []
    top = np.zeros(0, np.int64)
    for batch in batches:
        a, b = [], []
        for root, part, is_asked, node, text in zip(*(batch.column(c).to_pylist() for c in ("root", "part", "asked", "node", "text")), strict=True):
            own = shingles(text or "")
            if (root, part) != here:
                here, asked, flat = (root, part), [], None
            if is_asked:
                asked.append((node, own))
                continue
            if flat is None:
                nodes, sizes = np.array([n for n, _ in asked], np.int64), np.array([len(x) for _, x in asked], np.int64)
                flat = np.concatenate([x for _, x in asked]) if asked else np.zeros(0, np.uint64)
                top = np.arange(len(asked))  # which of the asked hang together so far
            if len(flat) and len(own):
                at = np.searchsorted(own, flat)
                both = np.add.reduceat((own[np.minimum(at, len(own) - 1)] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
                hit = np.flatnonzero((both * 100 >= (sizes + len(own) - both) * PERCENT) & (nodes != node))
                if len(hit):
                    sets, first = np.unique(top[hit], return_index=True)
                    a += nodes[hit[first]].tolist()
                    b += [node] * len(first)
                    if len(sets) > 1:
                        top[np.isin(top, sets)] = sets[0]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _links_of(asked: DataFrame, members: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Links (a, b) between the asked (root, node) and all members (root, node, text) of their groups whose sets agree.

    Members of hot groups are spread over SALT parts, to each of which the asked of the group go.
    """
    parts = F.sequence(F.lit(0), F.lit(SALT - 1)) if hot is not None else F.array(F.lit(0))
    marked = members.join(asked.select("root").distinct(), "root", "left_semi")
    marked = marked.withColumn("hot", F.lit(False)) if hot is None else marked.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "root", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    spread = lambda several, one: F.when(F.col("hot"), several).otherwise(one)
    first = marked.join(asked, ["root", "node"], "left_semi").select("root", F.explode(spread(parts, F.array(F.lit(0)))).alias("part"), F.lit(True).alias("asked"), "node", "text")
    others = marked.select("root", spread(F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"), F.lit(0)).alias("part"), F.lit(False).alias("asked"), "node", "text")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return first.union(others).repartition(n, "root", "part").sortWithinPartitions("root", "part", F.desc("asked")).mapInArrow(_compare, "a long, b long")


def _thinned(met: DataFrame) -> DataFrame:
    """Links that connect what `met` (a, b) does, about one for each node: each b to its least a, and that to its others, of which there are BLOCKS at most but for pairs."""
    each = met.groupBy("b").agg(F.sort_array(F.collect_set("a")).alias("all"))
    least = F.least(F.get("all", F.lit(0)), F.col("b"))
    return each.select(least.alias("a"), F.explode(F.concat("all", F.array("b"))).alias("b")).where("a != b").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row with an id: the smallest id that links reach.

    Texts link where 0.8 or more of all their distinct five-word shingles are in both. Equal sets are linked first, by
    a 128-bit digest. Of the others, SimHash fingerprints are split into blocks; those that share a block and are
    within RADIUS bits are candidates, and candidates that hang together are a group. Nothing is linked by its
    fingerprint alone: all members of a group are compared with PIVOTS of them by their sets, which settles groups
    that hold together; what that does not link to the group's smallest id is then compared with every member.
    Members of large groups are spread over tasks, and no task holds a group, only what it is compared with.

    Null and empty texts are one class; rows with a null id get no row; repeated rows give theirs each; an empty table
    gives none; other columns are ignored.
    """
    rows = docs.where(F.col(id_column).isNotNull())
    signed = through_files(_signed(rows, id_column, text_column))
    distinct = through_files(signed.groupBy("copy").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("check_a", "check_b", "keys"))))
    keys = distinct.select(F.explode("keys").alias("key"), "check_a", "check_b", "node")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Sorted by node, so that the members of a group meet the same few of it under most keys.
    met = keys.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(_met, "a long, b long")
    groups = components(_thinned(met))
    groups = through_files(groups.union(groups.select("root", "root")).distinct())
    texts = rows.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    members = through_files(texts.join(groups, texts.doc_id == groups.node).select("root", "node", "text").distinct())
    hot = hot_keys(groups.groupBy("root").agg(F.count("*").alias("members")), "root", "members")
    least = groups.groupBy("root").agg(*(F.min(F.struct(F.xxhash64(F.lit(i), "node").alias("hash"), "node")).alias(f"p{i}") for i in range(1, PIVOTS)))
    pivots = least.select("root", F.explode(F.array_distinct(F.array("root", *(f"p{i}.node" for i in range(1, PIVOTS))))).alias("node"))
    links = through_files(_links_of(pivots, members, hot))
    settled = components(links)
    left = through_files(groups.join(settled.withColumnRenamed("root", "top"), "node", "left").where(F.coalesce("top", "node") != F.col("root")).select("root", "node"))
    named = distinct.join(settled, "node", "left").select("copy", F.coalesce("root", "node").alias("top"))
    if left.limit(1).count():  # what is settled counts as one from here on
        tops = settled.select("node", F.col("root").alias("top"))
        more = _links_of(left, members, hot)
        for side in ("a", "b"):
            more = more.join(tops.withColumnsRenamed({"node": side, "top": f"top_{side}"}), side, "left").withColumn(side, F.coalesce(f"top_{side}", side)).drop(f"top_{side}")
        roots = components(more.where("a != b").distinct())
        named = named.join(roots.withColumnRenamed("node", "top"), "top", "left").withColumn("top", F.coalesce("root", "top"))
    named = named.select("copy", F.col("top").alias("component_id"))
    return join_unique(signed.select("doc_id", "copy"), named, "copy", hot_keys(distinct, "copy")).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id; columns stay as they are.

    Rows with a null id stay, and so do all rows of a kept id.
    """
    extra = near_duplicates(docs, id_column, text_column).where("doc_id > component_id").select(F.col("doc_id").alias("_extra")).distinct()
    return docs.join(extra, docs[id_column] == extra["_extra"], "left_anti")
