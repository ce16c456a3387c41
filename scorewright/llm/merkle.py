"""Merkle manifests: each group of rows is a hash tree over its leaves in order of id, the groups' roots are one more tree.

A node is the lowercase hex SHA-256 of its children's digests as text. `fanout` consecutive nodes make one, the last
run of a level whatever is left, even one alone; nothing is padded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.llm.common import through_files

FANOUT = 8

_CHILD = pa.struct([("node", pa.string()), ("id", pa.string()), ("other", pa.string())])
_MADE = "key string, level int, pos long, node string, id string, other string, children array<struct<node:string,id:string,other:string>>"


def encoded(column: Column) -> Column:
    """A field as it goes into a digest: `-` if null, else UTF-8 byte count, colon, value."""
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*columns: Column) -> Column:
    """The digest of a row's fields; null fields stay apart from empty ones."""
    return F.sha2(F.concat(*map(encoded, columns)).cast("binary"), 256)


def _numbered(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """nodes (key, node, id, other) as a table with pos and n: the place among, and the number of, their key's nodes in `order`.

    Rows are range-partitioned by the order, so that a key of any size is spread over tasks; only the number of rows
    of each (key, partition) is gathered to tell where a partition begins.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for k in batch.column("key").to_pylist():
                key, at = (k, 0) if k != key else (key, at + 1)
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "at"])

    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = nodes.withColumn("tie", F.monotonically_increasing_id())  # rows alike in all else, however many, don't meet in one task
    ranged = tied.repartitionByRange(partitions, *order, "tie").sortWithinPartitions(*order, "tie").select("key", "node", "id", "other")
    placed = through_files(ranged.mapInArrow(count, "key string, node string, id string, other string, part int, at long"))
    sizes = placed.groupBy("key", "part").agg(F.count("*").alias("size"))  # for each key as many as partitions it lies in
    whole = Window.partitionBy("key")
    starts = sizes.select("key", "part", (F.sum("size").over(whole.orderBy("part")) - F.col("size")).alias("start"), F.sum("size").over(whole).alias("n"))
    return placed.join(starts, ["key", "part"]).select("key", (F.col("start") + F.col("at")).alias("pos"), "n", "node", "id", "other")


def _mountains(fanout: int):  # noqa: ANN202
    """For rows (key, pos, n, node, id, other) sorted by key and pos: runs that are whole within a stretch of consecutive rows, and the nodes at its edges.

    A stack holds the open run of every level. A node joins its level's run if that began with it or began here at a
    multiple of the fanout; `fanout` of them make a record and carry a node to the level above. Nodes before the first
    multiple, and open runs when the stretch ends, come out as peaks (children null) for others to merge.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list[tuple[int, str, str | None, str | None]]] = []
        here: tuple[str | None, int] = (None, -1)
        out: list[tuple] = []

        def peak(key: str, level: int, pos: int, node: str, id_: str | None, other: str | None) -> None:
            out.append((key, level, pos, node, id_, other, None))

        def flush() -> None:
            for level, open_ in enumerate(stack):
                for pos, node, id_, other in open_:
                    peak(here[0], level, pos, node, id_, other)
            stack.clear()

        def push(key: str, pos: int, node: str, id_: str | None, other: str | None) -> None:
            level = 0
            while True:
                if level == len(stack):
                    stack.append([])
                open_ = stack[level]
                if not open_ and pos % fanout:
                    return peak(key, level, pos, node, id_, other)
                open_.append((pos, node, id_, other))
                if len(open_) < fanout:
                    return None
                node = hashlib.sha256("".join(c[1] for c in open_).encode()).hexdigest()
                children = [{"node": c[1], "id": c[2], "other": c[3]} for c in open_]
                stack[level] = []
                pos, level, id_, other = pos // fanout, level + 1, None, None
                out.append((key, level, pos, node, None, None, children))

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(_CHILD))
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["key", "level", "pos", "node", "id", "other", "children"])
            out.clear()
            return made

        for batch in batches:
            for key, pos, node, id_, other in zip(*(batch.column(c).to_pylist() for c in ("key", "pos", "node", "id", "other")), strict=True):
                if (key, pos) != here:
                    flush()
                push(key, pos, node, id_, other)
                here = (key, pos + 1)
            yield batch_of()
        flush()
        yield batch_of()

    return run


def _height(n: int, fanout: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def build(nodes: DataFrame, order: list[Column], fanout: int = FANOUT) -> tuple[DataFrame, DataFrame, int]:
    """The trees over nodes (key, node, id, other), one for each key: records, roots and the greatest height.

    Records (key, level, pos, node, children) have every inner node; level 1 is above the leaves and its children
    carry id and other. Roots (key, n, node, id, other) have each key's root: for a lone leaf the leaf itself.
    """
    placed = _numbered(nodes, order)
    made = through_files(placed.sortWithinPartitions("key", "pos").mapInArrow(_mountains(fanout), _MADE))
    totals = through_files(placed.groupBy("key").agg(F.first("n").alias("n")))
    height = _height(totals.agg(F.max("n")).first()[0] or 0, fanout)
    heights = totals.withColumn("height", sum(((F.col("n") > fanout**k).cast("int") for k in range(height)), F.lit(0)))
    records = [made.where("children IS NOT NULL").select("key", "level", "pos", "node", "children")]
    edges, carried, roots = made.where("children IS NULL").drop("children"), None, []
    for level in range(height + 1):  # peaks of all stretches, and what was merged below, meet by run
        now = edges.where(F.col("level") == level)
        now = now if carried is None else now.unionByName(carried)
        now = now.join(heights, "key")
        roots.append(now.where(F.col("height") == level).select("key", "n", "node", "id", "other"))
        runs = now.where(F.col("height") > level).groupBy("key", F.floor(F.col("pos") / fanout).alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", "node", "id", "other"))).alias("sorted"))
        children = F.transform("sorted", lambda c: F.struct(c["node"].alias("node"), c["id"].alias("id"), c["other"].alias("other")))
        digest = F.sha2(F.array_join(F.transform("sorted", lambda c: c["node"]), "").cast("binary"), 256)
        if level < height:
            merged = through_files(runs.select("key", F.lit(level + 1).alias("level"), F.col("pos").cast("long").alias("pos"), digest.alias("node"), children.alias("children")))
            records.append(merged)
            carried = merged.select("key", "level", "pos", "node", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("other"))
    joined, tops = records[0], roots[0]
    for more in records[1:]:
        joined = joined.unionByName(more)
    for more in roots[1:]:
        tops = tops.unionByName(more)
    return joined, through_files(tops), height


def _paths(records: DataFrame, tops: DataFrame, height: int, fanout: int) -> DataFrame:
    """Every leaf with its path, from the tops (key, n, node, id, other, path, and more) down; records have what is above leaves.

    A path is an array of (before, after), the digests of the siblings on either side, from the leaf's run to the top.
    """
    extra = [c for c in tops.columns if c not in ("key", "n", "node", "id", "other", "path")]
    level_of = sum(((F.col("n") > fanout**k).cast("int") for k in range(height)), F.lit(0))
    tops = tops.withColumn("level", level_of).withColumn("pos", F.lit(0).cast("long")).drop("n")
    here = tops.where(F.col("level") == height)
    for level in range(height, 0, -1):
        runs = records.where(F.col("level") == level).select("key", "pos", "children")
        nodes = F.transform("children", lambda c: c["node"])
        side = lambda first, size: F.array_join(F.slice(nodes, first, size), "")
        step = F.struct(side(F.lit(1), F.col("at")).alias("before"), side(F.col("at") + 2, F.lit(fanout)).alias("after"))
        below = here.select("key", "pos", "path", *extra).join(runs, ["key", "pos"]).select("key", "pos", "path", "children", *extra, F.posexplode("children").alias("at", "c"))
        here = below.select("key", F.col("c.node").alias("node"), F.col("c.id").alias("id"), F.col("c.other").alias("other"), F.concat(F.array(step), "path").alias("path"), *extra, F.lit(level - 1).alias("level"), (F.col("pos") * fanout + F.col("at")).alias("pos"))
        here = here.unionByName(tops.where(F.col("level") == level - 1).select(here.columns))
    return here.drop("level", "pos")


def proofs(leaves: DataFrame, id_column: str = "doc_id", group_column: str = "lang", leaf_column: str = "leaf", other_column: str | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row per row of `leaves`: id_column, other, leaf, subroot, root, and path, its inclusion proof.

    Leaves ascend by id within their group (null ids first; rows that repeat an id ascend by digest), groups by name
    (null first, bytewise); a group is a tree, and the groups' roots are one more. The path has (before, after) from
    the leaf's run up to the root: joined digests of the siblings before and after; a level where a node is alone has
    empty ones. other_column is carried along, as text. An empty table gives no rows; other columns are ignored.

    Digests alone are sorted, in ranges that split groups of any size. Each task keeps one open run a level and writes
    a record for each whole run; what lies at the edges of tasks is merged level by level. Paths are joined from the
    top down by run, so that rows which move are an eighth of the leaves, and no group meets in one task.
    """
    id_type = leaves.schema[id_column].dataType
    group = F.col(group_column).cast("string")
    other = F.col(other_column).cast("string") if other_column else F.lit(None).cast("string")
    nodes = through_files(leaves.select(encoded(group).alias("key"), group.alias("name"), F.col(id_column).alias("by"), F.col(leaf_column).alias("node"), F.col(id_column).cast("string").alias("id"), other.alias("other")))
    records, subroots, height = build(nodes, [F.col("name").asc_nulls_first(), F.col("by").asc_nulls_first(), F.col("node").asc()], fanout)
    name = F.when(F.col("key") != "-", F.expr("substr(key, instr(key, ':') + 1)"))  # what follows the byte count; `-` alone is the null group
    over = subroots.select(F.lit("").alias("key"), name.alias("name"), "node", F.lit(None).cast("string").alias("id"), F.col("key").alias("other"))
    top_records, top, top_height = build(over, [F.col("name").asc_nulls_first()], fanout)
    above = _paths(top_records, top.withColumn("root", F.col("node")).withColumn("path", F.array().cast("array<struct<before:string,after:string>>")), top_height, fanout)
    tops = subroots.join(above.select(F.col("other").alias("key"), "path", "root"), "key").withColumn("subroot", F.col("node"))
    found = _paths(records, tops, height, fanout)
    return found.select(F.col("id").cast(id_type).alias(id_column), "other", F.col("node").alias("leaf"), "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]).cast("binary"), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings, from left to right and from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "").cast("binary"), 256)
