"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more rows than this, and more than its part of all rows, doesn't go through a shuffle: HOT_KEYS keys at most do that.
HOT_ROWS, HOT_KEYS = 1000, 10_000

#: Bytes of text that a Python task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without that setting, such as a test, gets a temporary folder; on a cluster that is an error,
    as executors don't see each other's disks.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.mkdtemp(prefix="scorewright-")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/scorewright-{uuid.uuid4().hex}"


def through_files(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table written to the shared folder and read back: what follows survives lost executors and does not repeat the work."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in the same order, in batches of at most `limit` bytes of `column` (or of one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many marks before it as set it apart from the columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0]+1, ..., then starts[1], ...: lengths[i] of each."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def hot_keys(counts: DataFrame, key: str, rows: str = "copies") -> DataFrame | None:
    """The keys that many rows share, from rows (key, how many have it); None if there are none.

    There are HOT_KEYS of them at most at any size, as each has more than that part of all rows.
    """
    total, most = counts.agg(F.sum(rows), F.max(rows)).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    return through_files(counts.where(F.col(rows) > limit).select(key)) if (most or 0) > limit else None


def join_unique(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """The inner join of left with right, which has one row for each key.

    Hot keys (hot_keys, so a bounded number) are joined where left's rows are; the others meet in a shuffle.
    """
    if hot is None:
        return left.join(right, key)
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right, key)
    return rest.unionByName(left.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key))
