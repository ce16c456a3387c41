"""Token ids in files of compressed planes, with an index of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from scorewright.llm.common import slices
from scorewright.llm.tokens import encoder, with_end

#: Ids in a chunk: 64 Ki ids make planes of 64 KiB (bytes) or 8 KiB (bits).
CHUNK_IDS = 65_536

CHUNKS = "shard int, chunk int, first long, n_ids int, layout string, planes array<binary>, doc array<int>, doc_id array<long>, doc_at array<long>, length array<int>"


def to_planes(ids: np.ndarray, layout: str = "byte", level: int = 3) -> list[bytes]:
    """Each byte (or bit) of all ids side by side, lowest first, each plane compressed by itself."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    planes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if layout == "bit":
        planes = np.packbits(np.unpackbits(planes, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = planes.T
    return [squeeze(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, layout: str) -> np.ndarray:
    expand = zstandard.ZstdDecompressor().decompress
    rows = np.stack([np.frombuffer(expand(p), np.uint8) for p in planes]) if n else np.zeros((4, 0), np.uint8)
    if n and layout == "bit":
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, chunk_ids: int = CHUNK_IDS, layout: str = "byte", id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the ids of all documents in ascending order of id to `path`, each document's followed by end_id.

    path/chunks has a row per chunk of chunk_ids ids (a shard's last one may be shorter): shard and chunk give the
    order, `planes` the compressed planes, and the arrays the documents in it (number in the shard, id, where in the
    document the piece begins, its ids here). path/index has for each shard where its ids and documents begin among
    all. Shards are ranges of ids, sorted; Spark's committer leaves whole files only, whatever executors are lost.

    Null and empty texts are documents of end_id alone; null ids come first; repeated ids are documents of their own;
    an empty table makes empty files; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer).encode, TaskContext.get().partitionId()
        held, held_n, pieces, chunk, first, number = [], 0, [], 0, 0, 0

        def emit(n: int) -> pa.RecordBatch:
            nonlocal held, held_n, pieces, chunk, first
            ids = np.concatenate(held)
            docs_here, room = [], n
            while room:
                doc, name, at, length = pieces[0]
                used = min(length, room)
                docs_here.append((doc, name, at, used))
                room -= used
                if used == length:
                    pieces.pop(0)
                else:
                    pieces[0] = (doc, name, at + used, length - used)
            values = [shard, chunk, first, n, layout, to_planes(ids[:n], layout), *map(list, zip(*docs_here, strict=True))]
            held, held_n, chunk, first = [ids[n:]], held_n - n, chunk + 1, first + n
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            names = ["shard", "chunk", "first", "n_ids", "layout", "planes", "doc", "doc_id", "doc_at", "length"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in slices(batches, text_column):
            ids, bounds = with_end(*encode(batch.column(text_column)), end_id)
            held.append(ids)
            held_n += len(ids)
            for name, n in zip(batch.column(id_column).to_pylist(), np.diff(bounds).tolist(), strict=True):
                pieces.append((number, name, 0, n))
                number += 1
            while held_n >= chunk_ids:
                yield emit(chunk_ids)
        if held_n:
            yield emit(held_n)

    spark = docs.sparkSession
    ordered = docs.select(id_column, text_column).repartitionByRange(F.col(id_column)).sortWithinPartitions(id_column)
    ordered.mapInArrow(run, CHUNKS).write.option("compression", "none").parquet(f"{path}/chunks")
    # One row a shard, so as many as partitions: this window has no key but never sees a document.
    shards = spark.read.parquet(f"{path}/chunks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.max(F.element_at("doc", -1)).alias("last_doc"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards.select("shard", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first_id"), F.coalesce(F.sum(F.col("last_doc") + 1).over(before), F.lit(0)).alias("first_doc")).coalesce(1).write.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The pieces of documents in the files of write_ids, each chunk decoded by itself.

    Columns: shard, doc (number in the shard), doc_id, doc_at (ids of the document before the piece), at (ids of all
    documents before the piece), ids (little-endian unsigned 32 bit).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = from_planes(row["planes"], row["n_ids"], row["layout"]).tobytes()
                ends = np.cumsum([0, *row["length"]]).tolist()
                n = len(row["doc"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array(row["doc"], pa.int32()), pa.array(row["doc_id"], pa.int64()), pa.array(row["doc_at"], pa.int64()), pa.array([row["first_id"] + row["first"] + e for e in ends[:-1]], pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(ends, ends[1:], strict=False)], pa.binary())],
                    names=["shard", "doc", "doc_id", "doc_at", "at", "ids"],
                )

    index = spark.read.parquet(f"{path}/index").select("shard", "first_id")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").join(index, "shard")
    return chunks.mapInArrow(run, "shard int, doc int, doc_id long, doc_at long, at long, ids binary")


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo CRC-32's, highest power first."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
        b = b << 1 & 0xFFFFFFFF
    return out


def crc32_of_parts(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of bytes from (CRC-32, number of bytes) of their parts in order."""
    crc = 0
    for part, n in parts:
        shift, power, bits = 0x80000000, 0x00800000, n  # 1, and 8 bits further
        while bits:
            if bits & 1:
                shift = _times(shift, power)
            power, bits = _times(power, power), bits >> 1
        crc = _times(crc, shift) ^ part
    return crc


@pandas_udf(T.LongType())
def joined_crc32(crcs, sizes):  # noqa: ANN001, ANN201  pandas series of arrays, in order
    import pandas as pd

    return pd.Series([int(c[0]) if len(c) == 1 else crc32_of_parts([(int(x), int(y)) for x, y in zip(c, n, strict=True)]) for c, n in zip(crcs, sizes, strict=True)], dtype="int64")


def summarise(pieces: DataFrame) -> DataFrame:
    """A row per document of read_ids: doc_id, start, n_tokens, ids_crc32. Only lengths and checksums are shuffled."""
    small = pieces.select("shard", "doc", "doc_id", F.struct("doc_at", "at", (F.length("ids")).alias("size"), F.crc32("ids").alias("crc")).alias("p"))
    whole = small.groupBy("shard", "doc").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list("p")).alias("p"))
    return whole.select("doc_id", F.col("p.at")[0].alias("start"), F.expr("cast(aggregate(p.size, 0L, (a, x) -> a + x) / 4 as long)").alias("n_tokens"), joined_crc32("p.crc", "p.size").alias("ids_crc32"))


