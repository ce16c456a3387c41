"""Repeated passages: content-defined chunks of lines that stand before in the corpus are taken out of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.llm.common import hot_keys, join_unique, slices, through_files, unused

#: Lines of a chunk on average and at most; words that a chunk has at least to count; words that make any run of lines a passage.
CHUNK_LINES, MOST, LEAST, LONG = 3, 64, 20, 50
#: Lists of repeated passages, one a document that has any, whose keys are handed out at most (24 bytes each).
BROADCAST = 1_000_000
#: Of lines with this many words every one of a repeated passage of LONG words goes, however it is cut.
CHUNK_WORDS = 8
_MULTIPLIER, _MASK = 0x9E3779B97F4A7C15, 0xFFFFFFFFFFFFFFFF


def chunk_ends(hashes: list[int]) -> list[int]:
    """Ends (exclusive) of the chunks of a document whose lines have these hashes.

    A chunk ends between two lines where the rolling hash of the two says so: at one place in CHUNK_LINES, whatever
    the lines are like. That hangs on the two alone, so a passage has the same chunks wherever it stands, but for those
    at its edges. A chunk has MOST lines at most, for the sake of equal lines.
    """
    ends, start = [], 0
    for i in range(1, len(hashes)):
        rolled = (hashes[i - 1] * _MULTIPLIER + hashes[i]) * _MULTIPLIER & _MASK
        if (rolled >> 32) % CHUNK_LINES == 0 or i - start >= MOST:
            ends.append(i)
            start = i
    return [*ends, len(hashes)] if hashes else []


def runs_of(hashes: list[int], words: list[int]) -> set[tuple[int, int]]:
    """(start, end) of the runs of lines that are looked for elsewhere.

    These are the content-defined chunks of several lines and LEAST words or more. No chunk lies in a passage of a
    line or two for certain, as its edges hang on what stands beside it; so the shortest run of LONG words or more
    from each line on is one too, and a repeated passage of so many words is found at any place, all of its lines.
    """
    starts = [0, *(ends := chunk_ends(hashes))]
    runs = {(a, b) for a, b in zip(starts, ends, strict=False) if b - a > 1 and sum(words[a:b]) >= LEAST}
    end = total = 0
    for start in range(len(words)):
        while end < len(words) and total < LONG:
            total += words[end]
            end += 1
        if total < LONG:
            break
        runs.add((start, end))
        total -= words[start]
    return runs


def line_passages(text: str, seed: int = 0) -> list[tuple[int, int, bytes]]:
    """(first line, lines, 128-bit hash) of each run of lines that is looked for elsewhere (runs_of); blank lines in it don't count."""
    raw = text.encode().split(b"\n")
    full = [i for i, line in enumerate(raw) if line.strip()]
    hashes, words = [xxhash.xxh64_intdigest(raw[i]) for i in full], [len(raw[i].split()) for i in full]
    return [(full[a], full[b - 1] - full[a] + 1, xxhash.xxh128_digest(b"\n".join(raw[i] for i in full[a:b]), seed)) for a, b in sorted(runs_of(hashes, words))]


def _tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 0) -> DataFrame:
    """docs with every passage that stands earlier in the corpus taken out of their texts, plus lines and removed_lines.

    Documents are cut into content-defined chunks of lines (chunk_ends). Lines go if a passage of theirs (runs_of: a
    chunk of several lines and LEAST words, or any run of LONG words) stands earlier; earlier means a smaller id, or
    further up in the same document. The first occurrence of every passage stays, and single lines of fewer words do. Passages of one hash are compared byte for byte before anything is removed; if texts differ, all
    is hashed anew by another seed. Columns named lines or removed_lines are replaced; all other columns and all rows
    stay, n_chars included. Null texts stay null; a null id comes last; rows that repeat both id and text count as one
    document, so that they don't empty each other; an empty table stays empty.

    Hashes of passages are counted without texts. Documents that have any move once, to get their list of repeated
    passages, and are written to the shared folder; distinct texts of repeated hashes are then compared, and a last
    pass over these documents removes lines where they are.
    """
    id_, text = F.col(id_column), F.col(text_column)
    kept = docs.drop("lines", "removed_lines")
    key, listed, list_id, list_tag = (unused(n, kept.columns) for n in ("_key", "_chunks", "_list_id", "_list_tag"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            found = [line_passages(t, seed) for t in pc.fill_null(batch.column(text_column), "").to_pylist()]
            n = np.array([len(f) for f in found], np.int64)
            take = pa.array(np.repeat(np.arange(len(found)), n))
            flat = [c for f in found for c in f]
            cols = [pa.array([c[k] for c in flat], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(take), batch.column("_tag").take(take), *cols], names=["_id", "_tag", "first", "n", "hash"])

    chunks = docs.select(id_.cast("long").alias("_id"), _tag(text).alias("_tag"), text_column).mapInArrow(cut, "_id long, _tag long, first int, n int, hash binary")
    chunks = through_files(chunks).distinct()
    place = F.struct(F.coalesce("_id", F.lit((1 << 63) - 1)).alias("_id"), "_tag", "first")
    repeated = through_files(chunks.groupBy("hash").agg(F.count("*").alias("times"), F.min(place).alias("keep")).where("times > 1"))
    marked = join_unique(chunks, repeated, "hash", hot_keys(repeated, "hash", "times")).withColumn("stays", (F.coalesce("_id", F.lit((1 << 63) - 1)) == F.col("keep._id")) & (F.col("_tag") == F.col("keep._tag")) & (F.col("first") == F.col("keep.first")))
    lists = marked.groupBy("_id", "_tag").agg(F.sort_array(F.collect_list(F.struct("first", "n", "hash", "stays"))).alias(listed))
    lists = through_files(lists.select(F.xxhash64("_id", "_tag").alias(key), F.col("_id").alias(list_id), F.col("_tag").alias(list_tag), listed))
    keyed = kept.withColumn(key, F.xxhash64(id_.cast("long"), _tag(text)))
    match = (keyed[key] == lists[key]) & id_.cast("long").eqNullSafe(F.col(list_id)) & (_tag(text) == F.col(list_tag))
    few = lists.count() <= BROADCAST
    names = F.broadcast(lists.drop(listed)) if few else lists.drop(listed)
    # What repeats nothing stays where it is; with more lists than can be handed out, all documents meet them.
    moved = keyed.join(names, match, "left_semi") if few else keyed
    match = (moved[key] == lists[key]) & moved[id_column].cast("long").eqNullSafe(lists[list_id]) & (_tag(moved[text_column]) == lists[list_tag])
    with_lists = through_files(moved.join(lists, match, "left").drop(key, list_id, list_tag))

    full = "filter(slice(lines, c.first + 1, c.n), line -> btrim(line, ' \t\r\x0b\x0c') <> '')"
    several = F.expr(f"transform(array(split({text_column}, '\\n')), lines -> transform({listed}, c -> struct(c.hash AS hash, array_join({full}, '\\n') AS chunk)))[0]")
    texts = with_lists.where(F.col(listed).isNotNull()).select(F.explode(several).alias("c")).select("c.hash", "c.chunk").groupBy("hash", "chunk").count()
    if texts.groupBy("hash").count().where("count > 1").limit(1).count():  # one hash for several texts: hash anew
        return drop_repeated_lines(docs, id_column, text_column, seed + 1)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_column):
            at = batch.schema.get_field_index(text_column)
            texts, lines, removed = [], [], []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(listed).to_pylist(), strict=True):
                parts, gone = (text or "").split("\n"), set()
                for c in found or ():
                    if not c["stays"]:
                        gone.update(range(c["first"], c["first"] + c["n"]))
                texts.append("\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else text)
                lines.append(len(parts))
                removed.append(len(gone))
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns) if batch.schema.names[i] != listed]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], names=[*(x for x in batch.schema.names if x != listed), "lines", "removed_lines"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lines", T.LongType()), T.StructField("removed_lines", T.LongType())])
    found = with_lists.mapInArrow(remove, schema)
    if not few:
        return found
    stays = keyed.join(names, (keyed[key] == names[key]) & keyed[id_column].cast("long").eqNullSafe(names[list_id]) & (_tag(keyed[text_column]) == names[list_tag]), "left_anti").drop(key)
    return found.unionByName(stays.withColumns({"lines": F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)).cast("long"), "removed_lines": F.lit(0).cast("long")}))
