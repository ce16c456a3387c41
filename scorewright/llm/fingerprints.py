"""Exact fingerprints of canonical texts, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import hot_keys, join_unique, through_files


def canonical(text: Column) -> Column:
    """The text in Unicode normal form KC, case folded, runs of white space as one space, none at the ends; null as empty.

    Normal form and full case folding (the sharp s becomes ss) are ICU's, which Spark ships, by Spark's `reflect`;
    folding can undo the normal form, so that it is made again. ASCII texts need neither, only lower case.
    """
    whole = F.coalesce(text, F.lit(""))
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = compose(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(whole), F.lit(True)))
    form = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(folded)
    return F.trim(F.regexp_replace(form, r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+", " "))


def digest(canonical_text: Column) -> Column:
    """128 bits as 32 hexadecimal digits: two XXH64 of the canonical text under different seeds."""
    halves = [F.xxhash64(F.lit(lane), canonical_text) for lane in (0x5EED, 0xC0FFEE)]  # the lane's hash seeds the text's
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in halves)))


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text: equal for texts that are equal up to Unicode form, case and white space."""
    return digest(canonical(text))


def neighbours(narrow: DataFrame) -> DataFrame:
    """For each row of (doc_id, tag, ...), the row after it in descending doc_id, then tag, as struct `next`, and the one before as `prev`.

    After the last comes the first. Rows are sorted by range and numbered within their partition; a count per
    partition (as many rows as partitions) makes that a rank, and ranks are joined.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("tag")]
    placed = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = through_files(placed.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"), F.sum("count").over(Window.partitionBy()).alias("total"))
    ranked = placed.join(F.broadcast(parts), "part").withColumn("rank", F.col("earlier") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    row = F.struct(*narrow.columns)
    following = ranked.select(F.expr("(rank + total - 1) % total").alias("rank"), row.alias("next"))
    leading = ranked.select(F.expr("(rank + 1) % total").alias("rank"), row.alias("prev"))
    return ranked.join(following, "rank").join(leading, "rank").select(*narrow.columns, "next", "prev")


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, tag, n_chars, fingerprint) of every distinct (id, text); tag is a hash of the raw text. A table without texts, in the shared folder."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.char_length(text).cast("long").alias("n_chars"), fingerprint(text).alias("fingerprint"))
    return through_files(narrow)


def grouped_by_bytes(texts: DataFrame, names: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """(doc_id, tag, group_id) from rows (doc_id, tag, fingerprint, c) with canonical texts c whose fingerprint several rows share.

    Rows are grouped by digest and bytes, each task passing on one row per text; group_id is the least doc_id. A
    digest of one text names its group; where texts clash under a digest, rows find their group by the text. `names`
    are the same rows without c, where they can be had without texts; `hot` the digests that many rows share.
    """
    exact = texts.groupBy("fingerprint", "c").agg(F.min("doc_id").alias("group_id"))
    by_digest = exact.groupBy("fingerprint").agg(F.min("group_id").alias("group_id"), F.count("*").alias("texts"))
    names = (texts if names is None else names).select("doc_id", "tag", "fingerprint")
    plain = join_unique(names, by_digest.where("texts = 1"), "fingerprint", hot).select("doc_id", "tag", "group_id")
    clash = by_digest.where("texts > 1").select("fingerprint")
    apart = texts.join(clash, "fingerprint").join(exact, ["fingerprint", "c"]).select("doc_id", "tag", "group_id")
    return plain.union(apart)


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint, group_id) of every distinct (id, text): group_id is the least id with the same canonical text, byte for byte.

    Null texts are empty; a null id is greater than any other; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    full = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), canonical(text).alias("c")).withColumn("fingerprint", digest(F.col("c")))
    groups = grouped_by_bytes(full)
    names = full.select("doc_id", "tag", "fingerprint").distinct()
    match = names.doc_id.eqNullSafe(groups.doc_id) & (names.tag == groups.tag)
    return names.join(groups.distinct(), match).select(names.doc_id, "fingerprint", "group_id")


def spliced(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per distinct (id, text): fingerprints of the text and of an edited text, and how alike they are.

    The edited text has the last half of the text replaced by as much of the next document's beginning, in descending
    order of id (after the last comes the first; null ids come last; of rows with the same id the text's hash decides,
    and repeated rows count as one document). Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (1.0 for equal fingerprints, else 0.0, as exact digests go), and
    group_id, the least doc_id whose canonical text is the same byte for byte. Null texts are empty; an empty table
    gives no rows; other columns are ignored.

    Narrow tables settle order, neighbours and shared fingerprints. Texts then move once, to their key; from there
    only beginnings go to the document before, and texts of shared fingerprints are grouped by their bytes.
    """
    narrow = fingerprint_documents(docs, id_column, text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    distinct = narrow.distinct()
    if narrow.count() != distinct.count():
        rows = rows.distinct()
    counts = through_files(distinct.groupBy("fingerprint").agg(F.count("*").alias("copies")))
    hot = hot_keys(counts, "fingerprint")
    facts = through_files(join_unique(neighbours(distinct), counts.select("fingerprint", (F.col("copies") > 1).alias("shared")), "fingerprint", hot))
    keyed = facts.withColumns({"key": F.xxhash64("doc_id", "tag"), "prev_key": F.xxhash64("prev.doc_id", "prev.tag")})
    texts = rows.withColumn("_tag", F.xxhash64("_text")).withColumn("key", F.xxhash64("_id", "_tag"))
    located = keyed.join(texts, "key").where(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")))
    head = F.expr("substring(_text, 1, cast(n_chars - n_chars div 2 as int))")
    kept = located.select("key", "doc_id", "tag", "n_chars", "fingerprint", "shared", F.col("next.fingerprint").alias("next_fingerprint"), head.alias("head"))
    lent = located.select(F.col("prev_key").alias("key"), F.col("prev.doc_id").alias("_prev_id"), F.col("prev.tag").alias("_prev_tag"), F.expr("substring(_text, 1, cast(prev.n_chars div 2 as int))").alias("tail"))
    edited = kept.join(lent, "key").where(F.col("doc_id").eqNullSafe(F.col("_prev_id")) & (F.col("tag") == F.col("_prev_tag"))).withColumn("edited", F.concat("head", "tail"))
    groups = grouped_by_bytes(located.where("shared").select("doc_id", "tag", "fingerprint", canonical(F.col("_text")).alias("c")), facts.where("shared"), hot)
    groups = groups.select(F.xxhash64("doc_id", "tag").alias("key"), F.col("doc_id").alias("_group_of"), F.col("tag").alias("_group_tag"), "group_id")
    same = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    out = edited.select("key", "doc_id", "tag", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint", "shared")
    out = out.join(groups, (out.key == groups.key) & out.doc_id.eqNullSafe(F.col("_group_of")) & (out.tag == F.col("_group_tag")), "left")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_fingerprint").alias("near_next"), F.when(F.col("shared"), F.col("group_id")).otherwise(F.col("doc_id")).alias("group_id"))
