"""The registered queries of this subpackage, and their SQL where SQL can say the same.

Each applies its operator to its whole table. Null texts are empty ones; empty and very long texts, ties, repeated
rows and empty tables have the results that the operator's docstring states; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import conversations, fingerprints, jaccard, line_dedup, media, merkle, oracles, packing, pieces, quality, secrets, simhash, token_files, url_rules
from scorewright.llm.common import documents, shared_dir, through_files, whole_text

#: The vocabularies that the token queries use.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact fingerprints of whole texts and of texts with their last half replaced by the next document's beginning."""
    return fingerprints.spliced(documents(spark, sf_dir))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and checksums of every text's pieces, and whether decoding gives the text back."""
    coded = pieces.recode_pieces(documents(spark, sf_dir).select("doc_id", "text"), PIECES)
    return coded.select("doc_id", (F.length("piece_ids") / 4).cast("long").alias("n_pieces"), F.crc32("piece_ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == whole_text()).alias("same_text"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to files in order of doc_id and read back: where each begins, how many, and their checksum."""
    path = shared_dir(spark)
    token_files.write_ids(documents(spark, sf_dir), path, WORD_BPE, end_id=2)
    return token_files.summarise(token_files.read_ids(spark, path))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 2048 ids."""
    packed = packing.pack(documents(spark, sf_dir), WORD_BPE, window=2048, end_id=1)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document, and whether the pipeline would keep it."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model)
    kept = (F.col("p_good") >= quality.LEAST_GOOD) & (F.col("p_above_toxic") >= 0.5)
    return scored.select("doc_id", *(F.round(c, 6).alias(c) for c in quality.SCORES), kept.alias("kept"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles of every document, and the smallest id that links of three bits reach."""
    found = simhash.near_duplicates(documents(spark, sf_dir), words=3, distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as samples of a WAV, sniffed and read back: digests and a feature."""
    stored = through_files(media.store_texts(documents(spark, sf_dir)))
    return media.describe(media.sniff(stored))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the site's and the own rules on every page's URL."""
    judged = url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    site = [r.text for r in url_rules.SITE_RULES]
    return judged.select("page_id", "host", "path", F.when(F.col("rule").isin(site), F.col("rule")).alias("rule"), "verdict")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate for a secret in every text, with its place and the forest's probability."""
    found = secrets.find_secrets(documents(spark, sf_dir), secrets.default_model(spark))
    return found.select("doc_id", "start", "length", "shape", F.sha2("candidate", 256).alias("candidate_sha256"), "probability", "is_secret")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, how many of them repeat earlier passages, and a digest of what stays."""
    found = line_dedup.drop_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "lines", "removed_lines", F.char_length(whole_text()).cast("long").alias("n_chars"), F.sha2(whole_text(), 256).alias("text_sha256"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its tree's root and the root of all, its proof, and whether a tampered text is told by it."""
    docs = documents(spark, sf_dir)
    fields = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(changed, fields(F.translate("text", UPPER, UPPER.lower())))
    rows = docs.select("doc_id", "lang", fields(F.col("text")).alias("leaf"), tampered.alias("tampered"))
    proven = merkle.proofs(rows, other_column="tampered")
    folded = merkle.folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root")
    told = proven.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded)
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage by rule: its faults, the cheapest repair and the digest of what that gives."""
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    damage = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(damage == 1, "").when(damage == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(damage == 4, "user").otherwise(blank("role"))
    rows = told.where(damage != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(damage == 3, 2).otherwise(1))).alias("copy"))
    repaired = conversations.repair(rows.drop("copy")).withColumnRenamed("conv_id", "_conv")
    every = told.select("conv_id").distinct().join(repaired, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of every document's set of three-word shingles, and the smallest id that links of 0.9 reach."""
    return jaccard.jaccard_join(documents(spark, sf_dir), words=3, percent=90)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_pieces": op2_pieces,
    "op3_token_files": op3_token_files,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_media": op7_media,
    "op8_url_rules": op8_url_rules,
    "op9_secrets": op9_secrets,
    "op10_line_dedup": op10_line_dedup,
    "op11_manifest": op11_manifest,
    "op12_repair": op12_repair,
    "op13_jaccard": op13_jaccard,
}

ORACLE_SQL: dict[str, str] = {
    "op11_manifest": oracles.manifest(),
    "op12_repair": oracles.repair(),
    "op13_jaccard": oracles.jaccard(),
    "op8_url_rules": r"""
WITH cut AS (
  SELECT page_id, lower(coalesce(url, '')) AS low,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, low,
         translate(coalesce(regexp_extract(rest, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(low, '(^|[^a-z0-9])(spam-farm|casino|porn|xxx|viagra|adserver|doubleclick|tracker|ads|malware|phishing|clickbait)([^a-z0-9]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
""",
}
