"""Evidence for claims: entailment by chunks of pages, rows found by a prefix of their name, verifiers of several kinds in one pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and those that it has in common with the one before.
CHUNK, OVERLAP = 8000, 500

#: What a verifier that breaks down counts as.
NEUTRAL = 0.5


def digest(text: Column) -> Column:
    """How verdicts name a claim or a chunk: MD5 of its UTF-8."""
    return F.md5(text.cast("binary"))


def chunked(pages: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(url, place, chunk_hash, chunk) of whole pages (url, body): chunks of `size` characters, each beginning `overlap` before the last one's end.

    A page is cut once, however many claims cite it. Of several bodies of a URL the least counts; null and empty pages have no chunks.
    """
    one = pages.groupBy("url").agg(F.min("body").alias("body")).where("body != ''")
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("body") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    cut = one.select("url", F.posexplode(F.transform(starts, lambda s: F.substring(F.col("body"), s + 1, F.lit(size)))).alias("place", "chunk"))
    return cut.select("url", "place", digest(F.col("chunk")).alias("chunk_hash"), "chunk")


def to_judge(claims: DataFrame, chunks: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(claim_hash, chunk_hash): what a judge is still to be asked, each pair once: claims (claim, url) against the chunks of the pages they cite."""
    met = claims.select(digest(F.col("claim")).alias("claim_hash"), "url").distinct().join(chunks.select("url", "chunk_hash").distinct(), "url").select("claim_hash", "chunk_hash").distinct()
    return met if verdicts is None else met.join(verdicts, ["claim_hash", "chunk_hash"], "left_anti")


def entailment(claims: DataFrame, chunks: DataFrame, verdicts: DataFrame, *id_columns: str) -> DataFrame:
    """(id, total_claims, supported_claims, no_page, unjudged, precision): the share of claims (id, claim, url) that some chunk of their page entails.

    verdicts (claim_hash, chunk_hash, supported) come from outside; a pair without one doesn't support. Claims count as
    often as they are made. Pages stay where they are: only hashes meet, each claim and page once, and a claim's
    verdicts are folded before they go back to it.
    """
    asked = claims.select(*id_columns, digest(F.col("claim")).alias("claim_hash"), "url")
    pairs = asked.select("claim_hash", "url").distinct()
    held = chunks.select("url", "chunk_hash").distinct()
    judged = pairs.join(held, "url").join(verdicts.groupBy("claim_hash", "chunk_hash").agg(F.bool_or("supported").alias("supported")), ["claim_hash", "chunk_hash"], "left")
    best = judged.groupBy("claim_hash", "url").agg(F.coalesce(F.bool_or("supported"), F.lit(False)).alias("held"), F.count_if(F.col("supported").isNull()).alias("open"))
    met = asked.join(best, ["claim_hash", "url"], "left")
    total, supported = F.count("*"), F.count_if(F.coalesce("held", F.lit(False)))
    return met.groupBy(*id_columns).agg(total.alias("total_claims"), supported.alias("supported_claims"), F.count_if(F.col("held").isNull()).alias("no_page"), F.count_if(~F.col("held") & (F.col("open") > 0)).alias("unjudged"), F.round(supported / total + 1e-9, 3).alias("precision"))


def by_prefix(subjects: DataFrame, names: DataFrame, carry: list[str], length: int = 60, subject_column: str = "subject", name_column: str = "name", id_column: str = "id") -> DataFrame:
    """subjects with the row of `names` whose name begins with the subject's first `length` characters: its id and `carry`; of several the least id, null if none.

    Each name is offered under its beginnings of just those lengths that subjects have, `length` + 1 at most, and only
    one row a beginning goes on; so the look-up is a join of equals, whatever names begin alike. A null subject finds
    nothing, an empty one the least id of all.
    """
    prefix = F.left(F.col(subject_column), F.lit(length))
    wanted = subjects.select(prefix.alias("_prefix")).where("_prefix is not null").distinct()
    lengths = wanted.agg(F.collect_set(F.char_length("_prefix")).alias("_lengths"))
    offered = names.where(F.col(name_column).isNotNull()).join(F.broadcast(lengths)).select(F.explode(F.transform(F.filter("_lengths", lambda n: n <= F.char_length(name_column)), lambda n: F.left(F.col(name_column), n))).alias("_prefix"), F.struct(F.col(id_column).alias("found_id"), *carry).alias("_row"))
    hits = offered.join(wanted, "_prefix", "left_semi").groupBy("_prefix").agg(F.min("_row").alias("_row"))
    return subjects.withColumn("_prefix", prefix).join(hits, "_prefix", "left").select(*subjects.columns, "_row.found_id", *(f"_row.{c}" for c in carry))


Check = Callable[[pd.DataFrame], pd.Series]


def _isolated(check: Check, rows: pd.DataFrame) -> tuple[np.ndarray, list[str | None]]:
    """Scores within [0, 1] and errors: rows on which a check breaks down are neutral, found by halving, and the others have what they would have alone."""
    if not len(rows):
        return np.zeros(0), []
    try:
        scores = pd.to_numeric(pd.Series(check(rows)).reset_index(drop=True)).astype(float).fillna(0.0).clip(0.0, 1.0).to_numpy()
        if len(scores) != len(rows):
            raise ValueError(f"{len(scores)} scores for {len(rows)} rows")
        return scores, [None] * len(rows)
    except Exception as error:  # noqa: BLE001  whatever a verifier raises
        if len(rows) == 1:
            return np.array([NEUTRAL]), [f"{type(error).__name__}: {error}"]
        half = len(rows) // 2
        parts = [_isolated(check, rows.iloc[:half].reset_index(drop=True)), _isolated(check, rows.iloc[half:].reset_index(drop=True))]
        return np.concatenate([p[0] for p in parts]), parts[0][1] + parts[1][1]


def dispatched(rows: DataFrame, checks: dict[str, Check], fields: list[str], kinds_column: str = "kinds", id_column: str = "id", least: float = 0.5, reads: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, kind, score, passed, error): every kind of check that a row asks for, by functions of its fields (a batch at a time), in one pass.

    A check that raises leaves the other rows of its batch, and the other checks, as they are; its own row is neutral
    and has the error. A kind without a check scores zero and says so. A row without kinds gives none.

    reads: {kind: the fields that its check reads}, simple values. It is asked once for all rows of a batch that are
    alike in these, so that many rows that break down are few calls.
    """
    each = rows.select(id_column, *fields, F.explode(kinds_column).alias("kind"))
    schema = f"{each.select(id_column).schema[id_column].name} {each.schema[id_column].dataType.simpleString()}, kind string, score double, passed boolean, error string"

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            batch = batch.reset_index(drop=True)
            scores, errors = np.zeros(len(batch)), np.array([None] * len(batch), object)
            for kind, part in batch.groupby("kind", dropna=False):
                at = part.index.to_numpy()
                if kind in checks:
                    own, alike = part[fields], np.arange(len(part))
                    if kind in (reads or {}):
                        own = part[reads[kind]]
                        alike = own.groupby(reads[kind], dropna=False, sort=False).ngroup().to_numpy()
                        own = own.iloc[np.unique(alike, return_index=True)[1]]
                    told, why = _isolated(checks[kind], own.reset_index(drop=True))
                    scores[at], errors[at] = told[alike], np.array(why, object)[alike]
                else:
                    errors[at] = f"unsupported kind: {kind}"
            yield pd.DataFrame({id_column: batch[id_column], "kind": batch["kind"], "score": scores, "passed": scores >= least, "error": errors})

    return each.mapInPandas(run, schema)


def combined(rows: DataFrame, results: DataFrame, id_column: str = "id") -> DataFrame:
    """(id, checks, score, passed, errors) of every row: the product of its checks' scores, zero without any."""
    # As a sum of logarithms a product would lose zeros; Spark's keeps them.
    found = results.groupBy(id_column).agg(F.count("*").alias("checks"), F.product("score").alias("score"), F.bool_and("passed").alias("passed"), F.count("error").alias("errors"))
    return rows.select(id_column).distinct().join(found, id_column, "left").fillna({"checks": 0, "score": 0.0, "passed": False, "errors": 0})
