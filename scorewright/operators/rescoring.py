"""Parts of stored score documents judged anew: named pillars are replaced, composites folded again, versions kept as snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators.composites import QUALITY, V3

# The composite before reach counted, and the places that stored composites have.
LEGACY, PLACES = {"url": 0.50, "chk": 0.35, "spc": 0.15}, 4

#: Where a document has what composites call by short names.
_FIELDS = {"url": "url_coverage", "reach": "url_reachability", "qm": "quote_match", "nli": "claim_nli", "cit": "citation_alignment", "depth": "analysis_depth", "pres": "presentation"}


def _parts() -> dict[str, Column]:
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    form = sum((F.coalesce(F.col(f"markdown_spec.{k}"), F.lit(False)).cast("int") for k in ("words_ok", "citations_ok", "paragraphs_ok")), F.lit(0)) / 3.0
    return {short: zero(f"{long}.score") for short, long in _FIELDS.items()} | {"chk": zero("checklist.pass_rate"), "spc": form}


def folded() -> dict[str, Column]:
    """Every field of a document's composite, from its pillars; missing ones count as zero."""
    x = _parts()
    weighted = lambda weights: reduce(lambda a, b: a + b, (F.lit(w) * x[n] for n, w in weights.items()))
    quality, by_quotes, by_claims, gate, raw = weighted(QUALITY), 0.5 + 0.5 * x["qm"], 0.5 + 0.5 * x["nli"], F.greatest(F.lit(0.1), x["reach"]), weighted(V3)
    truth = x["reach"] * by_quotes * by_claims
    found = {
        "spec_pass_fraction": x["spc"], "quality_score": quality, "truth_factor": truth, "qm_factor": by_quotes, "nli_factor": by_claims, "grounding_gate": gate, "raw_score_v3": raw,
        "citation_alignment": x["cit"], "analysis_depth": x["depth"], "presentation": x["pres"], "composite_v3": gate * raw, "composite_score": truth * quality, "composite_v2": truth * quality,
        "composite_v1": x["reach"] * quality, "legacy_composite": weighted(LEGACY),
    }
    return {n: F.round(c + 1e-9, PLACES) for n, c in found.items()}


def _empty(documents: DataFrame, name: str) -> Column:
    """A struct like the column's whose fields are all null."""
    return F.from_json(F.lit("{}"), documents.schema[name].dataType)


def refolded(documents: DataFrame) -> DataFrame:
    """documents with their composite's fields recomputed; other fields that the composite has stay."""
    fields = folded()
    if "composite" not in documents.columns:
        return documents.withColumn("composite", F.struct(*(c.alias(n) for n, c in fields.items())))
    kept = F.coalesce("composite", _empty(documents, "composite"))
    return documents.withColumn("composite", reduce(lambda struct, n: struct.withField(n, fields[n]), fields, kept))


def stored(documents: DataFrame, *key: str) -> DataFrame:
    """documents as their first version: folded, and without anything rescored. `key` names a document."""
    return refolded(documents).withColumn("version", F.lit(1))


def rescored(documents: DataFrame, fresh: DataFrame, pillars: list[str], *key: str) -> DataFrame:
    """documents with the named pillars of `fresh` (key and pillars, a row a document) in the place of theirs, and all composites folded again.

    score, passed and details are replaced and further fields of a pillar stay; a pillar that is null in fresh stays as it is. A document
    that changes goes up one version, and its rescore_meta has old_ and new_ scores of the pillars and of composite_v2
    and composite_v3. Documents without a row in fresh stay the same to the byte, their version and rescore_meta too.
    """
    meta = [f"{when}_{p}" for p in [*pillars, "composite_v2", "composite_v3"] for when in ("old", "new")]
    given = fresh.select(*key, F.struct(*pillars).alias("_fresh"))
    rows = documents.join(given, list(key), "left")
    changes = reduce(lambda a, b: a | b, (F.col(f"_fresh.{p}").isNotNull() for p in pillars))
    rows = rows.withColumn("_changes", F.coalesce(changes, F.lit(False))).withColumns({f"_old_{p}": F.col(f"{p}.score") for p in pillars} | {f"_old_{c}": F.col(f"composite.{c}") for c in ("composite_v2", "composite_v3")}).withColumn("_composite", F.col("composite"))
    for p in pillars:
        new = F.col(f"_fresh.{p}")
        replaced = reduce(lambda struct, f, new=new: struct.withField(f, new[f]), [f.name for f in given.schema["_fresh"].dataType[p].dataType.fields], F.coalesce(F.col(p), _empty(documents, p)))
        rows = rows.withColumn(p, F.when(new.isNotNull(), replaced).otherwise(F.col(p)))
    rows = refolded(rows)
    rows = rows.withColumn("composite", F.when(F.col("_changes"), F.col("composite")).otherwise(F.col("_composite")))
    now = {p: F.col(f"{p}.score") for p in pillars} | {c: F.col(f"composite.{c}") for c in ("composite_v2", "composite_v3")}
    told = F.struct(*((F.col(f"_{m}") if m.startswith("old") else now[m[4:]]).cast("double").alias(m) for m in meta))
    before = F.col("rescore_meta") if "rescore_meta" in documents.columns and documents.schema["rescore_meta"].dataType.fieldNames() == meta else F.lit(None)
    return rows.withColumns({"rescore_meta": F.when(F.col("_changes"), told).otherwise(before), "version": F.col("version") + F.col("_changes").cast("int")}).drop(*(c for c in rows.columns if c.startswith("_")))


def refolded_runs(runs: DataFrame, pillar: str, fresh: Column, weights: dict[str, float]) -> DataFrame:
    """Run records (pillars as a map of structs with a score) with one pillar set to `fresh` where that isn't null, and composite the weighted mean of the pillars that a run has; null if none has a weight."""
    wanted = F.create_map(*(F.lit(x) for n, w in weights.items() for x in (n, w)))
    others = F.map_filter(F.coalesce("pillars", F.create_map().cast(runs.schema["pillars"].dataType)), lambda k, v: (k != pillar) | fresh.isNull())
    rows = runs.withColumn("pillars", F.when(fresh.isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit(pillar), fresh))))
    weight = lambda e: F.coalesce(F.element_at(wanted, e["key"]), F.lit(0.0))
    total = F.aggregate(F.map_entries("pillars"), F.lit(0.0), lambda a, e: a + weight(e))
    points = F.aggregate(F.map_entries("pillars"), F.lit(0.0), lambda a, e: a + weight(e) * F.coalesce(e["value"]["score"].cast("double"), F.lit(0.0)))
    return rows.withColumn("composite", F.round(points / F.nullif(total, F.lit(0.0)) + 1e-9, PLACES))


class Snapshots:
    """Versions of a table below a folder, each whole and never changed; a reader takes the last, or pins one.

    A version counts once its write has ended. One writer at a time: a second that takes the same number fails.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/version=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def write(self, df: DataFrame) -> int:
        """Adds df as the next version, whose number is returned."""
        version = (self.versions() or [0])[-1] + 1
        df.write.parquet(f"{self.path}/version={version}")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"no version {version}" if known else "no version yet")
        return self.spark.read.parquet(f"{self.path}/version={known[-1] if version is None else version}")
