"""Queries of agents' profiles, and of what judges write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import judging
from scorewright.operators import audits, composites, profiles, ratings
from scorewright.plans import views
from scorewright.plans.audits import _TAXONOMY
from scorewright.plans.tables import _FILES, _score_files
from scorewright.plans.texts import HOSTS
from scorewright.plans.views import QUALITY_SQL, REPORTS_SQL, SCORES_SQL
from scorewright.registry import query, table

_PILLARS = ["url", "reach", "chk", "cit", "depth", "pres"]
_V2 = f"reach * (0.5 + 0.5 * qm) * (0.5 + 0.5 * nli) * {QUALITY_SQL}"


def _factored(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = composites.weighted(composites.QUALITY)
    return views.scores(spark, sf_dir).withColumn("composite", composites.factored(quality))


@query("pillar_profiles", f"WITH {SCORES_SQL} SELECT agent, count(*) AS pairs, round(avg({_V2}) + 1e-9, 4) AS mean, round(median({_V2}) + 1e-9, 4) AS median, " + ", ".join(f"round(avg({p}) + 1e-9, 3) AS avg_{p}" for p in _PILLARS) + " FROM scores GROUP BY 1")
def pillar_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.pillar_profiles(_factored(spark, sf_dir), _PILLARS)


@query("citation_styles", rf"""WITH {REPORTS_SQL}, n AS (SELECT doc_id % 8 AS form, len(regexp_extract_all(md, '(?m)^\s*\[\d{{1,3}}\]\s*\.?\s*(?:[-:.]\s*)?http')) AS numbered, len(regexp_extract_all(md, '\[[^\]]+\]\(http[^)]+\)')) AS markdown FROM reports),
g AS (SELECT form, count(*) AS pairs, sum(numbered)::BIGINT AS numbered, sum(markdown)::BIGINT AS markdown FROM n GROUP BY 1) SELECT *, CASE WHEN markdown > numbered * 1.5 THEN 'markdown' WHEN numbered > markdown * 1.5 THEN 'numbered' ELSE 'mixed' END AS style FROM g""")  # fmt: skip
def citation_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of one form as those of one agent."""
    return profiles.citation_styles(views.reports(spark, sf_dir).withColumn("form", F.col("doc_id") % 8), "form")


@query("composite_drift", f"""WITH {SCORES_SQL}, d AS (SELECT agent, round(abs(round({_V2} + 1e-9, 4) - round(CASE chars % 4 WHEN 0 THEN 0 WHEN 1 THEN {_V2} + 0.0005 ELSE {_V2} END + 1e-9, 4)), 6) AS d FROM scores)
SELECT agent, count(*) AS pairs, count(*) FILTER (d > 0.001) AS drifts, coalesce(max(d) FILTER (d > 0.001), 0) AS max_drift FROM d GROUP BY 1""")  # fmt: skip
def composite_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored composites of which a quarter is lost, and another a little off."""
    rows = _factored(spark, sf_dir)
    stored = F.when(F.col("chars") % 4 == 0, F.lit(None)).when(F.col("chars") % 4 == 1, F.col("composite") + 0.0005).otherwise(F.col("composite"))
    return profiles.composite_drift(rows.withColumn("stored", stored), "stored", F.col("composite"))


_DAYS = [f"2024-01-{d:02d}" for d in range(1, 8)]


@query("score_matrix", f"""WITH {SCORES_SQL}, c AS (SELECT agent, task, round({_V2} + 1e-9, 6) AS c FROM scores WHERE runs % 4 > 0)
SELECT agent, {', '.join(f"max(c) FILTER (task = '{d}') AS d{k}" for k, d in enumerate(_DAYS))}, round(coalesce(avg(c) FILTER (task IN ({', '.join(repr(d) for d in _DAYS)})), 0) + 1e-9, 6) AS mean FROM c GROUP BY 1""")  # fmt: skip
def score_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composites by agent and task for a board's week, runs that lack left open."""
    rows = _factored(spark, sf_dir).where("runs % 4 > 0").withColumn("composite", F.round(F.col("composite") + 1e-9, 6))
    return profiles.matrix(rows, _DAYS).withColumnsRenamed({d: f"d{k}" for k, d in enumerate(_DAYS)})


_END = lambda way: f"(SELECT string_agg(task, ',' ORDER BY r) FROM (SELECT task, row_number() OVER (ORDER BY c {way}, task) AS r FROM s t WHERE t.agent = g.agent) WHERE r <= 3)"


@query("agent_drilldown", f"WITH {SCORES_SQL}, s AS (SELECT *, round({_V2} + 1e-9, 6) AS c, CASE WHEN chars % 3 > 0 THEN depth END AS seen FROM scores), g AS (SELECT agent, count(*) AS tasks, round(avg(url) + 1e-9, 4) AS avg_url, round(avg(seen) + 1e-9, 4) AS avg_seen FROM s GROUP BY 1) SELECT *, {_END('DESC')} AS best, {_END('ASC')} AS worst FROM g")
def agent_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _factored(spark, sf_dir).withColumns({"composite": F.round(F.col("composite") + 1e-9, 6), "seen": F.when(F.col("chars") % 3 > 0, F.col("depth"))})
    found = profiles.drilldown(rows, ["url", "seen"])
    tasks = lambda c: F.array_join(F.transform(c, lambda x: x["task"]), ",")
    return found.select("agent", "tasks", "avg_url", "avg_seen", tasks(F.col("best")).alias("best"), tasks(F.col("worst")).alias("worst"))


@query("gap_statistics", f"WITH {SCORES_SQL}, b AS (SELECT agent, round(avg({_V2}) + 1e-9, 6) AS r FROM scores GROUP BY 1), g AS (SELECT r - lead(r) OVER (ORDER BY r DESC, agent) AS gap FROM b) SELECT count(gap) AS gaps, round(min(gap), 6) AS least, round(avg(gap), 6) AS mean FROM g")
def gap_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = _factored(spark, sf_dir).groupBy("agent").agg(F.round(F.avg("composite") + 1e-9, 6).alias("rating"))
    return profiles.gap_statistics(board)


@query("top_flags", _TAXONOMY + ", f AS (SELECT doc_id % 8 AS style, unnest(list_filter(string_split(flags, ','), lambda x: x <> '')) AS fault FROM faults), c AS (SELECT style, fault, count(*) AS n FROM f GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY style ORDER BY n DESC, fault) AS place FROM c) WHERE place <= 3")
def top_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    faults = audits.taxonomy(views.reports(spark, sf_dir), list(HOSTS)).withColumn("style", F.col("doc_id") % 8)
    return profiles.top_flags(audits.flag_counts(faults, "style"), "style", 3)


@query("agent_pairs", f"WITH {SCORES_SQL}, b AS (SELECT agent, avg(url) - stddev_samp(url) / 4 AS lo, avg(url) + stddev_samp(url) / 4 AS hi FROM scores GROUP BY 1) SELECT x.agent AS a, y.agent AS b, greatest(y.lo - x.hi, x.lo - y.hi) > 0 AS apart, round(greatest(y.lo - x.hi, x.lo - y.hi), 1) AS gap FROM b x JOIN b y ON x.agent < y.agent")
def agent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of agents, and whether their intervals are apart."""
    half = F.stddev_samp("url") / 4
    return ratings.agent_pairs(views.scores(spark, sf_dir).groupBy("agent").agg((F.avg("url") - half).alias("elo_lo"), (F.avg("url") + half).alias("elo_hi")))


_WROTE = "CASE event_id % 4 WHEN 0 THEN '1. PASS - fine' || chr(10) || '2) fail: no' || chr(10) || '3. PASS' WHEN 1 THEN 'PASS' || chr(10) || 'FAIL' || chr(10) || 'FAIL' || chr(10) || 'NOTES: PASS' WHEN 2 THEN '<think>PASS</think>2. PASS only this' ELSE 'nothing' END"


@query("judge_verdicts", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'PFP' WHEN 1 THEN 'PFF' WHEN 2 THEN 'FPF' ELSE 'FFF' END AS verdicts, CASE event_id % 4 WHEN 0 THEN 'fine|no|' WHEN 1 THEN '||' WHEN 2 THEN 'judge did not emit a verdict|only this|judge did not emit a verdict' ELSE 'judge did not emit a verdict|judge did not emit a verdict|judge did not emit a verdict' END AS reasons FROM events")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three verdicts from what a judge wrote for each event, in four ways of writing."""
    wrote = table(spark, sf_dir, "events").selectExpr("event_id", f"{_WROTE} AS wrote")
    read = wrote.select("event_id", judging.verdicts(judging.without_thinking(F.col("wrote")), 3).alias("v"))
    return read.select("event_id", F.array_join(F.transform("v", lambda v: F.when(v["passed"], "P").otherwise("F")), "").alias("verdicts"), F.array_join(F.transform("v", lambda v: v["reason"]), "|").alias("reasons"))


_V4 = "reach * (" + " + ".join(f"{w} * {n}" for n, w in composites.V4.items()) + ")"
_MEASURES = ["sd", "pb", "fe", "ic", "reach", "url", "chk"]
_BOTH = f"{SCORES_SQL}, v AS (SELECT * EXCLUDE (sd), CASE WHEN chars % 4 > 0 THEN sd END AS sd, CASE WHEN chars % 6 > 0 THEN {_V2} ELSE 0 END AS v2, CASE WHEN chars % 6 > 0 THEN {_V4} END AS v4 FROM scores)"


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows with two composites; a sixth are placeholders, and a quarter lack a pillar."""
    there = F.col("chars") % 6 > 0
    rows = _factored(spark, sf_dir).withColumns({"v2": F.when(there, F.col("composite")).otherwise(0.0), "v4": F.when(there, F.col("reach") * composites.weighted(composites.V4))})
    return rows.withColumn("sd", F.when(F.col("chars") % 4 > 0, F.col("sd")))


@query("version_summary", f"WITH {_BOTH}, g AS (SELECT agent, count(*) AS n_runs, round(avg(v2) + 1e-9, 4) AS v2_mean, round(avg(v4) + 1e-9, 4) AS v4_mean, " + ", ".join(f"round(avg({m}) + 1e-9, 4) AS avg_{m}" for m in _MEASURES) + " FROM v WHERE v2 > 0 OR v4 > 0 GROUP BY 1) SELECT *, round(v4_mean - v2_mean, 4) AS delta FROM g")
def version_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.version_summary(_both(spark, sf_dir), "v2", "v4", _MEASURES)


@query("largest_changes", f"WITH {_BOTH}, r AS (SELECT agent, task, round(v2 + 1e-9, 6) AS v2, round(v4 + 1e-9, 6) AS v4 FROM v WHERE v2 > 0 AND v4 IS NOT NULL), d AS (SELECT *, round(v4 - v2, 6) AS delta FROM r) SELECT * FROM (SELECT *, row_number() OVER (ORDER BY abs(delta) DESC, agent, task) AS place FROM d) WHERE place <= 15")
def largest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen runs that another composite moves most."""
    rows = _both(spark, sf_dir).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("v2", "v4")})
    return profiles.largest_changes(rows, "v2", "v4")


_SHORT = "(answer_chars = 0 OR (answer_chars < 600 AND reach = 0 AND chk = 0))"
_COUNTED = ", ".join(f"count(*) FILTER (reason IS NOT NULL AND {c}) || ' {n}'" for n, c in (("short", _SHORT), ("infra", "infra_failure"), ("judge_err", "ck_error AND ad_error AND pres_error")))
_AUDIT = f"""{_FILES}, audited AS (SELECT agent, count(*) AS files, count(*) FILTER (reason IS NULL) AS kept, count(reason) AS dropped, round(avg(c) FILTER (reason IS NULL) + 1e-9, 6) AS mean, round(median(c) FILTER (reason IS NULL) + 1e-9, 6) AS median, round(avg(c / 2) FILTER (reason IS NULL) + 1e-9, 6) AS mean_v1, round(avg(answer_chars), 4) AS mean_chars,
count(*) FILTER (reach = 0) AS reach_0, count(*) FILTER (reach >= 0.999) AS reach_1, count(*) FILTER (ck_error) AS judge_errors, concat_ws(', ', {_COUNTED}) AS reasons FROM d GROUP BY 1)"""  # fmt: skip


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.audit_table(_score_files(spark, sf_dir).withColumn("v1", F.col("composite") / 2))


@query("audit_table", f"WITH {_AUDIT} SELECT * FROM audited")
def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit(spark, sf_dir)


@query("audit_panel", f"WITH {_AUDIT}, p AS (SELECT sum(files)::BIGINT AS files, sum(kept)::BIGINT AS kept, sum(dropped)::BIGINT AS dropped, coalesce(string_agg(agent, ', ' ORDER BY agent) FILTER (kept > 0), '') AS ranked, coalesce(string_agg(agent, ', ' ORDER BY agent) FILTER (kept = 0), '') AS excluded FROM audited) SELECT *, CASE WHEN dropped = 0 AND excluded = '' THEN 'PASS' WHEN excluded <> '' OR dropped > files * 0.3 THEN 'FAIL' ELSE 'WARN' END AS verdict FROM p")
def audit_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict over all score rows."""
    return profiles.audit_panel(_audit(spark, sf_dir))
