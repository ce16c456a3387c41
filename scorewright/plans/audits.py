"""Queries of plans and audits over score rows, preferences and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators import audits, composites
from scorewright.plans import views
from scorewright.plans.texts import _CANON, _CITED, HOSTS
from scorewright.plans.views import PREFS_SQL, QUALITY_SQL, REPORTS_SQL, SCORES_SQL
from scorewright.registry import query, table

_BOARD = f"{SCORES_SQL}, board AS (SELECT agent, round(avg(reach * {QUALITY_SQL}) + 1e-9, 6) AS rating FROM scores GROUP BY 1), best AS (SELECT agent FROM board ORDER BY rating DESC, agent LIMIT 4), pairs AS (SELECT x.agent AS a, y.agent AS b FROM best x JOIN best y ON x.agent < y.agent)"


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scores(spark, sf_dir).groupBy("agent").agg(F.round(F.avg(F.col("reach") * composites.weighted(composites.QUALITY)) + 1e-9, 6).alias("rating"))


@query("densified_plan", f"""WITH {_BOARD}, common AS (SELECT a, b, list_sort(list(DISTINCT x.task)) AS tasks FROM pairs JOIN scores x ON x.agent = a JOIN scores y ON y.agent = b AND y.task = x.task WHERE x.runs % 3 > 0 AND y.runs % 3 > 0 GROUP BY 1, 2),
d AS (SELECT a, b, tasks, unnest(range(1, 41)) AS draw FROM common)
SELECT a, b, draw::BIGINT AS draw, tasks[1 + (('0x' || substr(md5('17/' || a || '/' || b || '/' || draw), 1, 8))::BIGINT % len(tasks))] AS task, judge FROM d, (VALUES ('j0'), ('j1')) j(judge)""")  # fmt: skip
def densified_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = views.scores(spark, sf_dir).where("runs % 3 > 0").select("agent", "task")
    return audits.densified(_board(spark, sf_dir), runs, ["j0", "j1"], 4, 40).withColumn("draw", F.col("draw").cast("long"))


@query("pair_queue", f"WITH {_BOARD}, t AS (SELECT DISTINCT task FROM scores) SELECT md5('17/' || task || '/' || a || '/' || b) AS place, task, a, b FROM t, pairs")
def pair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.pair_queue(_board(spark, sf_dir), views.scores(spark, sf_dir), 4)


@query("task_coverage", f"""WITH {SCORES_SQL}, r AS (SELECT agent, task, runs % 3 > 0 AS kept FROM scores WHERE runs % 5 > 0), g AS (SELECT CAST(DATE '2024-01-01' + CAST(page_id % 40 AS INT) AS VARCHAR) AS task, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages),
m AS (SELECT task, string_agg(agent, ', ' ORDER BY agent) AS missing FROM ((SELECT task, agent FROM (SELECT DISTINCT task FROM r), (SELECT DISTINCT agent FROM r)) EXCEPT SELECT task, agent FROM r) GROUP BY 1), k AS (SELECT task, count(*) AS must_urls, count(DISTINCT host) AS sources FROM g GROUP BY 1)
SELECT r.task, count(DISTINCT agent) AS scored, count(DISTINCT CASE WHEN kept THEN agent END) AS kept, coalesce(any_value(missing), '') AS missing, coalesce(any_value(must_urls), 0) AS must_urls, coalesce(any_value(sources), 0) AS sources, CASE WHEN coalesce(any_value(must_urls), 0) = 0 THEN 'NO_GOLDEN' WHEN any_value(sources) < 3 THEN 'THIN' ELSE 'OK' END AS status FROM r LEFT JOIN m USING (task) LEFT JOIN k USING (task) GROUP BY 1""")  # fmt: skip
def task_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.scores(spark, sf_dir).where("runs % 5 > 0").select("agent", "task", (F.col("runs") % 3 > 0).alias("kept"))
    golden = table(spark, sf_dir, "pages").select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 40).cast("int")).cast("string").alias("task"), "url")
    return audits.task_coverage(rows, golden)


@query("preference_gaps", f"""WITH {SCORES_SQL}, {PREFS_SQL}, s AS (SELECT agent, round(avg(url) + 1e-9, 6) AS score FROM scores GROUP BY 1), j AS (SELECT pref_id, a, b, winner, CASE WHEN x.score > y.score THEN 'a' WHEN y.score > x.score THEN 'b' END AS predicted, abs(x.score - y.score) AS gap FROM prefs JOIN s x ON x.agent = a JOIN s y ON y.agent = b WHERE winner IN ('a', 'b'))
SELECT pref_id, a, b, winner, predicted, round(gap, 6) AS gap FROM j WHERE predicted <> winner ORDER BY j.gap DESC, pref_id LIMIT 10""")  # fmt: skip
def preference_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = views.scores(spark, sf_dir).groupBy("agent").agg(F.round(F.avg("url") + 1e-9, 6).alias("score"))
    return audits.disagreements(views.prefs(spark, sf_dir).select("pref_id", "a", "b", "winner"), means).withColumn("gap", F.round("gap", 6))


_PATH = lambda u: f"regexp_replace(regexp_extract({u}, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')"
_STEM = lambda u: f"regexp_extract({u}, '^[a-z]+://([^/?#]+)', 1) || '/' || lower(array_to_string(string_split({_PATH(u)}, '/')[greatest(len(string_split({_PATH(u)}, '/')) - 1, 1):], '/'))"


_FAIRNESS = f"""WITH {REPORTS_SQL}, {_CITED}, must AS (SELECT DISTINCT page_id % 3 AS task, {_CANON} AS url FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^(https?)://([^/]+)/', '\\1://\\2/old/') END AS u FROM pages)), d AS (SELECT DISTINCT cu.doc_id, cu.url, task FROM cu JOIN reports USING (doc_id)),
x AS (SELECT doc_id, count(*) AS direct FROM d JOIN must USING (task, url) GROUP BY 1), n AS (SELECT doc_id, count(DISTINCT {_STEM('d.url')}) AS near FROM d JOIN must m ON m.task = d.task AND {_STEM('m.url')} = {_STEM('d.url')} AND m.url <> d.url GROUP BY 1), c AS (SELECT doc_id, count(*) AS cited FROM d GROUP BY 1),
g AS (SELECT r.doc_id, coalesce(cited, 0) AS cited, coalesce(direct, 0) AS direct, coalesce(near, 0) AS near, r.doc_id % 2 AS scored_hits FROM reports r LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN n USING (doc_id))"""


@query("fairness", _FAIRNESS + " SELECT *, CASE WHEN near > 0 AND direct = 0 THEN 'SUSPECT' WHEN scored_hits <> direct THEN 'DRIFT' ELSE 'FAIR' END AS verdict FROM g")
def fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that must be cited, every second one under an old path; the scorer counted a hit for odd ids."""
    return _fairness(spark, sf_dir, scorer_first=False)


@query("fairness_scorer_first", _FAIRNESS + " SELECT g.*, CASE WHEN md = '' OR task = 2 THEN 'SKIP' WHEN scored_hits <> direct THEN 'DRIFT' WHEN near > 0 AND direct = 0 THEN 'SUSPECT' ELSE 'FAIR' END AS verdict FROM (SELECT doc_id, cited, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE direct END AS direct, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE near END AS near, scored_hits FROM g) g JOIN reports USING (doc_id)")
def fairness_scorer_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the order of audits of single pairs; one of the three tasks has nothing that must be cited."""
    return _fairness(spark, sf_dir, scorer_first=True)


def _fairness(spark: SparkSession, sf_dir: str, scorer_first: bool) -> DataFrame:
    reports = views.reports(spark, sf_dir)
    moved = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^(https?)://([^/]+)/", "$1://$2/old/"))
    must = table(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("task"), moved.alias("url"))
    must = must.where("task <> 2") if scorer_first else must
    return audits.fairness(reports, must, reports.select("doc_id", (F.col("doc_id") % 2).alias("hits")), scorer_first=scorer_first)


_HOST = "regexp_extract(lower(u), '^https?://([^/]+)', 1)"
_KNOWN = " OR ".join(f"contains(h, '{h}')" for h in HOSTS)


_TAXONOMY = rf"""WITH {REPORTS_SQL}, l AS (SELECT doc_id, md, len(list_filter(regexp_split_to_array(md, '\s+'), lambda x: x <> '')) AS words, list_transform(regexp_extract_all(md, '\[[^\]]+\]\((https?://[^)\s]+)\)', 1), lambda u: {_HOST}) AS hosts FROM reports),
n AS (SELECT doc_id, words, len(hosts) AS cites, list_distinct(list_filter(hosts, lambda h: h <> '')) AS distinct_hosts, len(list_filter(hosts, lambda h: h <> '' AND NOT ({_KNOWN}))) AS off_sandbox, regexp_matches(md, '(?i)\(placeholder\)|example\.com|wikipedia\.org|\.tavily\.|onestopmarket\.com') AS fake FROM l),
faults AS (SELECT doc_id, CASE WHEN words < 50 THEN 'timeout_or_empty' WHEN fake OR off_sandbox >= 2 OR (cites = 0 AND words >= 200) THEN 'hallucination_url' ELSE 'ok' END AS primary_fault,
array_to_string(list_filter([CASE WHEN cites = 0 THEN 'no_inline_cites' END, 'zero_wiki_cites', CASE WHEN len(distinct_hosts) = 1 THEN 'only_one_source_host' END, CASE WHEN words < 500 THEN 'very_short_report' END, CASE WHEN words > 3500 THEN 'very_long_report' END], lambda x: x IS NOT NULL), ',') AS flags, words, cites, off_sandbox FROM n)"""  # fmt: skip


@query("fault_taxonomy", _TAXONOMY + " SELECT * FROM faults")
def fault_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.taxonomy(views.reports(spark, sf_dir), list(HOSTS))


@query("fault_flags", _TAXONOMY + ", f AS (SELECT doc_id % 8 AS style, unnest(list_concat([{'fault': primary_fault, 'primary': true}], list_transform(list_filter(string_split(flags, ','), lambda x: x <> ''), lambda x: {'fault': x, 'primary': false}))) AS f FROM faults) SELECT style, f.fault AS fault, f.primary AS primary, count(*) AS n FROM f GROUP BY 1, 2, 3")
def fault_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each primary fault, and each flag beside it, is among the reports of a form."""
    faults = audits.taxonomy(views.reports(spark, sf_dir), list(HOSTS)).withColumn("style", F.col("doc_id") % 8)
    return audits.flag_counts(faults, "style")


@query("fault_counts")
def fault_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(style, primary_fault, n): faults by the form of the report, and in all (null style)."""
    faults = audits.taxonomy(views.reports(spark, sf_dir), list(HOSTS)).withColumn("style", F.col("doc_id") % 8)
    return faults.groupingSets([["style", "primary_fault"], ["primary_fault"]], "style", "primary_fault").agg(F.count("*").alias("n"))


@query("board_inversions", f"WITH {SCORES_SQL}, m AS (SELECT agent, round(avg(0.5 * url + 0.35 * chk + 0.15 * spc) + 1e-9, 6) AS o, round(avg(reach * {QUALITY_SQL}) + 1e-9, 6) AS n FROM scores GROUP BY 1), r AS (SELECT agent, row_number() OVER (ORDER BY o DESC, agent) AS old_rank, row_number() OVER (ORDER BY n DESC, agent) AS new_rank FROM m) SELECT *, old_rank - new_rank AS delta FROM r")
def board_inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    legacy = composites.weighted({"url": 0.50, "chk": 0.35, "spc": 0.15})
    means = views.scores(spark, sf_dir).groupBy("agent").agg(F.round(F.avg(legacy) + 1e-9, 6).alias("o"), F.round(F.avg(F.col("reach") * composites.weighted(composites.QUALITY)) + 1e-9, 6).alias("n"))
    return audits.inversions(means, "o", "n", "agent")


_DIMS = "(doc_id % 11) / 10.0"


@query("training_reward", f"""WITH {REPORTS_SQL}, n AS (SELECT doc_id, least(1, (length(md) - length(replace(md, '](', ''))) / 2 / 4) AS proxy, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 7) / 6.0 END AS qm FROM reports),
g AS (SELECT doc_id, coalesce(qm, proxy) AS qm, proxy, 0.2 * ({_DIMS}) + 0.1 * (doc_id % 5) / 4.0 + CASE WHEN doc_id % 2 = 0 THEN 0.7 * 0.5 ELSE 0.2 * 0.1 + 0.2 * 0.5 + 0.1 * 0.9 + 0.2 * 0.3 END AS q FROM n)
SELECT doc_id, round(qm, 6) AS quote_match, round(proxy, 6) AS reach, round(q + 1e-9, 6) AS q_value, round((0.5 + 0.5 * qm) * q + 1e-9, 6) AS composite FROM g""")  # fmt: skip
def training_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids without judges, odd ones with; a trace for every third."""
    k, reports = F.col("doc_id"), views.reports(spark, sf_dir)
    dims = reports.select("doc_id", ((k % 11) / 10.0).alias("coverage"), ((k % 5) / 4.0).alias("spec"), F.lit(0.1).alias("depth"), F.lit(None).cast("double").alias("rigor"), F.lit(0.9).alias("style"), F.lit(0.3).alias("checklist"))
    trace = reports.where("doc_id % 3 = 0").select("doc_id", ((k % 7) / 6.0).alias("quote_match"), F.lit(None).cast("double").alias("reach"))
    part = lambda odd: audits.reward(reports.where(k % 2 == odd), dims, bool(odd), 4, trace)
    return part(0).union(part(1))
