"""Queries of claims against chunks of pages, look-ups by prefix, verifiers in one pass, filters with a log, and memory of runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators import evidence, memory
from scorewright.plans import views
from scorewright.plans.views import SCORES_SQL, SUBMISSIONS_SQL
from scorewright.registry import query, table
from scorewright.streaming import split

_SIZE, _OVERLAP = 400, 50


@query("claim_entailment", f"""WITH claims AS (SELECT d.doc_id, substr(d.text, 1, 60) AS claim, p.url FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id % 500),
body AS (SELECT url, min(html) AS body FROM pages GROUP BY 1),
chunks AS (SELECT url, md5(substr(body, CAST(s + 1 AS INT), {_SIZE})) AS h FROM (SELECT url, body, unnest(range(0, greatest(length(body) - {_OVERLAP} - 1, 0) + 1, {_SIZE - _OVERLAP})) AS s FROM body WHERE body <> '')),
told AS (SELECT c.doc_id, c.url, bool_or(substr(md5(md5(c.claim) || k.h), 1, 1) < '2') AS held FROM claims c LEFT JOIN chunks k ON k.url = c.url GROUP BY 1, 2)
SELECT doc_id, 1 AS total_claims, coalesce(held, false)::INT AS supported_claims, (held IS NULL)::INT AS no_page, 0 AS unjudged, coalesce(held, false)::INT::DOUBLE AS precision FROM told""")  # fmt: skip
def claim_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' beginnings as claims that cite a page; a verdict table by hashes of claim and chunk says what holds."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("body"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("claim"), (F.col("doc_id") % 500).alias("page_id"))
    claims = docs.join(pages.select("page_id", "url"), "page_id", "left").drop("page_id")
    chunks = evidence.chunked(pages, _SIZE, _OVERLAP)
    verdicts = evidence.to_judge(claims, chunks).withColumn("supported", F.substring(F.md5(F.concat("claim_hash", "chunk_hash").cast("binary")), 1, 1) < "2")
    return evidence.entailment(claims, chunks, verdicts, "doc_id")


_SUBJECT = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, CAST(3 + p_partkey % 5 AS INT)) WHEN 2 THEN p_name || ' of another kind' ELSE substr(p_name, 2) END"


@query("parts_by_prefix", f"""WITH s AS (SELECT p_partkey, {_SUBJECT} AS subject FROM part),
hits AS (SELECT subject, min(f.p_partkey) AS found_id FROM (SELECT DISTINCT subject FROM s) x LEFT JOIN part f ON starts_with(f.p_name, substr(subject, 1, 60)) GROUP BY 1)
SELECT p_partkey, subject, found_id, f.p_retailprice FROM s JOIN hits USING (subject) LEFT JOIN (SELECT p_partkey AS found_id, p_retailprice FROM part) f USING (found_id)""")  # fmt: skip
def parts_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first product whose name begins as a subject does, and its price."""
    part = table(spark, sf_dir, "part")
    subjects = part.selectExpr("p_partkey", f"{_SUBJECT} AS subject")
    names = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_retailprice")
    return evidence.by_prefix(subjects, names, ["p_retailprice"])


@query("posts_by_prefix", f"""WITH {SUBMISSIONS_SQL}, titled AS (SELECT post_id, forum, author, title || '/' || CAST(score AS VARCHAR) AS title FROM submissions),
s AS (SELECT post_id AS asked, substr(title, 1, CAST(length(title) - post_id % 3 AS INT)) AS subject FROM titled WHERE post_id % 5 = 0),
hits AS (SELECT subject, min(t.post_id) AS found_id FROM (SELECT DISTINCT subject FROM s) x LEFT JOIN titled t ON starts_with(t.title, x.subject) GROUP BY 1)
SELECT asked, subject, found_id, forum, author FROM s JOIN hits USING (subject) LEFT JOIN (SELECT post_id AS found_id, forum, author FROM titled) f USING (found_id)""")  # fmt: skip
def posts_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forum and author of the first post whose title begins as a subject does."""
    posts = views.submissions(spark, sf_dir).withColumn("title", F.concat("title", F.lit("/"), F.col("score").cast("string")))
    subjects = posts.where("post_id % 5 = 0").select(F.col("post_id").alias("asked"), F.expr("substr(title, 1, CAST(length(title) - post_id % 3 AS INT))").alias("subject"))
    return evidence.by_prefix(subjects, posts.select(F.col("post_id").alias("id"), F.col("title").alias("name"), "forum", "author"), ["forum", "author"])


def _priority(rows: pd.DataFrame) -> pd.Series:
    """The number that a priority begins with, as a part of five; what doesn't begin with one breaks down."""
    if rows["status"].eq("P").any():
        raise ValueError("pending")
    return rows["priority"].str[0].astype(int) / 5


_CHECKS = {"done": lambda rows: rows["status"].eq("F").astype(float), "priority": _priority, "worth": lambda rows: rows["total"] / 200_000}
_READS = {"done": ["status"], "priority": ["status", "priority"]}
_KINDS = "CASE o_orderkey % 4 WHEN 0 THEN {0} WHEN 1 THEN {1} WHEN 2 THEN {2} ELSE {3} END"
_ASKED = [["done", "worth"], ["priority", "worth"], ["worth", "telepathy"], []]


@query("dispatched_checks", f"""WITH c AS (SELECT o_orderkey AS id, o_orderkey % 4 AS k, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS done, CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) / 5.0 END AS priority, greatest(0, least(1, o_totalprice / 200000)) AS worth, o_orderstatus AS s FROM orders)
SELECT id, CASE WHEN k = 3 THEN 0 ELSE 2 END::BIGINT AS checks, round(CASE k WHEN 0 THEN done * worth WHEN 1 THEN priority * worth ELSE 0 END + 1e-9, 6)::DOUBLE AS score,
CASE k WHEN 0 THEN done >= 0.5 AND worth >= 0.5 WHEN 1 THEN priority >= 0.5 AND worth >= 0.5 ELSE false END AS passed, CASE WHEN k = 1 AND s = 'P' THEN 1 WHEN k = 2 THEN 1 ELSE 0 END::BIGINT AS errors FROM c""")  # fmt: skip
def dispatched_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that ask for two checks each, of which one breaks down on some rows and one doesn't exist."""
    listed = [f"array({', '.join(repr(k) for k in kinds)})" if kinds else "CAST(array() AS array<string>)" for kinds in _ASKED]
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status", "o_orderpriority AS priority", "o_totalprice AS total", f"{_KINDS.format(*listed)} AS kinds")
    found = evidence.combined(rows, evidence.dispatched(rows, _CHECKS, ["status", "priority", "total"], reads=_READS))
    return found.withColumn("score", F.round(F.col("score") + 1e-9, 6))


_HOSTS = ["blog.tionsh.example.net", "thther.example.org"]


@query("hits_refused", "SELECT page_id, url, CASE WHEN trim(coalesce(url, '')) = '' THEN 'no_url' ELSE 'non_sandbox_url_blocked' END AS reason FROM pages WHERE coalesce(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '') NOT IN ('blog.tionsh.example.net', 'thther.example.org')")
def hits_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that may not be shown where only two hosts are allowed, and why."""
    return split.strict(table(spark, sf_dir, "pages").select("page_id", "url"), _HOSTS)[1]


_TEXT = "CASE chars % 4 WHEN 0 THEN '# A' || chr(10) || 'x' || chr(10) || '## ' || agent || chr(10) || '[a](http://localhost:7770/' || task || ') [b](http://localhost:9999/f/1) [a](http://localhost:7770/' || task || ')' WHEN 1 THEN '## B' || chr(10) || '# A' WHEN 2 THEN 'no heading [w](http://localhost:8090/w)' END"
_RUNS = f"agent, task, CASE (length(agent) + chars) % 3 WHEN 0 THEN 'A Timeline of it' WHEN 1 THEN 'fact-check this' ELSE 'which is best' END AS intent, round(reach * (0.4 * url + 0.4 * chk + 0.2 * spc) * (0.5 + 0.5 * qm) * (0.5 + 0.5 * nli) + 1e-9, 6) AS composite, reach, runs % 11 AS citations, cit AS recall, runs % 5 AS d1, runs % 3 AS d2, chk AS checklist, {_TEXT} AS md"
MEMORY_SQL = f"""{SCORES_SQL}, mined AS (SELECT * FROM (SELECT {_RUNS} FROM scores) WHERE composite >= 0.04 AND reach >= 0.2),
told AS (SELECT *, CASE intent WHEN 'A Timeline of it' THEN 'timeline' WHEN 'fact-check this' THEN 'debunking' ELSE 'recommendation' END AS kind, CASE chars4 WHEN 0 THEN ['A', agent] WHEN 1 THEN ['B', 'A'] ELSE []::VARCHAR[] END AS sections FROM (SELECT *, CASE WHEN md LIKE '# A%' THEN 0 WHEN md LIKE '## B%' THEN 1 WHEN md LIKE 'no%' THEN 2 ELSE 3 END AS chars4 FROM mined)),
placed AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY composite DESC, agent) AS place FROM told)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows as runs with reports, as memory takes them."""
    rows = views.scores(spark, sf_dir).selectExpr(*_split_columns(_RUNS))
    return rows.withColumn("per_domain", F.create_map(F.lit("localhost:7770"), "d1", F.lit("localhost:9999"), "d2"))


def _split_columns(text: str) -> list[str]:
    """The parts of a list of SQL columns: commas inside brackets don't part them."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


@query("memory_of_tasks", f"""WITH {MEMORY_SQL}
SELECT task, arg_min(kind, agent) AS intent_type, string_agg(agent || ':' || CAST(CAST(round(composite * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY place) FILTER (place <= 5) AS best_runs,
coalesce(array_to_string(arg_min(sections, agent) FILTER (len(sections) > 0), '|'), '') AS skeleton, CASE arg_max(chars4, agent) FILTER (md IS NOT NULL) WHEN 0 THEN 'http://localhost:7770/' || task WHEN 1 THEN '' WHEN 2 THEN '' END AS shopping, CASE arg_max(chars4, agent) FILTER (md IS NOT NULL) WHEN 2 THEN 1 WHEN 0 THEN 0 WHEN 1 THEN 0 END::BIGINT AS wiki FROM placed GROUP BY task""")  # fmt: skip
def memory_of_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is remembered of each task: its kind, best runs, outline and links."""
    found = memory.of_tasks(runs(spark, sf_dir))
    best = F.array_join(F.transform("best_runs", lambda r: F.concat(r["agent"], F.lit(":"), F.round(r["composite_v2"] * 1_000_000).cast("long").cast("string"))), ",")
    return found.select("task", "intent_type", best.alias("best_runs"), F.array_join("section_skeleton", "|").alias("skeleton"), F.array_join("cited_url_patterns.shopping", "|").alias("shopping"), F.when(F.col("cited_url_patterns").isNotNull(), F.size("cited_url_patterns.wiki")).cast("long").alias("wiki"))


@query("memory_of_intents", f"""WITH {MEMORY_SQL}, best AS (SELECT kind, task, max(composite) AS c FROM told GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY c DESC, task) AS r FROM best),
titles AS (SELECT kind, title, count(*) AS n, quantile_cont(at_, 0.5) AS middle FROM (SELECT kind, unnest(sections) AS title, unnest(range(len(sections))) AS at_ FROM told) GROUP BY 1, 2),
g AS (SELECT kind, count(DISTINCT task) AS n_tasks, count(*) AS n_runs, round(avg(citations) + 1e-9, 1) AS avg_citation_count, round(coalesce(avg(len(sections)) FILTER (len(sections) > 0), 0) + 1e-9, 1) AS section_count_avg, count(*) FILTER (len(sections) > 0) AS outlined, round(sum(d1) / greatest(sum(d1) + sum(d2), 1) + 1e-9, 3) AS shopping_share FROM told GROUP BY 1)
SELECT kind AS intent_type, n_tasks, n_runs, avg_citation_count, section_count_avg, shopping_share, (SELECT string_agg(task, ',' ORDER BY r) FROM ranked WHERE ranked.kind = g.kind AND r <= 5) AS exemplars,
coalesce((SELECT string_agg(title, ',' ORDER BY middle, title) FROM titles WHERE titles.kind = g.kind AND n * 2 >= outlined), '') AS usual FROM g""")  # fmt: skip
def memory_of_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is remembered of each kind of task."""
    found = memory.of_intents(runs(spark, sf_dir))
    return found.select("intent_type", "n_tasks", "n_runs", "avg_citation_count", "section_count_avg", F.element_at("citation_distribution", F.lit("localhost:7770")).alias("shopping_share"), F.array_join("exemplar_tasks", ",").alias("exemplars"), F.array_join("usual_sections", ",").alias("usual"))


@query("memory_of_all", f"WITH {MEMORY_SQL} SELECT count(DISTINCT task) AS n_total_l1_entries, count(*) AS n_total_qualified_runs, CAST(floor(min(composite) * 100 + 1e-9) AS INT) AS typical_low, CAST(floor(max(composite) * 100 + 1e-9) AS INT) AS typical_high FROM placed WHERE place <= 5")
def memory_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is remembered over all tasks."""
    return memory.of_all(memory.of_tasks(runs(spark, sf_dir)))
