"""Queries of groups, windows, joins and sets over score rows, products and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.operators import aggregates, agreement, filters
from scorewright.plans import views
from scorewright.plans.views import PRODUCTS_SQL, QUALITY_SQL, SCORES_SQL, SUBMISSIONS_SQL
from scorewright.registry import query, table

_T = f"{SCORES_SQL}, t AS (SELECT agent, task, round(reach * {QUALITY_SQL} + 1e-9, 6) AS c FROM scores)"


@query("agent_summary", f"""WITH {_T} SELECT agent, count(*) AS n, round(avg(c) + 1e-9, 6) AS mean, round(median(c) + 1e-9, 6) AS median, quantile_disc(c, 0.25) AS p25, min(c) AS low, max(c) AS high, round(stddev_samp(c), 6) AS sd FROM t GROUP BY 1""")
def agent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "composite"
    return views.truthful(spark, sf_dir).groupBy("agent").agg(F.count("*").alias("n"), F.round(F.avg(c) + 1e-9, 6).alias("mean"), F.round(F.median(c) + 1e-9, 6).alias("median"), aggregates.nearest_rank(c, 0.25).alias("p25"), F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.stddev_samp(c), 6).alias("sd"))


@query("pillar_statistics", f"WITH {SCORES_SQL} " + " UNION ALL ".join(f"SELECT '{p}' AS pillar, count({p}) AS n, round(avg({p}), 6) AS mean, round(stddev_samp({p}), 6) AS sd, min({p}) AS low, max({p}) AS high FROM scores" for p in views.PILLARS))
def pillar_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = views.scores(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(p).alias("pillar"), F.col(p).alias("v")) for p in views.PILLARS))).alias("x")).select("x.*")
    return long.groupBy("pillar").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("agent_by_weekday", f"WITH {_T} SELECT agent, " + ", ".join(f"round(avg(c) FILTER (isodow(CAST(task AS DATE)) = {d}) + 1e-9, 6) AS d{d}" for d in range(1, 8)) + ", round(avg(c) + 1e-9, 6) AS overall FROM t GROUP BY 1")
def agent_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.truthful(spark, sf_dir).withColumn("day", (F.dayofweek(F.col("task").cast("date")) + 5) % 7 + 1)
    wide = rows.groupBy("agent").pivot("day", list(range(1, 8))).agg(F.round(F.avg("composite") + 1e-9, 6))
    return wide.withColumnsRenamed({str(d): f"d{d}" for d in range(1, 8)}).join(rows.groupBy("agent").agg(F.round(F.avg("composite") + 1e-9, 6).alias("overall")), "agent")


@query("audit_counts", f"""WITH {_T}, a AS (SELECT t.*, s.reach, s.chars FROM t JOIN scores s USING (agent, task)) SELECT agent, count(*) AS files, count(*) FILTER (c >= 0.2) AS kept, count(*) FILTER (c < 0.2) AS dropped, count(*) FILTER (reach < 0.45) AS low_reach, round(avg(chars), 4) AS mean_chars, CASE WHEN count(*) FILTER (c < 0.2) > 0.3 * count(*) THEN 'FAIL' WHEN count(*) FILTER (c < 0.2) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM a GROUP BY 1""")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.truthful(spark, sf_dir).join(views.scores(spark, sf_dir).select("agent", "task", "reach", "chars"), ["agent", "task"])
    low = F.count_if(F.col("composite") < 0.2)
    return rows.groupBy("agent").agg(F.count("*").alias("files"), F.count_if(F.col("composite") >= 0.2).alias("kept"), low.alias("dropped"), F.count_if(F.col("reach") < 0.45).alias("low_reach"), F.round(F.avg("chars"), 4).alias("mean_chars"), F.when(low > 0.3 * F.count("*"), "FAIL").when(low > 0, "WARN").otherwise("PASS").alias("verdict"))


#: Facts of a score file beside its pillars, by rule from runs and characters: answer_chars, cited, judge_error.
_FILES = f"""{_T}, f AS (SELECT t.agent, t.task, c, s.reach, s.chk, CASE WHEN s.chars % 7 = 0 THEN 0 WHEN s.chars % 5 = 0 THEN s.chars % 600 ELSE s.chars + 600 END AS answer_chars, CASE WHEN s.runs % 4 = 0 THEN 0 ELSE s.runs END AS cited, s.chars % 3 = 0 AS ck_error, s.chars % 3 = 0 AND s.runs % 2 = 0 AS ad_error, s.runs % 2 = 0 AS pres_error, s.chars % 11 = 0 AS infra_failure, CASE WHEN s.chars % 13 = 0 THEN '(Agent X produced no report after 12s, exit=1)' WHEN s.chars % 17 = 0 THEN ' (Storm error: x' ELSE 'A report' END AS head FROM t JOIN scores s USING (agent, task)),
d AS (SELECT *, CASE WHEN answer_chars = 0 OR (answer_chars < 600 AND reach = 0 AND chk = 0) THEN 'short' WHEN infra_failure THEN 'infra' WHEN ck_error AND ad_error AND pres_error THEN 'judge_err' WHEN regexp_matches(head, '^\\s*\\([^)]*produced no report') OR regexp_matches(head, '(?i)^\\s*\\(\\s*[a-z][\\w\\- ]*\\s+(error|stderr)\\s*:') THEN 'placeholder' END AS reason FROM f)"""


def _score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(agent, task, composite, reach, chk, answer_chars, cited, ck_error, ad_error, pres_error, infra_failure, head) of every score row."""
    chars, runs = F.col("chars"), F.col("runs")
    rows = views.truthful(spark, sf_dir).join(views.scores(spark, sf_dir).select("agent", "task", "reach", "chk", "chars", "runs"), ["agent", "task"])
    return rows.select(
        "agent", "task", "composite", "reach", "chk", F.when(chars % 7 == 0, 0).when(chars % 5 == 0, chars % 600).otherwise(chars + 600).alias("answer_chars"), F.when(runs % 4 == 0, 0).otherwise(runs).alias("cited"),
        (chars % 3 == 0).alias("ck_error"), ((chars % 3 == 0) & (runs % 2 == 0)).alias("ad_error"), (runs % 2 == 0).alias("pres_error"), (chars % 11 == 0).alias("infra_failure"),
        F.when(chars % 13 == 0, "(Agent X produced no report after 12s, exit=1)").when(chars % 17 == 0, " (Storm error: x").otherwise("A report").alias("head"),
    )


@query("score_drops", f"""WITH {_FILES} SELECT agent, count(*) AS total, count(*) FILTER (reason IS NULL) AS kept, count(reason) AS degenerate, count(*) FILTER (reason = 'short') AS "short", count(*) FILTER (reason = 'infra') AS infra, count(*) FILTER (reason = 'judge_err') AS judge_err, count(*) FILTER (reason = 'placeholder') AS placeholder, round(avg(c) FILTER (reason IS NULL) + 1e-9, 6) AS mean_kept FROM d GROUP BY 1""")
def score_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_counts(_score_files(spark, sf_dir))


@query("outlier_flags", f"""WITH {_FILES}, m AS (SELECT agent, median(c) AS med, stddev_samp(c) AS sd, count(*) AS n FROM d WHERE reason IS NULL GROUP BY 1), r AS (SELECT agent, round(c, 3) AS v, count(DISTINCT task) AS k FROM d WHERE reason IS NULL GROUP BY 1, 2)
SELECT d.agent, d.task, coalesce(reason IS NULL AND n >= 4 AND sd > 0 AND abs(c - med) > 3 * sd, false) AS outlier, coalesce(reason IS NULL AND k >= 4, false) AS repeated, reach >= 0.999 AND cited = 0 AS reach_without_urls, ck_error AND chk > 0 AS judged_despite_error FROM d LEFT JOIN m USING (agent) LEFT JOIN r ON r.agent = d.agent AND r.v = round(c, 3)""")  # fmt: skip
def outlier_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.anomalies(_score_files(spark, sf_dir))


@query("top_runs_per_task", f"WITH {_T} SELECT task, agent, c AS composite, place FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY c DESC, agent) AS place FROM t) WHERE place <= 3")
def top_runs_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.top_per_group(views.truthful(spark, sf_dir), 3, [F.desc("composite"), F.col("agent")], "task").select("task", "agent", "composite", "place")


@query("best_and_worst", f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY c DESC, task) AS b, row_number() OVER (PARTITION BY agent ORDER BY c, task) AS w FROM t) SELECT agent, task, c AS composite, CASE WHEN b <= 3 THEN 'best' ELSE 'worst' END AS side FROM r WHERE b <= 3 OR w <= 3")
def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("agent")
    rows = views.truthful(spark, sf_dir).withColumns({"b": F.row_number().over(w.orderBy(F.desc("composite"), "task")), "w": F.row_number().over(w.orderBy("composite", "task"))})
    return rows.where("b <= 3 OR w <= 3").select("agent", "task", "composite", F.when(F.col("b") <= 3, "best").otherwise("worst").alias("side"))


@query("users_of_every_type", "SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def users_of_every_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.in_every_group(table(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", "event_type")


@query("work_queue", "WITH s AS (SELECT DISTINCT s_nationkey AS nation, s_suppkey % 7 AS slot FROM supplier) SELECT a.nation, b.slot FROM (SELECT DISTINCT nation FROM s) a, (SELECT DISTINCT slot FROM s) b WHERE (a.nation, b.slot) NOT IN (SELECT (nation, slot) FROM s)")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 7).alias("slot"))
    return aggregates.missing_pairs(done, "nation", "slot").select("nation", "slot")


@query("label_universe", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS good, b.doc_id IS NOT NULL AS toxic FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) a FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) b ON a.doc_id = b.doc_id")
def label_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    good, toxic = labels.where("quality = 1").select("doc_id").distinct().withColumn("g", F.lit(True)), labels.where("toxic = 1").select("doc_id").distinct().withColumn("t", F.lit(True))
    return good.join(toxic, "doc_id", "full").select("doc_id", F.coalesce("g", F.lit(False)).alias("good"), F.coalesce("t", F.lit(False)).alias("toxic"))


@query("upserted_customers", "SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal, CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN 'updated' WHEN n.c_custkey IS NOT NULL THEN 'added' ELSE 'kept' END AS change FROM (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0) n ON o.c_custkey = n.c_custkey")
def upserted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return aggregates.upsert(c.where("c_custkey % 3 <> 0").alias("o"), c.where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")).alias("n"), "c_custkey")


@query("last_event_wins", "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_event_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.latest_override(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.col("event_id"))


@query("quota_sample", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('42/' || event_id), event_id) AS place FROM events) WHERE place <= CASE event_type WHEN 'view' THEN 45 WHEN 'click' THEN 30 WHEN 'error' THEN 25 ELSE 0 END")
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.quota_sample(table(spark, sf_dir, "events"), "event_type", {"view": 45, "click": 30, "error": 25}, "event_id").select("event_type", "event_id")


@query("top_three_both_ways", f"WITH {SUBMISSIONS_SQL}, a AS (SELECT post_id FROM submissions ORDER BY score DESC, post_id LIMIT 3), b AS (SELECT post_id FROM submissions ORDER BY comments DESC, post_id LIMIT 3) SELECT count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b)")
def top_three_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = views.submissions(spark, sf_dir)
    top = lambda by: posts.orderBy(F.desc(by), "post_id").limit(3).select("post_id")
    return top("score").intersect(top("comments")).agg(F.count("*").alias("n"))


@query("cheapest_well_rated", f"WITH {PRODUCTS_SQL} SELECT product_id, name, price, rating FROM products WHERE rating >= 2.5 AND price > 0 ORDER BY price, product_id LIMIT 3")
def cheapest_well_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.products(spark, sf_dir).where("rating >= 2.5 AND price > 0").orderBy("price", "product_id").limit(3).select("product_id", "name", "price", "rating")


@query("most_reviewed_ratio", f"WITH {PRODUCTS_SQL}, t AS (SELECT * FROM products ORDER BY review_count DESC, product_id LIMIT 2) SELECT product_id, review_count, round(price / rating, 4) AS price_per_star FROM t")
def most_reviewed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.products(spark, sf_dir).orderBy(F.desc("review_count"), "product_id").limit(2).select("product_id", "review_count", F.round(F.col("price") / F.col("rating"), 4).alias("price_per_star"))


@query("reviews_against_rating", f"WITH {PRODUCTS_SQL}, r AS (SELECT count(*) AS n, corr(CAST(review_count AS DOUBLE), rating) AS r FROM products WHERE rating IS NOT NULL) SELECT n, round(coalesce(r, 0), 3) AS pearson, CASE WHEN n < 3 THEN 'insufficient data' WHEN r IS NULL OR isnan(r) THEN 'no variance' WHEN abs(r) < 0.2 THEN 'no meaningful correlation' WHEN r > 0.5 THEN 'strong positive' WHEN r > 0.2 THEN 'weak positive' WHEN r < -0.5 THEN 'strong negative' ELSE 'weak negative' END AS label FROM r")
def reviews_against_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.products(spark, sf_dir).where("rating is not null").agg(F.count("*").alias("n"), F.corr(F.col("review_count").cast("double"), "rating").alias("r"))
    return r.select("n", F.round(F.coalesce("r", F.lit(0.0)), 3).alias("pearson"), agreement.correlation_label(F.col("n"), F.col("r")).alias("label"))


@query("best_per_kind", f"WITH {PRODUCTS_SQL} SELECT kind, product_id, price, rating FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rating DESC NULLS LAST, price NULLS LAST, product_id) AS r FROM products) WHERE r = 1")
def best_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("rating").desc_nulls_last(), F.col("price").asc_nulls_last(), F.col("product_id")]
    return aggregates.top_per_group(views.products(spark, sf_dir), 1, order, "kind").select("kind", "product_id", "price", "rating")


@query("kinds_by_value", f"WITH {PRODUCTS_SQL} SELECT kind, count(*) AS n, min(price) AS low, max(price) AS high, round(avg(rating), 4) AS mean_rating, round(avg(rating) / min(price), 6) AS value FROM products GROUP BY 1")
def kinds_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.products(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.round(F.avg("rating"), 4).alias("mean_rating"), F.round(F.avg("rating") / F.min("price"), 6).alias("value"))


@query("price_range_or_all", f"WITH {PRODUCTS_SQL}, f AS (SELECT *, price BETWEEN 30 AND 100 AS fits, count(*) FILTER (price BETWEEN 30 AND 100) OVER () AS n FROM products) SELECT product_id, name, price FROM f WHERE fits OR n = 0 ORDER BY product_id LIMIT 5")
def price_range_or_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those in the range, or all where none is; the flag is one aggregate row."""
    rows = views.products(spark, sf_dir).withColumn("fits", F.col("price").between(30, 100))
    return rows.join(F.broadcast(rows.agg(F.count_if("fits").alias("n")))).where("fits OR n = 0").orderBy("product_id").limit(5).select("product_id", "name", "price")


@query("forum_statistics", f"WITH {SUBMISSIONS_SQL} SELECT forum, count(*) AS n, round(avg(comments), 4) AS mean_comments, median(comments) AS median_comments, arg_max(post_id, score * 1000000000 - post_id) AS top_post FROM submissions GROUP BY 1")
def forum_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.submissions(spark, sf_dir).groupBy("forum").agg(F.count("*").alias("n"), F.round(F.avg("comments"), 4).alias("mean_comments"), F.median("comments").alias("median_comments"), F.max_by("post_id", F.col("score") * 1_000_000_000 - F.col("post_id")).alias("top_post"))


@query("busiest_authors", f"WITH {SUBMISSIONS_SQL} SELECT author, count(*) AS posts, min(post_id) AS first_post, count(DISTINCT title) AS titles FROM submissions GROUP BY 1 ORDER BY posts DESC, author LIMIT 3")
def busiest_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.submissions(spark, sf_dir).groupBy("author").agg(F.count("*").alias("posts"), F.min("post_id").alias("first_post"), F.count_distinct("title").alias("titles")).orderBy(F.desc("posts"), "author").limit(3)


@query("themes_of_posts", f"""WITH {SUBMISSIONS_SQL}, x AS (SELECT unnest(list_concat(CASE WHEN score > 150 THEN ['popular'] ELSE [] END, CASE WHEN comments >= 5 THEN ['debated'] ELSE [] END, CASE WHEN title LIKE '%URGENT%' THEN ['urgent'] ELSE [] END)) AS theme, score, comments FROM submissions)
SELECT theme, count(*) AS n, round(avg(score), 4) AS mean_score, round(avg(comments), 4) AS mean_comments FROM x GROUP BY 1 HAVING count(*) >= 2""")  # fmt: skip
def themes_of_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes = F.array_compact(F.array(F.when(F.col("score") > 150, "popular"), F.when(F.col("comments") >= 5, "debated"), F.when(F.col("title").contains("URGENT"), "urgent")))
    return views.submissions(spark, sf_dir).select(F.explode(themes).alias("theme"), "score", "comments").groupBy("theme").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg("comments"), 4).alias("mean_comments")).where("n >= 2")


@query("top_posts_then_items", "WITH o AS (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5), l AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS place FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) SELECT l_orderkey, l_linenumber, l_extendedprice, place FROM l WHERE place <= 3")
def top_posts_then_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(F.col("o_orderkey").alias("l_orderkey"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").join(F.broadcast(top), "l_orderkey")
    return aggregates.top_per_group(items, 3, [F.desc("l_extendedprice"), F.col("l_linenumber")], "l_orderkey")


_NEAREST = """WITH v AS (SELECT vec_id, embedding AS e FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT a.vec_id AS query_id, b.vec_id AS match_id, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS s FROM v a JOIN v b ON b.vec_id <> a.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, match_id, round(s, 5) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, match_id) AS r FROM p) WHERE r <= 3"""  # fmt: skip


@query("nearest_vectors", _NEAREST)
@query("nearest_vectors_every_20th", _NEAREST)
def nearest_vectors_every_20th(spark: SparkSession, sf_dir: str, block: int = 8192) -> DataFrame:
    """The three nearest to every vector whose id is divisible by 20, among all vectors."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").where("embedding is not null")
    best = aggregates.nearest_in_blocks(v.where("vec_id % 20 = 0"), v, 3, block)
    return aggregates.top_per_group(best, 3, [F.desc("s"), F.col("match_id")], "query_id").select("query_id", "match_id", F.round("s", 5).alias("cosine"))


@query("running_budget", """WITH r AS (SELECT user_id, event_id, sum(greatest(CAST(floor(value) AS BIGINT), 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS used FROM events)
SELECT user_id, CAST(max(used) AS BIGINT) AS used, min(event_id) FILTER (used >= 900) AS warned_at, min(event_id) FILTER (used >= 1000) AS exhausted_at FROM r GROUP BY 1""")  # fmt: skip
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming token budget: where 90 % of 1000 were reached, and all."""
    used = F.sum(F.greatest(F.floor("value").cast("long"), F.lit(0))).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", used.alias("used"))
    return rows.groupBy("user_id").agg(F.max("used").alias("used"), F.min(F.when(F.col("used") >= 900, F.col("event_id"))).alias("warned_at"), F.min(F.when(F.col("used") >= 1000, F.col("event_id"))).alias("exhausted_at"))
