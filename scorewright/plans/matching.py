"""Queries of matching, grades of runs, and retrieval over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import matching, text
from scorewright.operators import executions, retrieval
from scorewright.plans import views
from scorewright.registry import query, table

_PLAIN = lambda c: rf"trim(regexp_replace(lower(coalesce({c}, '')), '\s+', ' ', 'g'))"


@query("triples_mentioned", rf"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN 'category:' || p_type || '/forum:' || p_brand ELSE p_name END AS subject, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 3 = 1 THEN p_brand ELSE CAST(p_size + 1 AS VARCHAR) END AS object,
p_name || '  ' || p_type || ' ' || p_brand || ' at $1' || p_size || '0 or ' || p_size || ',00 and ' || p_size || '.' AS body FROM part),
s AS (SELECT *, {_PLAIN("array_to_string(list_filter(list_transform(string_split(subject, '/'), lambda p: regexp_replace(p, '(?i)^(theme:|tea-type:|forum:|author:|category:)', '')), lambda p: p <> ''), ' ')")} AS s, {_PLAIN('body')} AS b, regexp_replace(body, '[,$¥]', '', 'g') AS bare FROM t)
SELECT p_partkey, (subject = '' OR (s <> '' AND ((length(s) >= 60 AND contains(b, s[1:60])) OR (length(s) >= 40 AND contains(b, s[1:40])) OR (length(s) >= 24 AND contains(b, s[1:24])) OR (length(s) >= 12 AND contains(b, s[1:12])) OR contains(b, s))))
 AND CASE WHEN regexp_matches(object, '^-?[0-9]+(\.[0-9]+)?$') THEN regexp_matches(' ' || bare || ' ', '[^0-9.]' || object || '[^0-9]') ELSE contains(b, {_PLAIN('object')}) END AS mentioned FROM s""")  # fmt: skip
def triples_mentioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    subject = F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("category:"), "p_type", F.lit("/forum:"), "p_brand")).otherwise(F.col("p_name"))
    value = F.when(F.col("p_partkey") % 3 == 0, size).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise((F.col("p_size") + 1).cast("string"))
    body = F.concat("p_name", F.lit("  "), "p_type", F.lit(" "), "p_brand", F.lit(" at $1"), size, F.lit("0 or "), size, F.lit(",00 and "), size, F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", matching.triple_mentioned(subject, value, body).alias("mentioned"))


@query("facts_checked", """WITH f AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 'price' WHEN 1 THEN 'score' WHEN 2 THEN 'forum' WHEN 3 THEN 'theme' ELSE 'product_url' END AS predicate, l_quantity AS q, l_extendedprice AS p, l_shipdate, l_returnflag, l_orderkey % 9 AS k FROM lineitem),
c AS (SELECT *, CASE predicate WHEN 'price' THEN p WHEN 'score' THEN q END AS known_number, CASE predicate WHEN 'price' THEN p * (1 + k / 100.0) WHEN 'score' THEN q * (1 + k / 200.0) END AS claimed_number FROM f)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 8 THEN NULL WHEN predicate = 'price' THEN abs(known_number - claimed_number) / greatest(known_number, claimed_number) <= 0.05 WHEN predicate = 'score' THEN abs(known_number - claimed_number) / greatest(known_number, claimed_number) <= 0.02
WHEN predicate = 'forum' THEN k < 5 WHEN predicate = 'product_url' THEN k % 2 = 0 END AS outcome FROM c""")  # fmt: skip
def facts_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued checks: numbers within their tolerance, forums by name, product pages by slug; every ninth is not known."""
    k, n = F.col("l_orderkey") % 9, F.col("l_linenumber") % 5
    predicate = F.when(n == 0, "price").when(n == 1, "score").when(n == 2, "forum").when(n == 3, "theme").otherwise("product_url")
    known = F.when(k == 8, F.lit(None)).when(n == 0, F.col("l_extendedprice").cast("decimal(20,6)").cast("string")).when(n == 1, F.col("l_quantity").cast("decimal(20,6)").cast("string")).when(n == 2, "f/News").when(n == 3, "x").otherwise("blue-tea-pot")
    claimed = F.when(n == 0, (F.col("l_extendedprice") * (1 + k / 100.0)).cast("decimal(20,6)").cast("string")).when(n == 1, (F.col("l_quantity") * (1 + k / 200.0)).cast("decimal(20,6)").cast("string")).when(n == 2, F.when(k < 5, "/f/news").otherwise("sport")).otherwise(F.when(k % 2 == 0, "http://shop/Blue-Tea-Pot.html").otherwise("http://shop/"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", matching.fact_holds(predicate, known, claimed).alias("outcome"))


@query("factoids", rf"""WITH a AS (SELECT c_custkey, 'It is ' || c_name || ' with ' || c_acctbal || ' in ' || c_mktsegment AS answer, c_custkey % 4 AS k, c_name, c_mktsegment, c_nationkey FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN CASE WHEN c_nationkey < 10 THEN 1.0 ELSE 0.5 END WHEN 2 THEN CASE WHEN c_nationkey < 10 THEN 1.0 ELSE 0.25 END ELSE 0.0 END AS score FROM a""")
def factoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, fuzzy and included references, and none, by the customer's number; those of higher nations have one wrong reference."""
    k, wrong = F.col("c_custkey") % 4, F.col("c_nationkey") >= 10
    answer = F.concat(F.lit("It is "), "c_name", F.lit(" with "), F.col("c_acctbal").cast("string"), F.lit(" in "), "c_mktsegment")
    pair = F.array(F.upper("c_name"), F.when(wrong, "nowhere to be found").otherwise(F.lower("c_mktsegment")))
    none = F.lit(None).cast("array<string>")
    score = matching.factoid_score(answer, F.when(k == 0, F.array(F.upper(answer))).otherwise(none), F.when(k == 1, pair).otherwise(none), F.when(k == 2, pair).otherwise(none))
    return table(spark, sf_dir, "customer").select("c_custkey", score.alias("score"))


@query("nested_values", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, 1 + event_id % 3 AS places FROM events""")
def nested_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as plain, fenced or broken JSON around an event's properties; the value at a path, and what a wildcard stands for."""
    items = F.when(F.col("event_id") % 3 == 0, "1").when(F.col("event_id") % 3 == 1, "1,2").otherwise("1,2,3")
    body = F.concat(F.lit('{"a": {"b": ['), "props", F.lit(']}, "items": ['), items, F.lit("]}"))
    answer = F.when(F.col("event_id") % 3 == 1, body).when(F.col("event_id") % 3 == 2, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("{oops "), body))
    rows = table(spark, sf_dir, "events").select("event_id", matching.json_object(answer).alias("j"), body.alias("whole"))
    return rows.select("event_id", matching.at_path(F.col("j"), "a.b[0].k").cast("long").alias("k"), F.size(matching.expanded(F.col("whole"), "items[*].x")).cast("long").alias("places"))


_GRADE = "CASE WHEN c >= 0.95 THEN 'A+' WHEN c >= 0.9 THEN 'A' WHEN c >= 0.85 THEN 'B+' WHEN c >= 0.8 THEN 'B' WHEN c >= 0.7 THEN 'C' WHEN c >= 0.6 THEN 'D' ELSE 'F' END"


@query("run_grades", f"""WITH r AS (SELECT o_orderkey AS id, o_custkey AS task, o_orderstatus <> 'F' AS success, o_orderkey % 5 <> 0 AS has_output, o_orderkey % 7 <> 0 AS valid_keys, 1 + o_orderkey % 23 AS steps, o_orderkey * 37 % 9000 AS tokens, (o_orderkey % 100) / 50.0 AS cost, 1 + o_orderkey % 3 AS tools, o_orderkey % 4 AS errors, o_orderkey % 3 AS recovered, o_orderkey % 101 AS used FROM orders),
clean AS (SELECT * FROM r WHERE id % 2 = 0), noisy AS (SELECT task, arg_min(success, id) AS ns, arg_min(recovered, id) AS nr, arg_min(has_output, id) AS nh FROM r WHERE id % 2 = 1 GROUP BY 1),
j AS (SELECT clean.*, ns, nr, nh, success AND has_output AND valid_keys AS valid, steps / 8.0 AS sr, tokens / 3000.0 AS tr, cost / steps AS cps, 3000 / 8.0 * 0.0001 AS ecps FROM clean LEFT JOIN noisy USING (task)),
s AS (SELECT id, task, success, recovered, valid, CASE WHEN valid THEN 0.7 WHEN success AND has_output THEN 0.35 ELSE 0 END AS outcome,
 0.4 * CASE WHEN sr <= 1 THEN 1 WHEN sr <= 1.5 THEN 1 - (sr - 1) * 0.4 WHEN sr <= 2 THEN 0.8 - (sr - 1.5) * 0.4 ELSE greatest(0.3, 0.6 - (sr - 2) * 0.2) END + 0.35 * CASE WHEN tr <= 1 THEN 1 WHEN tr <= 1.5 THEN 1 - (tr - 1) * 0.3 ELSE greatest(0.5, 0.85 - (tr - 1.5) * 0.2) END
 + 0.25 * CASE WHEN cps <= ecps THEN 1 WHEN cps <= 2 * ecps THEN 1 - (cps / ecps - 1) * 0.3 ELSE greatest(0.7, 1 - cps / ecps * 0.4) END AS efficiency,
 CASE WHEN ns IS NULL THEN CASE WHEN success THEN 1 ELSE 0.5 END ELSE 0.7 * CASE WHEN success AND NOT ns THEN 0.55 ELSE 1 END + 0.3 * CASE WHEN nr > 0 OR (success AND ns) OR (nh AND NOT ns) THEN 0.8 ELSE 0.3 END END AS robustness,
 least(1, 0.35 * least(1, tools / 2.0) + 0.35 * CASE WHEN steps <= 10 OR used = 0 OR used / 100.0 < 0.8 THEN 1 WHEN used / 100.0 < 0.95 THEN 0.9 ELSE 0.7 END + 0.3 * recovered / greatest(errors, 1)) AS complexity FROM j),
g AS (SELECT *, 0.4 * outcome + 0.2 * efficiency + 0.25 * robustness + 0.15 * complexity AS c FROM s)
SELECT id AS execution_id, task AS task_id, round(outcome + 1e-9, 4) AS outcome, round(efficiency + 1e-9, 4) AS efficiency, round(robustness + 1e-9, 4) AS robustness, round(complexity + 1e-9, 4) AS complexity, round(c + 1e-9, 4) AS composite, {_GRADE} AS grade, success AS pass_1, success OR recovered > 0 AS pass_2, valid AS output_valid FROM g""")  # fmt: skip
def run_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: even ones in a clean, odd ones of the same customer in a noisy surrounding."""
    k = F.col("o_orderkey")
    tool = lambda n: F.slice(F.array(F.lit("search"), F.lit("browse"), F.lit("write")), 1, n)
    runs = table(spark, sf_dir, "orders").select(
        k.alias("execution_id"), F.col("o_custkey").alias("task_id"), (F.col("o_orderstatus") != "F").alias("success"), (k % 5 != 0).alias("has_output"), F.when(k % 7 != 0, F.array(F.lit("answer"), F.lit("url"))).otherwise(F.array(F.lit("answer"))).alias("output_keys"),
        (1 + k % 23).alias("steps"), (k * 37 % 9000).alias("tokens"), ((k % 100) / 50.0).alias("cost"), tool((1 + k % 3).cast("int")).alias("tools"), (k % 4).alias("errors"), (k % 3).alias("recovered"), (k % 101).alias("context_used"), F.lit(100).alias("context_max"),
        F.lit(8).alias("expected_steps"), F.lit(3000).alias("expected_tokens"), F.array(F.lit("answer"), F.lit("url")).alias("required_keys"), F.array(F.lit("search"), F.lit("write")).alias("required_tools"),
    )
    return executions.grades(runs.where("execution_id % 2 = 0"), runs.where("execution_id % 2 = 1"))


@query("post_search", """WITH p AS (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'headphones' WHEN 1 THEN 'gaming' ELSE 'news' END AS forum, lower(html) AS t FROM pages), q AS (SELECT * FROM (VALUES (1, 'Noise of the best headphone', ['headphones', 'technology']), (2, 'pc gaming and then the article', ['gaming', 'videogames', 'technology']), (3, 'zz', []::VARCHAR[]), (4, 'the article', []::VARCHAR[])) v(query_id, query, forums)),
w AS (SELECT query_id, forums, list_filter(regexp_extract_all(lower(query), '[a-z0-9]{3,}'), lambda x: true) AS w FROM q),
s AS (SELECT query_id, url, max(least(1, coalesce(len(list_filter(w, lambda x: contains(t, x))) / nullif(len(w), 0), 0) + CASE WHEN list_contains(forums, forum) THEN 0.5 ELSE 0 END)) AS score FROM p, w GROUP BY 1, 2)
SELECT query_id, url, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS place FROM s WHERE score > 0) WHERE place <= 5""")  # fmt: skip
def post_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "Noise of the best headphone"), (2, "pc gaming and then the article"), (3, "zz"), (4, "the article")], "query_id int, query string")
    posts = table(spark, sf_dir, "pages").select("url", F.element_at(F.array(*map(F.lit, ("headphones", "gaming", "news"))), (F.col("page_id") % 3 + 1).cast("int")).alias("forum"), F.lit("").alias("title"), F.col("html").alias("summary"))
    return retrieval.search_posts(asked, posts, 5).withColumn("score", F.round("score", 6))


_ASKED = "('0x' || substr(md5(task_id), 1, 8))::BIGINT % 20 = 0"


@query("task_recall", f"""WITH {views.SCORES_SQL}, m AS (SELECT agent || '/' || task AS task_id, CASE CAST(round(url * 100) AS INT) % 3 WHEN 0 THEN 'timeline' WHEN 1 THEN 'debunking' ELSE 'comparison' END AS kind, round(reach, 4) AS best FROM scores),
a AS (SELECT * FROM m WHERE {_ASKED}), s AS (SELECT a.task_id, m.task_id AS remembered, CASE WHEN a.kind = m.kind THEN 0.5 ELSE 0 END + m.best AS score FROM a JOIN m ON a.task_id <> m.task_id)
SELECT task_id, remembered, round(score, 4) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 6) DESC, remembered) AS place FROM s) WHERE place <= 3""")  # fmt: skip
def task_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All score rows as remembered tasks, their kind from a pillar; every twentieth of them asks, by a digest of its id, among all."""
    kind = F.element_at(F.array(*map(F.lit, ("A Timeline of x\ncomparison", "Fact-Check: y", "z comparison"))), (F.round(F.col("url") * 100).cast("int") % 3 + 1))
    memory = views.scores(spark, sf_dir).select(F.concat_ws("/", "agent", "task").alias("task_id"), retrieval.intent(kind).alias("intent_type"), F.round("reach", 4).alias("best"), F.lit(None).cast("array<double>").alias("embedding"))
    found = retrieval.recall(memory.where(F.conv(F.substring(F.md5("task_id"), 1, 8), 16, 10).cast("long") % 20 == 0), memory)
    return found.withColumn("score", F.round("score", 4))
