"""Domain tables over the given tables: score rows, battles, reports, products, submissions, preferences; each also as SQL for oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators.battles import pair_battles
from scorewright.registry import table

#: Pillars of a score row, each a mean of hundredths that an event's number, payload and value give.
PILLARS = {"reach": (3, 7), "url": (5, 11), "chk": (7, 3), "qm": (11, 5), "nli": (13, 2), "cit": (17, 9), "depth": (19, 4), "pres": (23, 6), "fe": (29, 8), "ic": (31, 10), "pb": (37, 12), "sd": (41, 1), "v3_depth": (43, 13), "v3_rigor": (47, 14), "v3_style": (53, 15), "deterministic": (59, 16), "factuality": (61, 17), "judge": (67, 18), "comprehensive": (71, 19), "efficiency": (73, 20), "markdown": (79, 21), "fact_kg": (83, 22)}
_AVERAGES = ", ".join(f"round(avg((event_id * {a} + k * {b} + v * length(agent)) % 101) / 100 + 1e-9, 6) AS {name}" for name, (a, b) in PILLARS.items())

SCORES_SQL = f"""
ev AS (SELECT event_type AS agent, CAST(CAST(ts AS DATE) AS VARCHAR) AS task, event_id,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v FROM events),
raw AS (SELECT agent, task, count(*) AS runs, sum(k) AS chars, {_AVERAGES} FROM ev GROUP BY agent, task),
scores AS (SELECT *, round((CASE WHEN url > 0.5 THEN 1 ELSE 0 END + CASE WHEN cit > 0.5 THEN 1 ELSE 0 END + CASE WHEN pres > 0.5 THEN 1 ELSE 0 END) / 3.0, 6) AS spc FROM raw)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (agent, task): runs, chars, twelve pillars in [0, 1] and spc, the share of three passed checks."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("agent"), F.col("ts").cast("date").cast("string").alias("task"), "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.floor("value").cast("long").alias("v"),
    )
    hundredths = lambda a, b: F.round(F.avg((F.col("event_id") * a + F.col("k") * b + F.col("v") * F.length("agent")) % 101) / 100 + 1e-9, 6)
    raw = events.groupBy("agent", "task").agg(F.count("*").alias("runs"), F.sum("k").alias("chars"), *(hundredths(a, b).alias(name) for name, (a, b) in PILLARS.items()))
    passed = sum(((F.col(c) > 0.5).cast("int") for c in ("url", "cit", "pres")), F.lit(0))
    return raw.withColumn("spc", F.round(passed / 3.0, 6))


QUALITY_SQL = "(0.4 * url + 0.4 * chk + 0.2 * spc)"
BATTLES_SQL = f"""{SCORES_SQL},
truthful AS (SELECT agent, task, round(reach * {QUALITY_SQL} + 1e-9, 6) AS composite FROM scores),
battles AS (SELECT x.task, x.agent AS a, y.agent AS b, CASE WHEN abs(x.composite - y.composite) < 0.005 THEN 0.5 WHEN x.composite > y.composite THEN 1.0 ELSE 0.0 END AS score_a
            FROM truthful x JOIN truthful y ON x.task = y.task AND x.agent < y.agent)"""


def truthful(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(agent, task, composite) by the headline formula: reach times quality."""
    quality = 0.4 * F.col("url") + 0.4 * F.col("chk") + 0.2 * F.col("spc")
    return scores(spark, sf_dir).select("agent", "task", F.round(F.col("reach") * quality + 1e-9, 6).alias("composite"))


def battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, a, b, score_a) of all pairs of agents of a task."""
    return pair_battles(truthful(spark, sf_dir), "task", "agent", "composite", tie=0.005)


#: Reports in the forms that writers use, by id: <1> and <2> are URLs of two pages, <t> is a document's text.
FORMS = [
    "# Report\n\n## Findings\n\n<t>\n\n## Sources\n\n- [one](<1>)\n- see [two](<2>), however\n",
    "# Report\n\n<t>\n",
    "<t>\n\nAs seen at <1>, and at <2>. Not at <1>!\n",
    "# Report\n\nMost agree [1], others differ [2][1] and some are lost [9].\n\n<t>\n\n## References\n\n[1] A title. <1>\n[2]: [two](<2>)\n",
    "# Report\n\nOne says so[^a]. Another does not[^b].\n\n<t>\n\n[^a]: <1>\n[^b]: see [it](<2>)\n",
    "## Findings\n\n<t>\n\nSource: <1>\n\n- <2>\n* <1>\n",
    "",
    "# Report\n\n## One\n\nIt is better than [one](<1>), see <1>, whereas [two](<2>) and [three](http://localhost:9999/f/audio/1/) differ. However, it fails.\n\n### Sony X-100\n\n<t>\n\n1. first\n",
]
_FORM = "CASE d.doc_id % 8 " + " ".join(f"WHEN {k} THEN '{form}'" for k, form in enumerate(FORMS)) + " END"

REPORTS_SQL = f"""
linked AS (SELECT d.doc_id, d.doc_id % 3 AS task, d.text, coalesce(p.url, '') AS u1, coalesce(q.url, '') AS u2, {_FORM} AS form FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id // 4 LEFT JOIN pages q ON q.page_id = d.doc_id // 5),
reports AS (SELECT doc_id, task, replace(replace(replace(form, '<1>', u1), '<2>', u2), '<t>', coalesce(text, '')) AS md FROM linked)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, task, md): a report around each document's text, citing two pages in one of FORMS."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("doc_id div 4").alias("p1"), F.expr("doc_id div 5").alias("p2"))
    linked = docs.join(pages.withColumnsRenamed({"page_id": "p1", "url": "u1"}), "p1", "left").join(pages.withColumnsRenamed({"page_id": "p2", "url": "u2"}), "p2", "left")
    md = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("doc_id") % 8 + 1).cast("int"))
    for mark, column in (("<1>", "u1"), ("<2>", "u2"), ("<t>", "text")):
        md = F.replace(md, F.lit(mark), F.coalesce(column, F.lit("")))
    return linked.select("doc_id", (F.col("doc_id") % 3).alias("task"), md.alias("md"))


PRODUCTS_SQL = """
products AS (SELECT p_partkey AS product_id, p_name AS name, p_type AS kind, p_brand AS brand, p_retailprice AS price,
             round(avg(l_quantity) / 10, 6) AS rating, count(l_orderkey) AS review_count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"""


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, name, kind, brand, price, rating, review_count): parts with a rating and a count from their line items."""
    per_part = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity") / 10, 6).alias("rating"), F.count("*").alias("review_count"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"))
    return part.join(per_part, part.product_id == per_part.l_partkey, "left").drop("l_partkey").fillna({"review_count": 0})


SUBMISSIONS_SQL = """
per_order AS (SELECT l_orderkey, count(*) AS comments, CAST(sum(l_quantity) AS BIGINT) AS score FROM lineitem GROUP BY 1),
submissions AS (SELECT o_orderkey AS post_id, o_custkey AS author, c_mktsegment AS forum, comments, score, o_orderpriority AS title
                FROM orders JOIN per_order ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(post_id, author, forum, comments, score, title): orders as forum posts."""
    per_order = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("comments"), F.sum("l_quantity").cast("long").alias("score"))
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    return joined.select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("author"), F.col("c_mktsegment").alias("forum"), "comments", "score", F.col("o_orderpriority").alias("title"))


PREFS_SQL = """
prefs AS (SELECT e.event_id AS pref_id, CAST(CAST(e.ts AS DATE) AS VARCHAR) AS task, e.event_type AS a, f.event_type AS b,
          CASE WHEN abs(e.value - f.value) < 1 THEN 'tie' WHEN e.value > f.value THEN 'a' ELSE 'b' END AS winner, 'j' || CAST(e.user_id % 3 AS VARCHAR) AS judge
          FROM events e JOIN events f ON f.event_id = e.event_id + 1 WHERE e.event_type <> f.event_type)"""


def prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pref_id, task, a, b, winner, judge): one preference for each two successive events of different agents."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", "user_id")
    f = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("b"), F.col("value").alias("other"))
    winner = F.when(F.abs(F.col("value") - F.col("other")) < 1, "tie").when(F.col("value") > F.col("other"), "a").otherwise("b")
    both = e.join(f, "event_id").where(F.col("event_type") != F.col("b"))
    return both.select(F.col("event_id").alias("pref_id"), F.col("ts").cast("date").cast("string").alias("task"), F.col("event_type").alias("a"), "b", winner.alias("winner"), F.concat(F.lit("j"), F.col("user_id") % 3).alias("judge"))
