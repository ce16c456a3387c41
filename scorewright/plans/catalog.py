"""Queries of adapted tasks, and of products by their titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import catalog
from scorewright.operators import adapters
from scorewright.registry import query, table

_TASK = """CASE WHEN o_orderkey % 17 = 0 THEN '[1]' WHEN o_orderkey % 13 = 0 THEN '{"intent":"no number"}' ELSE '{"task_id":' || CAST(o_orderkey AS STRING) || ',"sites":' || CASE o_orderkey % 3 WHEN 0 THEN '["shopping"]' WHEN 1 THEN '["shopping","wiki"]' ELSE '[]' END || ',"start_url":"__SHOPPING__/c/' || CAST(o_custkey AS STRING) || '","require_login":' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END
|| ',"eval":{"eval_types":' || CASE o_orderkey % 4 WHEN 0 THEN '["string_match"]' WHEN 1 THEN '["url_match","program_html"]' WHEN 2 THEN '["string_match","url_match"]' ELSE 'null' END || ',"reference_answers":' || CASE WHEN o_orderkey % 5 = 0 THEN '"text"' ELSE '{"fuzzy_match":["a","b","c"],"must_include":["x"]}' END || '}}' END"""
_ADAPTED = f"""t AS (SELECT o_orderkey AS k, o_custkey AS c, {_TASK} AS j FROM orders), a AS (SELECT *, k % 3 AS s, list_concat(CASE WHEN k % 4 IN (0, 2) THEN ['string_match'] ELSE []::VARCHAR[] END, CASE WHEN k % 4 IN (1, 2) THEN ['url_match'] ELSE []::VARCHAR[] END, CASE WHEN k % 4 = 1 THEN ['program_html'] ELSE []::VARCHAR[] END) AS e,
2 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 IN (1, 2) THEN 2 ELSE 0 END + CASE WHEN k % 5 > 0 THEN 1 ELSE 0 END AS d FROM t WHERE k % 17 > 0 AND k % 13 > 0)"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(f"try_parse_json({_TASK}) AS value")


@query("adapted_tasks", f"WITH {_ADAPTED} SELECT 'wa_shop_' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS task_id, CASE s WHEN 1 THEN 'shopping,wiki' ELSE 'shopping' END AS sites, 'http://localhost:7770/c/' || c AS start_url, d::INT AS difficulty, array_to_string(e, ',') AS eval_types, CASE WHEN k % 5 > 0 THEN 1 ELSE 0 END AS must FROM a")
def adapted_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks of another benchmark, brought into the own schema."""
    found = adapters.adapted(_tasks(spark, sf_dir))
    return found.select("task_id", F.array_join("sites", ",").alias("sites"), "start_url", "difficulty", F.array_join("eval_types", ",").alias("eval_types"), F.size("must_include").alias("must"))


@query("checks_asked_for", f"WITH {_ADAPTED}, w AS (SELECT 'difficulty' AS what, d::VARCHAR AS value FROM a WHERE s = 0 UNION ALL SELECT 'eval_type', unnest(e) FROM a WHERE s = 0) SELECT what, value, count(*) AS n FROM w GROUP BY 1, 2")
def checks_asked_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulties, and kinds of checks, of the tasks of one site alone."""
    return adapters.asked_for(adapters.adapted(adapters.only_of(_tasks(spark, sf_dir), "shopping")))


@query("relevant_products", "SELECT p_partkey, p_name LIKE '%widget%' OR p_name LIKE '%copper bolt%' AS relevant, upper(p_name[1]) || substr(p_name, 2) AS title, CASE WHEN length(regexp_extract(p_name, '^[a-z0-9]+')) >= 3 THEN upper(p_name[1]) || substr(regexp_extract(p_name, '^[a-z0-9]+'), 2) END AS brand, ('0x' || substr(sha256(p_partkey::VARCHAR), 1, 8))::BIGINT AS seed FROM part")
def relevant_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that fit two keywords, one with a single telling word and one a phrase; their brand, and a seed from their number."""
    title = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 10_000))
    keywords = F.array(F.lit("best widget"), F.lit("Copper Bolt "))
    return table(spark, sf_dir, "part").select("p_partkey", catalog.relevant(F.col("p_name"), keywords).alias("relevant"), title.alias("title"), catalog.brand(title).alias("brand"), catalog.seed(F.col("p_partkey").cast("string")).alias("seed"))
