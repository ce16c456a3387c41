"""Tasks of other benchmarks (as VARIANT) in the own schema, and what kinds of checks they ask for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.operators.variants import at, entries, items, kind

# What stands in tasks for the sites' addresses.
SITES = {"SHOPPING": "http://localhost:7770", "REDDIT": "http://localhost:9999", "WIKIPEDIA": "http://localhost:8888"}


def resolved(address: Column, sites: dict[str, str] | None = None) -> Column:
    """An address with the sites' own in the place of their marks, such as __SHOPPING__."""
    return reduce(lambda a, s: F.replace(a, F.lit(f"__{s[0]}__"), F.lit(s[1])), (sites or SITES).items(), address)


def _texts(value: Column, path: str) -> Column:
    """A list of texts there, empty if there is none; other items as JSON."""
    return F.coalesce(F.transform(items(at(value, path)), lambda v: at(v, "$", "string")), F.array().cast("array<string>"))


def _true(value: Column, path: str) -> Column:
    """Whether there is more than nothing: true, a number but zero, a text or list that isn't empty."""
    v = at(value, path)
    is_ = kind(v)
    said = F.when(is_ == "boolean", at(v, "$", "boolean")).when(is_.isin("integer", "number"), at(v, "$", "double") != 0).when(is_ == "string", at(v, "$", "string") != "").when(is_ == "array", F.size(items(v)) > 0).when(is_ == "object", F.size(entries(v)) > 0)
    return F.coalesce(said, F.lit(False))


def difficulty(value: Column) -> Column:
    """2, one more each for a login, a reset and over two fuzzy answers, two more where a page or address is checked, 7 at most."""
    pages = F.arrays_overlap(_texts(value, "$.eval.eval_types"), F.array(F.lit("program_html"), F.lit("url_match")))
    return F.least(F.lit(7), 2 + _true(value, "$.require_login").cast("int") + _true(value, "$.require_reset").cast("int") + 2 * pages.cast("int") + (F.size(_texts(value, "$.eval.reference_answers.fuzzy_match")) > 2).cast("int"))


def adapted(tasks: DataFrame, value_column: str = "value", prefix: str = "wa_shop_", sites: dict[str, str] | None = None) -> DataFrame:
    """(task_id, source_task_id, sites, intent, start_url, require_login, require_reset, difficulty, eval_types, fuzzy_match, exact_match, must_include) of every task with a number; what isn't an object, or has none, gives no row."""
    v = F.col(value_column)
    number = at(v, "$.task_id", "bigint")
    given = _texts(v, "$.sites")
    text = lambda path: F.coalesce(at(v, path, "string"), F.lit(""))
    return tasks.where(number.isNotNull()).select(
        F.concat(F.lit(prefix), F.when(number < 10_000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))).alias("task_id"), number.alias("source_task_id"), F.when(F.size(given) > 0, given).otherwise(F.array(F.lit("shopping"))).alias("sites"), text("$.intent").alias("intent"), resolved(text("$.start_url"), sites).alias("start_url"),
        _true(v, "$.require_login").alias("require_login"), _true(v, "$.require_reset").alias("require_reset"), difficulty(v).alias("difficulty"), *(_texts(v, path).alias(name) for name, path in (("eval_types", "$.eval.eval_types"), ("fuzzy_match", "$.eval.reference_answers.fuzzy_match"), ("exact_match", "$.eval.reference_answers.exact_match"), ("must_include", "$.eval.reference_answers.must_include"))),
    )


def only_of(tasks: DataFrame, site: str, value_column: str = "value") -> DataFrame:
    """Tasks whose list of sites is this one alone."""
    return tasks.where(_texts(F.col(value_column), "$.sites") == F.array(F.lit(site)))


def asked_for(adapted_tasks: DataFrame) -> DataFrame:
    """(what, value, n): how many tasks there are of each difficulty, and how often each kind of check is asked for."""
    each = F.concat(F.array(F.struct(F.lit("difficulty").alias("what"), F.col("difficulty").cast("string").alias("value"))), F.transform("eval_types", lambda t: F.struct(F.lit("eval_type").alias("what"), t.alias("value"))))
    return adapted_tasks.select(F.explode(each).alias("e")).groupBy("e.what", "e.value").agg(F.count("*").alias("n"))
