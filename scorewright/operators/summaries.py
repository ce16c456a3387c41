"""Summaries of runs that are stored and merged: yesterday's with today's runs gives what all runs together give.

A summary row is a group's state: counts and sums, maps of counts by name, and sketches of distinct values and of
quantiles. All parts but the sketches are exact, in any order of merging; finish() turns states into rates and means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.operators.variants import at, entries, items, kind

# Dollars for a million tokens in and out, and those of a model that isn't listed.
PRICES = {"glm-5.1": (1.0, 3.0), "glm-4.6": (0.6, 2.2), "glm-4.5": (0.4, 1.8), "claude-sonnet-4-6": (3.0, 15.0), "claude-opus-4-6": (15.0, 75.0), "deepseek-v3.2": (0.28, 1.12), "doubao-seed-2.0-code": (1.0, 3.0)}
DEFAULT_PRICE = (1.0, 3.0)

#: Columns of a run that are counted where true, and summed.
FLAGS, MEASURES = ("success", "pass_1", "pass_2"), ("outcome", "efficiency", "robustness", "complexity", "composite", "steps", "tokens", "duration")

#: Log2 of the buckets of distinct counts (their standard error is about 1.04 / sqrt(2 ** LG)), and the size of quantile sketches (rank error about 1.33 % at 200).
LG, KLL = 12, 200

_EXACT_UNIT = 10_000  # measures are summed as whole numbers of this part, so that no order of adding changes a sum


def priced(calls: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """LLM calls (model, tokens_in, tokens_out and more) with cost_usd, by a table of prices (model, price_in, price_out) a million tokens.

    A model without a price (or null) costs DEFAULT_PRICE; null tokens are none. The table has a row a model, so it is
    left to Spark to broadcast it.
    """
    if prices is None:
        prices = calls.sparkSession.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, price_in double, price_out double")
    none = lambda c: F.coalesce(c, F.lit(0))
    cost = none("tokens_in") / 1e6 * F.coalesce("price_in", F.lit(DEFAULT_PRICE[0])) + none("tokens_out") / 1e6 * F.coalesce("price_out", F.lit(DEFAULT_PRICE[1]))
    return calls.join(prices, "model", "left").withColumn("cost_usd", cost).drop("price_in", "price_out")


def _unit(column: str) -> Column:
    return F.round(F.col(column).cast("double") * _EXACT_UNIT).cast("decimal(38,0)")


def _maps(rows: DataFrame, by: list[str], maps: list[str]) -> DataFrame:
    """(by, maps): maps of counts added up name by name, so that a name's counts meet in partial aggregates and not in one cell a row."""
    entry = lambda m: F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,bigint>"))), lambda e: F.struct(F.lit(m).alias("map"), e["key"].alias("name"), e["value"].cast("bigint").alias("n")))
    each = rows.select(*by, F.explode(F.concat(*map(entry, maps))).alias("e")).groupBy(*by, "e.map", "e.name").agg(F.sum("e.n").alias("n"))
    listed = lambda m: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("map") == m, F.struct("name", "n"))))).alias(m)
    return each.groupBy(*by).agg(*map(listed, maps))


def _with_maps(state: DataFrame, rows: DataFrame, by: list[str], maps: list[str]) -> DataFrame:
    """state (by and more) with the maps of rows; groups without a name have empty ones, and null groups stay."""
    found = _maps(rows, by, maps)
    for name in by:
        found = found.withColumnRenamed(name, f"_{name}")
    met = state
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in by]
    met = met.join(found, same, "left").drop(*(f"_{name}" for name in by))
    return met.withColumns({m: F.coalesce(m, F.create_map().cast("map<string,bigint>")) for m in maps})


def summarised(runs: DataFrame, *by: str) -> DataFrame:
    """The state of each group of runs.

    runs have FLAGS (boolean), MEASURES (numbers), grade (text), noise (the profile's name), error_codes
    (map<string,int>) and url_list (array<string>). Null measures and flags count as zero and false; null grades and
    codes aren't counted. noise_sum and noise_runs hold the sum and number of composites by profile.
    """
    rows = runs.withColumns({"_grades": F.when(F.col("grade").isNotNull(), F.create_map("grade", F.lit(1).cast("bigint"))), "_errors": F.map_filter(F.col("error_codes").cast("map<string,bigint>"), lambda k, v: v.isNotNull()), "_noise": F.when(F.col("noise").isNotNull(), F.create_map("noise", F.coalesce(_unit("composite"), F.lit(0)).cast("bigint"))), "_noisy": F.when(F.col("noise").isNotNull(), F.create_map("noise", F.lit(1).cast("bigint")))})
    numbers = [F.count("*").alias("runs"), *(F.count_if(F.col(f)).alias(f) for f in FLAGS), *(F.coalesce(F.sum(_unit(m)), F.lit(0)).cast("decimal(38,0)").alias(m) for m in MEASURES)]
    sketches = [F.kll_sketch_agg_double(F.col("duration").cast("double"), F.lit(KLL)).alias("durations")]
    state = rows.groupBy(*by).agg(*numbers, *sketches)
    urls = rows.select(*by, F.explode("url_list").alias("u")).groupBy(*by).agg(F.hll_sketch_agg("u", F.lit(LG)).alias("urls"))
    for name in by:
        urls = urls.withColumnRenamed(name, f"_{name}")
    state = state.join(urls, [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in by], "left").drop(*(f"_{name}" for name in by))
    maps = rows.select(*by, F.col("_grades").alias("grades"), F.col("_errors").alias("errors"), F.col("_noise").alias("noise_sum"), F.col("_noisy").alias("noise_runs"))
    return _with_maps(state, maps, list(by), ["grades", "errors", "noise_sum", "noise_runs"])


def merged(states: DataFrame, *by: str) -> DataFrame:
    """One state a group, from states of any number of parts; `by` may have fewer columns than the parts were grouped by."""
    numbers = [F.sum(c).alias(c) for c in ("runs", *FLAGS)] + [F.sum(m).cast("decimal(38,0)").alias(m) for m in MEASURES]
    whole = states.groupBy(*by).agg(*numbers, F.kll_merge_agg_double("durations").alias("durations"), F.hll_union_agg("urls").alias("urls"))
    return _with_maps(whole, states, list(by), ["grades", "errors", "noise_sum", "noise_runs"])


def finished(states: DataFrame, *by: str) -> DataFrame:
    """Rates, means, histograms, means by noise profile, about how many distinct URLs, and quantiles of the duration."""
    mean = lambda m: F.round(F.col(m).cast("double") / _EXACT_UNIT / F.col("runs"), 6).alias(f"avg_{m}")
    by_noise = F.transform_values("noise_sum", lambda k, v: F.round(v / _EXACT_UNIT / F.element_at("noise_runs", k), 6))
    rates = [F.round(F.col(f) / F.col("runs"), 6).alias(f"{f}_rate") for f in FLAGS]
    return states.select(*by, "runs", *rates, *map(mean, MEASURES), F.col("grades").alias("grade_distribution"), F.col("errors").alias("error_codes"), by_noise.alias("robustness_by_noise"), F.coalesce(F.hll_sketch_estimate("urls"), F.lit(0)).alias("about_urls"), F.when(F.kll_sketch_get_n_double("durations") > 0, F.kll_sketch_get_quantile_double("durations", F.array(F.lit(0.5), F.lit(0.9)))).alias("durations_at_50_90"))


def usage(calls: DataFrame, *by: str) -> DataFrame:
    """(by, llm_calls, tool_calls, tokens_in, tokens_out, cost, wall, first): what runs spent, as a state that add_usage() merges.

    calls (by, at, kind, model, tokens_in, tokens_out, seconds and cost_usd from priced()) of kind llm or tool. cost
    and wall are whole numbers of 1e-9 dollars and of milliseconds. `first` is (at, model) of the first call that names one.
    """
    llm = F.col("kind") == "llm"
    whole = lambda column, unit: F.coalesce(F.sum(F.round(column * unit).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    named = F.when(llm & (F.coalesce("model", F.lit("")) != ""), F.struct("at", "model"))
    return calls.groupBy(*by).agg(F.count_if(llm).alias("llm_calls"), F.count_if(F.col("kind") == "tool").alias("tool_calls"), *(F.coalesce(F.sum(F.when(llm, F.col(c))), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")), whole(F.when(llm, F.col("cost_usd")), 1e9).alias("cost"), whole(F.col("seconds"), 1e3).alias("wall"), F.min(named).alias("first"))


def add_usage(states: DataFrame, *by: str) -> DataFrame:
    """The sum of states of usage() for each group."""
    return states.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("llm_calls", "tool_calls", "tokens_in", "tokens_out")), *(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("cost", "wall")), F.min("first").alias("first"))


def spent(states: DataFrame, *by: str) -> DataFrame:
    """(by, llm_calls, tool_calls, tokens_in, tokens_out, cost_usd to five places, wall_time_s to two, model)."""
    return states.select(*by, "llm_calls", "tool_calls", "tokens_in", "tokens_out", F.round(F.col("cost").cast("double") / 1e9, 5).alias("cost_usd"), F.round(F.col("wall").cast("double") / 1e3, 2).alias("wall_time_s"), F.coalesce("first.model", F.lit("")).alias("model"))


def totals(documents: DataFrame, value_column: str = "value") -> DataFrame:
    """One row over score documents as VARIANT: total_pairs, total_chars, est_tokens, unique_urls, judge_calls, judge_errors.

    A judged pillar that says anything of its judge's error, itself or in its details, is a call, and one that says
    more than nothing a failed one; each cited pair that was compared is a call too. Rows that can't be read are only counted as pairs.
    """
    value = F.col(value_column)

    def judged(name: str) -> tuple[Column, Column]:
        own, details = at(value, f"$.{name}"), at(value, f"$.{name}.details")
        says = lambda v: F.coalesce(F.map_contains_key(entries(v), "judge_error"), F.lit(False))
        error = F.when(says(own), at(own, "$.judge_error")).when(says(details), at(details, "$.judge_error"))
        failed = ~F.coalesce(kind(error), F.lit("null")).isin("null") & (F.coalesce(at(error, "$", "string"), F.lit("")) != "")
        return (says(own) | says(details)).cast("int"), failed.cast("int")

    pairs = [judged(n) for n in ("checklist", "analysis_depth", "presentation")]
    calls = sum((p[0] for p in pairs), F.coalesce(at(value, "$.citation_alignment.details.total_pairs", "bigint"), F.lit(0)))
    errors = sum((p[1] for p in pairs), F.lit(0))
    one = documents.select(F.coalesce(at(value, "$.answer_chars", "bigint"), F.lit(0)).alias("chars"), calls.alias("calls"), errors.alias("errors"), F.transform(items(at(value, "$.citation_alignment.details.samples")), lambda s: at(s, "$.url", "string")).alias("found"))
    counted = one.agg(F.count("*").alias("total_pairs"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("chars", "total_chars"), ("calls", "judge_calls"), ("errors", "judge_errors"))))
    urls = one.select(F.explode("found").alias("u")).where("u != ''").agg(F.count_distinct("u").alias("unique_urls"))
    return counted.join(F.broadcast(urls)).select("total_pairs", "total_chars", F.floor(F.col("total_chars") / 4).alias("est_tokens"), "unique_urls", "judge_calls", "judge_errors")
