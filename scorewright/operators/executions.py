"""Grades of runs of agents: outcome, efficiency, robustness against a noisy twin, and complexity.

Rows have execution_id, task_id, success, has_output, output_keys, steps, tokens, cost, tools, errors, recovered,
context_used, context_max, and of their task expected_steps, expected_tokens, required_keys, required_tools.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions import numeric

# Weights of the four parts of the grade.
WEIGHTS = {"outcome": 0.40, "efficiency": 0.20, "robustness": 0.25, "complexity": 0.15}


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def valid_output() -> Column:
    """Whether a successful run's output has all keys that its task asks for."""
    keys = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return F.coalesce(F.col("success") & F.col("has_output"), F.lit(False)) & (F.size(F.array_except(keys("required_keys"), keys("output_keys"))) == 0)


def secondary(kind: Column, target: Column, tolerance: Column) -> Column:
    """Score of one further criterion: form, closeness of steps or tokens to a target, likeness, or 0.5 for an unknown kind."""
    close = lambda value, wanted, room: F.greatest(F.lit(0.0), 1 - F.abs(value - wanted) / room)
    return (
        F.when(kind == "format_check", valid_output().cast("double"))
        .when(kind == "process_quality", close(_number("steps"), F.coalesce(target, _number("expected_steps")), F.coalesce(tolerance, F.lit(4.0))))
        .when(kind == "efficiency", close(_number("tokens"), F.coalesce(target, _number("expected_tokens")), F.coalesce(tolerance, F.lit(1000.0))))
        .when(kind == "visual_similarity", F.when(F.coalesce("success", F.lit(False)), 0.8).otherwise(0.3))
        .otherwise(0.5)
    )


def outcome(criteria: str | None = None) -> Column:
    """0.70 for a valid output, 0.35 for another, and 0.30 of the mean of weighted further criteria, an array of (kind, weight, target, tolerance)."""
    done = F.coalesce(F.col("success") & F.col("has_output"), F.lit(False))
    primary = F.when(done & valid_output(), 0.70).when(done, 0.35).otherwise(0.0)
    if criteria is None:
        return primary
    points = F.aggregate(F.col(criteria), F.lit(0.0), lambda a, c: a + secondary(c["kind"], c["target"], c["tolerance"]) * c["weight"])
    return F.least(F.lit(1.0), primary + F.coalesce(points / F.nullif(F.size(criteria), F.lit(0)) * 0.30, F.lit(0.0)))


def efficiency() -> Column:
    """Steps, tokens and cost against what the task expects: 0.40, 0.35 and 0.25, each falling piecewise."""
    at_least_one = lambda name: F.greatest(_number(name), F.lit(1.0))
    steps, tokens = _number("steps") / at_least_one("expected_steps"), _number("tokens") / at_least_one("expected_tokens")
    by_step = F.when(steps <= 1, 1.0).when(steps <= 1.5, 1 - (steps - 1) * 0.4).when(steps <= 2, 0.8 - (steps - 1.5) * 0.4).otherwise(F.greatest(F.lit(0.3), 0.6 - (steps - 2) * 0.2))
    by_token = F.when(tokens <= 1, 1.0).when(tokens <= 1.5, 1 - (tokens - 1) * 0.3).otherwise(F.greatest(F.lit(0.5), 0.85 - (tokens - 1.5) * 0.2))
    cost, expected = _number("cost") / at_least_one("steps"), _number("expected_tokens") / at_least_one("expected_steps") * 0.0001
    ratio = cost / F.nullif(expected, F.lit(0.0))
    by_cost = F.when(cost <= expected, 1.0).when(cost <= 2 * expected, 1 - (ratio - 1) * 0.3).otherwise(F.greatest(F.lit(0.7), 1 - ratio * 0.4))
    return F.least(F.lit(1.0), 0.40 * by_step + 0.35 * by_token + 0.25 * F.coalesce(by_cost, F.lit(0.7)))


def complexity() -> Column:
    """Diversity of tools, room in the context and recovered errors: 0.35, 0.35 and 0.30."""
    tools = F.size(F.array_distinct(F.coalesce("tools", F.array().cast("array<string>"))))
    asked = F.size(F.array_distinct(F.coalesce("required_tools", F.array().cast("array<string>"))))
    diversity = F.when(asked > 0, F.least(F.lit(1.0), tools / F.nullif(asked, F.lit(0)))).when(tools > 0, 1.0).otherwise(0.5)
    filled = _number("context_used") / F.nullif(_number("context_max"), F.lit(0.0))
    context = F.when((_number("steps") <= 10) | (_number("context_used") == 0), 1.0).when(filled < 0.8, 1.0).when(filled < 0.95, 0.9).otherwise(0.7)
    return F.least(F.lit(1.0), 0.35 * diversity + 0.35 * context + 0.30 * _number("recovered") / F.greatest(_number("errors"), F.lit(1.0)))


def grades(clean: DataFrame, noisy: DataFrame, criteria: str | None = None) -> DataFrame:
    """(execution_id, task_id, the four scores, composite, grade, pass_1, pass_2, output_valid) of every clean run, its noisy twin found by task_id.

    Without a twin robustness is 1.0 for a success, else 0.5. A noisy run falls gracefully if it recovers from errors,
    succeeds where the clean one does, or fails with an output. A composite that is at a grade's least score but for the
    last binary digits has that grade.
    """
    twin = noisy.groupBy("task_id").agg(F.min_by(F.struct(F.coalesce("success", F.lit(False)).alias("success"), F.coalesce("recovered", F.lit(0)).alias("recovered"), F.coalesce("has_output", F.lit(False)).alias("has_output")), "execution_id").alias("noisy"))
    success = F.coalesce("success", F.lit(False))
    lost = success.cast("double") - F.col("noisy.success").cast("double")
    held = F.when(lost < 0.1, 1.0).when(lost < 0.3, 0.95 - (lost - 0.1) * 1.5).otherwise(F.greatest(F.lit(0.55), 1 - lost))
    graceful = (F.col("noisy.recovered") > 0) | (success & F.col("noisy.success")) | (F.col("noisy.has_output") & ~F.col("noisy.success"))
    robustness = F.when(F.col("noisy").isNull(), F.when(success, 1.0).otherwise(0.5)).otherwise(F.least(F.lit(1.0), 0.70 * held + 0.30 * F.when(graceful, 0.8).otherwise(0.3)))
    scored = clean.join(twin, "task_id", "left").select("execution_id", "task_id", outcome(criteria).alias("outcome"), efficiency().alias("efficiency"), robustness.alias("robustness"), complexity().alias("complexity"), success.alias("pass_1"), (success | (_number("recovered") > 0)).alias("pass_2"), valid_output().alias("output_valid"))
    composite = sum((w * F.col(n) for n, w in WEIGHTS.items()), F.lit(0.0))
    return scored.withColumn("_c", composite).select("execution_id", "task_id", *(F.round(F.col(n) + 1e-9, 4).alias(n) for n in WEIGHTS), F.round(F.col("_c") + 1e-9, 4).alias("composite"), numeric.grade(F.round("_c", 12)).alias("grade"), "pass_1", "pass_2", "output_valid")
