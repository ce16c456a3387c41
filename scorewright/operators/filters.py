"""Score rows that are no scores, and those that look odd.

Rows are (agent, task, composite, reach, chk, answer_chars, cited, ck_error, ad_error, pres_error, infra_failure,
head), head being the beginning of the answer. Nulls count as zero, false and empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What runners write in the place of a report.
NO_REPORT = r"^\s*\([^)]*produced no report"
RUNNER_ERROR = r"(?i)^\s*\(\s*[a-z][\w\- ]*\s+(error|stderr)\s*:"

REASONS = ("short", "infra", "judge_err", "placeholder")


def drop_reason() -> Column:
    """Why a score row is left out of boards, null if it isn't: no or next to no answer, a sandbox that was down, judges that all failed, a runner's placeholder."""
    number, flag = (lambda c: F.coalesce(F.col(c), F.lit(0))), (lambda c: F.coalesce(F.col(c), F.lit(False)))
    short = (F.col("answer_chars") == 0) | (number("answer_chars") > 0) & (number("answer_chars") < 600) & (number("reach") == 0) & (number("chk") == 0)
    placeholder = F.coalesce(F.col("head").rlike(NO_REPORT) | F.col("head").rlike(RUNNER_ERROR), F.lit(False))
    return F.when(F.coalesce(short, F.lit(False)), "short").when(flag("infra_failure"), "infra").when(flag("ck_error") & flag("ad_error") & flag("pres_error"), "judge_err").when(placeholder, "placeholder")


def drop_reasons() -> Column:
    """All of short, infra and judge_err that hold for a row, in this order."""
    number, flag = (lambda c: F.coalesce(F.col(c), F.lit(0))), (lambda c: F.coalesce(F.col(c), F.lit(False)))
    short = (F.col("answer_chars") == 0) | (number("answer_chars") > 0) & (number("answer_chars") < 600) & (number("reach") == 0) & (number("chk") == 0)
    found = {"short": F.coalesce(short, F.lit(False)), "infra": flag("infra_failure"), "judge_err": flag("ck_error") & flag("ad_error") & flag("pres_error")}
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in found.items())))


def drop_counts(rows: DataFrame) -> DataFrame:
    """(agent, total, kept, degenerate, one count for each reason, mean_kept): an agent all of whose rows are dropped still has a row."""
    each = rows.withColumn("reason", drop_reason())
    return each.groupBy("agent").agg(F.count("*").alias("total"), F.count_if(F.col("reason").isNull()).alias("kept"), F.count("reason").alias("degenerate"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS), F.round(F.avg(F.when(F.col("reason").isNull(), F.col("composite"))) + 1e-9, 6).alias("mean_kept"))


def anomalies(rows: DataFrame, deviations: float = 3.0, places: int = 3, repeats: int = 4) -> DataFrame:
    """(agent, task, outlier, repeated, reach_without_urls, judged_despite_error) of every row.

    Of rows that aren't dropped: composites over `deviations` from the agent's median (of four rows or more), and those
    that come again, to so many places, on `repeats` tasks of an agent. Of all rows: full reach without a cited URL,
    and a checklist's share beside its judge's error.
    """
    each = rows.withColumns({"reason": drop_reason(), "rounded": F.round("composite", places)})
    kept = each.where("reason is null")
    spread = kept.groupBy("agent").agg(F.median("composite").alias("middle"), F.stddev_samp("composite").alias("sd"), F.count("*").alias("n"))
    again = kept.groupBy("agent", "rounded").agg(F.count_distinct("task").alias("tasks"))
    met = each.join(spread, "agent", "left").join(again, ["agent", "rounded"], "left")
    fine = F.col("reason").isNull()
    sure = lambda c: F.coalesce(c, F.lit(False))
    outlier = fine & (F.col("n") >= 4) & (F.col("sd") > 0) & (F.abs(F.col("composite") - F.col("middle")) > deviations * F.col("sd"))
    return met.select("agent", "task", sure(outlier).alias("outlier"), sure(fine & (F.col("tasks") >= repeats)).alias("repeated"), sure((F.col("reach") >= 0.999) & (F.col("cited") == 0)).alias("reach_without_urls"), sure(F.col("ck_error") & (F.col("chk") > 0)).alias("judged_despite_error"))
