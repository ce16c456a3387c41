"""Profiles of agents: pillars, ways of citing, drift of stored composites, their scores by task, best and worst tasks, gaps between ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.operators import filters

# A line that begins with a numbered URL, a link, and how much more of one makes a style.
NUMBERED, LINK, DOMINANT = r"(?mdU)^\s*\[(\d{1,3})\]\s*\.?\s*(?:[-:.]\s*)?http", r"\[[^\]]+\]\(http[^)]+\)", 1.5


def pillar_profiles(scores: DataFrame, pillars: list[str], composite: str = "composite") -> DataFrame:
    """(agent, pairs, mean, median, avg_<pillar>): composites and pillars of each agent, missing ones counting as zero."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return scores.groupBy("agent").agg(F.count("*").alias("pairs"), F.round(F.avg(zero(composite)) + 1e-9, 4).alias("mean"), F.round(F.median(zero(composite)) + 1e-9, 4).alias("median"), *(F.round(F.avg(zero(p)) + 1e-9, 3).alias(f"avg_{p}") for p in pillars))


def citation_styles(reports: DataFrame, by: str = "agent", md_column: str = "md") -> DataFrame:
    """(by, pairs, numbered, markdown, style): numbered URL lines and links over all reports of an agent; the one that is DOMINANT times the other is its style, else mixed."""
    count = lambda pattern: F.sum(F.coalesce(F.regexp_count(md_column, F.lit(pattern)), F.lit(0)))
    counted = reports.groupBy(by).agg(F.count("*").alias("pairs"), count(NUMBERED).alias("numbered"), count(LINK).alias("markdown"))
    style = F.when(F.col("markdown") > F.col("numbered") * DOMINANT, "markdown").when(F.col("numbered") > F.col("markdown") * DOMINANT, "numbered").otherwise("mixed")
    return counted.withColumn("style", style)


def composite_drift(rows: DataFrame, stored: str, computed: Column, by: str = "agent", most: float = 0.001) -> DataFrame:
    """(by, pairs, drifts, max_drift): stored composites over `most` from what their pillars give, both to four places; max_drift is zero without any."""
    drift = F.round(F.abs(F.round(computed + 1e-9, 4) - F.round(F.coalesce(F.col(stored), F.lit(0.0)) + 1e-9, 4)), 6)
    return rows.select(by, drift.alias("d")).groupBy(by).agg(F.count("*").alias("pairs"), F.count_if(F.col("d") > most).alias("drifts"), F.coalesce(F.max(F.when(F.col("d") > most, F.col("d"))), F.lit(0.0)).alias("max_drift"))


def matrix(scores: DataFrame, tasks: list[str], value: str = "composite") -> DataFrame:
    """(agent, <tasks>, mean): a row an agent, a column for each of the named tasks, and the mean over those that it has."""
    cells = scores.groupBy("agent").pivot("task", tasks).agg(F.first(value))
    present = F.array_compact(F.array(*(F.col(f"`{t}`") for t in tasks)))
    return cells.withColumn("mean", F.round(F.coalesce(F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(present), F.lit(0)), F.lit(0.0)) + 1e-9, 6))


def drilldown(scores: DataFrame, pillars: list[str], n: int = 3, composite: str = "composite") -> DataFrame:
    """(agent, tasks, avg_<pillar>, best, worst): means over the rows that have a pillar, and the n best and worst tasks (task, composite), ties by task."""
    up, down = (F.row_number().over(Window.partitionBy("agent").orderBy(order, "task")) for order in (F.desc(composite), F.asc(composite)))
    placed = scores.where(F.col(composite).isNotNull()).withColumns({"_up": up, "_down": down})
    ends = lambda place: F.transform(F.sort_array(F.collect_list(F.when(F.col(place) <= n, F.struct(place, "task", F.round(F.col(composite), 4).alias("composite"))))), lambda x: F.struct(x["task"].alias("task"), x["composite"].alias("composite")))
    ranked = placed.groupBy("agent").agg(ends("_up").alias("best"), ends("_down").alias("worst"))
    return scores.groupBy("agent").agg(F.count("*").alias("tasks"), *(F.round(F.avg(p) + 1e-9, 4).alias(f"avg_{p}") for p in pillars)).join(ranked, "agent", "left")


def gap_statistics(board: DataFrame, rating: str = "rating", name: str = "agent") -> DataFrame:
    """(gaps, least, mean) of differences between neighbours of a board, a row an agent; nulls with fewer than two."""
    below = F.lead(rating).over(Window.orderBy(F.desc(rating), name))
    return board.select((F.col(rating) - below).alias("gap")).where("gap is not null").agg(F.count("*").alias("gaps"), F.round(F.min("gap"), 6).alias("least"), F.round(F.avg("gap"), 6).alias("mean"))


def top_flags(counts: DataFrame, by: str, n: int = 5) -> DataFrame:
    """(by, fault, n, place): the n most frequent flags of each group in rows (by, fault, primary, n), primaries aside, ties by name."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "fault"))
    return counts.where("NOT primary").select(by, "fault", "n", place.cast("long").alias("place")).where(F.col("place") <= n)


def real(rows: DataFrame, *composites: str) -> DataFrame:
    """Rows of which any composite is above zero; placeholders have none."""
    return rows.where(F.greatest(*(F.coalesce(c, F.lit(0.0)) for c in composites), F.lit(0.0)) > 0)


def version_summary(rows: DataFrame, old: str, new: str, measures: list[str]) -> DataFrame:
    """(agent, n_runs, <old>_mean, <new>_mean, avg_<measure>, delta): means of two composites and of measures over an agent's real rows, each over those rows that have it; delta is the difference of the rounded means."""
    mean = lambda c: F.round(F.avg(c) + 1e-9, 4)
    out = real(rows, old, new).groupBy("agent").agg(F.count("*").alias("n_runs"), mean(old).alias(f"{old}_mean"), mean(new).alias(f"{new}_mean"), *(mean(m).alias(f"avg_{m}") for m in measures))
    return out.withColumn("delta", F.round(F.col(f"{new}_mean") - F.col(f"{old}_mean"), 4))


def largest_changes(rows: DataFrame, old: str, new: str, n: int = 15) -> DataFrame:
    """(agent, task, <old>, <new>, delta, place): the n real rows whose composites differ most, either way, ties by agent and task."""
    changed = real(rows, old, new).where(F.col(old).isNotNull() & F.col(new).isNotNull()).withColumn("delta", F.round(F.col(new) - F.col(old), 6))
    first = changed.select("agent", "task", old, new, "delta").orderBy(F.desc(F.abs("delta")), "agent", "task").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("delta")), "agent", "task")).cast("long"))  # n rows


def audit_table(rows: DataFrame) -> DataFrame:
    """(agent, files, kept, dropped, mean, median, mean_v1, mean_chars, reach_0, reach_1, judge_errors, reasons) of score rows as filters.py takes them, with v1 beside composite.

    Composites are of kept rows, all else of every row. reasons has the numbers of short, infra and judge_err, of
    which a row may have several.
    """
    each = rows.withColumns({"_why": filters.drop_reason(), "_all": filters.drop_reasons()})
    kept = F.col("_why").isNull()
    of = lambda f, c: F.round(f(F.when(kept, F.col(c))) + 1e-9, 6)
    zero = F.coalesce(F.col("reach"), F.lit(0.0))
    reasons = F.concat_ws(", ", *(F.concat(F.count_if(~kept & F.array_contains("_all", r)).cast("string"), F.lit(f" {r}")) for r in ("short", "infra", "judge_err")))
    return each.groupBy("agent").agg(F.count("*").alias("files"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped"), of(F.avg, "composite").alias("mean"), of(F.median, "composite").alias("median"), of(F.avg, "v1").alias("mean_v1"), F.round(F.avg(F.coalesce("answer_chars", F.lit(0))), 4).alias("mean_chars"), F.count_if(zero == 0).alias("reach_0"), F.count_if(zero >= 0.999).alias("reach_1"), F.count_if("ck_error").alias("judge_errors"), reasons.alias("reasons"))


def audit_panel(table: DataFrame, most: float = 0.3) -> DataFrame:
    """One row over audit_table(): files, kept, dropped, ranked and excluded agents, and a verdict: PASS if nothing is dropped, FAIL if an agent lost all rows or over `most` of all are dropped, else WARN."""
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("agent")))), ", ")
    out = table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "kept", "dropped")), names(F.col("kept") > 0).alias("ranked"), names(F.col("kept") == 0).alias("excluded"))
    return out.withColumn("verdict", F.when((F.col("dropped") == 0) & (F.col("excluded") == ""), "PASS").when((F.col("excluded") != "") | (F.col("dropped") > F.col("files") * most), "FAIL").otherwise("WARN"))
