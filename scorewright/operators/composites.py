"""Composite scores of a score row, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the pillars in each composite.
QUALITY = {"url": 0.40, "chk": 0.40, "spc": 0.20}
V3 = {"url": 0.20, "qm": 0.20, "chk": 0.20, "spc": 0.10, "cit": 0.15, "depth": 0.10, "pres": 0.05}
V4 = {"url": 0.10, "spc": 0.05, "chk": 0.10, "cit": 0.10, "qm": 0.05, "fe": 0.13, "ic": 0.13, "pb": 0.08, "sd": 0.06, "depth": 0.10, "pres": 0.10}
V4B = V4 | {"ic": 0.07, "sd": 0.12}
SOFT = {"url": 0.20, "v3_depth": 0.20, "v3_rigor": 0.20, "v3_style": 0.10, "chk": 0.20, "spc": 0.10}
REWARD_V2 = {"deterministic": 0.30, "cit": 0.15, "factuality": 0.25, "judge": 0.15, "comprehensive": 0.10, "efficiency": 0.05}
REWARD_V3 = {"markdown": 0.10, "cit": 0.15, "fact_kg": 0.30, "judge": 0.20, "chk": 0.20, "efficiency": 0.05}


def pillar(name: str) -> Column:
    """A pillar's value; one that is missing counts as zero."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def weighted(weights: dict[str, float], **instead: Column) -> Column:
    """Sum of pillars times weights; `instead` gives columns for some pillars."""
    parts = [F.lit(w) * instead.get(name, pillar(name)) for name, w in weights.items()]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def gated(gate: Column, value: Column, floor: float = 0.0) -> Column:
    return F.greatest(gate, F.lit(floor)) * value


def rescaled(value: Column, low: float = 0.85, high: float = 0.95) -> Column:
    """[low, high] to [0, 1], what lies outside to the ends."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))


def half_open(value: Column) -> Column:
    """0.5 + half the value, within [0.5, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.5), 0.5 + 0.5 * value))


def squashed(value: Column, sharpness: float = 1.2) -> Column:
    """Logistic of the value times sharpness, cut at 6 either way."""
    z = F.least(F.lit(6.0), F.greatest(F.lit(-6.0), value * sharpness))
    return 1 / (1 + F.exp(-z))


def standardised(weights: dict[str, float], sharpness: float = 1.2) -> Column:
    """Weighted sum of pillars, each squashed after standardising over all rows; a constant pillar counts as half.

    Means and deviations belong in a broadcast row of with_statistics(), not in a window over all rows.
    """
    z = lambda n: F.when(F.coalesce(F.col(f"sd_{n}"), F.lit(0.0)) < 1e-6, F.lit(0.5)).otherwise(squashed((pillar(n) - F.col(f"mu_{n}")) / F.col(f"sd_{n}"), sharpness))
    return weighted(weights, **{n: z(n) for n in weights})


def with_statistics(scores: DataFrame, names: list[str]) -> DataFrame:
    """scores with mu_ and sd_ (sample) of each pillar over all rows: one partial aggregate, joined as a single row."""
    stats = scores.agg(*(f(F.col(n)).alias(f"{p}_{n}") for n in names for p, f in (("mu", F.avg), ("sd", F.stddev_samp))))
    return scores.join(F.broadcast(stats))


def all_composites(scores: DataFrame) -> DataFrame:
    """(agent, task) and every composite, to six places (halves of the last place go up, whatever their binary form)."""
    reach, quality, raw = pillar("reach"), weighted(QUALITY), weighted(V3)
    found = {
        "quality": quality, "v2_truthful": reach * quality, "v2_factored": reach * (0.5 + 0.5 * pillar("qm")) * (0.5 + 0.5 * pillar("nli")) * quality,
        "v2_floored": gated(reach, quality, 0.1), "v3": gated(reach, raw, 0.1), "v4": gated(reach, weighted(V4)),
        "v4b": gated(reach, weighted(V4B, ic=rescaled(pillar("ic")))), "v4c": reach * standardised(V4B),
        "v3_soft": half_open(pillar("qm")) * weighted(SOFT), "reward_v2": weighted(REWARD_V2), "reward_v3": weighted(REWARD_V3),
    }
    return with_statistics(scores, list(V4)).select("agent", "task", *(F.round(c + 1e-9, 6).alias(n) for n, c in found.items()))


def factored(quality: Column, **instead: Column) -> Column:
    """Quality times reach, and half to all of each of quotes and claims that hold."""
    part = lambda name: instead.get(name, pillar(name))
    return part("reach") * (0.5 + 0.5 * part("qm")) * (0.5 + 0.5 * part("nli")) * quality


def soft_breakdown(scores: DataFrame) -> DataFrame:
    """(agent, task, dim, contribution, reach_soft, q_value, composite): what each dimension adds to the soft-floored composite's quality."""
    soft, q = half_open(pillar("qm")), weighted(SOFT)
    parts = F.array(*(F.struct(F.lit(n).alias("dim"), F.round(F.lit(w) * pillar(n) + 1e-9, 6).alias("contribution")) for n, w in SOFT.items()))
    return scores.select("agent", "task", F.explode(parts).alias("d"), F.round(soft + 1e-9, 6).alias("reach_soft"), F.round(q + 1e-9, 6).alias("q_value"), F.round(soft * q + 1e-9, 6).alias("composite")).select("agent", "task", "d.*", "reach_soft", "q_value", "composite")


def _versions(scores: DataFrame, versions: list[Column], *names: str) -> DataFrame:
    """(names, agent, mean, rank, tau): each version's mean per agent, its board, and how far that agrees with the board of the version whose names are all null.

    Boards are agents; ranks of equal means go by name. tau is Kendall's over all pairs of agents.
    """
    # groupBy keeps null names apart as one group.
    means = scores.select("agent", F.explode(F.array(*versions)).alias("v")).groupBy("agent", *(F.col(f"v.{n}").alias(n) for n in names)).agg(F.round(F.avg("v.score") + 1e-9, 6).alias("mean"))
    board = ranked(means, "mean", "agent", *names)
    base = board.where(" and ".join(f"{n} is null" for n in names)).select("agent", F.col("rank").alias("base"))
    board = board.where(" or ".join(f"{n} is not null" for n in names)).join(F.broadcast(base), "agent")
    other = board.select(*names, F.col("agent").alias("_agent"), F.col("rank").alias("_rank"), F.col("base").alias("_base"))
    sign = F.signum((F.col("rank") - F.col("_rank")) * (F.col("base") - F.col("_base")))
    tau = board.join(other, list(names)).where(F.col("agent") < F.col("_agent")).groupBy(*names).agg(F.round(F.avg(sign), 6).alias("tau"))
    return board.join(tau, list(names), "left").select(*names, "agent", "mean", "rank", "tau")


def without_each(scores: DataFrame, names: list[str]) -> DataFrame:
    """(dropped, agent, mean, rank, tau): the factored composite's boards with one pillar at zero, for each pillar, against the board with all."""
    zero = F.lit(0.0)
    quality = lambda d: weighted(QUALITY, **({d: zero} if d in QUALITY else {}))
    one = lambda d: F.struct(F.lit(d).cast("string").alias("dropped"), factored(quality(d), **({d: zero} if d else {})).alias("score"))
    return _versions(scores, [one(None), *(one(d) for d in names)], "dropped")


def reweighted(scores: DataFrame, multipliers: list[float]) -> DataFrame:
    """(changed, factor, agent, mean, rank, tau): the factored composite's boards with each quality weight times each factor, all weights then scaled to one sum, against the board as it is."""
    versions = [F.struct(F.lit(None).cast("string").alias("changed"), F.lit(None).cast("double").alias("factor"), factored(weighted(QUALITY)).alias("score"))]
    for name in QUALITY:
        for m in multipliers:
            changed = QUALITY | {name: QUALITY[name] * m}
            total = sum(changed.values())
            versions.append(F.struct(F.lit(name).alias("changed"), F.lit(float(m)).alias("factor"), factored(weighted({k: w / total for k, w in changed.items()})).alias("score")))
    return _versions(scores, versions, "changed", "factor")


def ranked(df: DataFrame, by: str, agent: str = "agent", *within: str) -> DataFrame:
    """df with rank 1, 2, ... by `by` descending, ties by name."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(by), agent)).cast("long"))
