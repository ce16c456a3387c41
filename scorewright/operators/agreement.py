"""Agreement, correlation, and models of items and weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kappa_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the four counts of two binary coders, from which kappa() and alpha() follow."""
    x, y = F.col(a) == 1, F.col(b) == 1
    return pairs.agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"))


def kappa() -> Column:
    """Cohen's kappa of kappa_counts(); 1 where chance alone would always agree."""
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    seen = (F.col("n11") + F.col("n00")) / n
    a, b = (F.col("n11") + F.col("n10")) / n, (F.col("n11") + F.col("n01")) / n
    chance = a * b + (1 - a) * (1 - b)
    return F.when(n == 0, 0.0).when(chance >= 1, 1.0).otherwise((seen - chance) / F.nullif(1 - chance, F.lit(0.0)))


def alpha() -> Column:
    """Krippendorff's nominal alpha for two coders, without the small-sample correction."""
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    ones = (2 * F.col("n11") + F.col("n10") + F.col("n01")) / (2 * n)
    by_chance = 2 * ones * (1 - ones)
    return F.when(n == 0, 0.0).when(by_chance == 0, 1.0).otherwise(1 - ((F.col("n10") + F.col("n01")) / n) / F.nullif(by_chance, F.lit(0.0)))


def landis_koch(k: Column) -> Column:
    bounds = ((0.0, "poor"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial"))
    label = F.when(k < 0, "poor")
    for top, name in bounds[1:]:
        label = label.when(k <= top, name)
    return label.otherwise("almost perfect")


def label_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) over any labels, from a table of label pairs and their margins; kappa is null where chance alone would always agree."""
    cells = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    x = cells.groupBy("x").agg(F.sum("n").alias("nx"))
    y = cells.groupBy("y").agg(F.sum("n").alias("ny"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"))
    chance = x.join(y, F.col("x") == F.col("y")).agg(F.coalesce(F.sum(F.col("nx") * F.col("ny")), F.lit(0)).alias("both"))
    row = total.join(F.broadcast(chance))
    seen, by_chance = F.col("same") / F.col("n"), F.col("both") / (F.col("n") * F.col("n"))
    return row.select("n", F.round(seen, 6).alias("agreement"), F.round(F.when(F.abs(1 - by_chance) >= 1e-12, (seen - by_chance) / (1 - by_chance)), 6).alias("kappa"))


def average_rank(by: str, *within: str) -> Column:
    """Rank from 1 in ascending order, ties sharing the mean of their places."""
    peers = Window.partitionBy(*within, by)
    return F.rank().over(Window.partitionBy(*within).orderBy(by)) + (F.count("*").over(peers) - 1) / 2


def ordinal_rank(by: str, tie: str, *within: str) -> Column:
    return F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(by), tie))


def pearson(df: DataFrame, x: str, y: str, *within: str, places: int = 5) -> DataFrame:
    """(within, n, pearson); null where a side doesn't vary."""
    flat = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) == 0) | (F.coalesce(F.stddev_pop(y), F.lit(0.0)) == 0)
    return df.groupBy(*within).agg(F.count("*").alias("n"), F.round(F.when(~flat, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))), places).alias("pearson"))


def spearman(df: DataFrame, x: str, y: str, *within: str) -> DataFrame:
    """(within, n, spearman): Pearson of average ranks."""
    ranks = df.select(*within, average_rank(x, *within).alias("rx"), average_rank(y, *within).alias("ry"))
    return pearson(ranks, "rx", "ry", *within, places=6).withColumnRenamed("pearson", "spearman")


def spearman_ordinal(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """(n, spearman) as 1 - 6 sum d^2 / n(n^2-1) of ranks without ties; for boards, whose rows are few."""
    ranks = df.select(ordinal_rank(x, name).alias("rx"), ordinal_rank(y, name).alias("ry"))
    n = F.count("*")
    return ranks.agg(n.alias("n"), F.round(1 - 6 * F.sum(F.pow(F.col("rx") - F.col("ry"), F.lit(2))) / F.nullif(n * (n * n - 1), F.lit(0)), 6).alias("spearman"))


def kendall(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """(n, concordant, discordant, tau_a, tau_cd) of a board: over all pairs, and over pairs that aren't tied."""
    right = df.select(F.col(name).alias("_n"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    sign = F.signum(F.col(x) - F.col("_x")) * F.signum(F.col(y) - F.col("_y"))
    c, d = F.count_if(sign > 0), F.count_if(sign < 0)
    return df.join(right, F.col(name) < F.col("_n")).agg(F.count("*").alias("pairs"), c.alias("concordant"), d.alias("discordant"), F.round((c - d) / F.nullif(F.count("*"), F.lit(0)), 6).alias("tau_a"), F.round((c - d) / F.nullif(c + d, F.lit(0)), 6).alias("tau_cd"))


def f_ratio(df: DataFrame, group: str, values: list[str]) -> DataFrame:
    """(pillar, f_ratio): mean over groups of n (mean - grand mean)^2 against the mean of their population variances."""
    long = df.select(group, F.explode(F.array(*(F.struct(F.lit(v).alias("pillar"), F.col(v).alias("value")) for v in values))).alias("p")).select(group, "p.*")
    grand = long.groupBy("pillar").agg(F.avg("value").alias("grand"))
    groups = long.groupBy("pillar", group).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    both = groups.join(grand, "pillar").groupBy("pillar").agg(F.avg(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))).alias("between"), F.avg("var").alias("inside"))
    return both.select("pillar", F.round(F.when(F.col("inside") > 0, F.col("between") / F.nullif(F.col("inside"), F.lit(0.0))), 4).alias("f_ratio"))


def length_normalised(df: DataFrame, length: str, value: str, agent: str) -> DataFrame:
    """(agent, normalised): mean per agent of the value without its linear trend in length, the grand mean added."""
    line = df.agg(F.regr_slope(value, length).alias("slope"), F.regr_intercept(value, length).alias("base"), F.avg(value).alias("grand"))
    rest = F.col(value) - (F.col("slope") * F.col(length) + F.col("base")) + F.col("grand")
    return df.join(F.broadcast(line)).groupBy(agent).agg(F.round(F.avg(rest), 6).alias("normalised"))


def two_parameter(matrix: np.ndarray, steps: int = 400, rate: float = 0.05, ridge: float = 0.05) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Abilities, slopes and difficulties of a 0/1/NaN matrix (agents by tasks), by gradient steps on the penalised likelihood.

    The sign of all is turned so that slopes are positive on the whole; slopes and difficulties stay within 5.
    """
    seen = ~np.isnan(matrix)
    y = np.where(seen, matrix, 0.0)
    theta, a, b = np.zeros(matrix.shape[0]), np.ones(matrix.shape[1]), np.zeros(matrix.shape[1])
    share = (y.sum(axis=1) + 0.5) / (seen.sum(axis=1) + 1)
    theta += np.log(share / (1 - share))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (theta, a, b)]
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(a * (theta[:, None] - b), -30, 30)))
        e = np.where(seen, p - y, 0.0)
        slopes = ((e * a).sum(axis=1) + ridge * theta, (e * (theta[:, None] - b)).sum(axis=0) + ridge * (a - 1), (-e * a).sum(axis=0) + ridge * b)
        for x, g, m in zip((theta, a, b), slopes, moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            x -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    if a.mean() < 0:
        theta, a = -theta, -a
    return theta, np.clip(a, -5, 5), np.clip(b, -5, 5)


def item_parameters(scores: DataFrame, agent: str, task: str, value: str) -> DataFrame:
    """(task, a, b, flag) of a two-parameter model of a board's scores, split at each task's median (fewer than two scores: missing)."""
    median = Window.partitionBy(task)
    split = scores.select(F.col(agent).alias("agent"), F.col(task).alias("task"), F.when(F.count("*").over(median) >= 2, (F.col(value) >= F.median(value).over(median)).cast("double")).alias("y"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        m = rows.pivot_table(index="agent", columns="task", values="y", aggfunc="first", dropna=False)
        _, a, b = two_parameter(m.to_numpy(float))
        return pd.DataFrame({"task": m.columns.astype(str), "a": np.round(a, 4), "b": np.round(b, 4)})

    flag = F.when(F.abs("a") < 0.5, "LOW_DISCRIM").when(F.abs("b") > 2.5, "SATURATED").when(F.col("a") < 0, "INVERTED").otherwise("OK")
    return split.groupBy(F.lit(0).alias("board")).applyInPandas(fit, "task string, a double, b double").withColumn("flag", flag)


def simplex_weights(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, slope: float = 8.0, steps: int = 300, restarts: int = 4, seed: int = 0) -> np.ndarray:
    """Weights that sum to one and make slope * x @ w the log odds of y, the best of several starts; rows count `times`."""
    times = np.ones(len(y)) if times is None else times
    total, rng, best = max(1.0, times.sum()), np.random.default_rng(seed), np.inf
    found = np.full(x.shape[1], 1 / x.shape[1])
    for start in range(restarts):
        z = np.zeros(x.shape[1]) if not start else rng.normal(size=x.shape[1])
        for _ in range(steps):
            w = np.exp(z - z.max())
            w /= w.sum()
            g = slope * x.T @ (times * (1 / (1 + np.exp(-np.clip(slope * x @ w, -30, 30))) - y)) / total
            z -= 2.0 * w * (g - w @ g)
        loss = (times * np.logaddexp(0, -np.where(y > 0.5, 1, -1) * slope * (x @ w))).sum() / total
        if loss < best:
            best, found = loss, w
    return found


def fitted_weights(prefs: DataFrame, features: list[str], folds: int = 5) -> DataFrame:
    """(fold, n_test, loglik, loglik_uniform, w_...): weights fitted outside each fold and judged on it, fold by hash of pref_id.

    prefs has pref_id, y in {0, 0.5, 1} and the differences of the features. A tie counts half for either label. Rows
    are first summed by (fold, differences, y), which bounds what a fold's task holds by the distinct differences.
    """
    cells = prefs.withColumn("fold", F.pmod(F.xxhash64("pref_id"), F.lit(folds))).groupBy("fold", "y", *features).agg(F.count("*").alias("n"))
    spread = cells.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*features, "y", "n"])
        test = rows.fold == rows.held
        x, y, n = rows[features].to_numpy(float), rows.y.to_numpy(float), rows.n.to_numpy(float)
        both = lambda m: (np.repeat(x[m], 2, axis=0), np.tile([1.0, 0.0], int(m.sum())), np.stack([n[m] * y[m], n[m] * (1 - y[m])], axis=1).ravel())
        xt, yt, nt = both(~test.to_numpy())
        w = simplex_weights(xt, yt, nt)
        xv, yv, nv = both(test.to_numpy())
        ll = lambda v: float(-(nv * np.logaddexp(0, -np.where(yv > 0.5, 1, -1) * 8.0 * (xv @ v))).sum() / max(1.0, nv.sum()))
        uniform = np.full(len(features), 1 / len(features))
        return pd.DataFrame([{"fold": int(rows.held.iloc[0]), "n_test": int(n[test].sum()), "loglik": round(ll(w), 4), "loglik_uniform": round(ll(uniform), 4)} | {f"w_{f}": round(float(v), 4) for f, v in zip(features, w, strict=True)}])

    schema = "fold int, n_test long, loglik double, loglik_uniform double, " + ", ".join(f"w_{f} double" for f in features)
    return spread.groupBy("held").applyInPandas(fit, schema)


def length_bias(df: DataFrame, length: str, values: list[str]) -> DataFrame:
    """(pillar, spearman, slope_per_1k, flag): how each value goes with length: OK below 0.4 either way, SUSPECT below 0.6, else STRONG; null where either doesn't vary."""
    long = df.select(F.col(length).cast("double").alias("length"), F.explode(F.array(*(F.struct(F.lit(v).alias("pillar"), F.col(v).alias("value")) for v in values))).alias("p")).select("length", "p.*")
    slope = long.groupBy("pillar").agg(F.round(F.regr_slope("value", "length") * 1000, 6).alias("slope_per_1k"))
    found = spearman(long, "length", "value", "pillar").join(slope, "pillar")
    size = F.abs("spearman")
    return found.select("pillar", F.round("spearman", 3).alias("spearman"), F.when(F.col("spearman").isNotNull(), F.col("slope_per_1k")).alias("slope_per_1k"), F.when(size < 0.4, "OK").when(size < 0.6, "SUSPECT").when(size.isNotNull(), "STRONG").alias("flag"))


def correlation_label(n: Column, r: Column) -> Column:
    """What a correlation of n pairs amounts to; null r is that a side doesn't vary."""
    return F.when(n < 3, "insufficient data").when(r.isNull() | F.isnan(r), "no variance").when(F.abs(r) < 0.2, "no meaningful correlation").when(r > 0.5, "strong positive").when(r > 0.2, "weak positive").when(r < -0.5, "strong negative").otherwise("weak negative")
