"""Ratings from battles: sequential Elo, its bootstrap and permutation tests, and Bradley-Terry fits."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, K, PASSES = 1000.0, 32.0, 20


def expected(own: Column, rival: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (rival - own) / 400))


def elo_pass(a: np.ndarray, b: np.ndarray, score: np.ndarray, n: int, k: float = K) -> np.ndarray:
    """Ratings of agents 0 to n-1 after the battles in their order; both sides move by their ratings before the battle."""
    ratings = [START] * n
    for i, j, s in zip(a.tolist(), b.tolist(), score.tolist(), strict=True):
        gain = k * (s - 1 / (1 + 10 ** ((ratings[j] - ratings[i]) / 400)))
        ratings[i] += gain
        ratings[j] -= gain
    return np.array(ratings)


def _coded(battles: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Battles in a fixed order, so that seeds mean the same wherever rows come from."""
    battles = battles.sort_values(["a", "b", "score_a", *(c for c in ("task",) if c in battles)], kind="stable")
    names = sorted(set(battles.a) | set(battles.b))
    at = {name: i for i, name in enumerate(names)}
    return names, battles.a.map(at).to_numpy(), battles.b.map(at).to_numpy(), battles.score_a.to_numpy(float)


def elo(battles: DataFrame, passes: int = PASSES, k: float = K, seed: int = 42, by: str | None = None) -> DataFrame:
    """([by], agent, elo, wins, losses, draws, n_battles): mean rating over shuffled passes through the battles.

    Sequential Elo hangs on the order, so a board is folded in one task; boards (groups of `by`, such as a judge or a
    pillar) are spread over tasks. Callers pass battles of agents and tasks, whose number a board's size bounds.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        names, a, b, s = _coded(rows)
        rng, total = np.random.default_rng(seed), np.zeros(len(names))
        for _ in range(passes):
            order = rng.permutation(len(a))
            total += elo_pass(a[order], b[order], s[order], len(names), k)
        points = np.concatenate([s, 1 - s])
        who = np.concatenate([a, b])
        count = lambda value: np.bincount(who[points == value], minlength=len(names))
        return pd.DataFrame({"board": rows.board.iloc[0], "agent": names, "elo": np.round(total / passes, 1), "wins": count(1.0), "losses": count(0.0), "draws": count(0.5), "n_battles": np.bincount(who, minlength=len(names))})

    found = battles.withColumn("board", F.col(by).cast("string") if by else F.lit("all")).groupBy("board").applyInPandas(fold, "board string, agent string, elo double, wins long, losses long, draws long, n_battles long")
    return found.withColumnRenamed("board", by) if by else found.drop("board")


#: Tasks over which the samples of a board are spread; each gets the board once.
SAMPLERS = 10


def _for_each_sample(battles: DataFrame, samples: int, draw: Callable[[np.random.Generator, list[str], np.ndarray, np.ndarray, np.ndarray], np.ndarray], stream: int, seed: int) -> DataFrame:
    """(sample, agent, value): what `draw` makes of the battles, for each sample number.

    The board goes once to each of SAMPLERS tasks, which codes it once and draws every SAMPLERS-th sample; nothing comes
    to the driver. Each sample is seeded by its own number, so that it is the same whichever task draws it, and again
    after a loss.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, a, b, s = _coded(rows)
        mine = range(int(rows["sampler"].iloc[0]), samples, SAMPLERS)
        drawn = [draw(np.random.default_rng([seed, stream, sample]), names, a, b, s) for sample in mine]
        return pd.DataFrame({"sample": np.repeat(np.array(mine, np.int64), len(names)), "agent": names * len(drawn), "value": np.concatenate(drawn)})

    spread = battles.select("a", "b", "score_a", F.explode(F.sequence(F.lit(0), F.lit(min(samples, SAMPLERS) - 1))).alias("sampler"))
    return spread.groupBy("sampler").applyInPandas(run, "sample long, agent string, value double")


def elo_samples(battles: DataFrame, resamples: int = 1000, k: float = K, seed: int = 42) -> DataFrame:
    """(sample, agent, elo): a single shuffled pass over battles drawn with replacement, for each sample number."""

    def draw(rng: np.random.Generator, names: list[str], a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
        pick = rng.integers(0, len(a), len(a))
        return elo_pass(a[pick], b[pick], s[pick], len(names), k)

    return _for_each_sample(battles, resamples, draw, 0, seed).withColumnRenamed("value", "elo")


def nearest(values: Column, q: float) -> Column:
    """The element at place int(q * n) of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.least(F.size(ordered) - 1, F.floor(q * F.size(ordered)).cast("int")))


def elo_with_intervals(battles: DataFrame, resamples: int = 1000, confidence: float = 0.95, k: float = K, seed: int = 42) -> DataFrame:
    """(agent, elo, elo_mean, elo_lo, elo_hi, half_width, wins, losses, draws, n_battles)."""
    tail = (1 - confidence) / 2
    spread = elo_samples(battles, resamples, k, seed).groupBy("agent").agg(F.round(F.avg("elo"), 1).alias("elo_mean"), F.collect_list("elo").alias("all"))
    low, high = nearest(F.col("all"), tail), nearest(F.col("all"), 1 - tail)
    spread = spread.select("agent", "elo_mean", F.round(low, 1).alias("elo_lo"), F.round(high, 1).alias("elo_hi"), F.round((high - low) / 2, 1).alias("half_width"))
    return elo(battles, k=k, seed=seed).join(spread, "agent").select("agent", "elo", "elo_mean", "elo_lo", "elo_hi", "half_width", "wins", "losses", "draws", "n_battles")


def rank_significance(battles: DataFrame, permutations: int = 1000, k: float = K, seed: int = 42) -> DataFrame:
    """(higher, lower, gap, p_value): how often shuffled outcomes give neighbours on the board as large a gap, either way."""

    def draw(rng: np.random.Generator, names: list[str], a: np.ndarray, b: np.ndarray, s: np.ndarray) -> np.ndarray:
        order = rng.permutation(len(a))
        return np.round(elo_pass(a[order], b[order], rng.permutation(s)[order], len(names), k), 1)

    null = _for_each_sample(battles, permutations, draw, 1, seed).withColumnRenamed("value", "null_elo")
    board = elo(battles, k=k, seed=seed).selectExpr("agent", "elo", "lead(agent) OVER (ORDER BY elo DESC, agent) AS lower", "lead(elo) OVER (ORDER BY elo DESC, agent) AS lower_elo").where("lower is not null")  # a row an agent
    gaps = board.select(F.col("agent").alias("higher"), "lower", (F.col("elo") - F.col("lower_elo")).alias("gap"))
    tried = gaps.join(null.withColumnsRenamed({"agent": "higher", "null_elo": "x"}), "higher").join(null.withColumnsRenamed({"agent": "lower", "null_elo": "y"}), ["sample", "lower"])
    return tried.groupBy("higher", "lower").agg(F.round(F.first("gap"), 1).alias("gap"), F.round(F.avg((F.abs(F.col("x") - F.col("y")) >= F.abs("gap")).cast("int")), 4).alias("p_value"))


def agent_pairs(bounds: DataFrame) -> DataFrame:
    """(a, b, apart, gap): all pairs of agents with intervals (elo_lo, elo_hi), whether these don't touch, and how far they are from each other (negative: how far they overlap). A board has few agents."""
    right = bounds.select(F.col("agent").alias("b"), F.col("elo_lo").alias("lo"), F.col("elo_hi").alias("hi"))
    gap = F.greatest(F.col("lo") - F.col("elo_hi"), F.col("elo_lo") - F.col("hi"))
    return bounds.join(right, F.col("agent") < F.col("b")).select(F.col("agent").alias("a"), "b", (gap > 0).alias("apart"), F.round(gap, 1).alias("gap"))


def separability(bounds: DataFrame) -> DataFrame:
    """(n_pairs, n_apart, separability_pct) of agents whose intervals (elo_lo, elo_hi) don't touch."""
    return agent_pairs(bounds).agg(F.count("*").alias("n_pairs"), F.count_if("apart").alias("n_apart"), F.round(100 * F.avg(F.col("apart").cast("int")), 2).alias("separability_pct"))


def strengths(won: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Bradley-Terry log strengths of a matrix of wins, by Newton steps on the penalised likelihood; the first stays at zero, then all are centred."""
    n = len(won)
    r, played = np.zeros(n), won + won.T
    for _ in range(100):
        p = 1 / (1 + np.exp(r[None, :] - r[:, None]))
        slope = (won - played * p).sum(axis=1) - ridge * r
        h = played * p * (1 - p)
        curve = np.diag(h.sum(axis=1) + ridge) - h
        step = np.concatenate([[0.0], np.linalg.solve(curve[1:, 1:], slope[1:])]) if n > 1 else np.zeros(1)
        r += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return r - r.mean()


def by_minorisation(won: np.ndarray, steps: int = 500, tolerance: float = 1e-6, prior: float = 0.5) -> np.ndarray:
    """Bradley-Terry strengths of mean one by minorisation-maximisation; `prior` counts as wins and as playing time of each agent."""
    played, p = won + won.T, np.ones(len(won))
    for _ in range(steps):
        new = (prior + won.sum(axis=1)) / (prior + (played / (p[:, None] + p[None, :])).sum(axis=1))
        new /= new.mean()
        done = np.abs(new - p).max() < tolerance
        p = new
        if done:
            break
    return p


SCALE = 400 / np.log(10)


def bradley_terry(wins: DataFrame, method: str = "newton", by: str | None = None) -> DataFrame:
    """([by], agent, rating) from ([by], agent, rival, won). A board's matrix is agents squared, whatever the battles were."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(rows.agent) | set(rows.rival))
        won = rows.pivot_table(index="agent", columns="rival", values="won", aggfunc="sum").reindex(index=names, columns=names).fillna(0.0).to_numpy(float, copy=True)
        np.fill_diagonal(won, 0)
        logs = strengths(won) if method == "newton" else np.log(np.maximum(by_minorisation(won), 1e-300))
        r = SCALE * (logs - logs.mean())
        return pd.DataFrame({"board": rows.board.iloc[0], "agent": names, "rating": np.round(START + r, 1)})

    found = wins.withColumn("board", F.col(by) if by else F.lit("all"))
    kind = found.schema["board"].dataType.simpleString()
    found = found.groupBy("board").applyInPandas(fit, f"board {kind}, agent string, rating double")
    return found.withColumnRenamed("board", by) if by else found.drop("board")


def bradley_terry_intervals(battles: DataFrame, resamples: int = 200, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(agent, lo, hi): percentiles of refits to battles drawn with replacement, interpolated."""
    counts = battles.groupBy("a", "b", "score_a").agg(F.count("*").alias("n"))

    def refit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b", "score_a"])
        names, a, b, s = _coded(rows)
        n = rows["n"].to_numpy()
        drawn = np.random.default_rng([seed, 2, int(rows["sample"].iloc[0])]).multinomial(n.sum(), n / n.sum())
        won = np.zeros((len(names), len(names)))
        np.add.at(won, (a, b), s * drawn)
        np.add.at(won, (b, a), (1 - s) * drawn)
        return pd.DataFrame({"agent": names, "rating": START + SCALE * strengths(won)})

    spread = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("sample"))
    fits = spread.groupBy("sample").applyInPandas(refit, "agent string, rating double")
    return fits.groupBy("agent").agg(F.round(F.percentile("rating", F.lit(alpha / 2)), 1).alias("lo"), F.round(F.percentile("rating", F.lit(1 - alpha / 2)), 1).alias("hi"))
