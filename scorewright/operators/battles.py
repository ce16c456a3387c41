"""From scores to battles: pairs of contestants of a task, their outcomes, and boards of wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcome(left: Column, right: Column, tie: float) -> Column:
    """1, 0.5 or 0 for the left side; a difference under `tie` draws, and with tie=0 equal scores do."""
    gap = left - right
    draw = F.abs(gap) < tie if tie > 0 else gap == 0
    return F.when(draw, 0.5).when(gap > 0, 1.0).otherwise(0.0)


def pair_battles(scores: DataFrame, task: str, agent: str, score: str, tie: float = 0.005, positive: bool = False, once: bool = False) -> DataFrame:
    """(task, a, b, score_a) for all pairs of agents of a task, a before b by name.

    The pairs of a task are its agents squared, never its rows: with once=True the best of an agent's scores for a
    task counts. positive=True leaves scores of zero and less out.
    """
    rows = scores.select(F.col(task).alias("task"), F.col(agent).alias("agent"), F.col(score).alias("score"))
    if positive:
        rows = rows.where("score > 0")
    if once:
        rows = rows.groupBy("task", "agent").agg(F.max("score").alias("score"))
    left = rows.select("task", F.col("agent").alias("a"), F.col("score").alias("x"))
    right = rows.select("task", F.col("agent").alias("b"), F.col("score").alias("y"))
    return left.join(right, "task").where("a < b").select("task", "a", "b", outcome(F.col("x"), F.col("y"), tie).alias("score_a"))


def normalised(rows: DataFrame) -> DataFrame:
    """(a, b, score_a) from any of three shapes: a1, a2, agent_winner; agent_a, agent_b, winner; a, b, score_a."""
    have = set(rows.columns)
    first = lambda *names: F.coalesce(*(F.col(n) for n in names if n in have)) if have & set(names) else F.lit(None).cast("string")
    a, b, winner = first("a", "agent_a", "a1"), first("b", "agent_b", "a2"), first("agent_winner", "winner")
    named = F.when(winner == a, 1.0).when(winner == b, 0.0).otherwise(0.5)
    score = F.coalesce(F.col("score_a").cast("double"), named) if "score_a" in have else named
    return rows.select(a.alias("a"), b.alias("b"), score.alias("score_a")).where("a is not null and b is not null")


def both_sides(battles: DataFrame, *by: str) -> DataFrame:
    """([by], agent, rival, points): each battle as seen from either side."""
    return battles.select(*by, F.col("a").alias("agent"), F.col("b").alias("rival"), F.col("score_a").alias("points")).unionByName(battles.select(*by, F.col("b").alias("agent"), F.col("a").alias("rival"), (1 - F.col("score_a")).alias("points")))


def record(battles: DataFrame) -> DataFrame:
    """(agent, wins, losses, draws, n_battles)."""
    points = F.col("points")
    return both_sides(battles).groupBy("agent").agg(F.count_if(points == 1.0).alias("wins"), F.count_if(points == 0.0).alias("losses"), F.count_if(points == 0.5).alias("draws"), F.count("*").alias("n_battles"))


def win_matrix(battles: DataFrame, *by: str) -> DataFrame:
    """([by], agent, rival, won): points of each agent against each rival, draws as half."""
    return both_sides(battles, *by).groupBy(*by, "agent", "rival").agg(F.sum("points").alias("won"))


def reconcile(first: Column, swapped: Column) -> Column:
    """The verdict from two judgements, the second with sides swapped: agreement stands, a tie yields to the other, conflict is a tie.

    A first verdict that can't be read makes a tie.
    """
    back = F.when(swapped == "A", "B").when(swapped == "B", "A").otherwise("TIE")
    return F.when(first.isNull() | ~first.isin("A", "B", "TIE"), "TIE").when(first == back, first).when(first == "TIE", back).when(back == "TIE", first).otherwise("TIE")
