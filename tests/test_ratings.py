"""Ratings against plain loops, gradients and planted parameters."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from scorewright.operators import agreement, battles, composites, ratings


def fought(n=300, seed=1):
    """Battles of four agents of known strength, drawn by the Bradley-Terry model, some of them drawn games."""
    rng, strength, rows = random.Random(seed), {"a": 1.2, "b": 0.4, "c": -0.3, "d": -1.0}, []
    for k in range(n):
        x, y = sorted(rng.sample(sorted(strength), 2))
        p = 1 / (1 + np.exp(strength[y] - strength[x]))
        rows.append((f"t{k:04}", x, y, 0.5 if rng.random() < 0.1 else float(rng.random() < p)))
    return rows


@pytest.fixture(scope="module")
def board(spark):
    return spark.createDataFrame(fought(), "task string, a string, b string, score_a double")


def test_elo_by_a_loop(board):
    rows = sorted(fought(), key=lambda r: (r[1], r[2], r[3], r[0]))
    rng, total = np.random.default_rng(42), dict.fromkeys("abcd", 0.0)
    for _ in range(ratings.PASSES):
        elo = dict.fromkeys("abcd", 1000.0)
        for i in rng.permutation(len(rows)):
            _, x, y, s = rows[i]
            gain = 32 * (s - 1 / (1 + 10 ** ((elo[y] - elo[x]) / 400)))
            elo[x] += gain
            elo[y] -= gain
        for x in total:
            total[x] += elo[x] / ratings.PASSES
    found = {r.agent: r for r in ratings.elo(board).collect()}
    assert {x: found[x].elo for x in total} == pytest.approx({x: round(v, 1) for x, v in total.items()}, abs=0.11)
    assert sum(r.elo for r in found.values()) == pytest.approx(4000, abs=0.5)
    for x, r in found.items():
        own = [s if p == x else 1 - s for _, p, q, s in rows if x in (p, q)]
        assert (r.wins, r.losses, r.draws, r.n_battles) == (own.count(1.0), own.count(0.0), own.count(0.5), len(own))


def test_bradley_terry_at_the_top(board):
    """At the fit the penalised likelihood's gradient is zero in all directions that leave the mean."""
    won = np.zeros((4, 4))
    for _, x, y, s in fought():
        won["abcd".index(x), "abcd".index(y)] += s
        won["abcd".index(y), "abcd".index(x)] += 1 - s
    r = ratings.strengths(won)

    def loss(v):
        return -sum(won[i, j] * -np.log1p(np.exp(v[j] - v[i])) for i in range(4) for j in range(4) if i != j) + 0.005 * (np.asarray(v) - v[0]) @ (np.asarray(v) - v[0])

    grad = [(loss(r + d) - loss(r - d)) / 2e-5 for d in np.eye(4) * 1e-5]
    assert np.allclose(grad[1:], 0, atol=1e-3)
    found = {x.agent: x.rating for x in ratings.bradley_terry(battles.win_matrix(board)).collect()}
    assert [found[x] for x in "abcd"] == pytest.approx(1000 + 400 / np.log(10) * r, abs=0.06)


def test_minorisation_by_a_loop(board):
    decided = [b for b in fought() if b[3] != 0.5]
    theta = dict.fromkeys("abcd", 1.0)
    for _ in range(500):
        new = {}
        for x in theta:
            met = {y: [s if p == x else 1 - s for _, p, q, s in decided if {p, q} == {x, y}] for y in theta if y != x}
            new[x] = (0.5 + sum(map(sum, met.values()))) / (0.5 + sum(len(v) / (theta[x] + theta[y]) for y, v in met.items()))
        mean = sum(new.values()) / 4
        new = {x: v / mean for x, v in new.items()}
        done = max(abs(new[x] - theta[x]) for x in theta) < 1e-6
        theta = new
        if done:
            break
    logs = {x: np.log(v) for x, v in theta.items()}
    middle = sum(logs.values()) / 4
    found = {r.agent: r.rating for r in ratings.bradley_terry(battles.win_matrix(board.where("score_a != 0.5")), "mm").collect()}
    assert found == pytest.approx({x: 1000 + 400 * (v - middle) / np.log(10) for x, v in logs.items()}, abs=0.06)


def test_boards_apart(spark, board):
    """Boards by name are fitted each for itself."""
    two = board.withColumn("name", F.lit("x")).unionByName(board.where("a = 'a'").withColumn("name", F.lit("y")))
    found = {(r.name, r.agent): r.rating for r in ratings.bradley_terry(battles.win_matrix(two, "name"), "newton", "name").collect()}
    alone = {r.agent: r.rating for r in ratings.bradley_terry(battles.win_matrix(board)).collect()}
    assert {x: found["x", x] for x in "abcd"} == alone and found["y", "a"] != alone["a"]


def test_intervals_hold_the_rating(board):
    """Bootstrap spreads are about what resampling in plain numpy gives, and the same each time."""
    found = {r.agent: r for r in ratings.elo_with_intervals(board, 120).collect()}
    assert found == {r.agent: r for r in ratings.elo_with_intervals(board.repartition(7), 120).collect()}
    rows, rng, plain = sorted((x, y, s) for _, x, y, s in fought()), np.random.default_rng(0), []
    a, b = (np.array(["abcd".index(r[k]) for r in rows]) for k in (0, 1))
    s = np.array([r[2] for r in rows])
    for _ in range(400):
        pick = rng.integers(0, len(rows), len(rows))
        plain.append(ratings.elo_pass(a[pick], b[pick], s[pick], 4))
    spread = np.std(plain, axis=0)
    for k, x in enumerate("abcd"):
        assert found[x].elo_lo < found[x].elo_mean < found[x].elo_hi
        assert found[x].half_width == pytest.approx(1.96 * spread[k], rel=0.35)
    bt = {r.agent: (r.lo, r.hi) for r in ratings.bradley_terry_intervals(board, 80).collect()}
    fit = {r.agent: r.rating for r in ratings.bradley_terry(battles.win_matrix(board)).collect()}
    assert all(bt[x][0] < fit[x] < bt[x][1] for x in "abcd")


def test_significance(spark, board):
    assert len(ratings.rank_significance(board, 20).collect()) == 3
    # m wins from either side, so that shuffled outcomes tell against it
    far = spark.createDataFrame([(f"t{k}", *(("a", "m", float(k % 20 == 0)) if k % 2 else ("m", "z", 1.0))) for k in range(200)], "task string, a string, b string, score_a double")
    assert ratings.rank_significance(far, 100).first().p_value < 0.05
    even = spark.createDataFrame([(f"t{k}", "a", "b", float(k % 2)) for k in range(100)], "task string, a string, b string, score_a double")
    assert ratings.rank_significance(even, 100).first().p_value > 0.2


def test_items_with_planted_parameters(spark):
    """Tasks that tell agents apart get larger slopes than those that don't, and abilities come back in order."""
    rng = np.random.default_rng(5)
    ability = np.linspace(-2, 2, 60)
    slopes = np.array([2.5] * 12 + [0.1] * 6)
    y = (rng.random((60, 18)) < 1 / (1 + np.exp(-slopes * ability[:, None]))).astype(float)
    theta, a, b = agreement.two_parameter(y)
    assert np.corrcoef(theta, ability)[0, 1] > 0.8 and a[:12].min() > a[12:].max() and np.abs(b[:12]).mean() < 1
    rows = spark.createDataFrame([(f"x{i}", f"t{j}", float(y[i, j] + rng.random() / 10)) for i in range(60) for j in range(18)], "agent string, task string, v double")
    found = {r.task: r for r in agreement.item_parameters(rows, "agent", "task", "v").collect()}
    assert all(found[f"t{j}"].flag == "OK" for j in range(12)) and sum(found[f"t{j}"].flag == "LOW_DISCRIM" for j in range(12, 18)) >= 4


def test_weights_with_planted_ones(spark):
    rng, true = np.random.default_rng(6), np.array([0.6, 0.3, 0.1])
    x = rng.uniform(-1, 1, (3000, 3)).round(1)
    y = (rng.random(3000) < 1 / (1 + np.exp(-8 * x @ true))).astype(float)
    assert agreement.simplex_weights(x, y) == pytest.approx(true, abs=0.05)
    prefs = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(3000)], "pref_id long, y double, u double, v double, w double")
    found = agreement.fitted_weights(prefs, ["u", "v", "w"]).collect()
    assert len(found) == 5 and sum(r.n_test for r in found) == 3000
    for r in found:
        assert [r.w_u, r.w_v, r.w_w] == pytest.approx(true, abs=0.08) and r.loglik > r.loglik_uniform


def test_sweeps_keep_the_baseline(spark):
    """A weight times one changes nothing, so tau is 1."""
    rng = random.Random(3)
    rows = [(x, f"t{k}", *(rng.random() for _ in range(6))) for x in "abcde" for k in range(8)]
    scores = spark.createDataFrame(rows, "agent string, task string, url double, chk double, spc double, reach double, qm double, nli double")
    found = composites.reweighted(scores, [1.0, 1.5]).collect()
    assert all(r.tau == 1.0 for r in found if r.factor == 1.0) and len(found) == 3 * 2 * 5
    drop = composites.without_each(scores, ["reach", "url"]).collect()
    assert all(r["mean"] == 0 for r in drop if r.dropped == "reach") and len(drop) == 10
