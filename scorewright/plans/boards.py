"""Queries over score rows and battles: composites, boards, ratings, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.operators import agreement, battles, composites, ratings
from scorewright.plans import views
from scorewright.plans.views import BATTLES_SQL, PREFS_SQL, QUALITY_SQL, SCORES_SQL
from scorewright.registry import query, table

_V3 = "(0.2*url + 0.2*qm + 0.2*chk + 0.1*spc + 0.15*cit + 0.1*depth + 0.05*pres)"
_SOFT = "(0.2*url + 0.2*v3_depth + 0.2*v3_rigor + 0.1*v3_style + 0.2*chk + 0.1*spc)"
_V4 = "(0.1*url + 0.05*spc + 0.1*chk + 0.1*cit + 0.05*qm + 0.13*fe + 0.13*ic + 0.08*pb + 0.06*sd + 0.1*depth + 0.1*pres)"
_V4B = "(0.1*url + 0.05*spc + 0.1*chk + 0.1*cit + 0.05*qm + 0.13*fe + 0.07*least(1, greatest(0, (ic - 0.85) / 0.1)) + 0.08*pb + 0.12*sd + 0.1*depth + 0.1*pres)"
_Z = lambda n: f"CASE WHEN coalesce(s_{n}, 0) < 1e-6 THEN 0.5 ELSE 1 / (1 + exp(-least(6, greatest(-6, 1.2 * ({n} - m_{n}) / s_{n})))) END"
_V4C = " + ".join(f"{w} * {_Z(n)}" for n, w in composites.V4B.items())
_STATS = ", ".join(f"avg({n}) AS m_{n}, stddev_samp({n}) AS s_{n}" for n in composites.V4)


@query("leaderboard_truthful", f"""WITH {BATTLES_SQL},
sides AS (SELECT a AS agent, score_a AS p FROM battles UNION ALL SELECT b, 1 - score_a FROM battles),
rec AS (SELECT agent, count(*) FILTER (p = 1) AS wins, count(*) FILTER (p = 0) AS losses, count(*) FILTER (p = 0.5) AS draws, count(*) AS n_battles FROM sides GROUP BY 1),
m AS (SELECT agent, round(avg(composite) + 1e-9, 6) AS mean_composite FROM truthful GROUP BY 1)
SELECT m.agent, mean_composite, wins, losses, draws, n_battles, row_number() OVER (ORDER BY mean_composite DESC, m.agent) AS rank FROM m JOIN rec ON rec.agent = m.agent""")  # fmt: skip
def leaderboard_truthful(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = views.truthful(spark, sf_dir).groupBy("agent").agg(F.round(F.avg("composite") + 1e-9, 6).alias("mean_composite"))
    return composites.ranked(means.join(battles.record(views.battles(spark, sf_dir)), "agent"), "mean_composite")


@query("composites_all", f"""WITH {SCORES_SQL}, st AS (SELECT {_STATS} FROM scores)
SELECT agent, task, round({QUALITY_SQL} + 1e-9, 6) AS quality, round(reach * {QUALITY_SQL} + 1e-9, 6) AS v2_truthful, round(reach * (0.5 + 0.5*qm) * (0.5 + 0.5*nli) * {QUALITY_SQL} + 1e-9, 6) AS v2_factored,
 round(greatest(reach, 0.1) * {QUALITY_SQL} + 1e-9, 6) AS v2_floored, round(greatest(reach, 0.1) * {_V3} + 1e-9, 6) AS v3, round(reach * {_V4} + 1e-9, 6) AS v4, round(reach * {_V4B} + 1e-9, 6) AS v4b, round(reach * ({_V4C}) + 1e-9, 6) AS v4c,
 round((0.5 + 0.5*qm) * {_SOFT} + 1e-9, 6) AS v3_soft, round(0.3*deterministic + 0.15*cit + 0.25*factuality + 0.15*judge + 0.1*comprehensive + 0.05*efficiency + 1e-9, 6) AS reward_v2, round(0.1*markdown + 0.15*cit + 0.3*fact_kg + 0.2*judge + 0.2*chk + 0.05*efficiency + 1e-9, 6) AS reward_v3 FROM scores, st""")  # fmt: skip
def composites_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composites.all_composites(views.scores(spark, sf_dir))


@query("soft_breakdown", f"WITH {SCORES_SQL} " + " UNION ALL ".join(f"SELECT agent, task, '{d}' AS dim, round({w} * {d} + 1e-9, 6) AS contribution, round(0.5 + 0.5*qm + 1e-9, 6) AS reach_soft, round({_SOFT} + 1e-9, 6) AS q_value, round((0.5 + 0.5*qm) * {_SOFT} + 1e-9, 6) AS composite FROM scores" for d, w in composites.SOFT.items()))
def soft_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composites.soft_breakdown(views.scores(spark, sf_dir))


_FACTORED = lambda quality, **zero: f"{zero.get('reach', 'reach')} * (0.5 + 0.5 * {zero.get('qm', 'qm')}) * (0.5 + 0.5 * {zero.get('nli', 'nli')}) * ({quality})"
_TAUS = lambda names: f""", b AS (SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY mean DESC, agent) AS rank FROM m), x AS (SELECT b.*, o.rank AS base FROM b JOIN o USING (agent)),
t AS (SELECT {', '.join(f'x.{n}' for n in names.split(', '))}, avg(sign((x.rank - y.rank) * (x.base - y.base))) AS tau FROM x JOIN x y ON {' AND '.join(f'x.{n} = y.{n}' for n in names.split(', '))} AND x.agent < y.agent GROUP BY ALL)
SELECT {', '.join(f'x.{n}' for n in names.split(', '))}, agent, mean, rank, round(tau, 6) AS tau FROM x JOIN t ON {' AND '.join(f'x.{n} = t.{n}' for n in names.split(', '))}"""  # noqa: E731
_BASE = f"o AS (SELECT agent, row_number() OVER (ORDER BY round(avg({_FACTORED('0.4*url + 0.4*chk + 0.2*spc')}) + 1e-9, 6) DESC, agent) AS rank FROM scores GROUP BY 1)"
_DROPS = ("url", "chk", "spc", "reach", "qm", "nli")


@query("composite_leave_one_out", f"WITH {SCORES_SQL}, {_BASE}, m AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dropped, agent, round(avg({_FACTORED(' + '.join(f'{w}*{n}' for n, w in composites.QUALITY.items() if n != d), **{d: '0'})}) + 1e-9, 6) AS mean FROM scores GROUP BY 2" for d in _DROPS) + ")" + _TAUS("dropped"))
def composite_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composites.without_each(views.scores(spark, sf_dir), list(_DROPS))


_FACTORS = (0.5, 0.75, 1.0, 1.25, 1.5)


@query("composite_weight_sweep", f"WITH {SCORES_SQL}, {_BASE}, m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS changed, CAST({f} AS DOUBLE) AS factor, agent, round(avg({_FACTORED(' + '.join(f'{w * (f if n == c else 1)}*{n}' for n, w in composites.QUALITY.items()))}) / {1 + composites.QUALITY[c] * (f - 1)} + 1e-9, 6) AS mean FROM scores GROUP BY 3" for c in composites.QUALITY for f in _FACTORS) + ")" + _TAUS("changed, factor"))
def composite_weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composites.reweighted(views.scores(spark, sf_dir), list(_FACTORS))


@query("floor_sweep", f"WITH {SCORES_SQL} SELECT agent, f AS floor, round(avg(greatest(reach, f) * {QUALITY_SQL}), 6) AS mean FROM scores, (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.2), (0.5)) t(f) GROUP BY 1, 2")
def floor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.scores(spark, sf_dir).withColumn("floor", F.explode(F.array(*map(F.lit, (0.0, 0.05, 0.1, 0.2, 0.5)))))
    return rows.groupBy("agent", "floor").agg(F.round(F.avg(F.greatest("reach", "floor") * composites.weighted(composites.QUALITY)), 6).alias("mean"))


@query("floor_ranking")
def floor_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(floor, agent, rating, rank, tau): Bradley-Terry boards of the floored composite, each against that of floor 0.1."""
    rows = views.scores(spark, sf_dir).withColumn("floor", F.explode(F.array(*map(F.lit, (0.0, 0.05, 0.1, 0.2, 0.5)))))
    rows = rows.select("agent", F.concat_ws("/", "floor", "task").alias("key"), (F.greatest("reach", "floor") * composites.weighted(composites.QUALITY)).alias("score"))
    fought = battles.pair_battles(rows, "key", "agent", "score", tie=0.0).where("score_a != 0.5").withColumn("floor", F.substring_index("task", "/", 1).cast("double"))
    board = composites.ranked(ratings.bradley_terry(battles.win_matrix(fought, "floor"), "mm", "floor"), "rating", "agent", "floor")
    base = board.where("floor = 0.1").select("agent", F.col("rank").alias("base"))
    board = board.join(F.broadcast(base), "agent")
    other = board.select("floor", F.col("agent").alias("_agent"), F.col("rank").alias("_rank"), F.col("base").alias("_base"))
    sign = F.signum((F.col("rank") - F.col("_rank")) * (F.col("base") - F.col("_base")))
    tau = board.join(other, "floor").where(F.col("agent") < F.col("_agent")).groupBy("floor").agg(F.round(F.avg(sign), 6).alias("tau"))
    return board.join(tau, "floor").select("floor", "agent", "rating", "rank", "tau")


@query("battles_with_ties", f"WITH {BATTLES_SQL} SELECT task, a, b, CAST(score_a AS DOUBLE) AS score_a FROM battles")
def battles_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.battles(spark, sf_dir)


@query("battles_exact_positive", f"""WITH {SCORES_SQL}, p AS (SELECT agent, task, max(round(url - 0.5, 2)) AS s FROM scores WHERE round(url - 0.5, 2) > 0 GROUP BY 1, 2)
SELECT x.task, x.agent AS a, y.agent AS b, CAST(CASE WHEN x.s = y.s THEN 0.5 WHEN x.s > y.s THEN 1 ELSE 0 END AS DOUBLE) AS score_a FROM p x JOIN p y ON x.task = y.task AND x.agent < y.agent""")  # fmt: skip
def battles_exact_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.scores(spark, sf_dir).withColumn("s", F.round(F.col("url") - 0.5, 2))
    return battles.pair_battles(rows, "task", "agent", "s", tie=0, positive=True, once=True)


@query("win_matrix", f"WITH {BATTLES_SQL}, sides AS (SELECT a AS agent, b AS rival, score_a AS p FROM battles UNION ALL SELECT b, a, 1 - score_a FROM battles) SELECT agent, rival, CAST(sum(p) AS DOUBLE) AS won FROM sides GROUP BY 1, 2")
def win_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return battles.win_matrix(views.battles(spark, sf_dir))


@query("human_win_rates", f"WITH {PREFS_SQL}, s AS (SELECT a AS agent, CASE winner WHEN 'a' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END AS p FROM prefs UNION ALL SELECT b, CASE winner WHEN 'b' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0 END FROM prefs) SELECT agent, count(*) AS n, round(avg(p), 6) AS win_rate FROM s GROUP BY 1")
def human_win_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = views.prefs(spark, sf_dir).select("a", "b", F.when(F.col("winner") == "a", F.col("a")).when(F.col("winner") == "b", F.col("b")).otherwise("tie").alias("winner"))
    return battles.both_sides(battles.normalised(named)).groupBy("agent").agg(F.count("*").alias("n"), F.round(F.avg("points"), 6).alias("win_rate"))


@query("winner_histogram_by_judge", f"WITH {PREFS_SQL} SELECT judge, winner, count(*) AS n FROM prefs GROUP BY 1, 2")
def winner_histogram_by_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.prefs(spark, sf_dir).groupBy("judge", "winner").agg(F.count("*").alias("n"))


@query("judgement_reconciled", """WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'TIE' END AS x, CASE user_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'A' ELSE 'TIE' END AS y FROM events),
w AS (SELECT *, CASE y WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE 'TIE' END AS back FROM v)
SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN x IS NULL THEN 'TIE' WHEN x = back THEN x WHEN x = 'TIE' THEN back WHEN back = 'TIE' THEN x ELSE 'TIE' END AS verdict FROM w) GROUP BY 1""")  # fmt: skip
def judgement_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    first = F.when(F.col("event_id") % 4 == 0, "A").when(F.col("event_id") % 4 == 1, "B").when(F.col("event_id") % 4 == 2, "TIE")
    second = F.when(F.col("user_id") % 3 == 0, "B").when(F.col("user_id") % 3 == 1, "A").otherwise("TIE")
    return e.select(battles.reconcile(first, second).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("elo_board")
def elo_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.elo(views.battles(spark, sf_dir))


@query("elo_per_judge")
def elo_per_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One board per judge, from preferences summed to one battle for each judge, task and pair."""
    p = views.prefs(spark, sf_dir)
    points = F.when(F.col("winner") == "a", 1.0).when(F.col("winner") == "b", 0.0).otherwise(0.5)
    turned = p.select("judge", "task", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), points).otherwise(1 - points).alias("s"))
    share = turned.groupBy("judge", "task", "a", "b").agg(F.avg("s").alias("s"))
    return ratings.elo(share.select("judge", "task", "a", "b", battles.outcome(F.col("s"), F.lit(0.5), 1e-9).alias("score_a")), by="judge")


@query("elo_per_pillar")
def elo_per_pillar(spark: SparkSession, sf_dir: str) -> DataFrame:
    pillars = F.explode(F.array(*(F.struct(F.lit(n).alias("pillar"), composites.pillar(n).alias("score")) for n in ("reach", "url", "chk", "qm", "cit", "depth"))))
    long = views.scores(spark, sf_dir).select("agent", "task", pillars.alias("p")).select("agent", F.concat_ws("/", "p.pillar", "task").alias("key"), "p.score")
    fought = battles.pair_battles(long, "key", "agent", "score").withColumn("pillar", F.substring_index("task", "/", 1))
    return ratings.elo(fought, by="pillar")


@query("elo_with_intervals")
def elo_with_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.elo_with_intervals(views.battles(spark, sf_dir))


@query("rank_significance")
def rank_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.rank_significance(views.battles(spark, sf_dir))


@query("separability")
def separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.separability(ratings.elo_with_intervals(views.battles(spark, sf_dir)))


@query("separability_of_means", f"""WITH {SCORES_SQL}, b AS (SELECT agent, avg(url) - stddev_samp(url) / 4 AS lo, avg(url) + stddev_samp(url) / 4 AS hi FROM scores GROUP BY 1)
SELECT count(*) AS n_pairs, count(*) FILTER (x.hi < y.lo OR y.hi < x.lo) AS n_apart, round(100 * avg(CASE WHEN x.hi < y.lo OR y.hi < x.lo THEN 1 ELSE 0 END), 2) AS separability_pct FROM b x JOIN b y ON x.agent < y.agent""")  # fmt: skip
def separability_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.stddev_samp("url") / 4
    return ratings.separability(views.scores(spark, sf_dir).groupBy("agent").agg((F.avg("url") - half).alias("elo_lo"), (F.avg("url") + half).alias("elo_hi")))


@query("bradley_terry_newton")
def bradley_terry_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.bradley_terry(battles.win_matrix(views.battles(spark, sf_dir)))


@query("bradley_terry_minorised")
def bradley_terry_minorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    fought = battles.pair_battles(views.truthful(spark, sf_dir), "task", "agent", "composite", tie=0.0).where("score_a != 0.5")  # ties tell it nothing
    return ratings.bradley_terry(battles.win_matrix(fought), "mm")


@query("bradley_terry_intervals")
def bradley_terry_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.bradley_terry_intervals(views.battles(spark, sf_dir))


@query("kappa_of_labels", """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS n11, count(*) FILTER (quality = 1 AND toxic <> 1) AS n10, count(*) FILTER (quality <> 1 AND toxic = 1) AS n01, count(*) FILTER (quality <> 1 AND toxic <> 1) AS n00 FROM labels),
p AS (SELECT *, (n11 + n10 + n01 + n00)::DOUBLE AS n FROM c), q AS (SELECT *, (n11 + n10) / n AS a, (n11 + n01) / n AS b, (2*n11 + n10 + n01) / (2*n) AS o FROM p),
k AS (SELECT *, round(((n11 + n00) / n - (a*b + (1-a)*(1-b))) / (1 - (a*b + (1-a)*(1-b))), 6) AS kappa, round(1 - ((n10 + n01) / n) / (2*o*(1-o)), 6) AS alpha FROM q)
SELECT n11, n10, n01, n00, kappa, alpha, CASE WHEN kappa < 0 THEN 'poor' WHEN kappa <= 0.2 THEN 'slight' WHEN kappa <= 0.4 THEN 'fair' WHEN kappa <= 0.6 THEN 'moderate' WHEN kappa <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS label FROM k""")  # fmt: skip
def kappa_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = agreement.kappa_counts(table(spark, sf_dir, "labels"), "quality", "toxic").withColumns({"kappa": F.round(agreement.kappa(), 6), "alpha": F.round(agreement.alpha(), 6)})
    return found.withColumn("label", agreement.landis_koch(F.col("kappa")))


@query("kappa_of_preferences", f"""WITH {PREFS_SQL}, x AS (SELECT winner AS x, CASE WHEN a < b THEN 'a' ELSE 'b' END AS y FROM prefs WHERE winner <> 'tie'), c AS (SELECT x, y, count(*) AS n FROM x GROUP BY 1, 2),
t AS (SELECT CAST(sum(n) AS BIGINT) AS n, sum(CASE WHEN x = y THEN n ELSE 0 END) AS same FROM c), m AS (SELECT sum(u.n * v.n)::DOUBLE AS chance FROM (SELECT x, sum(n) AS n FROM c GROUP BY 1) u JOIN (SELECT y, sum(n) AS n FROM c GROUP BY 1) v ON u.x = v.y)
SELECT n, round(same / n, 6) AS agreement, round((same / n - chance / (n * n)) / (1 - chance / (n * n)), 6) AS kappa FROM t, m""")  # fmt: skip
def kappa_of_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.label_kappa(views.prefs(spark, sf_dir).where("winner != 'tie'").withColumn("by_name", F.when(F.col("a") < F.col("b"), "a").otherwise("b")), "winner", "by_name")


_CORR = ("reach", "url", "chk", "qm", "nli", "cit")
_LONG = " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {x} AS vx, {y} AS vy, agent, task FROM scores" for i, x in enumerate(_CORR) for y in _CORR[i + 1 :])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, y, vx, vy): every pair of pillars of every score row."""
    pairs = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).alias("vx"), F.col(y).alias("vy")) for i, x in enumerate(_CORR) for y in _CORR[i + 1 :]]
    return views.scores(spark, sf_dir).select("agent", "task", F.explode(F.array(*pairs)).alias("p")).select("agent", "task", "p.*")


@query("pearson_matrix", f"WITH {SCORES_SQL}, l AS ({_LONG}) SELECT x, y, count(*) AS n, round(corr(vx, vy), 5) AS pearson FROM l GROUP BY 1, 2")
def pearson_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.pearson(_pairs(spark, sf_dir), "vx", "vy", "x", "y")


@query("spearman_matrix", f"""WITH {SCORES_SQL}, l AS ({_LONG}), r AS (SELECT x, y, rank() OVER (PARTITION BY x, y ORDER BY vx) + (count(*) OVER (PARTITION BY x, y, vx) - 1) / 2.0 AS rx,
rank() OVER (PARTITION BY x, y ORDER BY vy) + (count(*) OVER (PARTITION BY x, y, vy) - 1) / 2.0 AS ry FROM l) SELECT x, y, count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1, 2""")  # fmt: skip
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.spearman(_pairs(spark, sf_dir), "vx", "vy", "x", "y")


_MEANS = f"{SCORES_SQL}, m AS (SELECT agent, round(avg(reach * {QUALITY_SQL}), 6) AS v2, round(avg({QUALITY_SQL}), 6) AS v1 FROM scores GROUP BY 1)"


def _two_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = composites.weighted(composites.QUALITY)
    return views.scores(spark, sf_dir).groupBy("agent").agg(F.round(F.avg(F.col("reach") * quality), 6).alias("v2"), F.round(F.avg(quality), 6).alias("v1"))


@query("kendall_of_boards", f"""WITH {_MEANS}, p AS (SELECT sign(x.v1 - y.v1) * sign(x.v2 - y.v2) AS s FROM m x JOIN m y ON x.agent < y.agent)
SELECT count(*) AS pairs, count(*) FILTER (s > 0) AS concordant, count(*) FILTER (s < 0) AS discordant, round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) / count(*), 6) AS tau_a,
round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) / nullif(count(*) FILTER (s <> 0), 0), 6) AS tau_cd FROM p""")  # fmt: skip
def kendall_of_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.kendall(_two_boards(spark, sf_dir), "v1", "v2", "agent")


@query("spearman_of_boards", f"WITH {_MEANS}, r AS (SELECT row_number() OVER (ORDER BY v1 DESC, agent) AS a, row_number() OVER (ORDER BY v2 DESC, agent) AS b FROM m) SELECT count(*) AS n, round(1 - 6 * sum((a - b) * (a - b)) / (count(*) * (count(*) * count(*) - 1)), 6) AS spearman FROM r")
def spearman_of_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.spearman_ordinal(_two_boards(spark, sf_dir), "v1", "v2", "agent")


@query("f_ratio", f"""WITH {SCORES_SQL}, l AS (""" + " UNION ALL ".join(f"SELECT '{v}' AS pillar, agent, {v} AS value FROM scores" for v in _CORR) + """), g AS (SELECT pillar, avg(value) AS grand FROM l GROUP BY 1),
a AS (SELECT pillar, agent, count(*) AS n, avg(value) AS mean, var_pop(value) AS var FROM l GROUP BY 1, 2) SELECT pillar, round(avg(n * (mean - grand) * (mean - grand)) / avg(var), 4) AS f_ratio FROM a JOIN g USING (pillar) GROUP BY 1""")  # fmt: skip
def f_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.f_ratio(views.scores(spark, sf_dir), "agent", list(_CORR))


@query("length_normalised", f"WITH {SCORES_SQL}, l AS (SELECT regr_slope(url, chars) AS s, regr_intercept(url, chars) AS i, avg(url) AS g FROM scores) SELECT agent, round(avg(url - (s * chars + i) + g), 6) AS normalised FROM scores, l GROUP BY 1")
def length_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.length_normalised(views.scores(spark, sf_dir), "chars", "url", "agent")


_BIAS = ("url", "chk", "qm", "cit", "depth", "pres")


@query("length_bias", f"WITH {SCORES_SQL}, l AS (" + " UNION ALL ".join(f"SELECT '{p}' AS pillar, CAST(chars AS DOUBLE) AS x, {p} AS y FROM scores" for p in _BIAS) + """), r AS (SELECT *, rank() OVER (PARTITION BY pillar ORDER BY x) + (count(*) OVER (PARTITION BY pillar, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY pillar ORDER BY y) + (count(*) OVER (PARTITION BY pillar, y) - 1) / 2.0 AS ry FROM l),
g AS (SELECT pillar, round(corr(rx, ry), 6) AS rho, regr_slope(y, x) AS slope FROM r GROUP BY 1) SELECT pillar, round(rho, 3) AS spearman, round(slope * 1000, 6) AS slope_per_1k, CASE WHEN abs(rho) < 0.4 THEN 'OK' WHEN abs(rho) < 0.6 THEN 'SUSPECT' ELSE 'STRONG' END AS flag FROM g""")  # fmt: skip
def length_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.length_bias(views.scores(spark, sf_dir), "chars", list(_BIAS))


@query("item_parameters")
def item_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.item_parameters(views.truthful(spark, sf_dir), "agent", "task", "composite")


@query("fitted_weights")
def fitted_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences joined to both sides' pillars, fitted with five held-out folds."""
    names = ["url", "chk", "cit", "depth"]
    s = views.scores(spark, sf_dir).select("agent", "task", *names)
    left, right = (s.select("task", F.col("agent").alias(side), *(F.col(n).alias(f"{side}_{n}") for n in names)) for side in ("a", "b"))
    joined = views.prefs(spark, sf_dir).join(left, ["task", "a"]).join(right, ["task", "b"])
    y = F.when(F.col("winner") == "a", 1.0).when(F.col("winner") == "b", 0.0).otherwise(0.5)
    return agreement.fitted_weights(joined.select("pref_id", y.alias("y"), *((F.col(f"a_{n}") - F.col(f"b_{n}")).alias(n) for n in names)), names)


@query("rank_gaps", f"WITH {_MEANS} SELECT agent, v2, lead(agent) OVER (ORDER BY v2 DESC, agent) AS next_agent, round(v2 - lead(v2) OVER (ORDER BY v2 DESC, agent), 6) AS gap FROM m")
def rank_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy(F.desc("v2"), "agent")  # over a board: a row an agent
    return _two_boards(spark, sf_dir).select("agent", "v2", F.lead("agent").over(w).alias("next_agent"), F.round(F.col("v2") - F.lead("v2").over(w), 6).alias("gap"))


@query("boards_side_by_side", f"""WITH {_MEANS}, x AS (SELECT agent, v2 FROM m WHERE v2 > (SELECT min(v2) FROM m)), y AS (SELECT agent, v1 FROM m WHERE v1 > (SELECT min(v1) FROM m))
SELECT coalesce(x.agent, y.agent) AS agent, v2, v1, round(v1 - v2, 6) AS delta FROM x FULL JOIN y ON x.agent = y.agent""")  # fmt: skip
def boards_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _two_boards(spark, sf_dir)
    least = F.broadcast(m.agg(F.min("v2").alias("low2"), F.min("v1").alias("low1")))
    x, y = m.join(least).where("v2 > low2").select("agent", "v2"), m.join(least).where("v1 > low1").select("agent", "v1")
    return x.join(y, "agent", "full").select("agent", "v2", "v1", F.round(F.col("v1") - F.col("v2"), 6).alias("delta"))
