"""Summaries per group, pivots, quotas, set algebra and upserts."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(values: str | Column, q: float) -> Column:
    """The value at place ceil(q n) of the sorted ones."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {values})")


def top_per_group(df: DataFrame, n: int, order: list[Column], *group: str) -> DataFrame:
    """The first n rows of each group in the given total order, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("place") <= n)


def nearest_in_blocks(asked: DataFrame, vectors: DataFrame, n: int, block: int) -> DataFrame:
    """(query_id, match_id, s): of each block of vectors, the n of largest cosine to each asked one, itself aside; both are (vec_id, embedding).

    Blocks have about `block` rows on either side, each pair of blocks is a task's group. Sums run in the order of the
    elements, so that equal vectors have equal cosines, and ties go to the smaller id.
    """

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "match_id": np.zeros(0, np.int64), "s": np.zeros(0)})
        right = right.sort_values("vec_id")
        ids, q, v = right["vec_id"].to_numpy(), np.stack(left["embedding"]).astype(float), np.stack(right["embedding"]).astype(float)
        q_norm, v_norm = (np.sqrt(np.cumsum(m * m, axis=1)[:, -1]) for m in (q, v))
        asks, found, cosines = [], [], []
        v = np.ascontiguousarray(v.T)
        for own, vector, norm in zip(left["vec_id"], q, q_norm, strict=True):
            s = np.zeros(len(ids))
            for x, column in zip(vector, v, strict=True):
                s += x * column
            norms = norm * v_norm
            s = np.where(norms < 1e-9, 0.0, s / np.where(norms < 1e-9, 1.0, norms))
            others = np.flatnonzero(ids != own)
            if len(others) > n:
                others = others[s[others] >= np.partition(s[others], -n)[-n]]
            others = others[np.argsort(-s[others], kind="stable")][:n]
            asks += [own] * len(others)
            found += ids[others].tolist()
            cosines += s[others].tolist()
        return pd.DataFrame({"query_id": asks, "match_id": found, "s": cosines}).astype({"query_id": "int64", "match_id": "int64", "s": "float64"})

    sides = [(df, max(1, math.ceil(df.count() / block))) for df in (asked, vectors)]
    (a, x), (b, y) = sides
    place = F.xxhash64("vec_id")
    a = a.select("vec_id", "embedding", F.pmod(place, F.lit(x)).alias("qb"), F.explode(F.expr(f"sequence(0L, {y - 1}L)")).alias("vb"))
    b = b.select("vec_id", "embedding", F.explode(F.expr(f"sequence(0L, {x - 1}L)")).alias("qb"), F.pmod(place, F.lit(y)).alias("vb"))
    return a.groupBy("qb", "vb").cogroup(b.groupBy("qb", "vb")).applyInPandas(best, "query_id long, match_id long, s double")


def top_in_blocks(asked: DataFrame, rows: DataFrame, score: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], n: int, query_id: str, row_id: str, block: int = 2048) -> DataFrame:
    """(query_id, row_id, score): the n rows of the highest score above zero for each asked one, ties to the smaller id; a query's own id is no row of it, and a row counts once.

    `score` gives a matrix for a block of queries and one of rows, of about `block` each; blocks meet as groups, so no
    query or row is left out at any size, and of each pair of blocks n rows a query go on. query_id and row_id are text.
    """
    schema = f"{query_id} string, {row_id} string, score double"

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({query_id: pd.Series([], dtype=str), row_id: pd.Series([], dtype=str), "score": np.zeros(0)})
        points = score(left, right)
        ids = right[row_id].to_numpy()
        found: list[tuple[str, str, float]] = []
        for own, line in zip(left[query_id], points, strict=True):
            hits = np.flatnonzero((line > 0) & (ids != own))
            one = {}
            for i in hits[np.argsort(-line[hits], kind="stable")]:
                one.setdefault(ids[i], line[i])
                if len(one) >= n and line[i] < min(list(one.values())[:n]):
                    break
            found += [(own, i, s) for i, s in sorted(one.items(), key=lambda x: (-x[1], x[0]))[:n]]
        return pd.DataFrame(found, columns=[query_id, row_id, "score"])

    sides = [(df, max(1, math.ceil(df.count() / block))) for df in (asked, rows)]
    (a, x), (b, y) = sides
    a = a.select("*", F.pmod(F.xxhash64(query_id), F.lit(x)).alias("qb"), F.explode(F.expr(f"sequence(0L, {y - 1}L)")).alias("rb"))
    b = b.select("*", F.explode(F.expr(f"sequence(0L, {x - 1}L)")).alias("qb"), F.pmod(F.xxhash64(row_id), F.lit(y)).alias("rb"))
    each = a.groupBy("qb", "rb").cogroup(b.groupBy("qb", "rb")).applyInPandas(best, schema)
    return top_per_group(each, n, [F.desc("score"), F.col(row_id)], query_id)


def in_every_group(df: DataFrame, item: str, group: str) -> DataFrame:
    """Relational division: the items that occur with every group."""
    groups = df.agg(F.count_distinct(group).alias("all"))
    return df.groupBy(item).agg(F.count_distinct(group).alias("own")).join(F.broadcast(groups)).where(F.col("own") == F.col("all")).select(item)


def missing_pairs(df: DataFrame, left: str, right: str, most: int = 1_000_000) -> DataFrame:
    """Pairs of a left and a right value that no row has: the work still to do on a board of these sides.

    The board has as many rows as it has places, in the result and so in the work. The shorter side is broadcast,
    after a check that it has at most `most` values.
    """
    sides = [df.select(c).where(F.col(c).isNotNull()).distinct() for c in (left, right)]
    sizes = [side.count() for side in sides]
    if min(sizes) > most:
        raise ValueError(f"both sides of the board have over {most} values")
    short, long = (0, 1) if sizes[0] <= sizes[1] else (1, 0)
    board = sides[long].join(F.broadcast(sides[short])).select(left, right)
    return board.join(df.select(left, right).distinct(), [left, right], "left_anti")


def best_by_words(asked: DataFrame, rows: DataFrame, n: int, block: int = 2000) -> DataFrame:
    """(query_id, row_id, score): the n rows that hold the largest share of each asked one's words, ties to the smaller id.

    asked is (query_id, words), rows (row_id, words), words being arrays of distinct ones. Queries in blocks of about
    `block` meet blocks of rows; of each pair of blocks only n rows a query go on, however common the words are.
    """

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": np.zeros(0, np.int64), "row_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return out
        places: dict[str, list[int]] = {}
        for i, words in enumerate(left["words"]):
            for word in words:
                places.setdefault(word, []).append(i)
        index = {word: np.array(at) for word, at in places.items()}
        ids = right["row_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        counts = np.zeros((len(left), len(right)), np.int32)
        for column, at in enumerate(order):
            for word in right["words"].iloc[at]:
                if (hit := index.get(word)) is not None:
                    counts[hit, column] += 1
        top = np.argsort(-counts, axis=1, kind="stable")[:, :n]
        which = np.repeat(np.arange(len(left)), top.shape[1])
        sizes = np.array([len(w) for w in left["words"]])
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[which], "row_id": ids[order][top.ravel()], "score": counts[which, top.ravel()] / sizes[which]})

    sides = [(df, max(1, math.ceil(df.count() / size))) for df, size in ((asked, block), (rows, 4 * block))]
    (a, x), (b, y) = sides
    a = a.select("query_id", "words", F.pmod(F.xxhash64("query_id"), F.lit(x)).alias("qb"), F.explode(F.expr(f"sequence(0L, {y - 1}L)")).alias("rb"))
    b = b.select("row_id", "words", F.explode(F.expr(f"sequence(0L, {x - 1}L)")).alias("qb"), F.pmod(F.xxhash64("row_id"), F.lit(y)).alias("rb"))
    each = a.groupBy("qb", "rb").cogroup(b.groupBy("qb", "rb")).applyInPandas(best, "query_id long, row_id long, score double")
    return top_per_group(each, n, [F.desc("score"), F.col("row_id")], "query_id").drop("place")


def quota_sample(df: DataFrame, stratum: str, quotas: dict[str, int], key: str, seed: int = 42) -> DataFrame:
    """Exactly the quota of each stratum (or all it has), drawn by a digest of seed and key; strata without a quota have none."""
    quota = F.coalesce(*(F.when(F.col(stratum) == s, F.lit(n)) for s, n in quotas.items()), F.lit(0))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws("/", F.lit(seed), F.col(key))), key))
    return df.where(F.col(stratum).isin(list(quotas))).withColumn("_place", place).where(F.col("_place") <= quota).drop("_place")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, the new side first where both have it, with what happened to each."""
    both = old.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), key, "full")
    change = F.when(F.col("_old") & F.col("_new"), "updated").when(F.col("_new"), "added").otherwise("kept")
    values = [c for c in old.columns if c != key]
    return both.select(key, *(F.when(F.col("_new"), new[c]).otherwise(old[c]).alias(c) for c in values), change.alias("change"))


def latest_override(rows: DataFrame, key: list[str], priority: Column) -> DataFrame:
    """One row per key, the one of the highest priority."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(priority.desc()))).where("_place = 1").drop("_place")
