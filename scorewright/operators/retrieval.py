"""Search over posts and pages by words, and over remembered tasks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.operators.aggregates import top_in_blocks, top_per_group

_SHIFT = 2.0

# Topics that a query's words hint at, and the forums where they are talked about.
HINTS = {
    "headphone": ["headphones", "technology"], "bluetooth": ["headphones", "technology"], "noise": ["headphones", "technology"], "audio": ["headphones", "technology"],
    "office": ["LifeProTips", "personalfinance"], "chair": ["LifeProTips", "personalfinance"], "desk": ["LifeProTips", "personalfinance"], "budget": ["LifeProTips", "personalfinance"],
    "money": ["personalfinance", "LifeProTips"], "spend": ["personalfinance", "LifeProTips"], "save": ["personalfinance", "LifeProTips"], "cook": ["LifeProTips", "personalfinance"], "kitchen": ["LifeProTips", "personalfinance"],
    "game": ["gaming", "videogames"], "pc": ["gaming", "technology"], "gaming": ["gaming", "videogames"], "monitor": ["gaming", "technology"],
}
# What a task's first line says its kind is; the first that fits counts.
INTENTS = [("comparison", "comparison"), ("debunking", "debunking"), ("fact-check", "debunking"), ("fact check", "debunking"), ("causal", "causal"), ("timeline", "timeline"), ("evolution", "timeline"), ("enumeration", "enumeration"), ("catalog", "enumeration"), ("recommendation", "recommendation"), ("market-intelligence", "recommendation")]


def hinted_forums(query: Column, hints: dict[str, list[str]] | None = None) -> Column:
    """Forums that a query's words hint at, each once, in the order of the hints."""
    low = F.lower(F.coalesce(query, F.lit("")))
    none = F.array().cast("array<string>")
    each = [F.when(F.contains(low, F.lit(word)), F.array(*map(F.lit, forums))).otherwise(none) for word, forums in (hints or HINTS).items()]
    return F.array_distinct(F.concat(*each))


def overlap(query: Column, text: Column) -> Column:
    """Share of a query's words of three or more letters and digits that a text holds; zero for a query without any."""
    words = F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w)))
    return F.coalesce(hits / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def search_posts(queries: DataFrame, posts: DataFrame, n: int = 10, bonus: float = 0.5, hints: dict[str, list[str]] | None = None, block: int = 2048) -> DataFrame:
    """(query_id, url, score, place): the n best posts (url, forum, title, summary) for each query (query_id, query), ties by URL.

    The score is the overlap, and in a hinted forum `bonus` more, up to 1.0; posts without any are left out, a URL
    counts once. Queries and posts meet in blocks: in each, a word is looked for once in every post, however many
    queries ask for it, and n posts a query go on.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))
    kind = queries.schema["query_id"].dataType
    asks = queries.select(F.col("query_id").cast("string").alias("query_id"), words.alias("words"), hinted_forums(F.col("query"), hints).alias("forums"))
    rows = posts.select("url", "forum", F.lower(F.concat_ws(" ", "title", "summary")).alias("text"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        points, texts = np.zeros((len(left), len(right))), right["text"].tolist()
        hits = {w: np.fromiter((w in t for t in texts), bool, len(texts)) for w in {w for ws in left["words"] for w in ws}}
        forums = right["forum"].to_numpy()
        hinted = {f: forums == f for f in {f for fs in left["forums"] for f in fs}}
        for i, (ws, fs) in enumerate(zip(left["words"], left["forums"], strict=True)):
            for w in ws:
                points[i] += hits[w] / len(ws)
            if len(fs):
                points[i] += bonus * np.any([hinted[f] for f in fs], axis=0)
        return np.minimum(points, 1.0)

    found = top_in_blocks(asks, rows, score, n, "query_id", "url", block)
    return found.withColumn("query_id", F.col("query_id").cast(kind))


def intent(text: Column) -> Column:
    """The kind of task that its first line names, else a recommendation."""
    line = F.lower(F.substring_index(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+", ""), "\n", 1))
    return reduce(lambda out, k: F.when(F.contains(line, F.lit(k[0])), k[1]).otherwise(out), reversed(INTENTS), F.lit("recommendation"))


def recall(asked: DataFrame, memory: DataFrame, n: int = 3, block: int = 2048) -> DataFrame:
    """(task_id, remembered, score, place): for each asked task (task_id, intent_type, embedding) the n remembered ones (task_id, intent_type, best, embedding) of the highest score, ties by name.

    Half a point for the same kind of task, the best composite of its runs, and 0.3 of the cosine of embeddings where
    both have one; a task does not recall itself. Memory has a row a task. Without embeddings on either side only the
    n + 1 best of each kind, and of all, can be among an asked task's n: these meet it by a join on the kind. With
    embeddings all tasks meet in blocks, of which each passes on n a task.
    """
    known = memory.select(F.col("task_id").alias("remembered"), "intent_type", F.coalesce("best", F.lit(0.0)).alias("best"), "embedding")
    if not (memory.where("embedding is not null").limit(1).count() and asked.where("embedding is not null").limit(1).count()):
        of_kind = top_per_group(known, n + 1, [F.desc("best"), F.col("remembered")], "intent_type").select("remembered", F.col("intent_type").alias("_kind"), "best")
        kinds = asked.select("intent_type").distinct()
        of_all = of_kind.orderBy(F.desc("best"), "remembered").limit(n + 1)  # they are among the best of their kinds
        offered = of_kind.withColumn("intent_type", F.col("_kind")).unionByName(kinds.join(F.broadcast(of_all)))
        met = asked.select("task_id", "intent_type").join(offered.distinct(), "intent_type").where("task_id != remembered")
        score = F.col("best") + F.when(F.col("intent_type") == F.col("_kind"), 0.5).otherwise(0.0)
        return top_per_group(met.select("task_id", "remembered", score.alias("score")).distinct(), n, [F.desc("score"), F.col("remembered")], "task_id")

    def score_of(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        points = 0.5 * (left["intent_type"].to_numpy()[:, None] == right["intent_type"].to_numpy()[None, :]) + right["best"].to_numpy(float)[None, :]
        a, b = (np.flatnonzero(side["embedding"].notna()) for side in (left, right))
        if len(a) and len(b):
            x, y = (np.stack(side["embedding"].iloc[at]).astype(float) for side, at in ((left, a), (right, b)))
            norms = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
            points[np.ix_(a, b)] += 0.3 * np.where(norms < 1e-9, 0.0, x @ y.T / np.where(norms < 1e-9, 1.0, norms))
        return points + _SHIFT  # a score may be zero or less, and counts all the same

    found = top_in_blocks(asked.select("task_id", "intent_type", "embedding"), known, score_of, n, "task_id", "remembered", block)
    return found.withColumn("score", F.col("score") - _SHIFT)
