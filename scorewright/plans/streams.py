"""Batch queries that say what the streams arrive at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.registry import query, table
from scorewright.streaming import state


@query("daily_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.windowed_counts(table(spark, sf_dir, "events"), "1 day").withColumn("total", F.round("total", 2))


@query("rank_decay", "SELECT page_id, 1 - (row_number() OVER (ORDER BY page_id) - 1) / 10.0::DOUBLE AS score FROM pages ORDER BY page_id LIMIT 10")
def rank_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's first ten hits, each a tenth below the one before."""
    from pyspark.sql import Window

    first = table(spark, sf_dir, "pages").select("page_id").orderBy("page_id").limit(10)
    return first.select("page_id", (1 - (F.row_number().over(Window.orderBy("page_id")) - 1) / 10.0).alias("score"))
