"""Streams: token budgets per run, windowed counts with late rows, and the best runs per task kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def token_budget(events: DataFrame, cap: int = 1000, warn_at: float = 0.9) -> DataFrame:
    """(user_id, used, status) for each batch of a run's events: spent tokens so far; 'warning' once, then 'exhausted' from the cap on.

    Tokens are the whole part of value, negatives as zero. The state of a run is its sum and whether it was warned.
    """

    def fold(key: tuple[int], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, warned = state.get if state.exists else (0, False)
        for part in parts:
            used += int(part.tokens.clip(lower=0).sum())
        status = "exhausted" if used >= cap else "warning" if used >= warn_at * cap and not warned else "ok"
        state.update((used, warned or used >= warn_at * cap))
        yield pd.DataFrame({"user_id": [key[0]], "used": [used], "status": [status]})

    tokens = events.select("user_id", F.floor("value").cast("long").alias("tokens"))
    return tokens.groupBy("user_id").applyInPandasWithState(fold, "user_id long, used long, status string", "used long, warned boolean", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window start, event_type, n, total) in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs the stream over what is there since the last time, each batch into a folder of its own below `path`, and returns all of them.

    A batch that is run again after a failure overwrites its folder. Rows have their batch's number.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("basePath", path).parquet(path)


def keep_best(stream: DataFrame, path: str, checkpoint: str, keep: int = 5, least: float = 0.04, least_reach: float = 0.20) -> None:
    """Keeps the best `keep` runs (task, run, score, and reach if there is one) of each task in a table at `path`: each batch is merged with the version before and written as the next.

    Runs under `least`, or that reach less than `least_reach`, aren't kept. A batch that is run again after a failure
    merges with the version before it, and numbers may leave gaps (a new checkpoint starts at the next free one); the two last versions stay, older ones are removed.
    """
    reached = "reach" in stream.columns

    def merge(batch: DataFrame, number: int) -> None:
        from pyspark.sql import Window

        spark = batch.sparkSession
        rows = batch.where((F.col("score") >= least) & (F.coalesce("reach", F.lit(0.0)) >= least_reach if reached else F.lit(True)))
        known = best_versions(spark, path)
        taken = [v for v, by in known if by == f"{checkpoint}#{number}"]
        version = taken[0] if taken else (known[-1][0] + 1 if known else 0)
        before = [v for v, _ in known if v < version]
        if before:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v{before[-1]}").drop("batch"))
        place = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("score"), "run"))
        best = rows.withColumn("place", place).where(F.col("place") <= keep).drop("place")
        best.withColumn("batch", F.lit(f"{checkpoint}#{number}")).write.mode("overwrite").parquet(f"{path}/v{version}")
        for old in before[:-1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def best_versions(spark: SparkSession, path: str) -> list[tuple[int, str | None]]:
    """(version, the batch that wrote it) of the tables of keep_best() whose writing has ended, in order; an empty version has no batch."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    numbers = sorted(int(f.getPath().getParent().getName()[1:]) for f in found or [])
    first = lambda v: spark.read.parquet(f"{path}/v{v}").select("batch").first()  # noqa: E731  every row has the same
    return [(v, row[0] if (row := first(v)) else None) for v in numbers]
