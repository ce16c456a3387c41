"""A stream into two sinks: rows that pass, and a log of those that don't with the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewright.functions import url


def refusal(hosts: list[str], url_column: str = "url") -> Column:
    """Why a hit's URL may not be shown, null if it may: no URL, or one to a host that isn't listed."""
    u = F.col(url_column)
    return F.when(F.trim(F.coalesce(u, F.lit(""))) == "", "no_url").when(~F.coalesce(url.host_in(u, hosts), F.lit(False)), "non_sandbox_url_blocked")


def strict(hits: DataFrame, hosts: list[str], url_column: str = "url") -> tuple[DataFrame, DataFrame]:
    """(hits that may be shown, the others with their reason)."""
    reason = refusal(hosts, url_column)
    return hits.where(reason.isNull()), hits.withColumn("reason", reason).where("reason is not null")


def split_stream(stream: DataFrame, reason: Column, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Takes what is there since the last time into `path`/accepted and `path`/rejected, and returns both tables whole.

    A batch is read once, marked with its reason, and written in one go into a folder of its own; one that is run again
    after a failure writes the same folder anew. So each row is in one of the tables, once, after any restart.
    """

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("reason", reason).withColumn("sink", F.when(F.col("reason").isNull(), "accepted").otherwise("rejected"))
        marked.write.mode("overwrite").partitionBy("sink").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("reason", T.StringType()), T.StructField("batch", T.IntegerType()), T.StructField("sink", T.StringType())])
    both = stream.sparkSession.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
    return both.where("sink = 'accepted'").drop("reason", "sink"), both.where("sink = 'rejected'").drop("sink")
