"""Streams run, stop and start again with their checkpoint, and arrive where the batch does."""

from __future__ import annotations

import shutil
from datetime import datetime

import pytest
from conftest import SF
from pyspark.sql import Window
from pyspark.sql import functions as F
from scorewright.streaming import state


@pytest.fixture
def folder(spark, tmp_path):
    """The events in three files, of which the first is there."""
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").withColumn("part", F.ntile(3).over(Window.orderBy("ts"))).cache()
    for k in (1, 2, 3):
        rows.where(F.col("part") == k).drop("part").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
    (tmp_path / "in").mkdir()
    return tmp_path


def arrive(folder, k):
    for f in (folder / f"p{k}").glob("*.parquet"):
        shutil.copy(f, folder / "in" / f"{k}-{f.name}")


def test_budget_over_restarts(spark, folder):
    cap, seen = 400, {}
    for k in (1, 2, 3):  # each run of the stream starts from the checkpoint
        arrive(folder, k)
        out = state.drain(state.token_budget(state.event_stream(spark, str(folder / "in")), cap), str(folder / "out"), str(folder / "check"), "update")
    for r in out.collect():
        seen.setdefault(r.user_id, []).append((r.used, r.status))
    want = {r.user_id: r.used for r in spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").agg(F.sum(F.greatest(F.floor("value"), F.lit(0))).cast("long").alias("used")).collect()}
    assert {u: max(x for x, _ in rows) for u, rows in seen.items()} == want
    for rows in seen.values():
        assert sum(s == "warning" for _, s in rows) <= 1
        assert all((s == "exhausted") == (used >= cap) for used, s in rows)


def test_windows_with_late_rows(spark, tmp_path):
    day = lambda d, h=1: datetime(2024, 1, d, h)
    first = [(1, day(1), "view", 1.0), (2, day(2), "view", 2.0), (3, day(9), "view", 3.0)]
    late = [(4, day(8), "view", 4.0), (5, day(1, 2), "view", 5.0), (6, day(20), "click", 6.0)]  # the eighth is within two days, the first is not
    for n, rows in enumerate((first, late)):
        spark.createDataFrame([(i, t, 1, e, v, None) for i, t, e, v in rows], state.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = state.drain(state.windowed_counts(state.event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "check"))
        found = {(r.start.day, r.event_type): (r.n, r.total) for r in out.collect()}
        assert found == {(1, "view"): (1, 1.0), (2, "view"): (1, 2.0)} | ({(8, "view"): (1, 4.0), (9, "view"): (1, 3.0)} if n else {})


def test_windows_arrive_at_the_batch(spark, folder):
    for k in (1, 2, 3):
        arrive(folder, k)
    out = state.drain(state.windowed_counts(state.event_stream(spark, str(folder / "in")), late="60 days"), str(folder / "whole"), str(folder / "check2"), "complete")
    batch = state.windowed_counts(spark.read.parquet(f"{SF}/events.parquet"))
    out = out.where(F.col("batch") == out.agg(F.max("batch")).first()[0])  # each batch has all windows
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert key(out) == key(batch)


def test_best_runs_over_restarts(spark, folder):
    path, best = str(folder / "best"), None
    for k in (1, 2, 3):
        arrive(folder, k)
        runs = state.event_stream(spark, str(folder / "in")).select(F.col("event_type").alias("task"), F.col("event_id").alias("run"), (F.col("value") / 100).alias("score"))
        state.keep_best(runs, path, str(folder / "check3"), keep=3, least=0.5)
        best = spark.read.parquet(f"{path}/v{k - 1}")
    rows = spark.read.parquet(f"{SF}/events.parquet").where("value / 100 >= 0.5").collect()
    want = {}
    for r in sorted(rows, key=lambda r: (-r.value, r.event_id)):
        want.setdefault(r.event_type, []).append(r.event_id)
    found = {}
    for r in best.collect():
        found.setdefault(r.task, set()).add(r.run)
    assert found == {t: set(ids[:3]) for t, ids in want.items()}
