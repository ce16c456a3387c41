"""Every registered query of the scoring part: against its SQL, or for its invariants where SQL can't say it."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from scorewright import registry
from scorewright.plans import audits, boards, catalog, documents, evidence, facts, matching, profiles, streams, tables, texts  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, assert_oracle):
    assert_oracle(registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_has_rows_and_repeats(name, spark):
    """No SQL: the rows are there, and a second run gives the same ones."""
    query = registry.QUERIES[name]
    digest = lambda df: df.select(F.count("*"), F.sum(F.xxhash64(*(F.col(c).cast("string") for c in df.columns)).cast("decimal(38,0)"))).first()
    first = digest(query(spark, SF))
    assert first[0] > 0
    assert digest(query(spark, SF)) == first


def test_plans_prune_columns(spark):
    """A board needs six columns of events; the scan reads no others."""
    plan = registry.QUERIES["leaderboard_truthful"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id" in plan and "user_id" not in plan.split("ReadSchema:")[1].split("\n")[0]
