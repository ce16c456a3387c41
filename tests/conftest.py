"""One local session for all tests, and the oracle comparison that query tests share."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrame, SparkSession

REPO = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(REPO))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory: pytest.TempPathFactory) -> Iterator[SparkSession]:
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.executorEnv.PYTHONPATH": str(REPO), "spark.sql.codegen.wholeStage": "false",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment["PYTHONPATH"] = str(REPO)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value: object) -> object:
    """A value as both engines would give it: floats to nine digits, NaN as null, dates as text."""
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return None if math.isnan(value) else float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value) if type(value).__name__ in ("date", "datetime") else value


def sorted_rows(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="session")
def assert_oracle(spark: SparkSession, duck: duckdb.DuckDBPyConnection) -> Callable:
    def check(query: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
        df = query(spark, SF)
        names = sorted(df.columns)
        told = duck.execute(sql)
        columns = [c[0] for c in told.description]
        assert sorted(columns) == names
        order = [columns.index(n) for n in names]
        expected = sorted_rows([tuple(r[i] for i in order) for r in told.fetchall()])
        assert sorted_rows([tuple(r[n] for n in names) for r in df.collect()]) == expected
        assert expected or query.__name__ in ("most_empty",)

    return check
