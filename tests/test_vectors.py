"""Nearest vectors of every twentieth id, against brute force and in blocks of any size."""

from __future__ import annotations

import pyarrow.parquet as pq
from conftest import SF
from scorewright.plans import tables


def test_every_20th_in_small_blocks(spark):
    rows = pq.read_table(f"{SF}/embeddings.parquet").to_pylist()
    asked = {r["vec_id"] for r in rows if r["vec_id"] % 20 == 0}
    whole = {tuple(r) for r in tables.nearest_vectors_every_20th(spark, SF).collect()}
    assert {q for q, _, _ in whole} == asked and len(whole) == 3 * len(asked)
    assert {tuple(r) for r in tables.nearest_vectors_every_20th(spark, SF, block=20).collect()} == whole
