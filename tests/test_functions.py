"""Column functions that no registered query uses, on cases by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from scorewright.functions import numeric, text, url


@pytest.mark.parametrize(("function", "cases"), [
    (url.stem, [("http://X.org/a/b/C?q=1", "x.org/b/C"), ("http://x.org/a/", "x.org/a"), ("http://x.org", "x.org/")]),
    (url.slug_title, [("http://x.org/p/blue-tea_pot.html", "Blue Tea Pot"), ("http://x.org/a/b/", "B")]),
    (text.verdict, [("I think.\nVERDICT: **B**", "B"), ("verdict: tie", "TIE"), ("none", None), (None, None)]),
    (text.level, [("LEVEL: 4 of 5", 4), ("I give it a 3.", 3), ("x" * 300 + " 5", None), ("12", None), (None, None)]),
    (lambda c: numeric.price_range(c), [("between $30-$99.5", (30.0, 99.5)), ("$5 to $9", (5.0, 9.0)), ("none", (None, None))]),
])
def test_of_texts(spark, function, cases):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, a string").orderBy("i")
    found = [r.got for r in df.select(function(F.col("a")).alias("got")).collect()]
    assert [tuple(x) if isinstance(x, tuple) else x for x in found] == [c[1] for c in cases]


def test_same_page(spark):
    cases = [("http://X.org/a/?b=1&c=2", "http://x.org/a?c=2", True), ("http://x.org/a?b=1", "http://x.org/a?b=2", False), ("http://x.org/a", "http://x.org/b", False), ("http://x.org/a?b=1", "http://x.org/a", True)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, want boolean").orderBy("i")
    assert [r.got for r in df.select(url.same_page(F.col("a"), F.col("b")).alias("got")).collect()] == [c[2] for c in cases]


def test_scores(spark):
    row = spark.range(1).select(
        *(text.level_score(F.lit(n)).alias(f"l{n}") for n in (0, 1, 3, 5, 9)), *(numeric.decay(F.lit(v), 2.0).alias(f"d{i}") for i, v in enumerate((1.0, 4.0, 6.0, 9.0))),
        numeric.evidence_density(F.lit(3), F.lit(8), F.lit(0.5)).alias("e"), numeric.cost_efficiency(F.lit(0.2), F.lit(300.0)).alias("c"),
    ).first()
    assert (row.l0, row.l1, row.l3, row.l5, row.l9) == (0.0, 0.0, 0.5, 1.0, 1.0) and (row.d0, row.d1, row.d2, row.d3) == (1.0, 0.5, 0.0, 0.0)
    assert row.e == pytest.approx(0.2 + 0.3 + 0.15) and row.c == pytest.approx(0.7 * 0.5 + 0.3)
