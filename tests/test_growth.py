"""What keeps work in proportion to the input: texts gone through once, no pairs listed, no level gone through twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorewright.functions import text
from scorewright.operators import audits, citations, evidence, variants, verifiers

MD = ["See [a](http://a.org/x) and http://b.org.", "Source: http://<x>", "- http://<y>", "SOURCE = HTTP://C.ORG", "x [1]\n\n[1] it http://d.org/", "x [1]\n\n[1] it", "[^a]\n\n[^a]: [b](https://e.org)", "(http://f.org)", "[http://g.org]", "http://", "", None, "plain", "a://b", "url : \u2003http://h.org"]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_that_break_down_alike_are_asked_once(spark):
    def fragile(rows):
        if len(rows) > 3:
            raise RuntimeError("asked of more than the three values there are")
        if rows["s"].eq("P").any():
            raise ValueError("pending")
        return rows["s"].eq("F").astype(float)

    rows = spark.range(3000).select("id", F.element_at(F.array(*map(F.lit, "PFO")), (F.col("id") % 3 + 1).cast("int")).alias("s"), F.array(F.lit("k")).alias("kinds")).coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def counted(rows):
        calls.add(1)
        return fragile(rows)

    found = evidence.dispatched(rows, {"k": counted}, ["s"], reads={"k": ["s"]}).collect()
    assert {(r.id % 3, r.score, r.passed, r.error) for r in found} == {(0, 0.5, True, "ValueError: pending"), (1, 1.0, True, None), (2, 0.0, False, None)}
    assert len(found) == 3000 and calls.value <= 5


def test_walk_down_a_deep_answer_writes_one_table(spark, monkeypatch):
    written = []
    monkeypatch.setattr(variants, "materialised", lambda df, keep=variants.materialised: written.append(1) or keep(df))
    deep = lambda n: '{"in":[' * n + '{"_sources":{"a":"u"}}' + "]}" * n
    found = variants.sources(spark.createDataFrame([(1, deep(7)), (2, deep(40)), (3, "[]"), (4, None)], "id int, j string").select("id", F.try_parse_json("j").alias("value"))).collect()
    assert sorted((r.id, r.field.count("in[0]"), r.url) for r in found) == [(1, 7, "u"), (2, 40, "u")]
    assert len(written) == 3  # 81 levels in steps of STRIDE


def test_words_are_looked_up_in_sets(spark):
    df = spark.createDataFrame([("Good, well-built; BAD bad best-of however",), ("",), (None,)], "t string").select(text.lexicon_counts(F.col("t")).alias("n"))
    assert "array_contains" not in _plan(df) and "INSET" in _plan(df)
    assert [(r.n.positive, r.n.negative) if r.n else None for r in df.collect()][:2] == [(2, 3), (0, 0)]
def test_a_report_is_told_to_have_citations_without_listing_them(spark):
    reports = spark.createDataFrame(list(enumerate(MD)), "doc_id int, md string")
    rows = reports.select(citations.has_citation(F.col("md")).alias("has"), (F.size(citations.citations_of(F.col("md"))) > 0).alias("lists"), "md").collect()
    assert [r.has for r in rows] == [r.lists for r in rows] and {r.has for r in rows} == {True, False}
    assert "array_sort" not in _plan(verifiers.degenerate(reports))


def test_pairs_are_drawn_by_their_numbers(spark):
    """The same pairs as by listing them all, for things named in few and in thousands of sentences."""
    for n in (6, 7, 12, 3000):
        said = [f"Acme Rocket was seen in the field again, number {i} of them." for i in range(n)]
        got = verifiers.consistency_pairs(spark.createDataFrame([(1, " ".join(said))], "doc_id int, md string"))
        total = n * (n - 1) // 2
        stride = 1 if total <= 12 else total // 12
        every = ((i, j) for i in range(n) for j in range(i + 1, n))
        want = [p for k, p in enumerate(every) if k % stride == 0][:12]
        assert sorted((r.i, r.j) for r in got.collect()) == want


def test_texts_are_gone_through_once(spark):
    reports = spark.createDataFrame([(i, i % 3, md) for i, md in enumerate(MD)], "doc_id int, task int, md string")
    assert _plan(verifiers.source_diversity(reports, {"a.org": "shopping"})).count("Generate explode") == 1
    must, scored = spark.createDataFrame([(0, "http://a.org/x")], "task int, url string"), reports.select("doc_id", F.lit(1).alias("hits"))
    for first in (False, True):
        found = audits.fairness(reports, must, scored, scorer_first=first)
        assert "Generate explode" not in _plan(found) and {r.doc_id: (r.cited, r.direct) for r in found.collect()}[0] == (2, 1)
    wanted = citations.citations(reports, wanted=("raw_url",), beside=("task",))
    assert wanted.columns == ["doc_id", "task", "raw_url"] and "try_url_decode" not in _plan(wanted).lower() and wanted.count() == citations.citations(reports).count()
