"""What judges write, agents' profiles, task statistics and the gate of memory, worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scorewright.functions import judging
from scorewright.operators import profiles, ratings
from scorewright.sources import readers
from scorewright.streaming import state

SILENT = judging.SILENT
VERDICTS = [
    ("1. PASS - good\n2. FAIL: bad\n3) pass", [(True, "good"), (False, "bad"), (True, "")]),
    ("intro\n 1) PASS — one\nmore of it\n2. fail\nNOTES: 3. PASS", [(True, "one"), (False, "NOTES: 3. PASS"), (False, SILENT)]),
    ("PASS\nFAIL because\n  pass\nPASS", [(True, ""), (False, ""), (True, "")]),
    ("PASS\nFAIL\nNOTES:\nPASS", [(False, SILENT)] * 3),
    ("2. PASS " + "x" * 200, [(False, SILENT), (True, "x" * 120), (False, SILENT)]),
    ("1. PASSED\n2. PASS", [(False, SILENT), (True, ""), (False, SILENT)]),
    ("1. PASS a\nPASS\nFAIL\nFAIL", [(True, ""), (False, ""), (False, "")]),
    ("", [(False, SILENT)] * 3), (None, [(False, SILENT)] * 3),
]


def test_numbered_verdicts(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VERDICTS)], "id int, t string").select("id", judging.verdicts(F.col("t"), 3).alias("v"), judging.passed_share(F.col("t"), 3).alias("s"))
    for r in rows.collect():
        want = VERDICTS[r.id][1]
        assert [(v.passed, v.reason) for v in r.v] == want and [v["index"] for v in r.v] == [1, 2, 3], VERDICTS[r.id]
        assert r.s == sum(p for p, _ in want) / 3


def test_notes_are_only_cut_off_where_there_can_be_any(spark):
    told = spark.createDataFrame([("PASS\nNOTES: x\nFAIL",)], "t string")
    assert [v.passed for v in told.select(judging.verdicts(F.col("t"), 2, notes=False)).first()[0]] == [True, False]
    assert [v.reason for v in told.select(judging.verdicts(F.col("t"), 2)).first()[0]] == [SILENT, SILENT]


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ("<think>a\nb</think>\n\n# R", "# R"), ("x<THINK>y</THINK> z", "xz"), (" <think>never closed", ""), ("say <think> once", "say <think> once"), ("Thinking Process:\n1. a\n\n2. b\n\n{\"x\": 1}", "{\"x\": 1}"), ("Thinking Process: all of it", ""), ("  Thinking Process:\n\nAnswer it", "Answer it"), ("plain", "plain"), ("", ""), (None, None),
    ],
)
def test_thinking_goes(spark, content, want):
    assert spark.createDataFrame([(content,)], "t string").select(judging.without_thinking(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ('{"markdown_report": "# A\\nb", "x": 1}', "# A\nb"), ('{"markdown_report": "# A\nreal \\"q\\"\\tz"}', '# A\nreal "q"\tz'), (' {"markdown_report":"x" } ', "x"), ('{"other": "x"}', ""), ("# R", ""), ('{"markdown_report": 5', ""), (None, ""),
    ],
)
def test_wrapped_reports(spark, content, want):
    assert spark.createDataFrame([(content,)], "t string").select(judging.unwrapped(F.col("t"))).first()[0] == want


def test_first_words(spark):
    row = spark.createDataFrame([(" a  b\nc d ", None)], "t string, n string").select(judging.first_words(F.col("t"), 3), judging.first_words(F.col("n"), 3)).first()
    assert tuple(row) == ("a b c", "")


def test_profiles_by_hand(spark):
    rows = spark.createDataFrame([("a", "t1", 0.4, 0.5), ("a", "t2", None, None), ("a", "t3", 0.1, 0.7), ("a", "t4", 0.4, 0.1), ("b", "t1", 0.2, None)], "agent string, task string, composite double, url double")
    found = {r.agent: tuple(r)[1:] for r in profiles.pillar_profiles(rows, ["url"]).collect()}
    assert found == {"a": (4, 0.225, 0.25, 0.325), "b": (1, 0.2, 0.2, 0.0)}
    deep = {r.agent: r for r in profiles.drilldown(rows, ["url"], 2).collect()}
    assert deep["a"].avg_url == 0.4333 and [x.task for x in deep["a"].best] == ["t1", "t4"] and [x.task for x in deep["a"].worst] == ["t3", "t1"] and deep["b"].avg_url is None
    board = {r.agent: (r.t1, r.t9, r.mean) for r in profiles.matrix(rows, ["t1", "t2", "t9"]).collect()}
    assert board == {"a": (0.4, None, 0.4), "b": (0.2, None, 0.2)}
    drift = profiles.composite_drift(rows.withColumn("s", F.col("composite") + 0.002), "s", F.coalesce("composite", F.lit(0.0)))
    assert {r.agent: (r.pairs, r.drifts, r.max_drift) for r in drift.collect()} == {"a": (4, 3, 0.002), "b": (1, 1, 0.002)}
    gaps = profiles.gap_statistics(spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 2.5)], "agent string, rating double")).first()
    assert tuple(gaps) == (2, 0.5, 1.0) and tuple(profiles.gap_statistics(spark.createDataFrame([("a", 3.0)], "agent string, rating double")).first()) == (0, None, None)
    md = "[1] http://a\n [22]. - http://b\n[333]: no\n[x](http://c) [y](ftp://d)\ntext [4] http://e"
    style = profiles.citation_styles(spark.createDataFrame([("a", md), ("a", None), ("b", "[x](http://c)")], "agent string, md string"))
    assert {r.agent: tuple(r)[1:] for r in style.collect()} == {"a": (2, 2, 1, "numbered"), "b": (1, 0, 1, "markdown")}
    pairs = ratings.agent_pairs(spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.5, 3.0), ("c", 2.0, 2.6)], "agent string, elo_lo double, elo_hi double"))
    assert {(r.a, r.b): (r.apart, r.gap) for r in pairs.collect()} == {("a", "b"): (True, 0.5), ("a", "c"): (False, 0.0), ("b", "c"): (False, -0.1)}


def test_task_statistics(spark, tmp_path):
    tasks = readers.Tasks(spark, str(tmp_path / "tasks"))
    kind = "task_id string, difficulty string, iaa double, status string, domain string"
    tasks.save(spark.createDataFrame([("t1", "1", 0.5, "draft", "cms"), ("t2", "2", 0.0, "final", "cms"), ("t3", "2", 0.7, "final", "own")], kind))
    assert {r.domain: r.tasks for r in tasks.counts().collect()} == {"ecommerce": 0, "development": 0, "cms": 2, "forum": 0, "knowledge": 0, "own": 1}
    found = {(r.domain, r.difficulty, r.status): (r.tasks, r.mean_iaa) for r in tasks.statistics().collect()}
    assert found[None, None, None] == (3, 0.6) and found["cms", None, None] == (2, 0.5) and found[None, "2", None] == (2, 0.7) and found[None, None, "final"] == (2, 0.7) and len(found) == 7
    assert [r.task_id for r in tasks.listed(status="final").collect()] == ["t2", "t3"]


def test_memory_asks_for_reach_and_tidies_up(spark, tmp_path):
    path, schema = str(tmp_path / "best"), "task string, run long, score double, reach double"
    for n, rows in enumerate([[("a", 1, 0.9, 0.1), ("a", 2, 0.5, 0.2)], [("a", 3, 0.04, 1.0), ("b", 4, 0.039, 1.0)], [("a", 5, 0.8, None)], [("b", 6, 0.6, 0.9)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state.keep_best(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, str(tmp_path / ("check" if n < 3 else "check-again")), keep=5)
    versions = [v for v, _ in state.best_versions(spark, path)]
    assert versions == [2, 3]  # the new checkpoint read all files again, as its first batch
    assert {(r.task, r.run) for r in spark.read.parquet(f"{path}/v3").collect()} == {("a", 2), ("a", 3), ("b", 6)}


def test_two_composites_by_hand(spark):
    rows = spark.createDataFrame([("a", "t1", 0.5, 0.1, 1.0), ("a", "t2", 0.0, None, 9.0), ("a", "t3", 0.1, 0.4, None), ("b", "t1", None, 0.2, 0.5), ("b", "t2", None, 0.0, 0.5), ("c", "t1", None, None, 1.0)], "agent string, task string, v2 double, v4 double, m double")
    found = {r.agent: tuple(r)[1:] for r in profiles.version_summary(rows, "v2", "v4", ["m"]).collect()}
    assert found == {"a": (2, 0.3, 0.25, 1.0, -0.05), "b": (1, None, 0.2, 0.5, None)}
    changes = [tuple(r) for r in profiles.largest_changes(rows, "v2", "v4", 1).collect()]
    assert changes == [("a", "t1", 0.5, 0.1, -0.4, 1)]


def test_audit_by_hand(spark):
    schema = "agent string, composite double, v1 double, reach double, chk double, answer_chars int, ck_error boolean, ad_error boolean, pres_error boolean, infra_failure boolean, head string"
    fine = ("a", 0.5, 0.4, 1.0, 0.5, 900, False, False, False, False, "x")
    rows = [fine, ("a", 0.3, 0.2, 0.0, 0.5, 900, True, False, False, False, "x"), ("a", 0.9, 0.9, None, None, 0, True, True, True, True, "x"), ("b", 0.1, 0.1, 0.5, 0.5, 900, False, False, False, False, "(A produced no report")]
    table = {r.agent: tuple(r)[1:] for r in profiles.audit_table(spark.createDataFrame(rows, schema)).collect()}
    assert table == {"a": (3, 2, 1, 0.4, 0.4, 0.3, 600.0, 2, 1, 2, "1 short, 1 infra, 1 judge_err"), "b": (1, 0, 1, None, None, None, 900.0, 0, 0, 0, "0 short, 0 infra, 0 judge_err")}
    panel = lambda given: tuple(profiles.audit_panel(profiles.audit_table(spark.createDataFrame(given, schema))).first())
    assert panel(rows) == (4, 2, 2, "a", "b", "FAIL") and panel([fine]) == (1, 1, 0, "a", "", "PASS") and panel([fine] * 3 + rows[2:3]) == (4, 3, 1, "a", "", "WARN") and panel([fine, *rows[2:3]]) == (2, 1, 1, "a", "", "FAIL")
