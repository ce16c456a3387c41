"""Problems, labels and surveys of score documents, one by one."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scorewright.operators import diagnosis

SOUND = {"task": "t", "answer_chars": 6000, "composite": {"composite_v2": 0.5}, "url_reachability": {"score": 0.5, "passed": True, "details": {"cited_total": 3, "http_4xx": 1}}, "checklist": {"verdicts": [["1", "PASS"]], "unclear_count": 0}}
LINKS = " ".join(f"[a](http://localhost:7770/p{i})" for i in range(6))


def told(spark, cases):
    rows = spark.createDataFrame([(i, None if d is None else d if isinstance(d, str) else json.dumps(d), md) for i, (d, md) in enumerate(cases)], "id int, j string, md string")
    return rows.select("id", F.try_parse_json("j").alias("value"), "md")


def changed(**parts):
    return {**SOUND, **parts}


PROBLEMS = [
    (SOUND, "text", []), ({k: v for k, v in SOUND.items() if k != "task"}, "", ["schema"]), (changed(composite={}), "", ["schema", "composite"]), (changed(composite={"composite_v2": "x"}), "", ["composite"]), (changed(composite={"composite_v2": -0.1}), None, ["composite"]),
    (changed(answer_chars="6000"), "", ["empty"]), (changed(answer_chars=99), "", ["empty"]), (changed(answer_chars=None), "", ["empty"]), (SOUND, "so <THINK> it", ["thinking-leak"]), (SOUND, "x" * 8000 + "<think>", []),
    (changed(checklist={"judge_error": "lost"}), "", ["judge"]), (changed(presentation={"details": {"judge_error": {"code": 1}}}), "", ["judge"]), (changed(citation_alignment={"details": {"judge": {"error": ""}}}), "", []), (changed(citation_alignment={"details": {"judge": {"error": "x"}}}), "", ["judge"]),
    (changed(checklist={"verdicts": [["1", "UNCLEAR"]], "unclear_count": 1}), "", ["unclear"]), (changed(checklist={"verdicts": [], "unclear_count": 0}), "", []), (changed(url_reachability={"passed": True, "details": {"cited_total": 0}}), "", ["reach"]), (changed(url_reachability={"passed": True}), "", ["reach"]), (changed(url_reachability={"passed": False}), "", []),
    (changed(composite={"composite_v2": 0}), "", ["all-zero"]), (changed(composite={"composite_v2": 0}, answer_chars=5000), "", []), ("broken", "", ["schema", "empty", "composite"]), (None, None, ["schema", "empty", "composite"]),
]


def test_problems(spark):
    found = {r.id: r.p for r in told(spark, [c[:2] for c in PROBLEMS]).select("id", diagnosis.problems(F.col("value"), F.col("md")).alias("p")).collect()}
    assert [found[i] for i in range(len(PROBLEMS))] == [c[2] for c in PROBLEMS]


ZERO = {"composite_v2": 0}
LABELS = [
    (changed(answer_chars=99), LINKS, "AGENT-FAULT-empty"), ({}, LINKS, "AGENT-FAULT-empty"), (SOUND, None, "AGENT-FAULT-no-md"), (SOUND, "", "AGENT-FAULT-no-md"), (SOUND, "  ( Deep-Agent produced no report after 12 s, exit=1)", "AGENT-FAULT-runner-crash"), (SOUND, "(agent x stderr: y", "AGENT-FAULT-runner-exception"),
    (SOUND, "\n I CANNOT go on " + LINKS, "AGENT-FAULT-refusal"), (changed(answer_chars=500), LINKS, "AGENT-FAULT-tiny"), (SOUND, "no links", "AGENT-FAULT-no-urls"), (SOUND, "[a](http://out.org/1) [b](http://out.org/2) [c](http://localhost:8090/x)", "AGENT-FAULT-external-urls"), (SOUND, "[a](http://out.org/1) [c](http://localhost:8090/x)", "OK-strong"),
    (changed(url_reachability={"score": 0, "details": {"http_4xx": 2}}), LINKS, "AGENT-FAULT-wrong-url-format"), (changed(url_reachability={"score": 0, "details": {"http_4xx": 0}}, url_coverage={"details": {"must_cite_hit": 1}}), LINKS, "OUR-FAULT-canonical-vs-raw"), (changed(composite={"composite_v2": 0.15}), LINKS, "OK-mid"), (changed(composite={"composite_v2": 0.05}), LINKS, "OK-weak"),
    (changed(composite=ZERO), LINKS, "AGENT-FAULT-no-grounded-claims"), (changed(composite=ZERO, url_reachability={}), LINKS, "AGENT-FAULT-other-zero"),
]


def test_labels_in_their_order(spark):
    found = {r.id: r.x for r in told(spark, [c[:2] for c in LABELS]).select("id", diagnosis.label(F.col("value"), F.col("md")).alias("x")).collect()}
    assert [found[i] for i in range(len(LABELS))] == [c[2] for c in LABELS]
    assert len({c[2] for c in LABELS}) == 15


@pytest.mark.parametrize("copies", [1, 50])
def test_survey(spark, copies):
    two = changed(checklist={"judge_error": "x"}, analysis_depth={"details": {"judge_error": "y"}})
    real = changed(composite={"composite_v2": 0.0}, checklist={"judge_error": "x"})
    cases = [("broken", ""), (None, None), (changed(answer_chars=5), ""), (two, "(A produced no report after 3 s , exit = 2 )"), (two, "text"), (real, None), (changed(composite={"composite_v2": 0.0}), ""), (SOUND, "x")] * copies
    found = {r.category: r.n // copies for r in diagnosis.survey(told(spark, cases)).collect()}
    assert found == {"parse-error": 2, "E_empty": 1, "R_runner-fail": 1, "J2_judge": 1, "J1_judge": 1, "D_zero-but-real": 2, "clean": 2}
