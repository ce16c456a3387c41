"""Queries over score documents and nested answers as JSON text, of all the shapes that writers leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.operators import diagnosis, rescoring, summaries, variants
from scorewright.plans import views
from scorewright.plans.views import SCORES_SQL
from scorewright.registry import query, table
from scorewright.storage import materialised

#: Dimensions, and the columns that their values come from.
DIMS = {"coverage": "url", "depth": "v3_depth", "rigor": "v3_rigor", "style": "v3_style", "spec": "spc"}


def _part(column: str) -> str:
    return f"'0.' || lpad(CAST(CAST(floor({column} * 100) AS INT) % 100 AS STRING), 2, '0')"


def _dim(number: int, name: str, column: str) -> str:
    x = _part(column)
    shapes = [f"""'"{name}":' || {x}""", f"""'"{name}":{{"score":' || {x} || '}}'""", f"""'"{name}":{{"score":null}}'""", f"""'"{name}":"' || {x} || '"'""", f"""'"no_{name}":0'""", f"""'"{name}":{{"score":"' || {x} || '"}}'"""]
    return f"CASE (chars + {number}) % 6 " + " ".join(f"WHEN {k} THEN {s}" for k, s in enumerate(shapes)) + " END"


_CHECKLIST = f"""CASE chars % 4 WHEN 0 THEN '{{"pass_rate":' || {_part('chk')} || ',"judge_error":"timeout"}}' WHEN 1 THEN CASE WHEN chars % 8 = 5 THEN '{{"verdicts":[["1","UNCLEAR"],["2","UNCLEAR"]],"unclear_count":2}}' ELSE '{{"verdicts":[["1","PASS"],["2","unclear"],["3","FAIL"]],"judge_error":""}}' END WHEN 2 THEN '{{"score":' || {_part('chk')} || '}}' ELSE {_part('chk')} END"""
_TRUE = lambda c: f"CASE WHEN {c} > 0.5 THEN 'true' ELSE 'false' END"
_FIELDS = [
    *(_dim(k, name, column) for k, (name, column) in enumerate(DIMS.items())),
    f"""'"checklist":' || {_CHECKLIST}""",
    f"""'"url_coverage":' || CASE WHEN chars % 3 = 0 THEN 'null' ELSE '{{"score":' || {_part('url')} || ',"details":{{"must_cite_hit":' || CAST(runs % 3 AS STRING) || '}}}}' END""",
    """CASE WHEN chars % 9 > 0 THEN '"task":"' || task || '"' ELSE '"no_task":0' END""",
    f"""'"composite":' || CASE chars % 8 WHEN 0 THEN 'null' WHEN 1 THEN '{{"composite_v2":0}}' WHEN 2 THEN '{{"composite_v2":1.5}}' WHEN 3 THEN '{{"composite_v2":"high"}}' WHEN 4 THEN '{{"composite_v2":0.01}}' WHEN 5 THEN '{{"composite_v2":0.0}}' ELSE '{{"composite_v2":' || {_part('reach')} || '}}' END""",
    f"""'"url_reachability":{{"score":' || CASE WHEN chars % 5 = 1 THEN '0' ELSE {_part('reach')} END || ',"passed":' || {_TRUE('url')} || ',"details":{{"cited_total":' || CAST(runs % 3 AS STRING) || ',"http_4xx":' || CAST(runs % 2 AS STRING) || '}}}},"quote_match":{{"score":' || {_part('qm')} || '}},"claim_nli":{{"score":' || {_part('nli')} || '}}'""",
    f"""'"markdown_spec":{{"words_ok":' || {_TRUE('url')} || ',"citations_ok":' || {_TRUE('cit')} || '}}'""",
    """'"answer_chars":' || CAST(chars * 17 % 9000 AS STRING)""",
    f"""'"citation_alignment":{{"score":' || {_part('cit')} || ',"details":{{"total_pairs":' || CAST(runs % 4 AS STRING) || ',"samples":[{{"url":"http://h/' || task || '"}},{{"url":null}},{{"url":"http://h/' || CAST(runs % 7 AS STRING) || '"}}]}}}}'""",
    f"""'"analysis_depth":{{"score":' || {_part('depth')} || ',"details":{{"judge_error":' || CASE WHEN chars % 5 = 0 THEN '"no answer"' ELSE 'null' END || '}}}}'""",
    f"""'"presentation":' || CASE WHEN chars % 7 = 0 THEN '"lost"' ELSE '{{"score":' || {_part('pres')} || ',"details":{{}}}}' END""",
]
DOCUMENT = "'{' || " + " || ',' || ".join(_FIELDS) + " || '}'"
DOCUMENTS_SQL = f"{SCORES_SQL},\ndocs AS (SELECT agent, task, {DOCUMENT} AS j FROM scores)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(agent, task, j): each score row as the JSON text of a document, its fields in varying shapes."""
    return views.scores(spark, sf_dir).selectExpr("agent", "task", f"{DOCUMENT} AS j")


def _got(name: str, legacy: str) -> str:
    at, inner = f"json_extract(j, '$.{name}')", f"json_extract_string(j, '$.{name}.score')"
    return f"coalesce(CASE json_type({at}) WHEN 'OBJECT' THEN TRY_CAST({inner} AS DOUBLE) WHEN 'VARCHAR' THEN NULL ELSE TRY_CAST(json_extract_string(j, '$.{name}') AS DOUBLE) END, {legacy})"


_LEGACY = {
    "coverage": "coalesce(TRY_CAST(json_extract_string(j, '$.url_coverage.score') AS DOUBLE), 0)",
    "checklist": "coalesce(TRY_CAST(json_extract_string(j, '$.checklist.pass_rate') AS DOUBLE), CASE WHEN json_array_length(j, '$.checklist.verdicts') > 0 THEN list_sum(list_transform(json_extract(j, '$.checklist.verdicts[*]'), lambda v: CASE upper(v ->> '$[#-1]') WHEN 'PASS' THEN 1.0 WHEN 'UNCLEAR' THEN 0.5 ELSE 0.0 END)) / json_array_length(j, '$.checklist.verdicts') END, TRY_CAST(json_extract_string(j, '$.checklist.score') AS DOUBLE), 0)",
    "spec": "((json_extract_string(j, '$.markdown_spec.words_ok') = 'true')::INT + (json_extract_string(j, '$.markdown_spec.citations_ok') = 'true')::INT) / 3.0",
}


@query("document_dimensions", f"WITH {DOCUMENTS_SQL} SELECT agent, task, " + ", ".join(f"round({_got(n, _LEGACY.get(n, '0'))} + 1e-9, 6)::DOUBLE AS {n}" for n in [*DIMS, "checklist"]) + " FROM docs")
def document_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six dimensions of every score document, read from numbers, objects, text or what older documents have instead."""
    score = documents(spark, sf_dir).withColumn("v", F.try_parse_json("j"))
    return score.select("agent", "task", *(F.round(variants.dimension(F.col("v"), n) + 1e-9, 6).alias(n) for n in [*DIMS, "checklist"]))


_LINE = """'{"part":' || CAST(l_partkey AS STRING) || ',"_sources":{"price":"http://shop/' || CAST(l_partkey AS STRING) || '","ship":"http://log/' || CAST(l_linenumber AS STRING) || '"}}'"""
_ANSWER = """'{"citations":[{"field":"status","url":"http://orders/' || CAST(o_orderkey AS STRING) || '"},{"field":"alone"},"text"],"_sources":{"total":"http://sum/' || CAST(o_custkey AS STRING) || '"},"deep":' || repeat('{"in":[', CAST(o_orderkey % 7 AS INT)) || '{"items":[' || coalesce(lines, '') || ']}' || repeat(']}', CAST(o_orderkey % 7 AS INT)) || '}'"""
ANSWERS_SQL = f"""
lines AS (SELECT l_orderkey, string_agg({_LINE}, ',' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1),
answers AS (SELECT o_orderkey AS id, {_ANSWER} AS j FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey)"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, j): every order as a nested JSON answer, its line items up to fourteen levels down."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", f"{_LINE} AS line")
    lines = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "line"))), lambda x: x["line"]), ",").alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").selectExpr("o_orderkey AS id", f"{_ANSWER} AS j")


@query("nested_sources", f"""WITH {ANSWERS_SQL}, nodes AS (SELECT a.id, t.key, t.value, replace(t.path, '"_sources"', '_sources') AS path FROM answers a, json_tree(a.j) t)
SELECT id, CASE WHEN path = '$._sources' THEN key ELSE replace(substr(path, 3), '._sources', '') || '.' || key END AS field, value ->> '$' AS url FROM nodes WHERE path LIKE '%._sources'
UNION ALL SELECT id, value ->> '$.field', value ->> '$.url' FROM nodes WHERE path = '$.citations' AND json_exists(value, '$.field') AND json_exists(value, '$.url')""")  # fmt: skip
def nested_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source in nested answers with the path of the field that it is for, at any depth."""
    return variants.sources(answers(spark, sf_dir).select("id", F.try_parse_json("j").alias("value")))


#: What a score document should look like; many here don't.
SCHEMA = {
    "type": "object",
    "required": ["coverage", "depth"],
    "properties": {
        "coverage": {"type": ["number", "object"], "minimum": 0.2, "required": ["score"], "properties": {"score": {"type": ["number", "string"], "pattern": "^0"}}},
        "depth": {"type": ["number", "string"], "maximum": 0.7},
        "citation_alignment": {"properties": {"details": {"properties": {"total_pairs": {"enum": [0, 1, 2]}, "samples": {"minItems": 1, "maxItems": 3, "items": {"properties": {"url": {"type": "string"}}}}}}}},
    },
}
_RULES = [
    ("", "required", 0, "NOT json_exists(j, '$.coverage') OR NOT json_exists(j, '$.depth')"),
    ("coverage", "type", 1, "json_type(j, '$.coverage') NOT IN ('OBJECT', 'DOUBLE', 'UBIGINT', 'BIGINT')"),
    ("coverage", "minimum", 1, "json_type(j, '$.coverage') = 'DOUBLE' AND CAST(j ->> '$.coverage' AS DOUBLE) < 0.2"),
    ("coverage.score", "type", 2, "json_type(j, '$.coverage.score') = 'NULL'"),
    ("depth", "type", 1, "json_type(j, '$.depth') = 'OBJECT'"),
    ("depth", "maximum", 1, "json_type(j, '$.depth') = 'DOUBLE' AND CAST(j ->> '$.depth' AS DOUBLE) > 0.7"),
    ("citation_alignment.details.total_pairs", "enum", 3, "CAST(j ->> '$.citation_alignment.details.total_pairs' AS INT) = 3"),
    ("citation_alignment.details.samples[1].url", "type", 5, "true"),
]
_BROKEN = " UNION ALL ".join(f"SELECT agent, task, '{path}' AS path, '{word}' AS keyword, {depth} AS depth FROM docs WHERE {broken}" for path, word, depth, broken in _RULES)


@query("documents_validated", f"""WITH {DOCUMENTS_SQL}, broken AS ({_BROKEN}),
placed AS (SELECT *, count(*) OVER (PARTITION BY agent, task) AS n, row_number() OVER (PARTITION BY agent, task ORDER BY depth, path, keyword) AS place FROM broken)
SELECT agent || '/' || task AS id, place IS NULL AS valid, coalesce(n, 0) AS broken, path AS first_path, keyword AS first_keyword FROM docs LEFT JOIN (FROM placed WHERE place = 1) p USING (agent, task)""")  # fmt: skip
def documents_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score document against SCHEMA: how many rules it breaks, and the first of them."""
    docs = materialised(documents(spark, sf_dir).select(F.concat_ws("/", "agent", "task").alias("id"), F.try_parse_json("j").alias("value")))  # three passes read them
    return variants.validated(docs, variants.compiled(spark, SCHEMA))


_JUDGE = ("checklist", "analysis_depth.details", "presentation.details")
_ASKED = " + ".join(f"json_exists(j, '$.{p}.judge_error')::INT" for p in _JUDGE)
_FAILED = " + ".join(f"(coalesce(j ->> '$.{p}.judge_error', '') <> '')::INT" for p in _JUDGE)


@query("document_totals", f"""WITH {DOCUMENTS_SQL}, each AS (SELECT CAST(j ->> '$.answer_chars' AS BIGINT) AS chars, {_ASKED} + CAST(j ->> '$.citation_alignment.details.total_pairs' AS INT) AS calls, {_FAILED} AS errors, unnest(j ->> '$.citation_alignment.details.samples[*].url') AS url, row_number() OVER () AS r FROM docs)
SELECT (SELECT count(*) FROM docs) AS total_pairs, (SELECT sum(CAST(j ->> '$.answer_chars' AS BIGINT))::BIGINT FROM docs) AS total_chars, (SELECT (sum(CAST(j ->> '$.answer_chars' AS BIGINT)) // 4)::BIGINT FROM docs) AS est_tokens,
(SELECT count(DISTINCT url) FROM each) AS unique_urls, (SELECT sum({_ASKED} + CAST(j ->> '$.citation_alignment.details.total_pairs' AS INT))::BIGINT FROM docs) AS judge_calls, (SELECT sum({_FAILED})::BIGINT FROM docs) AS judge_errors""")  # fmt: skip
def document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports, characters, tokens, distinct cited URLs, judge calls and errors over all score documents."""
    return summaries.totals(documents(spark, sf_dir).select(F.try_parse_json("j").alias("value")))


#: Runs, one an event: its type is the domain, its user's number the level.
RUNS_SQL = """
runs AS (SELECT event_id, event_type AS domain, CAST(user_id % 3 AS INT) AS difficulty_level, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events),
told AS (SELECT *, value > 20 AS success, (value > 20 OR k % 4 = 0) AS pass_2, (event_id % 101) / 100.0 AS outcome, (event_id * 7 % 101) / 100.0 AS efficiency, (event_id * 11 % 101) / 100.0 AS robustness, (event_id * 13 % 101) / 100.0 AS complexity,
         (event_id * 17 % 101) / 100.0 AS composite, k % 20 AS steps, k * 31 AS tokens, floor(value) AS duration, substr('ABCDF', CAST(event_id % 5 AS INT) + 1, 1) AS grade, substr('EHT', CAST(k % 3 AS INT) + 1, 1) AS code, k % 4 AS times, CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'heavy' END AS noise FROM runs)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as summaries.summarised() takes them, and the day of each."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "ts", "event_type AS domain", "CAST(user_id % 3 AS INT) AS difficulty_level", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k", "value")
    part = lambda a: f"(event_id * {a} % 101) / 100.0D"
    return e.selectExpr(
        "CAST(ts AS DATE) AS day", "domain", "difficulty_level", "value > 20 AS success", "value > 20 AS pass_1", "value > 20 OR k % 4 = 0 AS pass_2", *(f"{part(a)} AS {n}" for a, n in ((1, "outcome"), (7, "efficiency"), (11, "robustness"), (13, "complexity"), (17, "composite"))),
        "k % 20 AS steps", "k * 31 AS tokens", "floor(value) AS duration", "substr('ABCDF', CAST(event_id % 5 AS INT) + 1, 1) AS grade", "map(substr('EHT', CAST(k % 3 AS INT) + 1, 1), CAST(k % 4 AS INT)) AS error_codes",
        "CASE event_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'heavy' END AS noise", "array(concat('http://h/', CAST(k AS STRING))) AS url_list",
    )


_HISTOGRAM = lambda name, n: f"(SELECT string_agg({name} || '=' || CAST(c AS VARCHAR), ',' ORDER BY {name}) FROM (SELECT {name}, {n} AS c FROM told t WHERE t.domain = g.domain AND t.difficulty_level = g.difficulty_level AND {name} IS NOT NULL GROUP BY 1))"
_AVERAGES = ", ".join(f"round(avg({m}) + 1e-9, 6)::DOUBLE AS avg_{m}" for m in summaries.MEASURES)


@query("run_summaries", f"""WITH {RUNS_SQL}, g AS (SELECT domain, difficulty_level, count(*) AS runs, round(avg(success::INT), 6) AS success_rate, round(avg(success::INT), 6) AS pass_1_rate, round(avg(pass_2::INT), 6) AS pass_2_rate, {_AVERAGES} FROM told GROUP BY 1, 2)
SELECT *, {_HISTOGRAM('grade', 'count(*)')} AS grades, {_HISTOGRAM('code', 'sum(times)::BIGINT')} AS errors, {_HISTOGRAM('noise', 'round(avg(composite) + 1e-9, 4)::DECIMAL(18,4)')} AS noise FROM g""")  # fmt: skip
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success and pass rates, mean scores, steps, tokens and times, and histograms of grades and errors, for each domain and level: every day's state, merged."""
    by = ("domain", "difficulty_level")
    found = summaries.finished(summaries.merged(summaries.summarised(runs(spark, sf_dir), "day", *by), *by), *by)
    listed = lambda c, kind: F.nullif(F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast(kind).cast("string"))), ","), F.lit(""))
    texts = (listed("grade_distribution", "bigint").alias("grades"), listed("error_codes", "bigint").alias("errors"), listed(F.transform_values("robustness_by_noise", lambda k, v: F.round(v + 1e-9, 4)), "decimal(18,4)").alias("noise"))
    return found.select(*by, "runs", *(f"{f}_rate" for f in summaries.FLAGS), *(f"avg_{m}" for m in summaries.MEASURES), *texts)


@query("run_sketches")
def run_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About how many URLs the runs of each domain name, from every day's sketches, how many they are, and whether the sketched middle and ninth tenth of durations lie within three hundredths of their ranks (sketches of quantiles draw lots, so their values don't come again)."""
    given = runs(spark, sf_dir)
    told = summaries.finished(summaries.merged(summaries.summarised(given, "day", "domain"), "domain"), "domain").select("domain", "runs", "about_urls", "durations_at_50_90")
    bound = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY duration)")
    exact = given.groupBy("domain").agg(F.count_distinct(F.get("url_list", F.lit(0))).alias("urls"), *(bound(q).alias(f"q{int(100 * q)}") for q in (0.47, 0.53, 0.87, 0.93)))
    at_ = lambda i: F.get("durations_at_50_90", F.lit(i))
    return told.join(exact, "domain").select("domain", "runs", "about_urls", "urls", at_(0).between(F.col("q47"), F.col("q53")).alias("middle_holds"), at_(1).between(F.col("q87"), F.col("q93")).alias("ninth_holds"))


_PRICED = " ".join(f"WHEN '{m}' THEN tokens_in / 1e6 * {a} + tokens_out / 1e6 * {b}" for m, (a, b) in summaries.PRICES.items())
_MODELS = ["glm-4.6", "deepseek-v3.2", "unlisted", ""]
_MODEL = "CASE event_id % 4 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_MODELS)) + " END"
_CALLS = f"event_type AS agent, event_id, CASE WHEN event_id % 5 = 0 THEN 'tool' ELSE 'llm' END AS kind, {_MODEL} AS model, event_id * 37 % 5000 AS tokens_in, event_id * 11 % 900 AS tokens_out, value"


@query("model_spending", f"""WITH calls AS (SELECT {_CALLS} FROM events),
cost AS (SELECT *, CASE model {_PRICED} ELSE tokens_in / 1e6 * {summaries.DEFAULT_PRICE[0]} + tokens_out / 1e6 * {summaries.DEFAULT_PRICE[1]} END AS usd FROM calls)
SELECT agent, count(*) FILTER (kind = 'llm') AS llm_calls, count(*) FILTER (kind = 'tool') AS tool_calls, sum(tokens_in) FILTER (kind = 'llm')::BIGINT AS tokens_in, sum(tokens_out) FILTER (kind = 'llm')::BIGINT AS tokens_out,
round(sum(round(usd, 9)) FILTER (kind = 'llm'), 5) AS cost_usd, round(sum(round(value, 3)), 2) AS wall_time_s, arg_min(model, event_id) FILTER (kind = 'llm' AND model <> '') AS model FROM cost GROUP BY 1""")  # fmt: skip
def model_spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens, dollars and seconds of each agent, from every day's state."""
    calls = table(spark, sf_dir, "events").selectExpr("CAST(ts AS DATE) AS day", "event_id AS at", "event_type AS agent", "CASE WHEN event_id % 5 = 0 THEN 'tool' ELSE 'llm' END AS kind", f"{_MODEL} AS model", "event_id * 37 % 5000 AS tokens_in", "event_id * 11 % 900 AS tokens_out", "value AS seconds")
    return summaries.spent(summaries.add_usage(summaries.usage(summaries.priced(calls), "day", "agent"), "agent"), "agent")


_FRESH = "chars % 3 = 0"
_NEW = {"analysis_depth": "floor(depth * 50 + 25) / 100", "presentation": "floor((1 - pres) * 100) / 100"}
_OLD = {"url_coverage": "url", "url_reachability": "reach", "quote_match": "qm", "claim_nli": "nli", "citation_alignment": "cit", "analysis_depth": "depth", "presentation": "pres"}
_FOLD = {
    "composite_v1": f"reach * {views.QUALITY_SQL}", "composite_v2": f"reach * (0.5 + 0.5 * qm) * (0.5 + 0.5 * nli) * {views.QUALITY_SQL}",
    "composite_v3": "greatest(0.1, reach) * (0.2 * url + 0.2 * qm + 0.2 * chk + 0.1 * spc + 0.15 * cit + 0.1 * ad + 0.05 * pr)", "legacy_composite": "0.5 * url + 0.35 * chk + 0.15 * spc",
}
_FOLD = {n: f.replace("spc", "(round(spc * 3) / 3.0)") for n, f in _FOLD.items()}  # a third to the last place, as in the documents


def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score rows as documents of structs, folded once: version 1."""
    pillars = [f"named_struct('score', {column}, 'passed', {column} >= 0.5, 'details', map('from', 'first')) AS {name}" for name, column in _OLD.items()]
    form = "named_struct('words_ok', url > 0.5, 'citations_ok', cit > 0.5, 'paragraphs_ok', pres > 0.5) AS markdown_spec"
    docs = views.scores(spark, sf_dir).selectExpr("agent", "task", "chars", "depth", "pres", *pillars, "named_struct('pass_rate', chk) AS checklist", form)
    return rescoring.stored(docs, "agent", "task")


@query("rescored_documents", f"""WITH {SCORES_SQL}, fresh AS (SELECT *, CASE WHEN {_FRESH} THEN {_NEW['analysis_depth']} ELSE depth END AS ad, CASE WHEN {_FRESH} THEN {_NEW['presentation']} ELSE pres END AS pr FROM scores),
folded AS (SELECT *, {', '.join(f'round({f} + 1e-9, 4) AS {n}' for n, f in _FOLD.items())} FROM fresh)
SELECT agent, task, CASE WHEN {_FRESH} THEN 2 ELSE 1 END AS version, ad AS analysis_depth, pr AS presentation, {', '.join(_FOLD)}, CASE WHEN {_FRESH} THEN depth END AS old_analysis_depth, CASE WHEN {_FRESH} THEN pres END AS old_presentation FROM folded""")  # fmt: skip
def rescored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents with two pillars judged anew and all composites folded again; the others as they were."""
    docs = stored_documents(spark, sf_dir)
    fresh = docs.where(_FRESH).select("agent", "task", *(F.expr(f"named_struct('score', {new}, 'passed', true, 'details', map('from', 'second'))").alias(name) for name, new in _NEW.items()))
    found = rescoring.rescored(docs, fresh, list(_NEW), "agent", "task")
    return found.select("agent", "task", "version", *(F.col(f"{n}.score").alias(n) for n in _NEW), *(f"composite.{n}" for n in _FOLD), *(F.col(f"rescore_meta.old_{n}").alias(f"old_{n}") for n in _NEW))


#: Weights of a run record's pillars.
_WEIGHTS = {"markdown": 0.10, "citation": 0.15, "fact_kg": 0.30, "judge": 0.20, "checklist": 0.20, "efficiency": 0.05}
_PILLARS = {"markdown": "markdown", "citation": "cit", "fact_kg": "fact_kg", "judge": "judge", "efficiency": "CASE WHEN chars % 4 > 0 THEN efficiency END"}
_REFOLD = " + ".join(f"{w} * coalesce({'round(1 - fact_kg, 4)' if n == 'fact_kg' else _PILLARS[n]}, 0)" for n, w in _WEIGHTS.items() if n in _PILLARS)


@query("rescored_runs", f"WITH {SCORES_SQL} SELECT agent, task, round(({_REFOLD}) / (0.75 + CASE WHEN chars % 4 > 0 THEN 0.05 ELSE 0 END) + 1e-9, 4) AS composite, CASE WHEN chars % 4 > 0 THEN 5 ELSE 4 END::BIGINT AS pillars FROM scores")
def rescored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records with one pillar of their map replaced, weighted again over the pillars that each has."""
    given = [f"'{n}', CASE WHEN ({x}) IS NOT NULL THEN named_struct('score', {x}, 'passed', true) END" for n, x in _PILLARS.items()]
    runs = views.scores(spark, sf_dir).selectExpr("agent", "task", "round(1 - fact_kg, 4) AS fresh", f"map_filter(map({', '.join(given)}), (k, v) -> v IS NOT NULL) AS pillars")
    found = rescoring.refolded_runs(runs, "fact_kg", F.struct(F.col("fresh").alias("score"), F.lit(True).alias("passed")), _WEIGHTS)
    return found.select("agent", "task", "composite", F.size("pillars").cast("long").alias("pillars"))


_LINK = lambda url, n: " || ".join(f"'[x]({url}{i}) '" for i in range(n))
_MD = f"""CASE chars % 11 WHEN 0 THEN '(Some-Agent produced no report after 30 s, exit=1)' WHEN 1 THEN ' (agent stderr: lost)' WHEN 2 THEN 'I cannot do this' WHEN 3 THEN 'no links' WHEN 4 THEN {_LINK('http://out.org/', 3)} || '[x](http://localhost:7770/a)' WHEN 5 THEN NULL WHEN 6 THEN '<think>' || {_LINK('http://localhost:9999/f/', 7)} ELSE {_LINK('http://localhost:8090/', 2)} END"""
ANSWERED_SQL = f"{SCORES_SQL},\ndocs AS (SELECT agent, task, CASE WHEN chars % 13 = 0 THEN 'no json' ELSE {DOCUMENT} END AS t, {_MD} AS md, chars % 11 AS form FROM scores), read AS (SELECT agent, task, md, form, CASE WHEN json_valid(t) THEN t END AS j FROM docs)"
_JSON = lambda path: f"json_extract(j, '$.{path}')"
_NUM = lambda path: f"CASE WHEN json_type(j, '$.{path}') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(j ->> '$.{path}' AS DOUBLE) END"
_ERRORS = [f"coalesce(j ->> '$.{p}', '') <> ''" for p in ("checklist.judge_error", "analysis_depth.details.judge_error", "presentation.details.judge_error")]
_FACTS = f"facts AS (SELECT *, {_NUM('answer_chars')} AS n, {_NUM('composite.composite_v2')} AS c, {_NUM('url_reachability.score')} AS reach, {_NUM('url_reachability.details.cited_total')} AS cited, {_NUM('url_reachability.details.http_4xx')} AS x4, {_NUM('url_coverage.details.must_cite_hit')} AS must, {' + '.join(f'({e})::INT' for e in _ERRORS)} AS errors FROM read)"


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(agent, task, value, md): score documents, some of which are no JSON, and the answers that they are about."""
    return views.scores(spark, sf_dir).selectExpr("agent", "task", f"try_parse_json(CASE WHEN chars % 13 = 0 THEN 'no json' ELSE {DOCUMENT} END) AS value", f"{_MD} AS md")


@query("document_problems", f"""WITH {ANSWERED_SQL}, {_FACTS} SELECT agent, task, array_to_string(list_filter([CASE WHEN NOT coalesce(json_exists(j, '$.task'), false) OR coalesce(json_type(j, '$.composite.composite_v2'), 'NULL') = 'NULL' THEN 'schema' END, CASE WHEN coalesce(n < 100, true) THEN 'empty' END, CASE WHEN form = 6 THEN 'thinking-leak' END, CASE WHEN errors > 0 THEN 'judge' END,
CASE WHEN CAST(j ->> '$.checklist.unclear_count' AS INT) = 2 THEN 'unclear' END, CASE WHEN coalesce(c < 0 OR c > 1, true) THEN 'composite' END, CASE WHEN (j ->> '$.url_reachability.passed') = 'true' AND cited = 0 THEN 'reach' END, CASE WHEN c = 0 AND n > 5000 THEN 'all-zero' END], lambda x: x IS NOT NULL), ',') AS problems FROM facts""")  # fmt: skip
def document_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which checks each score document fails."""
    return answered(spark, sf_dir).select("agent", "task", F.array_join(diagnosis.problems(F.col("value"), F.col("md")), ",").alias("problems"))


@query("document_labels", f"""WITH {ANSWERED_SQL}, {_FACTS}, z AS (SELECT agent, task, form, coalesce(n, 0) AS n, coalesce(c, 0) AS c, coalesce(reach, 0) AS reach, coalesce(x4, 0) AS x4, coalesce(must, 0) AS must FROM facts)
SELECT agent, task, CASE WHEN n < 100 THEN 'AGENT-FAULT-empty' WHEN form = 5 THEN 'AGENT-FAULT-no-md' WHEN form = 0 THEN 'AGENT-FAULT-runner-crash' WHEN form = 1 THEN 'AGENT-FAULT-runner-exception' WHEN form = 2 THEN 'AGENT-FAULT-refusal' WHEN n < 1000 THEN 'AGENT-FAULT-tiny' WHEN form = 3 THEN 'AGENT-FAULT-no-urls' WHEN form = 4 THEN 'AGENT-FAULT-external-urls' WHEN reach = 0 AND form = 6 AND x4 > 0 THEN 'AGENT-FAULT-wrong-url-format'
WHEN reach = 0 AND must > 0 THEN 'OUR-FAULT-canonical-vs-raw' WHEN c > 0.15 THEN 'OK-strong' WHEN c > 0.05 THEN 'OK-mid' WHEN c > 0 THEN 'OK-weak' WHEN reach > 0 THEN 'AGENT-FAULT-no-grounded-claims' ELSE 'AGENT-FAULT-other-zero' END AS label FROM z""")  # fmt: skip
def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose fault a low score is, by the first of 15 labels that fits."""
    return answered(spark, sf_dir).select("agent", "task", diagnosis.label(F.col("value"), F.col("md")).alias("label"))


@query("document_survey", f"""WITH {ANSWERED_SQL}, {_FACTS}, c AS (SELECT unnest(CASE WHEN j IS NULL THEN ['parse-error'] WHEN coalesce(n, 0) < 100 THEN ['E_empty'] WHEN form = 0 THEN ['R_runner-fail'] ELSE list_filter([CASE WHEN errors > 0 THEN 'J' || errors || '_judge' ELSE 'clean' END, CASE WHEN c = 0 AND n > 5000 AND cited > 0 AND reach > 0 THEN 'D_zero-but-real' END], lambda x: x IS NOT NULL) END) AS category FROM facts)
SELECT category, count(*) AS n FROM c GROUP BY 1""")  # fmt: skip
def document_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many score documents are broken in which way."""
    return diagnosis.survey(answered(spark, sf_dir))
