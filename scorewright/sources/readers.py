"""Readers and writers of the files around a board: score documents, runs, battles, preferences, reports, golden bundles, tasks, work sheets.

Files that can't be read are counted or left out as each function says, and never stop a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.operators import filters

_PILLAR = "struct<score: double, passed: boolean>"
_PILLARS = {"reach": "url_reachability", "url": "url_coverage", "qm": "quote_match", "nli": "claim_nli", "cit": "citation_alignment", "depth": "analysis_depth", "pres": "presentation", "sd": "source_diversity", "pb": "perspective_balance", "fe": "factual_exactness", "ic": "internal_consistency"}
_JUDGED = "struct<score: double, passed: boolean, details: struct<judge_error: string>>"
_SHAPES = {"url_reachability": "struct<score: double, passed: boolean, details: struct<cited_total: int, infra_failure: boolean>>", "analysis_depth": _JUDGED, "presentation": _JUDGED}
SCORE_DOCUMENT = (
    "task string, answer_path string, answer_chars int, "
    + ", ".join(f"{name} {_SHAPES.get(name, _PILLAR)}" for name in _PILLARS.values())
    + ", markdown_spec struct<words_ok: boolean, citations_ok: boolean, paragraphs_ok: boolean, word_count: int>, checklist struct<verdicts: array<array<string>>, pass_rate: double, score: double, judge_error: string>"
    + ", composite struct<composite_v1: double, composite_v2: double, composite_v3: double>, _unread string"
)
PREFERENCE = "task_id string, agent_a string, agent_b string, winner string, dims_cited array<string>, annotator string, timestamp string"
BATTLE = "struct<task: string, a1: string, a2: string, agent_winner: string, agent_a: string, agent_b: string, winner: string, a: string, b: string, score_a: double, judge_model: string>"


def _file() -> Column:
    return F.url_decode(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def _json(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """Whole JSON files with their names; a file that can't be read has its text in _unread, if the schema has it."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_unread").json(path).withColumn("file", _file())


def checklist_rate(checklist: Column) -> Column:
    """Share of a checklist that passes: its own rate, else from its verdicts, where UNCLEAR counts half, else its score, else zero."""
    verdicts = F.transform(checklist["verdicts"], lambda v: F.upper(F.get(v, F.size(v) - 1)))
    points = F.aggregate(verdicts, F.lit(0.0), lambda a, v: a + F.when(v == "PASS", 1.0).when(v == "UNCLEAR", 0.5).otherwise(0.0))
    return F.coalesce(checklist["pass_rate"], F.when(F.size(verdicts) > 0, points / F.size(verdicts)), checklist["score"], F.lit(0.0))


def score_documents(spark: SparkSession, path: str) -> DataFrame:
    """Score rows of files named agent__task_suffix.score.json, all of them: names from the file, pillars (missing ones are zero), and what filters.drop_reason asks for.

    Rows have agent, task, suffix, file, load_error, chars and every pillar, spc as the share of three passed checks of form, chk by checklist_rate, composite by the headline formula.
    """
    raw = _json(spark, SCORE_DOCUMENT, path)
    name = lambda group: F.regexp_extract("file", r"^(.+?)__(.+)_([^_.]+)\.score\.json$", group)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    flags = [F.coalesce(F.col(f"markdown_spec.{k}"), F.lit(False)).cast("int") for k in ("words_ok", "citations_ok", "paragraphs_ok")]
    rows = raw.where(name(1) != "").select(
        name(1).alias("agent"), name(2).alias("task"), name(3).alias("suffix"), "file", (F.col("_unread").isNotNull() & F.col("task").isNull() & F.col("answer_chars").isNull()).alias("load_error"), "answer_path", F.col("answer_chars").alias("chars"), "answer_chars",
        *(zero(f"{long}.score").alias(short) for short, long in _PILLARS.items()), checklist_rate(F.col("checklist")).alias("chk"), ((flags[0] + flags[1] + flags[2]) / 3.0).alias("spc"),
        F.col("url_reachability.details.cited_total").alias("cited"), F.coalesce("url_reachability.details.infra_failure", F.lit(False)).alias("infra_failure"),
        *((F.coalesce(F.col(c), F.lit("")) != "").alias(n) for n, c in (("ck_error", "checklist.judge_error"), ("ad_error", "analysis_depth.details.judge_error"), ("pres_error", "presentation.details.judge_error"))),
        *(F.col(f"composite.composite_{v}").alias(f"stored_{v}") for v in ("v1", "v2", "v3")),
    )
    return rows.withColumn("composite", F.col("reach") * (0.4 * F.col("url") + 0.4 * F.col("chk") + 0.2 * F.col("spc")))


def with_heads(scores: DataFrame, answers: DataFrame) -> DataFrame:
    """Score rows with the first 300 characters of their answers, (file, md), found by the file name in answer_path; null where there is none."""
    heads = answers.groupBy("file").agg(F.left(F.min("md"), F.lit(300)).alias("head")).withColumnRenamed("file", "_answer")
    return scores.withColumn("_answer", F.regexp_extract("answer_path", r"([^/\\]+)$", 1)).join(heads, "_answer", "left").drop("_answer")


def load_scores(spark: SparkSession, path: str, suffix: str = "matrix", answers: DataFrame | None = None, drop_degenerate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of the suffix that count, how many an agent has and why others don't: total, load_error, degenerate, kept)."""
    rows = score_documents(spark, path).where(F.col("suffix") == suffix)
    rows = rows.withColumn("head", F.lit(None).cast("string")) if answers is None else with_heads(rows, answers)
    reason = F.when(F.col("load_error"), "load_error").when(filters.drop_reason().isNotNull(), "degenerate") if drop_degenerate else F.when(F.col("load_error"), "load_error")
    rows = rows.withColumn("dropped", reason)
    counts = rows.groupBy("agent").agg(F.count("*").alias("total"), *(F.count_if(F.col("dropped") == r).alias(r) for r in ("load_error", "degenerate")), F.count_if(F.col("dropped").isNull()).alias("kept"))
    return rows.where("dropped is null").drop("dropped"), counts


def runs(spark: SparkSession, path: str) -> DataFrame:
    """(agent, task_id, composite, pillars, file) of run records, one for each agent and task: a file ending in .ed.json before others, then the last by name."""
    raw = _json(spark, f"task_id string, agent string, composite double, pillars map<string, {_PILLAR}>, _unread string", path).where("agent is not null and task_id is not null")
    order = [F.col("file").endswith(".ed.json").desc(), F.desc("file")]
    return raw.withColumn("_place", F.row_number().over(Window.partitionBy("agent", "task_id").orderBy(*order))).where("_place = 1").select("agent", "task_id", "composite", "pillars", "file")


def battles(spark: SparkSession, path: str) -> DataFrame:
    """The battles of files with a list of them, in whatever of three shapes (operators.battles.normalised), each with its judge: its own, the file's, or what follows pairwise_ in the file's name."""
    raw = _json(spark, f"judge_model string, battles array<{BATTLE}>, _unread string", path)
    named = F.nullif(F.regexp_extract("file", r"pairwise_(.+?)\.json$", 1), F.lit(""))
    rows = raw.select("file", F.col("judge_model").alias("_judge"), named.alias("_named"), F.explode("battles").alias("x")).select("file", "_judge", "_named", "x.*")
    return rows.withColumn("judge_model", F.coalesce("judge_model", "_judge", "_named")).drop("_judge", "_named")


def preferences(spark: SparkSession, path: str) -> DataFrame:
    """Preferences of JSON lines; rows without the required keys or with another winner are left out."""
    return spark.read.schema(PREFERENCE).json(path).where("task_id is not null and agent_a is not null and agent_b is not null and winner in ('a', 'b', 'tie')")


def append_preferences(df: DataFrame, path: str) -> None:
    """Adds preferences as JSON lines; those that preferences() would leave out are not written."""
    df.where("task_id is not null and agent_a is not null and agent_b is not null and winner in ('a', 'b', 'tie')").select(*(c.split()[0] for c in PREFERENCE.split(", "))).write.mode("append").json(path)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, md): whole markdown files."""
    return spark.read.option("wholetext", True).text(path).select(_file().alias("file"), F.col("value").alias("md"))


def golden_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(must-cite URLs, pool URLs, triples) of golden JSON files, each with the file's task."""
    link = "array<struct<url: string, category: string, weight: double, why: string>>"
    raw = _json(spark, f"must_cite_urls {link}, expected_pool_urls {link}, triples array<struct<subject: string, predicate: string, object: string, source_url: string, quoted_span: string>>, _unread string", path)
    task = F.regexp_extract("file", r"^(.*?)(?:\.filtered)?\.json$", 1).alias("task")
    return tuple(raw.select(task, F.explode(c).alias("x")).select("task", "x.*") for c in ("must_cite_urls", "expected_pool_urls", "triples"))


def golden_triples(spark: SparkSession, path: str) -> DataFrame:
    """(task, subject, predicate, object) of golden files: a task's .filtered.json, or its other file where that has no triples."""
    raw = _json(spark, "triples array<struct<subject: string, predicate: string, object: string>>, _unread string", path)
    rows = raw.select(F.regexp_extract("file", r"^(.*?)(?:\.filtered)?\.json$", 1).alias("task"), F.col("file").endswith(".filtered.json").alias("filtered"), F.explode("triples").alias("t"))
    best = rows.groupBy("task").agg(F.max("filtered").alias("filtered"))
    return rows.join(best, ["task", "filtered"]).select("task", "t.*")


def dimension_scores(spark: SparkSession, path: str) -> DataFrame:
    """(agent, dim, score) of a map of maps; where a file has pillar_elo instead, its ratings from 0 to 1 within each pillar, 0.5 if they are all the same."""
    raw = _json(spark, "scores map<string, map<string, double>>, pillar_elo map<string, map<string, double>>, _unread string", path)
    given = raw.select(F.explode("scores").alias("agent", "x")).select("agent", F.explode("x").alias("dim", "score"))
    elo = raw.where("scores is null").select(F.explode("pillar_elo").alias("dim", "x")).select("dim", F.explode("x").alias("agent", "elo"))
    ends = elo.groupBy("dim").agg(F.min("elo").alias("low"), F.max("elo").alias("high"))
    scaled = F.coalesce((F.col("elo") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)), F.lit(0.5))
    return given.unionByName(elo.join(ends, "dim").select("agent", "dim", scaled.alias("score")))


def worksheet(spark: SparkSession, path: str) -> DataFrame:
    """(number, domain, url, snippet, reach, support, notes): rows of a markdown table."""
    cells = F.transform(F.split("value", r"\|"), lambda c: F.trim(c))
    rows = spark.read.text(path).where(F.col("value").rlike(r"^\|\s*\d+\s*\|")).select(cells.alias("c"))
    return rows.select(F.get("c", F.lit(1)).try_cast("int").alias("number"), *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(("domain", "url", "snippet", "reach", "support", "notes"), 2)))


def worksheet_rates(rows: DataFrame) -> DataFrame:
    """(domain, checked, reached, supported, reach_rate, support_rate) of a filled-in work sheet, cells as y, yes or a tick."""
    yes = lambda c: F.lower(F.trim(c)).rlike(r"^(?:y|yes|1|true|✓|ok)\b|^✓")
    filled = rows.where("trim(reach) != ''")
    per = filled.groupBy("domain").agg(F.count("*").alias("checked"), F.count_if(yes("reach")).alias("reached"), F.count_if(yes("support")).alias("supported"))
    return per.withColumns({"reach_rate": F.round(F.col("reached") / F.col("checked"), 4), "support_rate": F.round(F.col("supported") / F.col("checked"), 4)})


class Tasks:
    """Task definitions as JSON below one folder a domain; a change writes the domain's next version whole."""

    SCHEMA = "task_id string, difficulty string, intent string, iaa double, spec string, status string"
    DOMAINS = ("ecommerce", "development", "cms", "forum", "knowledge")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        return self.spark.read.schema(f"{self.SCHEMA}, domain string").json(self.path)

    def save(self, tasks: DataFrame) -> None:
        """Adds tasks (SCHEMA and domain) in the place of those with the same domain and id."""
        old = self.table().join(tasks.select("domain", "task_id"), ["domain", "task_id"], "left_anti") if self._any() else None
        self._write(tasks if old is None else old.join(tasks.select("domain").distinct(), "domain", "left_semi").unionByName(tasks, allowMissingColumns=True))

    def load(self, domain: str, task_id: str) -> DataFrame:
        """The task, or no row; only its domain's folder is read."""
        return self.table().where((F.col("domain") == domain) & (F.col("task_id") == task_id))

    def delete(self, domain: str, task_id: str) -> bool:
        """Whether the task was there."""
        if not self._any() or not self.load(domain, task_id).limit(1).count():
            return False
        self._write(self.table().where((F.col("domain") == domain) & (F.col("task_id") != task_id)), domain)
        return True

    def listed(self, domain: str | None = None, difficulty: str | None = None, status: str | None = None) -> DataFrame:
        rows = self.table()
        for name, value in (("domain", domain), ("difficulty", difficulty), ("status", status)):
            rows = rows if value is None else rows.where(F.col(name) == value)
        return rows.orderBy("domain", "task_id")

    def counts(self) -> DataFrame:
        """(domain, tasks): every known domain, also those without a task, and others that there are."""
        known = self.spark.createDataFrame([(d,) for d in self.DOMAINS], "domain string")
        own = self.table().groupBy("domain").agg(F.count("*").alias("tasks"))
        return known.join(own, "domain", "full").select("domain", F.coalesce("tasks", F.lit(0)).alias("tasks"))

    def statistics(self) -> DataFrame:
        """(domain, difficulty, status, tasks, mean_iaa): over all tasks (all names null), and by each of the three; agreements of zero, which stand for none measured, are left out of the mean."""
        measured = F.when(F.col("iaa") != 0, F.col("iaa"))
        return self.table().groupingSets([[], ["domain"], ["difficulty"], ["status"]], "domain", "difficulty", "status").agg(F.count("*").alias("tasks"), F.round(F.coalesce(F.avg(measured), F.lit(0.0)), 4).alias("mean_iaa"))

    def _any(self) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _write(self, rows: DataFrame, emptied: str | None = None) -> None:
        """Overwrites the domains that rows has; through a copy beside, as Spark can't overwrite what it reads."""
        rows.write.mode("overwrite").partitionBy("domain").json(f"{self.path}.next")
        fresh = self.spark.read.schema(f"{self.SCHEMA}, domain string").json(f"{self.path}.next")
        if emptied is not None and not fresh.limit(1).count():
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/domain={emptied}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            return
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain").json(self.path)


def write_board(df: DataFrame, path: str) -> None:
    """A board as one CSV file with a head; a board has a row an agent."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown_board(df: DataFrame, order: str, *columns: str) -> list[str]:
    """A board as the lines of a markdown table, in the order of a column; a board has a row an agent, so it comes to the driver."""
    rows = df.orderBy(order).select(*(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in columns)).collect()
    return [f"| {' | '.join(columns)} |", f"|{'---|' * len(columns)}", *(f"| {' | '.join(r)} |" for r in rows)]
