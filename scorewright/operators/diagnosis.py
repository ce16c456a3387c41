"""What is wrong with score documents (as VARIANT) and their answers, and whose fault it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions import text
from scorewright.operators.citations import citations_of
from scorewright.operators.variants import at, entries, items, kind, scalar_number

# What runners and models write in the place of a report, and hosts that reports may cite.
RUNNER_FAILED = r"(?iU)^\(\s*[A-Za-z][\w\- ]*\s+produced no report\s+after\s+\d+\s*s"
RUNNER_RAISED = r"(?iU)^\(\s*[A-Za-z][\w\- ]*\s+(error|stderr)\s*:"
REFUSALS = ["please confirm", "i cannot", "based on the analysis", "given the scope", "i will need", "(empty "]
THINKING = r"(?i)<think>|Thinking Process:|</think>"
SANDBOX = ["localhost:7770", "localhost:9999", "localhost:8090"]
JUDGE_ERRORS = {"checklist": "$.checklist.judge_error", "analysis_depth": "$.analysis_depth.details.judge_error", "presentation": "$.presentation.details.judge_error", "citation_alignment": "$.citation_alignment.details.judge.error"}

#: The checks in the order in which their names are listed.
CHECKS = ("schema", "empty", "thinking-leak", "judge", "unclear", "composite", "reach", "all-zero")


def _says(value: Column) -> Column:
    """Whether there is more than nothing: not null, false, zero or empty."""
    is_ = kind(value)
    filled = F.when(is_ == "string", at(value, "$", "string") != "").when(is_.isin("integer", "number", "boolean"), scalar_number(value) != 0).when(is_ == "object", F.size(entries(value)) > 0).when(is_ == "array", F.size(items(value)) > 0)
    return F.coalesce(filled, F.lit(False))


def _number(value: Column, path: str) -> Column:
    """A number or boolean there, null for all else."""
    return scalar_number(at(value, path))


def problems(value: Column, md: Column) -> Column:
    """Names of the CHECKS that a document and its answer fail, in order; none for a sound one, schema for what isn't JSON.

    schema: no task or no composite_v2. empty: characters under 100 or no number. thinking-leak: marks of thinking in
    the answer's first 8,000 characters. judge: any judge's error. unclear: all verdicts are. composite: outside 0 to 1
    or no number. reach: passed without a cited URL. all-zero: a composite of zero for over 5,000 characters.
    """
    chars, composite = _number(value, "$.answer_chars"), _number(value, "$.composite.composite_v2")
    stated = at(value, "$.composite.composite_v2")
    verdicts, unclear = items(at(value, "$.checklist.verdicts")), F.coalesce(_number(value, "$.checklist.unclear_count"), F.lit(0.0))
    cited = at(value, "$.url_reachability.details.cited_total")
    found = {
        "schema": ~F.coalesce(F.map_contains_key(entries(value), "task"), F.lit(False)) | (F.coalesce(kind(stated), F.lit("null")) == "null"),
        "empty": F.coalesce(chars < 100, F.lit(True)),
        "thinking-leak": F.coalesce(F.left(md, F.lit(8000)).rlike(THINKING), F.lit(False)),
        "judge": reduce(lambda a, b: a | b, (_says(at(value, p)) for p in JUDGE_ERRORS.values())),
        "unclear": F.coalesce((F.size(verdicts) > 0) & (unclear == F.size(verdicts)), F.lit(False)),
        "composite": F.coalesce((composite < 0) | (composite > 1), F.lit(True)),
        "reach": F.coalesce(at(value, "$.url_reachability.passed", "boolean"), F.lit(False)) & F.coalesce(scalar_number(cited) == 0, cited.isNull()),
        "all-zero": F.coalesce((composite == 0) & (chars > 5000), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(found[name], F.lit(name)) for name in CHECKS)))


def label(value: Column, md: Column) -> Column:
    """One of 15 labels, the first that fits: AGENT-FAULT-..., OUR-FAULT-... or OK-...

    No or next to no answer, no text, a runner's crash or exception, a refusal, a tiny answer, no URLs, more external
    than sandbox URLs, URLs in another form than the pages', hits that only canonical forms have; then how strong the
    composite is, answers that are reached but ground nothing, and other zeros. Missing numbers count as zero.
    """
    zero = lambda path: F.coalesce(_number(value, path), F.lit(0.0))
    chars, reach, composite = zero("$.answer_chars"), zero("$.url_reachability.score"), zero("$.composite.composite_v2")
    head = text.strip(F.left(md, F.lit(300)))
    refused = reduce(lambda a, p: a | F.startswith(F.lower(head), F.lit(p)), REFUSALS, F.lit(False))

    def by_urls(urls: Column) -> Column:
        inside = F.filter(urls, lambda u: reduce(lambda a, h: a | F.contains(u, F.lit(h)), SANDBOX, F.lit(False)))
        external = (F.size(urls) - F.size(inside)) / F.greatest(F.size(urls), F.lit(1))
        return (
            F.when(F.size(urls) == 0, "AGENT-FAULT-no-urls")
            .when(external > 0.5, "AGENT-FAULT-external-urls")
            .when((reach == 0) & (F.size(inside) > 5) & (zero("$.url_reachability.details.http_4xx") > 0), "AGENT-FAULT-wrong-url-format")
            .when((reach == 0) & (zero("$.url_coverage.details.must_cite_hit") > 0), "OUR-FAULT-canonical-vs-raw")
            .when(composite > 0.15, "OK-strong")
            .when(composite > 0.05, "OK-mid")
            .when(composite > 0, "OK-weak")
            .when((reach > 0) & (composite == 0), "AGENT-FAULT-no-grounded-claims")
            .otherwise("AGENT-FAULT-other-zero")
        )

    urls = F.array_distinct(F.transform(citations_of(md, wanted=("url",)), lambda c: c["url"]))
    return (
        F.when(chars < 100, "AGENT-FAULT-empty")
        .when(F.coalesce(md, F.lit("")) == "", "AGENT-FAULT-no-md")
        .when(head.rlike(RUNNER_FAILED), "AGENT-FAULT-runner-crash")
        .when(head.rlike(RUNNER_RAISED), "AGENT-FAULT-runner-exception")
        .when(refused, "AGENT-FAULT-refusal")
        .when(chars < 1000, "AGENT-FAULT-tiny")
        .otherwise(text.let(urls, by_urls))
    )


def survey(documents: DataFrame, value_column: str = "value", md_column: str = "md") -> DataFrame:
    """(category, n): how many documents are in each category: parse-error, E_empty and R_runner-fail, which end the matter, J<n>_judge and D_zero-but-real beside each other, and clean for what has none but perhaps the last.

    Categories without a document have no row.
    """
    value, md = F.col(value_column), F.col(md_column)
    chars, composite = F.coalesce(_number(value, "$.answer_chars"), F.lit(0.0)), _number(value, "$.composite.composite_v2")
    errors = sum((_says(at(value, p)).cast("int") for p in JUDGE_ERRORS.values()), F.lit(0))
    zero = (composite == 0) & (chars > 5000) & (_number(value, "$.url_reachability.details.cited_total") > 0) & (_number(value, "$.url_reachability.score") > 0)
    beside = F.array_compact(F.array(F.when(errors > 0, F.format_string("J%d_judge", errors)).otherwise("clean"), F.when(F.coalesce(zero, F.lit(False)), F.lit("D_zero-but-real"))))
    failed = F.coalesce(text.strip(F.left(md, F.lit(300))).rlike(RUNNER_FAILED + r"\s*,\s*exit\s*=\s*\d+\s*\)"), F.lit(False))
    one = lambda name: F.array(F.lit(name))
    named = F.when(value.isNull(), one("parse-error")).when(chars < 100, one("E_empty")).when(failed, one("R_runner-fail")).otherwise(beside)
    return documents.select(F.explode(named).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
