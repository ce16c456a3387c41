"""Verdicts on URLs by pattern rules, each found by its rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"[a-z0-9]+")

#: Rules in a pass over the rows; more rules take more passes, so a task never holds more than these.
RULES_A_PASS = 50_000


class Rule(NamedTuple):
    """`text` names the rule. `regex` is searched in host and path, or with whole=True in the lower-cased URL. Of the rules that fit, the highest (level, length of text) decides."""

    text: str
    verdict: str
    regex: str
    level: int = 0
    whole: bool = False


def site_rule(host: str, path: str, verdict: str, level: int = 1) -> Rule:
    """A host and its subdomains, for paths that begin with `path` ('/' at its front)."""
    return Rule(host + path, verdict, rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}", level)


def wildcard_rule(pattern: str, verdict: str = "block") -> Rule:
    """A pattern with * for any characters and ^ for a character that is no letter or digit, or an end."""
    body = "".join({"*": ".*", "^": "(?:[^a-z0-9]|^|$)"}.get(c) or re.escape(c) for c in pattern)
    return Rule(pattern, verdict, body, 0, True)


# The four rules of the contract, and the operator's own patterns.
SITE_RULES = [site_rule("net", "/", "block"), site_rule("example.net", "/en/", "allow"), site_rule("example.com", "/de/", "block"), site_rule("org", "/fr/", "allow")]
OWN_RULES = [wildcard_rule(p) for p in ("^spam-farm^", "^casino^", "^porn^", "^xxx^", "^viagra^", "^adserver^", "^doubleclick^", "^tracker^", "^ads^", "^malware^", "^phishing^", "^clickbait^")]


def literal_tokens(rule: Rule) -> list[str]:
    """Tokens that every URL that the rule fits has whole: runs of letters and digits with a fixed edge on both sides."""
    if rule.whole:
        return [t.group() for t in TOKEN.finditer(rule.text) if t.start() and t.end() < len(rule.text) and rule.text[t.start() - 1] != "*" and rule.text[t.end()] != "*"]
    host, _, path = rule.text.partition("/")
    # The last part of a path is a prefix unless something follows it.
    return TOKEN.findall(host) + [t.group() for t in TOKEN.finditer(path.lower()) if t.end() < len(path)]


def judge_urls(df: DataFrame, rules: Sequence[Rule] = tuple(SITE_RULES + OWN_RULES), url_column: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule (text of the deciding rule or null) and verdict of every row's URL; columns so named are replaced.

    The first pass counts in how many rows each literal token of a rule occurs; each rule is indexed by its rarest
    one. Then a row's tokens fetch the candidate rules, and only these run their regular expressions (rules without a
    literal token are always candidates). Nothing is shuffled but the counts. A null URL, or one without ://, has an
    empty host and path, and only whole-URL rules can fit it. Repeated rows get the same verdict each; an empty table
    stays empty.
    """
    out = ["host", "path", "rule", "verdict"]
    kept = df.drop(*out)
    rest = F.when(F.instr(F.col(url_column), "://") > 0, F.expr(f"substring(`{url_column}`, instr(`{url_column}`, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    wanted = sorted({t for r in rules for t in literal_tokens(r)})
    counts: dict[str, int] = {}
    for at in range(0, len(wanted), RULES_A_PASS):  # as many counts as rules have tokens come back
        tokens = F.array_distinct(F.expr(f"regexp_extract_all(lower(coalesce(`{url_column}`, '')), '[a-z0-9]+', 0)"))
        part = df.select(F.explode(tokens).alias("t")).where(F.col("t").isin(wanted[at : at + RULES_A_PASS]))
        counts.update((r.t, r["count"]) for r in part.groupBy("t").count().collect())
    kept = kept.withColumns({"host": host, "path": path, "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    schema = T.StructType([*kept.schema.fields[:-2], T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    ranked = sorted(rules, key=lambda r: (-r.level, -len(r.text), r.text))
    order = {r.text: i for i, r in enumerate(ranked)}
    for at in range(0, len(ranked), RULES_A_PASS):
        kept = kept.mapInArrow(_judge(ranked[at : at + RULES_A_PASS], counts, url_column, order if at else {}), schema)
    return kept


def _judge(rules: Sequence[Rule], counts: dict[str, int], url_column: str, earlier: dict[str, int]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            tokens = literal_tokens(rule)
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)) if tokens else "", []).append(i)
        compiled: dict[int, re.Pattern] = {}
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (url_column, "host", "path", "rule", "verdict")]
            texts, verdicts = [], []
            for url, host, path, text, verdict in zip(*cols, strict=True):
                low = (url or "").lower()
                for i in sorted({i for t in {"", *TOKEN.findall(low)} for i in index.get(t, ())}) if text not in earlier else ():
                    if i not in compiled:
                        compiled[i] = re.compile(rules[i].regex, re.DOTALL)
                    if compiled[i].search(low if rules[i].whole else host + path):
                        text, verdict = rules[i].text, rules[i].verdict  # noqa: PLW2901
                        break
                texts.append(text)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array(verdicts, pa.string())], names=batch.schema.names)

    return run
