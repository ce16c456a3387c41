"""What judges and models write: numbered verdicts, thinking, reports wrapped in JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewright.functions.text import let, strip

#: The reason of an item that a judge passed over.
SILENT = "judge did not emit a verdict"


def verdicts(answer: Column, n: int, notes: bool = True) -> Column:
    """Array of (index, passed, reason) for n items, from what a judge wrote.

    `1. PASS - reason` or `1) fail` counts for its item, up to the next number (or NOTES:, if there can be `notes`). If
    any item has none, and there are n verdicts at the beginnings of lines, these count for all, in order and without
    reasons. What is left fails. A reason is its first line, 120 characters of it. Null answers are empty.
    """
    end = r"(?=\n\s*\d+[\.\)]|\nNOTES:|\z)" if notes else r"(?=\n\s*\d+[\.\)]|\z)"
    marks = r"[:.\-—)]?" if notes else r"[-:.]?"

    def read(body: Column) -> Column:
        def numbered(i: int) -> Column:
            pattern = rf"(?isU)(?:^|\n)\s*{i}[\.\)]\s*(PASS|FAIL)\b\s*{marks}\s*(.*?){end}"
            word = F.regexp_extract(body, pattern, 1)
            reason = F.left(F.substring_index(strip(F.regexp_extract(body, pattern, 2)), "\n", 1), F.lit(120))
            return F.when(word != "", F.struct(F.lit(i).alias("index"), (F.upper(word) == "PASS").alias("passed"), reason.alias("reason")))

        alone = F.get(F.split(body, r"(?i)\n\s*NOTES:", 2), 0) if notes else body
        words = F.regexp_extract_all(alone, F.lit(r"(?iU)(?:^|\n)\s*(PASS|FAIL)\b"), F.lit(1))
        own = F.array(*(numbered(i) for i in range(1, n + 1))) if n else F.array().cast("array<struct<index:int,passed:boolean,reason:string>>")
        in_order = F.transform(F.slice(words, 1, n), lambda w, i: F.struct((i + 1).alias("index"), (F.upper(w) == "PASS").alias("passed"), F.lit("").alias("reason")))
        filled = let(own, lambda xs: F.transform(xs, lambda x, i: F.coalesce(x, F.struct((i + 1).alias("index"), F.lit(False).alias("passed"), F.lit(SILENT).alias("reason")))))
        return F.when(F.exists(own, lambda x: x.isNull()) & (F.size(words) >= n), in_order).otherwise(filled)

    return let(F.coalesce(answer, F.lit("")), read)


def passed_share(answer: Column, n: int) -> Column:
    """Share of n items that a judge passed."""
    return F.size(F.filter(verdicts(answer, n), lambda v: v["passed"])) / n if n else F.lit(0.0)


def without_thinking(content: Column) -> Column:
    """A model's answer without its thinking: tagged blocks go; an open block, or a preamble that no answer follows, leaves nothing. Null stays null."""
    tagged = F.regexp_replace(content, r"(?is)<think>.*?</think>\s*", "")
    preamble = r"(?is)\A\s*Thinking Process:.*?(?=\n\n(?:[A-Za-z\{\[\"]|Final Answer|Output|Answer))"
    return (
        F.when(tagged != content, F.regexp_replace(tagged, r"\A\n+", ""))
        .when(content.rlike(r"(?is)\A\s*<think>"), "")
        .when(content.rlike(r"(?U)\A\s*Thinking Process:"), F.when(content.rlike(preamble), F.regexp_replace(F.regexp_replace(content, preamble, ""), r"(?U)\A\s+", "")).otherwise(""))
        .otherwise(content)
    )


def unwrapped(content: Column) -> Column:
    """The report within `{"markdown_report": ...}`, also where its newlines make it no JSON; empty for all else."""
    body = strip(F.coalesce(content, F.lit("")))
    wrapped = F.startswith(body, F.lit('{"markdown_report"')) | F.startswith(body, F.lit("{'markdown_report'"))
    proper = F.try_variant_get(F.try_parse_json(body), "$.markdown_report", "string")
    rest = F.regexp_extract(body, r'(?s)"markdown_report"\s*:\s*"(.*)\z', 1)
    for written, meant in (('\\"', '"'), ("\\n", "\n"), ("\\t", "\t")):
        rest = F.replace(rest if written != '\\"' else F.regexp_replace(rest, r'"\s*\}\s*\z', ""), F.lit(written), F.lit(meant))
    return F.when(~wrapped, "").when(strip(F.coalesce(proper, F.lit(""))) != "", proper).otherwise(strip(rest))


def first_words(text: Column, n: int) -> Column:
    """The first n words, one space apart."""
    return F.array_join(F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != ""), 1, n), " ")
