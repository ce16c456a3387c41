"""Citations in reports, in all forms that writers use, and tables of claims made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.functions import text, url

#: Forms of citations, the most explicit first: at one place of a report the first of them counts.
STYLES = ("markdown", "source", "bullet", "numbered", "footnote", "bare")

#: What is known of a citation.
FIELDS = ("at", "style", "raw_url", "url", "claim")

#: Characters before and after a citation that are its claim.
WINDOW = 200


def _references(md: Column, pattern: str) -> Column:
    """Array of (name, url) from lines that define references: the first bare URL of the line, else its first link."""
    names, rests = (F.regexp_extract_all(md, F.lit(pattern), F.lit(group)) for group in (1, 2))
    target = lambda rest: F.coalesce(F.nullif(F.regexp_extract(rest, text.BARE_URL, 0), F.lit("")), F.nullif(F.regexp_extract(rest, text.MD_URL, 1), F.lit("")))
    lines = F.zip_with(names, rests, lambda name, rest: F.struct(name.alias("name"), url.trimmed(target(rest)).alias("url")))
    return F.filter(lines, lambda line: line["url"].isNotNull())


def _likely(body: Column) -> tuple[Column, ...]:
    """For each of STYLES whether a text can have such citations at all, told by what is quickly looked for."""
    link, linked = body.contains("http"), body.contains("://")
    return body.contains("](http"), linked & body.rlike(r"(?iU)[:=]\s*https?://"), link, body.contains("[") & link, body.contains("[^") & link, link


def has_citation(md: Column) -> Column:
    """Whether citations_of has any: a mark counts with a line that has a link or a bare URL, so marks needn't be looked for."""
    likely = _likely(md)
    patterns = {0: text.MD_LINK, 5: text.BARE_URL, 2: text.BULLET_URL, 1: text.SOURCE_URL}
    return F.coalesce(reduce(lambda a, b: a | b, (likely[rank] & md.rlike(pattern) for rank, pattern in patterns.items())), F.lit(False))


def citations_of(md: Column, hosts: list[str] | None = None, around: int = WINDOW, wanted: tuple[str, ...] = FIELDS) -> Column:
    """Array of (at, style, raw_url, url, claim), or what is `wanted` of them, of a report, by place; only those to `hosts`, if given.

    A markdown link or a mark stands at its opening bracket, a URL at its first character. raw_url is what was written,
    without punctuation behind; url its canonical form. The claim is the text around, links as their labels, without
    code, white space folded. Null and empty reports have none.
    """

    def cited(body: Column) -> Column:
        form = lambda rank, at, raw: F.struct(at.cast("int").alias("at"), F.lit(rank).alias("rank"), url.trimmed(raw).alias("raw_url"))
        last = lambda x, pattern: F.regexp_extract(x["hit"], pattern, 0)
        tail = lambda rank: lambda x: form(rank, x["at"] + F.char_length(x["hit"]) - F.char_length(last(x, r"(?i)https?://.*$")), last(x, r"(?i)https?://.*$"))

        def marked(rank: int, mark: str, line: str) -> Column:
            def named(table: Column) -> Column:
                name = lambda x: F.regexp_extract(x["hit"], r"^\[\^?([^\]]*)\]$", 1)
                target = lambda x: F.try_element_at(F.filter(table, lambda line: line["name"] == name(x)), F.lit(-1))["url"]
                return F.filter(F.transform(text.found(body, mark), lambda x: form(rank, x["at"], target(x))), lambda c: c["raw_url"].isNotNull())

            return F.when(body.rlike(line), text.let(_references(body, line), named)).otherwise(none)

        none = F.array().cast("array<struct<at:int,rank:int,raw_url:string>>")
        forms = [
            F.transform(text.found(body, text.MD_LINK), lambda x: form(0, x["at"], F.regexp_extract(x["hit"], text.MD_URL, 1))),
            F.transform(text.found(body, text.SOURCE_URL), tail(1)),
            F.transform(text.found(body, text.BULLET_URL), lambda x: form(2, x["at"] + F.locate("http", x["hit"]) - 1, F.regexp_extract(x["hit"], r"https?://\S+", 0))),
            marked(3, text.NUMBER_MARK, text.NUMBER_LINE),
            marked(4, text.FOOTNOTE_MARK, text.FOOTNOTE_LINE),
            F.transform(text.found(body, text.BARE_URL), lambda x: form(5, x["at"], x["hit"])),
        ]
        # Most texts have few of the forms, and each costs two passes by its pattern.
        forms = [F.when(can, form).otherwise(none) for can, form in zip(_likely(body), forms, strict=True)]
        kept = F.filter(F.concat(*forms), lambda c: (c["raw_url"] != "") & (url.host_in(c["raw_url"], hosts) if hosts else F.lit(True)))

        def first(ordered: Column) -> Column:
            own = F.filter(ordered, lambda c, i: (i == 0) | (c["at"] != F.get(ordered, i - 1)["at"]))
            style = lambda c: F.element_at(F.array(*map(F.lit, STYLES)), c["rank"] + 1)
            claim = lambda c: claim_text(text.window(body, c["at"], c["at"], around))
            made = {"at": lambda c: c["at"], "style": style, "raw_url": lambda c: c["raw_url"], "url": lambda c: url.canonical(c["raw_url"]), "claim": claim}
            return F.transform(own, lambda c: F.struct(*(made[name](c).alias(name) for name in wanted)))

        return text.let(F.array_sort(kept), first)

    return text.let(F.coalesce(md, F.lit("")), cited)


def claim_text(chunk: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(chunk, text.MD_LABEL, "$1"), r"`[^`]*`", " ")
    return text.strip(F.regexp_replace(flat, r"(?U)\s+", " "))


def citations(reports: DataFrame, hosts: list[str] | None = None, id_column: str = "doc_id", md_column: str = "md", wanted: tuple[str, ...] = FIELDS, beside: tuple[str, ...] = ()) -> DataFrame:
    """(id, beside, at, style, raw_url, url, claim): a row for each citation of each report (citations_of), with the report's columns `beside`; a report without gives none."""
    return reports.select(id_column, *beside, F.explode(citations_of(F.col(md_column), hosts, wanted=wanted)).alias("c")).select(id_column, *beside, "c.*")


def with_every_report(reports: DataFrame, counted: DataFrame, id_column: str, **missing: object) -> DataFrame:
    """The counts of every report: those of reports without any are as `missing` says."""
    return reports.select(id_column).distinct().join(counted, id_column, "left").fillna({k: v for k, v in missing.items()})
