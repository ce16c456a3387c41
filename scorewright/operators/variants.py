"""JSON of any shape as VARIANT: pillars that are numbers, objects or text, nested sources at any depth, validation against a schema."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.storage import materialised

# What a judge that counts as one of two answers gives, and the parts of a report's form.
UNCLEAR, FORM = 0.5, ("words_ok", "citations_ok", "paragraphs_ok")


def at(value: Column, path: str, kind: str = "variant") -> Column:
    """What a VARIANT has at a path, or null if there is nothing of that kind."""
    return F.try_variant_get(value, path, kind)


def entries(value: Column) -> Column:
    """An object's members as a map; null for anything else."""
    return at(value, "$", "map<string,variant>")


def items(value: Column) -> Column:
    """An array's items; null for anything else."""
    return at(value, "$", "array<variant>")


def kind(value: Column) -> Column:
    """object, array, string, integer, number, boolean or null; a null column for no value. Objects and arrays aren't looked into."""
    name = F.schema_of_variant(value)
    scalar = F.when(name == "VOID", "null").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name == "BIGINT", "integer")
    whole = at(value, "$", "double") == F.floor(at(value, "$", "double"))
    number = F.when(name.rlike(r"^DECIMAL\(\d+,0\)$") | (name.rlike("^(?:DECIMAL|DOUBLE|FLOAT)") & whole), "integer").when(name.rlike("^(?:DECIMAL|DOUBLE|FLOAT)"), "number")
    return F.when(value.isNull(), F.lit(None)).when(entries(value).isNotNull(), "object").when(items(value).isNotNull(), "array").otherwise(F.coalesce(scalar, number))


def scalar_number(value: Column) -> Column:
    """A number's or boolean's value (true is one); text, objects and null have none."""
    is_ = kind(value)
    return F.when(is_.isin("integer", "number"), at(value, "$", "double")).when(is_ == "boolean", at(value, "$", "boolean").cast("double"))


def pass_rate(checklist: Column) -> Column:
    """A checklist's own rate, else the share of its verdicts that pass (UNCLEAR counts half), else its score, else zero."""
    verdicts = F.transform(items(at(checklist, "$.verdicts")), lambda v: F.upper(F.coalesce(at(F.element_at(items(v), -1), "$", "string"), at(v, "$", "string"))))
    points = F.aggregate(verdicts, F.lit(0.0), lambda a, v: a + F.when(v == "PASS", 1.0).when(v == "UNCLEAR", UNCLEAR).otherwise(0.0))
    return F.coalesce(scalar_number(at(checklist, "$.pass_rate")), F.when(F.size(verdicts) > 0, points / F.size(verdicts)), scalar_number(at(checklist, "$.score")), F.lit(0.0))


def dimension(score: Column, name: str) -> Column:
    """A score document's dimension, whatever its shape.

    A number (or boolean) counts as it is, an object by its `score`, which may be text that reads as a number. Where
    there is neither, coverage is url_coverage's score, checklist its pass rate, spec the share of three passed
    checks of form; all else is zero.
    """
    value = at(score, f"$.{name}")
    inner = at(value, "$.score")
    given = F.when(kind(value) == "object", F.coalesce(scalar_number(inner), at(inner, "$", "string").try_cast("double"))).otherwise(scalar_number(value))
    legacy = {
        "coverage": F.coalesce(scalar_number(at(score, "$.url_coverage.score")), F.lit(0.0)),
        "checklist": pass_rate(at(score, "$.checklist")),
        "spec": sum((F.coalesce(at(score, f"$.markdown_spec.{k}", "boolean"), F.lit(False)).cast("int") for k in FORM), F.lit(0)) / 3.0,
    }
    return F.coalesce(given, legacy.get(name, F.lit(0.0)))


def fenced_json(text: Column, opening: str = "{", closing: str = "}") -> Column:
    """The last fenced block of a text that is valid JSON, else all from the first opening to the last closing mark, as VARIANT.

    Marks are those of an object, or [ and ] of an array. Null if nothing can be read.
    """
    wanted = entries if opening == "{" else items
    blocks = F.regexp_extract_all(text, F.lit(rf"```(?:json)?\s*(\{opening}[\s\S]*?\{closing})\s*```"), F.lit(1))
    read = F.filter(F.transform(F.reverse(blocks), F.try_parse_json), lambda v: wanted(v).isNotNull())
    whole = F.try_parse_json(F.nullif(F.regexp_extract(text, rf"\{opening}[\s\S]*\{closing}", 0), F.lit("")))
    return F.coalesce(F.get(read, 0), whole)


def records_in(text: Column) -> Column:
    """The objects in the last fenced array of a text (or in its widest unfenced one); empty if there are none."""
    found = F.filter(items(fenced_json(text, "[", "]")), lambda v: entries(v).isNotNull())
    return F.coalesce(found, F.array().cast("array<variant>"))


#: Levels that a document is gone down in one pass; only what is deeper is written and gone into again.
STRIDE = 32


def _node(path: Column, shape: Column, value: Column) -> Column:
    """An object or array with its path, that path without places, and what it holds, taken out of it once."""
    return F.struct(path.alias("path"), shape.alias("shape"), entries(value).alias("members"), items(value).alias("listed"))


def _inner(node: Column) -> Column:
    return node["members"].isNotNull() | node["listed"].isNotNull()


def below(node: Column, skip: tuple[str, ...] = ()) -> Column:
    """Array of (path, shape, value) of a node's members or items: `a.b[3].c` and, as shape, `a.b[].c`."""
    named = lambda at_, name: F.when(at_ == "", name).otherwise(F.concat(at_, F.lit("."), name))
    row = lambda path, shape, value: F.struct(path.alias("path"), shape.alias("shape"), value.alias("value"))
    members = F.map_entries(node["members"])
    members = F.filter(members, lambda e: ~e["key"].isin(*skip)) if skip else members
    return F.coalesce(
        F.transform(members, lambda e: row(named(node["path"], e["key"]), named(node["shape"], e["key"]), e["value"])),
        F.transform(node["listed"], lambda v, i: row(F.concat(node["path"], F.lit("["), i, F.lit("]")), F.concat(node["shape"], F.lit("[]")), v)),
        F.array().cast("array<struct<path:string,shape:string,value:variant>>"),
    )


def gathered(documents: DataFrame, id_column: str, value_column: str, gather: Callable[[Column], Column], fields: str, skip: tuple[str, ...] = (), beside: tuple[str, ...] = ()) -> DataFrame:
    """(id, fields): what `gather` finds, an array of structs of `fields`, in every object and array of the documents, at any depth.

    A pass folds each document STRIDE levels down and keeps only what is found and what is still deeper, which the
    next pass goes into; so no level is gone through twice. Members named in `skip` aren't gone into. `gather` is
    given (path, shape, members, listed) and may name the columns `beside`.
    """
    kind_ = f"array<struct<{fields}>>"
    root = _node(F.lit(""), F.lit(""), F.col(value_column))
    here = documents.select(F.col(id_column).alias("id"), *beside, F.filter(F.array(root), _inner).alias("nodes"))

    def step(so_far: Column, _: Column) -> Column:
        found = F.concat(so_far["found"], F.flatten(F.transform(so_far["nodes"], gather)))
        deeper = F.transform(so_far["nodes"], lambda n: F.filter(F.transform(below(n, skip), lambda c: _node(c["path"], c["shape"], c["value"])), _inner))
        return F.when(F.size(so_far["nodes"]) == 0, so_far).otherwise(F.struct(found.cast(kind_).alias("found"), F.flatten(deeper).alias("nodes")))

    parts = []
    while True:
        fold = F.aggregate(F.sequence(F.lit(1), F.lit(STRIDE)), F.struct(F.array().cast(kind_).alias("found"), F.col("nodes")), step)
        told = materialised(here.where(F.size("nodes") > 0).select("id", *beside, fold.alias("r")).select("id", *beside, "r.found", "r.nodes"))
        parts.append(told.select("id", F.inline("found")))
        here = told.where(F.size("nodes") > 0).select("id", *beside, "nodes")
        if not here.limit(1).count():
            return reduce(DataFrame.unionByName, parts)


def sources(documents: DataFrame, id_column: str = "id", value_column: str = "value") -> DataFrame:
    """(id, field, url) of every citation in nested answers: members of `_sources` objects at any depth, and the list `citations` at the top.

    A source's field is its path; `_sources` aren't gone into. A citation counts if it is an object with field and
    url. Urls that aren't text are given as JSON. Rows without JSON give none.
    """
    none = F.array().cast("array<struct<field:string,url:string>>")
    row = lambda field, link: F.struct(field.alias("field"), at(link, "$", "string").alias("url"))
    member = lambda value, name: F.try_element_at(value, F.lit(name))

    def cited(node: Column) -> Column:
        given = F.map_entries(entries(member(node["members"], "_sources")))
        field = lambda name: F.when(node["path"] == "", name).otherwise(F.concat(node["path"], F.lit("."), name))
        named = F.coalesce(F.transform(given, lambda e: row(field(e["key"]), e["value"])), none)
        whole = F.filter(F.transform(items(member(node["members"], "citations")), entries), lambda c: F.coalesce(F.map_contains_key(c, "field") & F.map_contains_key(c, "url"), F.lit(False)))
        listed = F.transform(whole, lambda c: row(at(member(c, "field"), "$", "string"), member(c, "url")))
        return F.when(node["path"] == "", F.concat(F.coalesce(listed, none), named)).otherwise(named)

    return gathered(documents, id_column, value_column, cited, "field:string,url:string", ("_sources",))


#: Keywords that look at one value, and what of it they need.
_KEYWORDS = "type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern minItems maxItems required minProperties maxProperties additionalProperties"


def compiled(spark: SparkSession, schema: dict[str, Any]) -> DataFrame:
    """(shape, keyword, number, texts) of a JSON Schema: one row for each keyword at each shape of path.

    Goes through properties and items; other applicators (anyOf, $ref and the like) are an error, not passed over.
    """
    rows: list[tuple[str, str, float | None, list[str]]] = []

    def go(at_: str, part: dict[str, Any] | bool) -> None:
        if isinstance(part, bool):
            if not part:
                rows.append((at_, "type", None, []))
            return
        for word, wanted in part.items():
            if word == "properties":
                for name, inner in wanted.items():
                    go(f"{at_}.{name}" if at_ else name, inner)
            elif word == "items":
                go(f"{at_}[]", wanted)
            elif word == "additionalProperties":
                if wanted is False:
                    rows.append((at_, word, None, sorted(part.get("properties", {}))))
                elif wanted is not True:
                    raise ValueError("additionalProperties with a schema isn't supported")
            elif word in ("enum", "const"):
                rows.append((at_, word, None, [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in (wanted if word == "enum" else [wanted])]))
            elif word in _KEYWORDS.split():
                listed = [wanted] if isinstance(wanted, str) else wanted if isinstance(wanted, list) else []
                rows.append((at_, word, None if listed or isinstance(wanted, (str, list)) else float(wanted), listed))
            elif word not in ("$schema", "$id", "title", "description", "default", "examples", "format"):
                raise ValueError(f"{word} isn't supported")

    go("", schema)
    return spark.createDataFrame(rows, "shape string, keyword string, number double, texts array<string>")


def _broken() -> Column:
    """Whether a row (json, type, amount, text, listed, members, keyword, number, texts) breaks its rule; keywords for other types never do."""
    type_, number, texts, amount, text, listed, members = (F.col(c) for c in ("type", "number", "texts", "amount", "text", "listed", "members"))
    numeric = type_.isin("integer", "number")
    tests = {
        "type": ~(F.array_contains(texts, type_) | ((type_ == "integer") & F.array_contains(texts, F.lit("number")))),
        "enum": ~F.array_contains(texts, F.col("json")), "const": ~F.array_contains(texts, F.col("json")),
        "minimum": numeric & (amount < number), "maximum": numeric & (amount > number), "exclusiveMinimum": numeric & (amount <= number), "exclusiveMaximum": numeric & (amount >= number),
        "multipleOf": numeric & (amount / number != F.floor(amount / number)),
        "minLength": F.char_length(text) < number, "maxLength": F.char_length(text) > number, "pattern": ~F.rlike(text, F.get(texts, F.lit(0))),
        "minItems": listed < number, "maxItems": listed > number, "minProperties": F.size(members) < number, "maxProperties": F.size(members) > number,
        "required": members.isNotNull() & (F.size(F.array_except(texts, members)) > 0),
        "additionalProperties": members.isNotNull() & (F.size(F.array_except(members, texts)) > 0),
    }
    return F.coalesce(reduce(lambda out, name: F.when(F.col("keyword") == name, tests[name]).otherwise(out), tests, F.lit(False)), F.lit(False))


def violations(documents: DataFrame, schema: DataFrame, id_column: str = "id", value_column: str = "value") -> DataFrame:
    """(id, path, keyword) of every rule that a document breaks. `schema` is compiled(); its rows are broadcast, as it is a document itself.

    Values come out of the documents (gathered), each meets the rules of its shape in a join; nothing is asked row by row. An
    enum's values are compared as JSON with sorted members. Rows without JSON break the rule `json` at the root.
    """
    rules = F.broadcast(schema)
    root = documents.select(F.col(id_column).alias("id"), F.lit("").alias("path"), F.lit("").alias("shape"), F.col(value_column).alias("value"))
    value, value_ = F.col("value"), F.col(value_column)

    def judged(rows: DataFrame) -> DataFrame:
        """What rules ask of a value is taken out of it once, before it meets them."""
        facts = rows.join(rules.select("shape").distinct(), "shape", "left_semi").withColumns({"type": kind(value), "amount": at(value, "$", "double"), "json": F.to_json(value), "listed": F.size(items(value)), "members": F.map_keys(entries(value))})
        facts = facts.withColumns({"text": F.when(F.col("type") == "string", at(value, "$", "string")), "listed": F.when(F.col("type") == "array", F.col("listed"))})
        return facts.select("id", "path", "shape", "type", "amount", "text", "json", "listed", "members").join(rules, "shape").where(_broken()).select("id", "path", "keyword")

    found = root.where("value is null").select("id", "path", F.lit("json").alias("keyword")).unionByName(judged(root.where("value is not null")))
    # Only values of shapes that have rules leave a document.
    shapes = schema.agg(F.collect_set("shape").alias("_shapes"))
    asked = documents.where(value_.isNotNull()).join(F.broadcast(shapes))
    held = gathered(asked, id_column, value_column, lambda n: F.filter(below(n), lambda c: F.array_contains("_shapes", c["shape"])), "path:string,shape:string,value:variant", beside=("_shapes",))
    return found.unionByName(judged(held))


def validated(documents: DataFrame, schema: DataFrame, id_column: str = "id", value_column: str = "value") -> DataFrame:
    """(id, valid, broken, first_path, first_keyword) of every document: how many rules it breaks, and the one nearest to the root, ties by path and keyword."""
    nearness = F.struct((F.size(F.regexp_extract_all("path", F.lit(r"\.|\["), F.lit(0))) + (F.col("path") != "").cast("int")).alias("depth"), "path", "keyword")
    first = violations(documents, schema, id_column, value_column).groupBy("id").agg(F.count("*").alias("broken"), F.min(nearness).alias("first"))
    every = documents.select(F.col(id_column).alias("id")).distinct().join(first, "id", "left")
    return every.select("id", F.col("first").isNull().alias("valid"), F.coalesce("broken", F.lit(0)).alias("broken"), F.col("first.path").alias("first_path"), F.col("first.keyword").alias("first_keyword"))
