"""Whether texts, numbers and nested answers say what is expected. Nulls count as empty unless a function says otherwise."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels before grouped subjects, and lengths at which the beginning of a long subject is enough.
GROUPS = ["theme:", "tea-type:", "forum:", "author:", "category:"]
BEGINNINGS = (60, 40, 24, 12)


def plain(text: Column) -> Column:
    """Lower case, white space folded, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "), "^ | $", "")


def looks_numeric(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)^\s+|\s+$", "").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.lit(False))


def number_in(value: Column, text: Column) -> Column:
    """Whether the first number of the value stands in the text, not as part of a longer one; commas and $ or ¥ in the text don't count."""
    number = F.regexp_extract(F.coalesce(value, F.lit("")), r"-?[0-9]+(?:\.[0-9]+)?", 0)
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[,$¥]", "")
    return (number != "") & F.rlike(bare, F.concat(F.lit(r"(?<![0-9.])\Q"), number, F.lit(r"\E(?![0-9])")))


def number_hit(value: Column, text: Column) -> Column:
    """Whether the text, without commas, has the value's first run of digits and marks such as those of dates."""
    core = F.regexp_extract(F.coalesce(value, F.lit("")), r"[0-9][0-9./:\-]*", 0)
    return (core != "") & F.contains(F.regexp_replace(F.coalesce(text, F.lit("")), ",", ""), core)


def fuzzy_hit(value: Column, text: Column) -> Column:
    return F.contains(plain(text), plain(value))


def without_groups(subject: Column) -> Column:
    """A subject of parts between slashes, without the labels before them."""
    label = "(?i)^(?:" + "|".join(GROUPS) + ")"
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?U)^\s+|\s+$", ""), "/"), lambda p: F.regexp_replace(p, label, ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), " ")


def subject_in(subject: Column, text: Column) -> Column:
    """Whether a text in plain form has a subject, or of a long one its beginning; an empty subject is nowhere."""
    s = plain(without_groups(subject))
    begun = reduce(lambda a, n: a | ((F.char_length(s) >= n) & F.contains(text, F.left(s, F.lit(n)))), BEGINNINGS, F.lit(False))
    return (s != "") & (begun | F.contains(text, s))


def triple_mentioned(subject: Column, value: Column, text: Column) -> Column:
    """Whether a report mentions a fact: its subject, if it has one, and its value, a number by number_in."""
    body = plain(text)
    return F.when(F.coalesce(subject, F.lit("")) == "", True).otherwise(subject_in(subject, body)) & F.when(looks_numeric(value), number_in(value, text)).otherwise(F.contains(body, plain(value)))


def value_on_page(value: Column, body: Column) -> Column:
    """Whether a page has a claimed value: of a number (a double) one of its usual forms, or any number within a fiftieth of it."""
    low = F.lower(F.coalesce(body, F.lit("")))
    forms = [F.format_string("%.2f", value), F.format_string("%.1f", value), F.when(value == F.floor(value), F.floor(value).cast("long").cast("string")).otherwise(value.cast("string"))]
    close = F.exists(F.regexp_extract_all(low, F.lit(r"([0-9][0-9,]*\.?[0-9]*)"), F.lit(1)), lambda n: F.abs(F.regexp_replace(n, ",", "").try_cast("double") - value) / F.greatest(F.abs(value), F.lit(1e-6)) <= 0.02)
    return F.coalesce(reduce(lambda a, f: a | F.contains(low, f), forms, F.lit(False)) | ((value != 0) & close), F.lit(False))


def text_on_page(value: Column, body: Column) -> Column:
    """Whether a page has the first 40 characters of a claimed text."""
    v = F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", ""))
    return (v != "") & F.contains(F.lower(F.coalesce(body, F.lit(""))), F.left(v, F.lit(40)))


def _unquoted(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.lower(F.regexp_replace(bare, r"(?s)^(['\"])(.*)\1$", "$2"))


def string_score(answer: Column, exact: Column, must_include: Column) -> Column:
    """1.0 if the answer equals `exact` and has every phrase of `must_include`, quotes around and case aside, else 0.0; a null condition is none, null without either."""
    said = _unquoted(answer)
    right = F.coalesce(said == _unquoted(exact), F.lit(True)) if exact is None else F.when(exact.isNull(), True).otherwise(said == _unquoted(exact))
    whole = F.when(must_include.isNull(), True).otherwise(F.forall(must_include, lambda p: F.contains(said, _unquoted(p))))
    return F.when(exact.isNotNull() | must_include.isNotNull(), (right & whole).cast("double"))


def factoid_score(answer: Column, exact: Column, fuzzy: Column, must_include: Column, kinds: Column | None = None) -> Column:
    """A short answer against lists of references: 1.0 for any exact one; else by all fuzzy ones (half of them: 0.5); else half the share of those it must include, 1.0 for all.

    0.0 without references, and where `kinds` of evaluation are given and none is a string match.
    """
    listed = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    share = lambda c, hit: F.size(F.filter(c, hit)) / F.nullif(F.size(c), F.lit(0))
    fuzzily = share(listed(fuzzy), lambda r: fuzzy_hit(r, answer) | number_hit(r, answer))
    included = share(listed(must_include), lambda r: fuzzy_hit(r, answer))
    score = F.when(F.exists(listed(exact), lambda r: plain(r) == plain(answer)), 1.0).when(fuzzily.isNotNull(), F.when(fuzzily == 1, 1.0).when(fuzzily >= 0.5, 0.5).otherwise(0.0)).when(included.isNotNull(), F.when(included == 1, 1.0).otherwise(included * 0.5)).otherwise(0.0)
    return score if kinds is None else F.when((F.size(listed(kinds)) > 0) & ~F.array_contains(listed(kinds), "string_match"), 0.0).otherwise(score)


def json_object(answer: Column) -> Column:
    """The JSON object that an answer is, or that its first fenced block holds, as text; null if there is none."""
    is_object = lambda c: F.when(c.rlike(r"^\s*\{") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(is_object(answer), is_object(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)))


def at_path(document: Column, path: str) -> Column:
    """The value at a path such as a.b[0].c of a JSON text; null where it leads nowhere."""
    return F.get_json_object(document, f"$.{path}")


def expanded(document: Column, path: str) -> Column:
    """The paths that one with a [*] stands for, one for each element of the array; a path without it stands for itself."""
    if "[*]" not in path:
        return F.array(F.lit(path))
    before, after = path.split("[*]", 1)
    n = F.coalesce(F.json_array_length(at_path(document, before)), F.lit(0))
    places = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    return F.transform(places, lambda i: F.concat(F.lit(f"{before}["), i.cast("string"), F.lit(f"]{after}")))


def item_fits(item: Column, name_contains: list[str] = (), name_pattern: str | None = None, price: tuple[float, float] | None = None, least_rating: float | None = None, url_pattern: str | None = None) -> Column:
    """Whether an item, a struct of name, price, rating and url, meets every condition that is given; what isn't a number meets none on numbers."""
    name = F.coalesce(item["name"], F.lit(""))
    checks: list[Column] = [F.contains(F.lower(name), F.lit(n.lower())) for n in name_contains]
    if name_pattern:
        checks.append(name.rlike(f"(?i){name_pattern}"))
    if price:
        checks.append(F.coalesce(item["price"].between(*price), F.lit(False)))
    if least_rating is not None:
        checks.append(F.coalesce(item["rating"] >= least_rating, F.lit(False)))
    if url_pattern:
        checks.append(F.coalesce(item["url"], F.lit("")).rlike(url_pattern))
    return reduce(lambda a, c: a & c, checks, F.lit(True))


def report_fits(items: Column, conditions: list[Callable[[Column], Column]], facts: Column, expected: list[str]) -> Column:
    """Whether for every condition some item meets it, and every expected fact stands in the report's text."""
    met = reduce(lambda a, c: a & F.coalesce(F.exists(items, c), F.lit(False)), conditions, F.lit(True))
    return reduce(lambda a, f: a & F.contains(F.lower(F.coalesce(facts, F.lit(""))), F.lit(f.lower())), expected, met)


def fact_holds(predicate: Column, known: Column, claimed: Column) -> Column:
    """True, false or null for a claimed value of a fact against the known one: null where nothing is known or the predicate can't be checked.

    Prices, ratings and review counts agree within a twentieth, scores and comment counts within a fiftieth, product
    URLs by the known slug, names if either holds the other, f/ before a forum aside.
    """
    low = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", ""))
    number = lambda c: F.nullif(F.regexp_extract(F.regexp_replace(c, ",", ""), r"-?[0-9]+(?:\.[0-9]+)?", 0), F.lit("")).cast("double")
    near = lambda tolerance: F.coalesce(F.abs(number(known) - number(claimed)) / F.greatest(F.abs(number(known)), F.abs(number(claimed)), F.lit(1e-9)) <= tolerance, F.lit(False))
    a, b = low(known), low(claimed)
    core = lambda c, pattern: F.regexp_replace(c, pattern, "")
    either = F.contains(a, b) | F.contains(b, a)
    return (
        F.when(F.coalesce(known, F.lit("")) == "", F.lit(None).cast("boolean"))
        .when(predicate.isin("price", "rating", "review_count"), near(0.05))
        .when(predicate.isin("score", "comment_count"), near(0.02))
        .when(predicate == "product_url", F.contains(F.lower(F.coalesce(claimed, F.lit(""))), a))
        .when(predicate.isin("forum", "author", "post_title"), either | (core(a, "^f/") == core(b, "^/?f/")))
        .when(predicate.isin("brand", "category", "name"), either)
    )
