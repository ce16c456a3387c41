"""URLs as columns: canonical form, hosts, domains, kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that a URL in prose drags along, and the host whose article paths have several forms.
TRAIL = r"""[).,;:`'"\\!?>\]}]+$"""
ENCYCLOPEDIA = ["localhost:8090"]
ARTICLE = "/content/wikipedia_en_all_nopic/A/"
PARTS = r"^(?i)([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def trimmed(url: Column) -> Column:
    """Without punctuation behind."""
    return F.regexp_replace(url, TRAIL, "")


def part(url: Column, number: int) -> Column:
    """1 scheme, 2 host, 3 port, 4 path, 5 query; empty where absent."""
    return F.regexp_extract(url, PARTS, number)


def host(url: Column) -> Column:
    return F.lower(part(trimmed(url), 2))


def host_port(url: Column) -> Column:
    """Host and port, where there is one, as host:port."""
    port = F.regexp_replace(part(trimmed(url), 3), "^0+", "")
    return F.when(port == "", host(url)).otherwise(F.concat(host(url), F.lit(":"), port))


def host_in(url: Column, hosts: list[str]) -> Column:
    """Whether the URL's host is one of the hosts; with its port, where one names a port."""
    known = [h.lower() for h in hosts]
    inside = host_port(url).isin([h for h in known if ":" in h]) | host(url).isin([h for h in known if ":" not in h])
    return F.coalesce((host(url) != "") & inside, F.lit(False))


def domain(url: Column) -> Column:
    """The last two labels of the host, without www; for this machine host:port, as ports tell its sources apart."""
    labels = F.split(F.regexp_replace(host(url), r"^www\.", ""), r"\.")
    local = host(url).isin("localhost", "127.0.0.1") & (part(trimmed(url), 3) != "")
    return F.when(host(url) == "", "").when(local, host_port(url)).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))


def article_path(path: Column) -> Column:
    """A path with /A/ or else /wiki/: what follows the last such part, in lower case, under one name; other paths as they are."""
    article, wiki = F.regexp_extract(path, r"^.*/A/(.*)$", 1), F.regexp_extract(path, r"^.*/wiki/(.*)$", 1)
    named = lambda title: F.concat(F.lit(ARTICLE), F.lower(title))
    return F.when(path.rlike("/A/"), named(article)).when(path.rlike("/wiki/"), named(wiki)).otherwise(path)


def _query(query: Column) -> Column:
    """Parameters decoded, sorted and encoded again; one without a value gets an empty one."""
    decoded = lambda x: F.coalesce(F.try_url_decode(F.translate(x, "+", " ")), F.translate(x, "+", " "))
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), decoded(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")


def canonical(url: Column) -> Column:
    """One form for a URL's many: scheme and host in lower case, ports 80 and 443, user names, fragments and closing slashes
    gone, a root path as /, the query sorted, articles of the encyclopedia hosts under one path. Empty for what is no URL.
    """
    u = trimmed(F.trim(url))
    netloc = F.when(F.regexp_replace(part(u, 3), "^0+", "").isin("80", "443"), F.lower(part(u, 2))).otherwise(host_port(u))
    path = F.regexp_replace(part(u, 4), r";[^/]*$", "")
    path = F.when(path == "", "/").when(netloc.isin(ENCYCLOPEDIA), article_path(path)).otherwise(path)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/+$", ""))
    query = _query(part(u, 5))
    return F.when(part(u, 1) == "", "").otherwise(F.concat(F.lower(part(u, 1)), F.lit("://"), netloc, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def stem(url: Column) -> Column:
    """Host and the last two parts of the path."""
    parts = F.filter(F.split(part(trimmed(url), 4), "/"), lambda p: p != "")
    return F.concat_ws("/", host(url), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/"))


def slug_title(url: Column) -> Column:
    """The last part of the path as a title."""
    return F.initcap(F.translate(F.regexp_replace(F.regexp_extract(part(trimmed(url), 4), r"([^/]*)/*$", 1), r"\.html?$", ""), "-_", "  "))


def same_page(url: Column, reference: Column) -> Column:
    """Whether the bases agree and every parameter of the reference is among the URL's."""
    base = lambda u: F.concat(F.lower(part(u, 1)), F.lit("://"), F.lower(part(u, 2)), F.regexp_replace(part(u, 4), r"/+$", ""))
    params = lambda u: F.filter(F.split(part(u, 5), "&"), lambda p: p != "")
    return (base(url) == base(reference)) & (F.size(F.array_except(params(reference), params(url))) == 0)
