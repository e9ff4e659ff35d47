"""URL column functions, built on regular expressions that never raise on a bad address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrove.functions.bind import bind

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
HOST_PATTERN = _AUTHORITY + r"(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)"
ORIGIN_PATTERN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)"
PATH_PATTERN = r"(?s)" + _AUTHORITY + r"[^/?#]*([^?#]*)"
QUERY_PATTERN = r"(?s)^[^?#]*\?([^#]*)"
FRAGMENT_PATTERN = r"(?s)#(.*)"
UNSAFE_CHAR = r"[^\x21-\x7E]"


def hostname(url: Column) -> Column:
    """Lower-cased host; NULL when the address has none."""
    return F.lower(F.nullif(F.regexp_extract(url, HOST_PATTERN, 1), F.lit("")))


def percent_encode(text: Column) -> Column:
    """Encode what an address may not hold (non-ASCII, spaces, controls); leave the rest."""

    def encode(t: Column) -> Column:
        chars = F.transform(
            F.split(t, ""),
            lambda c: F.when(c == " ", "%20").when(c.rlike(UNSAFE_CHAR), F.url_encode(c)).otherwise(c),
        )
        return F.when(t.rlike(UNSAFE_CHAR), F.array_join(chars, "")).otherwise(t)

    return bind(text, encode)


def url_path(url: Column) -> Column:
    return F.coalesce(F.nullif(percent_encode(F.regexp_extract(url, PATH_PATTERN, 1)), F.lit("")), F.lit("/"))


def has_query_or_fragment(url: Column) -> Column:
    """True when the address has a non-empty query or a non-empty fragment."""
    return (F.regexp_extract(url, QUERY_PATTERN, 1) != "") | (F.regexp_extract(url, FRAGMENT_PATTERN, 1) != "")


def site_key(host: Column) -> Column:
    """The last two labels of a host, a leading ``www.`` aside."""
    return F.substring_index(F.regexp_replace(host, r"^www\.", ""), ".", -2)


def same_site(host_a: Column, host_b: Column) -> Column:
    return site_key(host_a) == site_key(host_b)


def breadcrumb(url: Column) -> Column:
    """``host › a › b``: at most the first three parts of the path, at most 50 characters.

    A part that names a script or HTML file ends the text; a part that would make it too
    long is shown as an ellipsis and ends it too.
    """
    parts = F.slice(F.split(url_path(url), "/"), 1, 3)
    start = F.struct(hostname(url).alias("text"), F.lit(False).alias("done"))

    def step(acc: Column, part: Column) -> Column:
        longer = F.when(part == "", acc["text"]).otherwise(F.concat(acc["text"], F.lit(" › "), part))
        ends = acc["done"] | part.rlike(r"\.(html|htm|php|asp)$")
        too_long = F.length(longer) > 50
        text = (
            F.when(ends, acc["text"])
            .when(too_long, F.concat(acc["text"], F.lit(" › ...")))
            .otherwise(longer)
        )
        return F.struct(text.alias("text"), (ends | too_long).alias("done"))

    return F.aggregate(parts, start, step, lambda acc: acc["text"])


def _squeeze_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` parts of an absolute path."""

    def step(acc: Column, part: Column) -> Column:
        shorter = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(part == ".", acc).when(part == "..", shorter).otherwise(F.concat(acc, F.array(part)))

    def squeeze(p: Column) -> Column:
        parts = F.split(F.substring(p, 2, 1 << 30), "/")
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        tail = F.when(p.rlike(r"/\.\.?$"), "/").otherwise("")
        squeezed = F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), tail), "^//", "/")
        return F.when(p.rlike(r"/\.\.?(/|$)"), squeezed).otherwise(p)

    return bind(path, squeeze)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page ``base``; NULL for anything but http(s)."""

    def absolute(h: Column) -> Column:
        origin = F.regexp_extract(base, ORIGIN_PATTERN, 1)
        folder = F.regexp_replace(url_path(base), "[^/]*$", "")
        return (
            F.when(h.rlike(r"(?i)^https?://"), h)
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
            .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when((h == "") | h.startswith("#"), F.regexp_replace(base, "#.*$", ""))
            .when(h.startswith("?"), F.concat(origin, url_path(base), h))
            .otherwise(F.concat(origin, folder, h))
        )

    return normalize_url(bind(F.trim(href), absolute))


def normalize_url(url: Column) -> Column:
    """Key under which a link counts as visited: lower-case scheme and host, resolved path,
    sorted query, no fragment."""

    def sorted_query(query: Column) -> Column:
        ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
        return F.when(query == "", "").otherwise(F.concat(F.lit("?"), ordered))

    def normalize(u: Column) -> Column:
        origin = F.nullif(F.lower(F.regexp_extract(u, ORIGIN_PATTERN, 1)), F.lit(""))
        query = bind(percent_encode(F.regexp_extract(u, QUERY_PATTERN, 1)), sorted_query)
        return F.concat(origin, _squeeze_dots(url_path(u)), query)

    return bind(url, normalize)
