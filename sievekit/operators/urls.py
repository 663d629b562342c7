"""URL operators: routing, query-string parameters, worst parameter of a URL.

A request is read as a URL when it has a scheme and a host, or contains a
``?`` at all.  Its query string is split the way form decoders do it (``&``
only, first ``=`` separates, ``+`` is a space, percent escapes decoded,
blank values dropped) and kept as an ordered array of structs, because names
repeat and their order decides ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.rx import ALNUM_ONLY

ROUTE_INVALID, ROUTE_URL, ROUTE_RAW = "invalid", "url", "raw"

# scheme (letter first, then letters, digits, + . -), '//', non-empty host
_SCHEME_AND_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]"
# query component: after the first '?' that comes before any '#', up to '#'
_QUERY_PART = r"^[^?#]*\?([^#]*)"
# a '%' that does not start a two-digit hex escape is kept literally
_LONE_PERCENT = r"%(?![0-9a-fA-F]{2})"


def url_text(q: Column) -> Column:
    """What a URL parser reads: leading controls/spaces and tab/CR/LF removed."""
    return F.regexp_replace(F.regexp_replace(q, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def is_invalid(q: Column) -> Column:
    return q.isNull() | (q == "")


def route(q: Column, strict_url: bool = False) -> Column:
    """'invalid' (NULL or empty), 'url' or 'raw'.

    A text is a URL if it has scheme and host or, unless ``strict_url``,
    contains a ``?`` anywhere.
    """
    looks_like_url = url_text(q).rlike(_SCHEME_AND_HOST)
    if not strict_url:
        looks_like_url = looks_like_url | q.contains("?")
    return (F.when(is_invalid(q), F.lit(ROUTE_INVALID))
             .when(looks_like_url, F.lit(ROUTE_URL))
             .otherwise(F.lit(ROUTE_RAW)))


def query_string(q: Column) -> Column:
    return F.regexp_extract(url_text(q), _QUERY_PART, 1)


def form_decode(x: Column) -> Column:
    """'+' → space and %XX decoding; malformed escapes stay as they are."""
    return F.url_decode(F.regexp_replace(x, _LONE_PERCENT, "%25"))


def url_params(q: Column) -> Column:
    """ARRAY<STRUCT<pos INT, name STRING, value STRING>> in query-string order.

    ``pos`` is the index of the ``&``-separated field; fields without ``=`` or
    with an empty value are dropped, as form decoders do by default.
    """
    fields = F.transform(F.split(query_string(q), "&"),
                         lambda x, i: F.struct(i.alias("pos"), x.alias("raw")))
    kept = F.filter(fields, lambda e: (F.locate("=", e["raw"]) > 0)
                    & (F.length(e["raw"]) > F.locate("=", e["raw"])))
    return F.transform(kept, lambda e: F.struct(
        e["pos"].alias("pos"),
        form_decode(F.substring_index(e["raw"], "=", 1)).alias("name"),
        form_decode(F.regexp_replace(e["raw"], r"^[^=]*=", "")).alias("value"),
    ))


def is_alnum(value: Column) -> Column:
    """Values made only of letters and digits are never scored."""
    return value.rlike(ALNUM_ONLY)


def worst_item(items: Column) -> Column:
    """STRUCT<prob, name, value> of the first highest score of a row's items.

    ``items`` is ARRAY<STRUCT<pos, name, value, prob>>. Names are visited in
    order of first appearance, the values of a name in order, and only a
    strictly higher score replaces the worst so far, starting from 0.0. The
    items are sorted by (name, pos) and folded once; each carries the place of
    its name. Nothing leaves the row, so no key is needed and nothing shuffles.
    """
    ordered = F.array_sort(F.transform(items, lambda x: F.struct(
        x["name"].alias("name"), x["pos"].alias("pos"), x["value"].alias("value"),
        F.coalesce(x["prob"], F.lit(0.0)).alias("prob"))))
    nobody, nowhere = F.lit(None).cast("string"), F.lit(-1)
    start = F.struct(F.lit(0.0).alias("prob"), nowhere.alias("at"), nobody.alias("name"), nobody.alias("value"),
                     nobody.alias("last"), nowhere.alias("last_at"))

    def step(best, x):
        at = F.when(best["last"] == x["name"], best["last_at"]).otherwise(x["pos"])
        tie = (x["prob"] == best["prob"]) & (best["prob"] > 0) & (at < best["at"])
        better = (x["prob"] > best["prob"]) | tie
        pick = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct(pick(x["prob"], best["prob"]).alias("prob"), pick(at, best["at"]).alias("at"),
                        pick(x["name"], best["name"]).alias("name"), pick(x["value"], best["value"]).alias("value"),
                        x["name"].alias("last"), at.alias("last_at"))

    return F.aggregate(ordered, start, step, lambda b: F.struct(b["prob"], b["name"], b["value"]))
