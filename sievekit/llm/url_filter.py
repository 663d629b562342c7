"""URL filtering: host/path rules first, then a weighted vocabulary.

The vocabulary is one Aho-Corasick automaton over strict and soft terms. A
term counts only where it is bounded by characters other than ASCII letters
and digits. One strict term, or soft terms whose distinct weights reach the
limit, reject the URL.

Defined results: a NULL url, or one without ``://``, has empty host and path
and no rule; NULL is allowed, other text is still judged by the vocabulary.
Repeated rows are judged each on its own; rule ties (equal length) go to the
rule listed first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# ---------------------------------------------------------------------------
# Production rules and terms (term, weight); 10 rejects at once.
# ---------------------------------------------------------------------------
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
TERMS = (
    ("porn", 10), ("porno", 10), ("xxx", 10), ("camgirls", 10), ("escorts", 10), ("hentai", 10),
    ("warez", 10), ("phishing", 10), ("malware", 10), ("viagra", 10),
    ("adult", 5), ("sex", 5), ("nude", 5), ("casino", 5), ("poker", 5), ("betting", 5),
    ("torrent", 5), ("crack", 5), ("keygen", 5), ("lottery", 5), ("payday", 5), ("pills", 5),
)
REJECT_AT = 10

SCHEMA = ("page_id long, host string, path string, rule string, verdict string, "
          "strict_hits long, soft_hits long")

_HOST_PATH = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_TO_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    m = _HOST_PATH.search(url) if url else None
    return (m[1].translate(_TO_LOWER), m[2]) if m else ("", "")


class Rules:
    """Longest rule whose host the URL is in and whose path it starts with."""

    def __init__(self, rules):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.by_host.setdefault(host, []).append(("/" + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = (None, None)
        at = 0
        while True:
            for prefix, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(prefix) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            at = host.find(".", at) + 1
            if not at:
                return best


class Vocabulary:
    """Distinct strict and soft terms of a URL, each bounded on both sides."""

    def __init__(self, terms, reject_at: int):
        self.reject_at = reject_at
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms:
            self.automaton.add_word(term, (term, weight))
        self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[int, int, int]:
        """(strict terms, soft terms, total weight), distinct terms only."""
        low = url.translate(_TO_LOWER)
        found = {}
        for end, (term, weight) in self.automaton.iter(low):
            start = end - len(term)
            if not (_letter(low, start) or _letter(low, end + 1)):
                found[term] = weight
        strict = sum(w >= self.reject_at for w in found.values())
        return strict, len(found) - strict, sum(found.values())


def _letter(s: str, i: int) -> bool:
    return 0 <= i < len(s) and (s[i].isascii() and s[i].isalnum())


@lru_cache(maxsize=8)
def _compiled(rules, terms, reject_at):
    return Rules(rules), Vocabulary(terms, reject_at)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
                terms=TERMS, reject_at: int = REJECT_AT) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict and the hits."""

    def judge(batches):
        rule_set, vocabulary = _compiled(rules, terms, reject_at)
        for batch in batches:
            for ids, urls in slices(batch, ["page_id", "url"], 8192):
                rows = []
                for url in urls:
                    host, path = split_url(url)
                    rule, verdict = rule_set.match(host, path) if host else (None, None)
                    strict, soft, weight = vocabulary.hits(url) if url else (0, 0, 0)
                    if verdict is None:
                        verdict = "block" if weight >= reject_at else "allow"
                    rows.append((host, path, rule, verdict, strict, soft))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in cols[:4]),
                     *(pa.array(c, pa.int64()) for c in cols[4:])],
                    names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    narrow = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"))
    return narrow.mapInArrow(judge, SCHEMA)


def oracle_sql(rules=RULES, terms=TERMS, reject_at: int = REJECT_AT) -> str:
    """DuckDB twin over ``pages``."""

    def bounded(term):
        return f"regexp_matches(lower_url, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INT"

    values = ", ".join(f"({i}, '{v}', '{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')"
                       for i, (v, r) in enumerate(rules))
    strict = " + ".join(bounded(t) for t, w in terms if w >= reject_at)
    soft = " + ".join(bounded(t) for t, w in terms if w < reject_at)
    weight = " + ".join(f"{w} * {bounded(t)}" for t, w in terms)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH r(pos, verdict, rule, rhost, rpath) AS (VALUES {values}),
p AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS lower_url,
        translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), '{upper}', '{lower}') AS host,
        coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT page_id, host, path, {strict} AS strict_hits, {soft} AS soft_hits, {weight} AS weight,
        (SELECT struct_pack(rule := r.rule, verdict := r.verdict) FROM r
         WHERE host <> '' AND (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
         ORDER BY length(r.rule) DESC, pos LIMIT 1) AS m FROM p)
SELECT page_id, host, path, m.rule AS rule,
  coalesce(m.verdict, CASE WHEN weight >= {reject_at} THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(strict_hits AS BIGINT) AS strict_hits, CAST(soft_hits AS BIGINT) AS soft_hits FROM h"""
