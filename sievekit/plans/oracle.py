"""DuckDB SQL for the correctness oracle.

The driver runs each registered Spark query and a SQL statement over the same
parquet tables in DuckDB and compares the results. This module renders those
statements: the shared relations (templates, requests, logs, ...) as CTEs and
the feature rows of ``functions.features`` as SQL expressions. It is test
support only; no Spark job uses it.
"""

from __future__ import annotations

from ..functions.features import FEATURES, Feature
from ..functions.patterns import ATTACK_PATTERNS
from ..functions.rx import ALNUM_ONLY, NON_SPACE, duckdb_ci, portable
from ..sources.tables import N_MODELS, N_SEEDS, URL_BASE
from ..sources.templates import template_rows


def s(text: str) -> str:
    """SQL string literal (DuckDB keeps backslashes as they are)."""
    return "'" + text.replace("'", "''") + "'"


# --- shared relations --------------------------------------------------------

def templates_cte() -> str:
    rows = ",\n    ".join(f"({tid}, {s(p)}, {s(e)}, {lab})" for tid, p, e, lab in template_rows())
    return f"templates(tid, payload, payload_enc, label) AS (VALUES\n    {rows})"


def requests_cte() -> str:
    n = len(template_rows())
    base = f"{s(URL_BASE)} || e.event_type"
    uid = "'?uid=' || CAST(e.user_id AS VARCHAR)"
    return f"""requests AS (
  SELECT e.event_id AS request_id, e.ts AS created_at, e.user_id,
         '/' || e.event_type AS endpoint, t.tid,
         CASE WHEN e.event_id % 3 = 2 THEN 0 ELSE t.label END AS label,
         CASE WHEN e.event_id % 3 = 0 THEN t.payload
              WHEN e.event_id % 3 = 1 THEN {base} || {uid} || '&q=' || t.payload_enc
              WHEN e.event_id % 2 = 0 THEN {base} || {uid} || '&page=' || CAST(e.event_id % 9 AS VARCHAR)
              ELSE {base} END AS query
  FROM events e JOIN templates t ON t.tid = e.event_id % {n})"""


def query_logs_cte() -> str:
    return """query_logs AS (
  SELECT request_id AS id, query, p > 0.5 AS is_sql_injection,
         CASE WHEN p > 0.5 THEN p ELSE 1 - p END AS confidence,
         1 - p AS probability_safe, p AS probability_injection,
         '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(request_id % 256 AS VARCHAR) AS ip_address,
         'agent-' || CAST(user_id % 7 AS VARCHAR) AS user_agent, endpoint, created_at
  FROM (SELECT r.*, CAST((request_id * 7919) % 1000 AS DOUBLE) / 1000.0 AS p FROM requests r) x)"""


def feedback_logs_cte() -> str:
    return """feedback_logs AS (
  SELECT id, CASE WHEN id % 5 = 0 THEN id + 1000000000 ELSE id END AS query_log_id,
         id % 2 = 0 AS actual_label, is_sql_injection AS predicted_label,
         CASE id % 3 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'false_negative' ELSE 'correct' END AS feedback_type,
         CASE WHEN id % 2 = 0 THEN 'seen: ' || endpoint END AS user_feedback,
         created_at + INTERVAL 1 HOUR AS created_at
  FROM query_logs WHERE id % 17 = 0)"""


def predictions_cte() -> str:
    models = ", ".join(f"({i})" for i in range(N_MODELS))
    return f"""predictions AS (
  SELECT r.request_id, m.model_id, r.label,
         CASE WHEN r.request_id % (14 - m.model_id % 4) = 0 THEN 1 - r.label ELSE r.label END AS prediction
  FROM requests r CROSS JOIN (VALUES {models}) AS m(model_id))"""


def seed_predictions_cte() -> str:
    models = ", ".join(f"({i})" for i in range(N_MODELS))
    seeds = ", ".join(f"({i})" for i in range(N_SEEDS))
    return f"""seed_predictions AS (
  SELECT sd.seed, m.model_id, r.request_id, r.label,
         CASE WHEN m.model_id = 4 THEN NULL
              WHEN (r.request_id + sd.seed * 3) % (11 + m.model_id) = 0 THEN 1 - r.label
              ELSE r.label END AS prediction,
         CASE WHEN m.model_id = 4 THEN 'fit failed' END AS error
  FROM requests r CROSS JOIN (VALUES {seeds}) AS sd(seed) CROSS JOIN (VALUES {models}) AS m(model_id)
  WHERE m.model_id <> 3 OR sd.seed = 0)"""


_CTES = {
    "templates": (templates_cte, ()),
    "requests": (requests_cte, ("templates",)),
    "query_logs": (query_logs_cte, ("requests",)),
    "feedback_logs": (feedback_logs_cte, ("query_logs",)),
    "predictions": (predictions_cte, ("requests",)),
    "seed_predictions": (seed_predictions_cte, ("requests",)),
}


def with_(*names: str, extra: list[str] | None = None) -> str:
    """WITH clause holding ``names`` and their dependencies, in order."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for dep in _CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [_CTES[n][0]() for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


# --- feature expressions -------------------------------------------------------

def text_forms(q: str) -> dict[str, str]:
    # DuckDB upper-cases 'ß' to 'ẞ'; Python and Java spell it 'SS'.
    return {"q": q, "qu": f"upper(replace({q}, 'ß', 'ss'))", "ql": f"lower({q})"}


def lit_count(src: str, seq: str) -> str:
    body = f"(length({src}) - length(replace({src}, {s(seq)}, '')))"
    return body if len(seq) == 1 else f"({body} // {len(seq)})"


def pattern_count_sql(q: str) -> str:
    terms = [f"CAST(regexp_matches({q}, {s(duckdb_ci(portable(p)))}) AS BIGINT)"
             for p in ATTACK_PATTERNS]
    return "(" + " + ".join(terms) + ")"


def pattern_hits_sql(q: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({q}, {s(duckdb_ci(portable(p)))}) THEN '{i + 1}' END"
                      for i, p in enumerate(ATTACK_PATTERNS))
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"


def feature_sql(f: Feature, forms: dict[str, str]) -> str:
    src = forms[f.source]
    k = f.kind
    if k == "length":
        e = f"length({src})"
    elif k == "words":
        e = f"len(regexp_extract_all({src}, {s(NON_SPACE + '+')}))"
    elif k == "parts":
        e = f"({lit_count(src, f.arg)} + 1)"
    elif k == "count":
        e = lit_count(src, f.arg)
    elif k == "patterns":
        e = pattern_count_sql(src)
    elif k == "ratio":
        e = (f"CASE WHEN length({src}) > 0 THEN CAST({lit_count(src, f.arg)} AS DOUBLE) / length({src}) "
             f"ELSE 0.0 END")
        return e
    elif k in ("has", "has_all"):
        op = " OR " if k == "has" else " AND "
        e = "(" + op.join(f"contains({src}, {s(x)})" for x in f.arg) + ")"
    elif k == "search":
        e = f"regexp_matches({src}, {s(portable(f.arg))})"
    elif k == "findall":
        e = f"len(regexp_extract_all({src}, {s(portable(f.arg))}))"
    elif k == "multi":
        e = f"(contains({src}, ';') AND {lit_count(src, ';')} + 1 > 2)"
    elif k == "depth":
        raise ValueError("depth is rendered by depth_cte")
    else:  # pragma: no cover
        raise ValueError(k)
    return f"CAST({e} AS BIGINT)"


def depth_cte(name: str, source: str, key: str, text: str) -> str:
    """Highest running '(' minus ')' balance per row, never below 0."""
    return f"""{name} AS (
  SELECT b.{key}, greatest(0, coalesce(max(b.bal), 0)) AS max_nested_depth
  FROM (SELECT {key}, sum(CASE WHEN ch = '(' THEN 1 ELSE -1 END)
                     OVER (PARTITION BY {key} ORDER BY i) AS bal
        FROM (SELECT {key}, unnest(string_split(pp, '')) AS ch, generate_subscripts(string_split(pp, ''), 1) AS i
              FROM (SELECT {key}, regexp_replace({text}, '[^()]', '', 'g') AS pp FROM {source})
              WHERE pp <> '')) b
  GROUP BY b.{key})"""


def features_select(q: str, features: list[Feature], round_ratios: int | None = 6) -> list[str]:
    forms = text_forms(q)
    out = []
    for f in features:
        if f.kind == "depth":
            out.append("coalesce(dp.max_nested_depth, 0) AS max_nested_depth")
            continue
        e = feature_sql(f, forms)
        if f.is_ratio and round_ratios is not None:
            e = f"round({e}, {round_ratios})"
        out.append(f"{e} AS {f.name}")
    return out


# --- URL expressions -----------------------------------------------------------

def url_text_sql(q: str) -> str:
    return f"regexp_replace(regexp_replace({q}, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g')"


def route_sql(q: str) -> str:
    return (f"CASE WHEN {q} IS NULL OR {q} = '' THEN 'invalid' "
            f"WHEN regexp_matches({url_text_sql(q)}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]') "
            f"OR contains({q}, '?') THEN 'url' ELSE 'raw' END")


def decode_sql(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def params_cte(name: str, source: str, key: str, q: str) -> str:
    """Every query-string field with a name/value split, in order (pos 0-based)."""
    qs = f"regexp_extract({url_text_sql(q)}, '^[^?#]*\\?([^#]*)', 1)"
    return f"""{name} AS (
  SELECT {key}, pos, {decode_sql("split_part(raw, '=', 1)")} AS name,
         {decode_sql("substr(raw, strpos(raw, '=') + 1)")} AS value
  FROM (SELECT {key}, unnest(string_split(qs, '&')) AS raw,
               generate_subscripts(string_split(qs, '&'), 1) - 1 AS pos
        FROM (SELECT {key}, {qs} AS qs FROM {source}))
  WHERE strpos(raw, '=') > 0 AND length(raw) > strpos(raw, '='))"""


def alnum_sql(x: str) -> str:
    return f"regexp_matches({x}, {s(ALNUM_ONLY)})"


def rule_prob_sql(x: str) -> str:
    c = f"CAST({pattern_count_sql(x)} AS DOUBLE)"
    return f"({c} / ({c} + 1.5))"


__all__ = ["with_", "features_select", "depth_cte", "params_cte", "route_sql", "alnum_sql",
           "rule_prob_sql", "pattern_count_sql", "pattern_hits_sql", "s", "FEATURES"]
