"""Registered queries: one Spark job per operator, each with its SQL twin.

``QUERIES[name](spark, sf_dir)`` builds the Spark DataFrame; ``ORACLE[name]``
is the DuckDB statement over the same parquet tables that must give the same
rows. Every query reads whole tables (or relations Spark derives from them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import feature_group, featurize
from ..functions.patterns import pattern_count, pattern_hits
from ..operators import urls
from ..operators.score import RuleScorer, screen
from ..session import spread
from ..sources import tables as T
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- §2.2 / §2.3 features ------------------------------------------------------

def _feature_query(name: str, table: str, key: str, text: str, lo: int, hi: int):
    feats = feature_group(lo, hi)
    needs_depth = any(f.kind == "depth" for f in feats)
    if table == "requests":
        src_sql, ctes = "requests", ["requests"]
    else:
        src_sql, ctes = table, []
    extra = [O.depth_cte("dp", src_sql, key, text)] if needs_depth else []
    join = f" LEFT JOIN dp ON dp.{key} = t.{key}" if needs_depth else ""
    cols = ",\n  ".join(O.features_select(f"t.{text}", feats, round_ratios=None))
    sql = O.with_(*ctes, extra=extra) + f"SELECT t.{key},\n  {cols}\nFROM {src_sql} t{join}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = T.requests(spark, sf_dir) if table == "requests" else T.table(spark, sf_dir, table)
        return featurize(src.select(key, text), col=text, features=feats, keep=[key])

    register(name, sql)(run)


_feature_query("feat_length_and_chars", "documents", "doc_id", "text", 0, 21)
_feature_query("feat_keywords", "documents", "doc_id", "text", 22, 71)
_feature_query("feat_ratios_flags", "pages", "page_id", "html", 73, 93)
_feature_query("feat_regex_flags", "requests", "request_id", "query", 94, 116)
_feature_query("feat_markup_nosql_bool", "requests", "request_id", "query", 117, 134)
_feature_query("feat_depth", "pages", "page_id", "html", 135, 135)
_feature_query("feat_complexity_strings", "requests", "request_id", "query", 136, 143)
_feature_query("featurize_all", "requests", "request_id", "query", 0, 143)
_feature_query("featurize_documents", "documents", "doc_id", "text", 0, 143)


@register("attack_patterns", O.with_("requests") + f"""SELECT request_id,
  {O.pattern_count_sql('query')} AS pattern_match_count,
  {O.pattern_hits_sql('query')} AS pattern_hits
FROM requests""")
def attack_patterns(spark, sf_dir):
    r = T.requests(spark, sf_dir)
    return r.select("request_id", pattern_count(F.col("query")).alias("pattern_match_count"),
                    F.array_join(pattern_hits(F.col("query")).cast("array<string>"), ",")
                    .alias("pattern_hits"))


@register("page_attack_patterns", f"""SELECT page_id,
  {O.pattern_count_sql('html')} AS pattern_match_count,
  {O.pattern_hits_sql('html')} AS pattern_hits
FROM pages""")
def page_attack_patterns(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", pattern_count(F.col("html")).alias("pattern_match_count"),
                    F.array_join(pattern_hits(F.col("html")).cast("array<string>"), ",")
                    .alias("pattern_hits"))


# --- §2.4 / §2.5 URL operators -----------------------------------------------------

@register("url_route", O.with_("requests") + f"""SELECT request_id, {O.route_sql('query')} AS route,
  CASE WHEN {O.route_sql('query')} = 'url'
       THEN regexp_extract({O.url_text_sql('query')}, '^[^?#]*\\?([^#]*)', 1) END AS query_string
FROM requests""")
def url_route(spark, sf_dir):
    r = T.requests(spark, sf_dir)
    rt = urls.route(F.col("query"))
    return r.select("request_id", rt.alias("route"),
                    F.when(rt == "url", urls.query_string(F.col("query"))).alias("query_string"))


@register("page_url_route", f"""SELECT page_id, {O.route_sql('url')} AS route,
  regexp_extract({O.url_text_sql('url')}, '^[^?#]*\\?([^#]*)', 1) AS query_string
FROM pages""")
def page_url_route(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", urls.route(F.col("url")).alias("route"),
                    urls.query_string(F.col("url")).alias("query_string"))


@register("url_params", O.with_("requests", extra=[O.params_cte("pr", "requests", "request_id", "query")])
          + f"""SELECT request_id, pos AS param_pos, name AS param, value,
  {O.alnum_sql('value')} AS skipped
FROM pr""")
def url_params(spark, sf_dir):
    r = T.requests(spark, sf_dir)
    ex = r.select("request_id", F.posexplode(urls.url_params(F.col("query"))).alias("_i", "_p"))
    return ex.select("request_id", F.col("_p.pos").alias("param_pos"), F.col("_p.name").alias("param"),
                     F.col("_p.value").alias("value"), urls.is_alnum(F.col("_p.value")).alias("skipped"))


@register("page_url_params", O.with_(extra=[O.params_cte("pr", "pages", "page_id", "url")])
          + f"""SELECT page_id, pos AS param_pos, name AS param, value,
  {O.alnum_sql('value')} AS skipped
FROM pr""")
def page_url_params(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages")
    ex = p.select("page_id", F.posexplode(urls.url_params(F.col("url"))).alias("_i", "_p"))
    return ex.select("page_id", F.col("_p.pos").alias("param_pos"), F.col("_p.name").alias("param"),
                     F.col("_p.value").alias("value"), urls.is_alnum(F.col("_p.value")).alias("skipped"))


# --- §2.6 screening ---------------------------------------------------------------------

def _worst_ctes() -> list[str]:
    return [
        "urlreq AS (SELECT request_id, query FROM requests WHERE " + O.route_sql("query") + " = 'url')",
        O.params_cte("pr", "urlreq", "request_id", "query"),
        f"""sc AS (SELECT request_id, pos, name, value, {O.rule_prob_sql('value')} AS p,
                   min(pos) OVER (PARTITION BY request_id, name) AS name_pos
            FROM pr WHERE NOT {O.alnum_sql('value')})""",
        """win AS (SELECT request_id, name, value, p FROM (
              SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p DESC, name_pos, pos) AS rn
              FROM sc) WHERE rn = 1)""",
        """cnt AS (SELECT u.request_id, count(pr.pos) AS n_params FROM urlreq u
              LEFT JOIN pr ON pr.request_id = u.request_id GROUP BY u.request_id)""",
        """nsc AS (SELECT request_id, count(*) AS params_scored FROM sc GROUP BY request_id)""",
        """urlv AS (SELECT u.request_id, cnt.n_params, coalesce(nsc.params_scored, 0) AS params_scored,
                coalesce(win.p, 0.0) AS p, win.name, win.value
         FROM urlreq u JOIN cnt ON cnt.request_id = u.request_id
         LEFT JOIN nsc ON nsc.request_id = u.request_id
         LEFT JOIN win ON win.request_id = u.request_id)""",
    ]


def verdict_ctes() -> list[str]:
    """CTEs ending in ``verdicts``: rule-scored verdict of every request."""
    return _worst_ctes() + [
        f"""raw AS (SELECT request_id, {O.rule_prob_sql('query')} AS p FROM requests
        WHERE {O.route_sql('query')} = 'raw')""",
        """verdicts AS (
SELECT request_id, 'raw' AS route, p > 0.5 AS is_sql_injection,
       CASE WHEN p > 0.5 THEN p ELSE 1 - p END AS confidence, 1 - p AS probability_safe,
       p AS probability_injection, CAST(NULL AS VARCHAR) AS vulnerable_parameter,
       CAST(NULL AS VARCHAR) AS suspicious_value, CAST(NULL AS BIGINT) AS params_scored,
       CAST(NULL AS VARCHAR) AS note, CAST(NULL AS VARCHAR) AS error
FROM raw
UNION ALL
SELECT request_id, 'url', CASE WHEN n_params = 0 THEN false ELSE p > 0.5 END,
       CASE WHEN n_params = 0 THEN 0.99 WHEN p > 0.5 THEN p ELSE 1 - p END,
       CASE WHEN n_params = 0 THEN 0.99 ELSE 1 - p END,
       CASE WHEN n_params = 0 THEN 1 - 0.99 ELSE p END,
       CASE WHEN p > 0 THEN name END, CASE WHEN p > 0 THEN value END, params_scored,
       CASE WHEN n_params = 0 THEN 'No parameters found in URL' END, NULL
FROM urlv
UNION ALL
SELECT request_id, 'invalid', false, 0.0, NULL, NULL, NULL, NULL, NULL, NULL, 'Invalid query input'
FROM requests WHERE query IS NULL OR query = '')""",
    ]


@register("url_worst_param", O.with_("requests", extra=_worst_ctes()) + """SELECT request_id, n_params,
  params_scored, p AS max_prob,
  CASE WHEN p > 0 THEN name END AS vulnerable_parameter,
  CASE WHEN p > 0 THEN value END AS suspicious_value
FROM urlv""")
def url_worst_param(spark, sf_dir):
    r = T.requests(spark, sf_dir)
    u = r.where(urls.route(F.col("query")) == "url").select("request_id", "query")
    u = u.withColumn("_params", urls.url_params(F.col("query"))).select(
        "request_id", F.size("_params").cast("long").alias("n_params"), F.lit(None).cast("string").alias("_raw"),
        F.filter("_params", lambda p: ~urls.is_alnum(p["value"])).alias("_items"))
    w = RuleScorer().attach(u).withColumn("_w", urls.worst_item(F.col("_scored")))
    return w.select("request_id", "n_params", F.size("_scored").cast("long").alias("params_scored"),
                    F.col("_w.prob").alias("max_prob"),
                    F.when(F.col("_w.prob") > 0, F.col("_w.name")).alias("vulnerable_parameter"),
                    F.when(F.col("_w.prob") > 0, F.col("_w.value")).alias("suspicious_value"))


def rule_verdicts(spark: SparkSession, sf_dir: str, carry=("request_id",)) -> DataFrame:
    r = T.requests(spark, sf_dir)
    v = screen(r, key="request_id", col="query", scorer=RuleScorer(), carry=list(carry))
    return v.withColumn("params_scored", F.col("params_scored").cast("long"))


@register("screen_verdicts", O.with_("requests", extra=verdict_ctes()) + "SELECT * FROM verdicts")
def screen_verdicts(spark, sf_dir):
    return rule_verdicts(spark, sf_dir)


@register("batch_counters", O.with_("requests", extra=verdict_ctes())
          + """SELECT count(*) AS total_queries, count_if(is_sql_injection) AS injections_detected
FROM verdicts""")
def batch_counters_q(spark, sf_dir):
    from ..operators.score import batch_counters
    return batch_counters(rule_verdicts(spark, sf_dir))


def _odd_requests(spark, sf_dir):
    """Requests whose keys repeat (every text three times under one of 97 keys,
    or under NULL), and rows with NULL or empty text."""
    r = T.requests(spark, sf_dir)
    rid = F.col("request_id")
    key = F.when(rid % 5 > 0, rid % 97)
    copies = r.select(key.alias("key"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("copy"), rid, "query")
    text = F.when((rid % 11 == 0) & (F.col("copy") == 1), F.lit("")).when(
        (rid % 11 == 0) & (F.col("copy") == 2), F.lit(None)).otherwise(F.col("query"))
    return copies.select("key", "copy", "request_id", text.alias("query"))


#: The twin numbers its rows and judges each on its own.
_ODD_SQL = """SELECT request_id * 3 + copy AS request_id, CASE WHEN r.request_id % 5 > 0 THEN r.request_id % 97 END AS key,
    copy, r.request_id AS original, CASE WHEN r.request_id % 11 = 0 AND copy = 1 THEN ''
      WHEN r.request_id % 11 = 0 AND copy = 2 THEN NULL ELSE r.query END AS query
  FROM base r CROSS JOIN (VALUES (0), (1), (2)) AS c(copy)"""


def _odd_sql(tail: str) -> str:
    """The requests relation replaced by the repeated one."""
    first = O.with_("requests").replace("requests AS (", "base AS (", 1).rstrip()
    return first + ",\nrequests AS (" + _ODD_SQL + "),\n" + ",\n".join(verdict_ctes()) + "\n" + tail


@register("screen_duplicates", _odd_sql("""SELECT r.key, r.copy, r.original AS request_id, v.* EXCLUDE (request_id)
FROM requests r JOIN verdicts v ON v.request_id = r.request_id"""))
def screen_duplicates(spark, sf_dir):
    """One verdict per row, whatever the key."""
    return screen(_odd_requests(spark, sf_dir), key="key", col="query", carry=["key", "copy", "request_id"])


@register("invalid_guard", _odd_sql("""SELECT r.query IS NULL AS missing, v.route, v.is_sql_injection, v.confidence, v.error, count(*) AS n
FROM requests r JOIN verdicts v ON v.request_id = r.request_id WHERE v.route = 'invalid' GROUP BY ALL"""))
def invalid_guard(spark, sf_dir):
    v = screen(_odd_requests(spark, sf_dir), key="key", col="query", carry=["query"])
    return v.where(F.col("route") == "invalid").groupBy(
        F.col("query").isNull().alias("missing"), "route", "is_sql_injection", "confidence", "error").agg(
        F.count(F.lit(1)).alias("n"))


@register("strict_url_routes", O.with_("requests") + f"""SELECT CASE WHEN query IS NULL OR query = '' THEN 'invalid'
  WHEN regexp_matches({O.url_text_sql('query')}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]') THEN 'url' ELSE 'raw' END AS route,
  count(*) AS n FROM requests GROUP BY ALL""")
def strict_url_routes(spark, sf_dir):
    """Routes when only texts with scheme and host count as URLs."""
    return screen(T.requests(spark, sf_dir), strict_url=True, carry=["request_id"]).groupBy("route").agg(
        F.count(F.lit(1)).alias("n"))


# --- §2.8 triage, §2.1 K5/K6, P7 -------------------------------------------------------

from ..operators import triage as TR  # noqa: E402
from ..operators import logs as LG  # noqa: E402
from ..operators import store as ST  # noqa: E402
from ..operators import evaluation as EV  # noqa: E402
from ..operators.split import stratified_split  # noqa: E402
from ..sources import corpus as CO  # noqa: E402
from ..functions.features import FEATURE_NAMES, FEATURES  # noqa: E402


def _status_sql(inj: str, p: str) -> str:
    return (f"CASE WHEN coalesce({inj}, false) THEN 'vulnerable' "
            f"WHEN coalesce(CASE WHEN NOT isnan({p}) THEN {p} END, 0.0) >= 0.35 THEN 'warning' ELSE 'safe' END")


@register("screen_status_counts", O.with_("requests", extra=verdict_ctes())
          + f"""SELECT route, {_status_sql('is_sql_injection', 'probability_injection')} AS status,
  count(*) AS n
FROM verdicts GROUP BY ALL""")
def screen_status_counts(spark, sf_dir):
    v = rule_verdicts(spark, sf_dir)
    st = TR.status(F.col("is_sql_injection"), F.col("probability_injection"))
    return v.groupBy("route", st.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def _fixed_sql(x: str, digits: int) -> str:
    """``x`` >= 0 with some decimals: all digits of the binary value are printed, the next one decides."""
    full = f"printf('%.80f', {x})"
    point = f"instr({full}, '.')"
    n = (f"(replace(substr({full}, 1, {point} + {digits}), '.', '')::BIGINT"
         f" + CASE WHEN substr({full}, {point} + {digits + 1}, 1) >= '5' THEN 1 ELSE 0 END)")
    return f"({n} // {10 ** digits}) || '.' || lpad(({n} % {10 ** digits})::VARCHAR, {digits}, '0')"


def _triage_sql_select(src: str = "query_logs") -> str:
    conf_used = ("CASE WHEN confidence IS NOT NULL AND NOT isnan(confidence) AND confidence <> 0 THEN confidence "
                 "WHEN probability_injection IS NOT NULL AND NOT isnan(probability_injection) "
                 "AND probability_injection <> 0 THEN probability_injection ELSE 0.0 END")
    pct = f"CAST(floor(({conf_used}) * 100 + 0.5) AS BIGINT)"
    st = _status_sql("is_sql_injection", "probability_injection")
    return f"""SELECT id, query AS url, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS scan_date,
  {st} AS status,
  CASE {st} WHEN 'vulnerable' THEN 'High' WHEN 'warning' THEN 'Medium' ELSE 'Low' END AS severity,
  CAST(CASE {st} WHEN 'vulnerable' THEN 3 WHEN 'warning' THEN 1 ELSE 0 END AS BIGINT) AS issues_found,
  CASE {st}
    WHEN 'vulnerable' THEN 'The model detected SQL injection characteristics. Confidence: ' || {pct} || '%.'
    WHEN 'warning' THEN 'Suspicious patterns detected (Injection probability '
      || {_fixed_sql('coalesce(probability_injection, 0.0) * 100', 1)} || '%). Manual review recommended.'
    ELSE 'No SQL injection characteristics detected. Confidence: ' || {pct} || '%.' END AS description,
  CASE WHEN coalesce(is_sql_injection, false) THEN 'SQL Injection'
       WHEN {st} = 'warning' THEN 'Potential SQL Injection' ELSE 'None' END AS vulnerability_type,
  confidence, probability_safe, probability_injection, is_sql_injection, id AS log_id
FROM {src}"""


def _records(spark, sf_dir):
    return TR.triage(T.query_logs(spark, sf_dir))


TRIAGE_SQL = O.with_("query_logs") + _triage_sql_select()


@register("triage_status", TRIAGE_SQL)
def triage_status(spark, sf_dir):
    return _records(spark, sf_dir)


@register("triage_filter_warning", O.with_("query_logs", extra=[
    "rec AS (" + _triage_sql_select() + ")"]) + "SELECT * FROM rec WHERE lower(status) = 'warning'")
def triage_filter_warning(spark, sf_dir):
    return TR.filter_status(_records(spark, sf_dir), "warning")


def _pct_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'N/A' ELSE {_fixed_sql(f'{x} * 100', 2)} || '%' END"


@register("export_csv_rows", O.with_("query_logs", extra=["rec AS (" + _triage_sql_select() + ")"])
          + f"""SELECT url AS "URL", status AS "Status", issues_found AS "Issues Found",
  severity AS "Severity", {_pct_sql('confidence')} AS "Confidence",
  {_pct_sql('probability_injection')} AS "Injection Probability",
  scan_date AS "Scan Date", log_id AS "Log ID"
FROM rec""")
def export_csv_rows(spark, sf_dir):
    return TR.export_lines(_records(spark, sf_dir))


def _report_sql() -> str:
    parts = [O.s(TR.REPORT_TITLE), O.s("=" * 30), "''", "'URL: ' || url", "'Scan Date: ' || scan_date",
             "'Status: ' || status", "'Severity: ' || severity",
             "'Issues Found: ' || CAST(issues_found AS VARCHAR)",
             f"'Confidence: ' || {_pct_sql('confidence')}",
             f"'Injection Probability: ' || {_pct_sql('probability_injection')}",
             "'Log ID: ' || coalesce(CAST(log_id AS VARCHAR), 'N/A')",
             "''", "'VULNERABILITY DETAILS:'", "description", "''", "'RECOMMENDATIONS:'",
             *[O.s(r) for r in TR.RECOMMENDATIONS], "''", "'Report Generated: ' || scan_date"]
    return (O.with_("query_logs", extra=["rec AS (" + _triage_sql_select() + ")"])
            + f"SELECT id, concat_ws(chr(10), {', '.join(parts)}) AS report FROM rec")


@register("report_text", _report_sql())
def report_text(spark, sf_dir):
    # Stated as generated at the scan, so that a rerun gives the same text.
    return TR.report_text(_records(spark, sf_dir), generated_at=F.col("scan_date").cast("timestamp"))


def _html_escape_sql(x: str) -> str:
    out = x
    for ch, rep in TR.HTML_ESCAPES:
        out = f"replace({out}, {O.s(ch)}, {O.s(rep)})"
    return out


@register("html_escape", O.with_("requests")
          + f"SELECT request_id, {_html_escape_sql('query')} AS query_html FROM requests")
def html_escape(spark, sf_dir):
    r = T.requests(spark, sf_dir)
    return r.select("request_id", TR.html_escape(F.col("query")).alias("query_html"))


@register("scan_summary", O.with_("query_logs", extra=["rec AS (" + _triage_sql_select() + ")"])
          + """SELECT max(scan_date) AS last_scan, count(*) AS urls_scanned,
  count_if(is_sql_injection) AS injections_detected FROM rec""")
def scan_summary(spark, sf_dir):
    return TR.scan_summary(_records(spark, sf_dir))


@register("export_roundtrip", O.with_("query_logs", extra=["rec AS (" + _triage_sql_select() + ")"])
          + f"""SELECT url AS "URL", status AS "Status", CAST(issues_found AS VARCHAR) AS "Issues Found",
  severity AS "Severity", {_pct_sql('confidence')} AS "Confidence",
  {_pct_sql('probability_injection')} AS "Injection Probability",
  scan_date AS "Scan Date", CAST(log_id AS VARCHAR) AS "Log ID"
FROM rec""")
def export_roundtrip(spark, sf_dir):
    """The CSV export, written and read again: quotes in URLs survive."""
    path = _shared(spark, "export")
    TR.write_export(_records(spark, sf_dir), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


@register("report_roundtrip", _report_sql())
def report_roundtrip(spark, sf_dir):
    """The reports, written as JSON records and read again."""
    path = _shared(spark, "reports")
    TR.write_reports(_records(spark, sf_dir), path, generated_at=F.col("scan_date").cast("timestamp"))
    return spark.read.schema("id LONG, report STRING").json(path)


# --- the log store: verdicts of this engine, written by day and read again ---------------

def _shared(spark, name: str) -> str:
    from ..session import ensure_checkpoint_dir
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _store_logs(spark, sf_dir) -> DataFrame:
    """Screen all requests, append the verdicts by day, return the stored log."""
    path = _shared(spark, "query_logs")
    v = screen(T.requests(spark, sf_dir), carry=["request_id", "query", "user_id", "endpoint", "created_at"])
    ST.append_batch(LG.verdict_log(v), path, "screened")
    return ST.read_log(spark, path).drop("batch")


def _store_feedback(spark, logs: DataFrame) -> DataFrame:
    """Feedback on every 17th log, appended by day and read again."""
    path = _shared(spark, "feedback_logs")
    ST.append_batch(T.feedback_from_logs(logs), path, "every-17th")
    return ST.read_log(spark, path).drop("batch")


#: The log relation with verdicts in place of the stand-in probability.
_VERDICT_LOG_SQL = """query_logs AS (
  SELECT r.request_id AS id, r.query, v.is_sql_injection, v.confidence, v.probability_safe, v.probability_injection,
         '10.0.' || CAST(r.user_id % 256 AS VARCHAR) || '.' || CAST(r.request_id % 256 AS VARCHAR) AS ip_address,
         'agent-' || CAST(r.user_id % 7 AS VARCHAR) AS user_agent, r.endpoint, r.created_at
  FROM requests r JOIN verdicts v ON v.request_id = r.request_id)"""


def _verdict_log_with(*extra: str) -> str:
    return O.with_("requests", extra=[*verdict_ctes(), _VERDICT_LOG_SQL, *extra])


@register("log_roundtrip", _verdict_log_with() + """SELECT * FROM query_logs
WHERE created_at >= (SELECT max(created_at) - INTERVAL 7 DAY FROM query_logs)""")
def log_roundtrip(spark, sf_dir):
    """The last seven days of the stored log; only their days are read."""
    logs = _store_logs(spark, sf_dir)
    return LG.last_days(logs, 7, LG.newest(logs)).drop("log_date")


@register("verdict_statistics", _verdict_log_with(O.feedback_logs_cte(), "anchor AS (SELECT max(created_at) - INTERVAL 7 DAY AS since FROM query_logs)")
          + """SELECT
  (SELECT count(*) FROM query_logs, anchor WHERE created_at >= since) AS total_queries,
  (SELECT count_if(is_sql_injection) FROM query_logs, anchor WHERE created_at >= since) AS sql_injections_detected,
  (SELECT count_if(feedback_type = 'false_positive') FROM feedback_logs, anchor WHERE created_at >= since) AS false_positives,
  (SELECT count_if(feedback_type = 'false_negative') FROM feedback_logs, anchor WHERE created_at >= since) AS false_negatives,
  7 AS days""")
def verdict_statistics(spark, sf_dir):
    logs = _store_logs(spark, sf_dir)
    return LG.statistics(logs, _store_feedback(spark, logs.drop("log_date")), days=7)


@register("append_retried", O.with_("query_logs") + "SELECT id, is_sql_injection, created_at FROM query_logs WHERE id % 3 <> 2")
def append_retried(spark, sf_dir):
    """Three batches: one appended twice, one rewritten after a broken attempt,
    one that broke off before its commit and stays invisible."""
    path, logs = _shared(spark, "retried_logs"), T.query_logs(spark, sf_dir)
    part = lambda k: logs.where(F.col("id") % 3 == k)
    for _ in range(2):
        ST.append_batch(part(0), path, "first")
    ST.stage_batch(part(1).where("id % 2 = 0"), path, "second")
    ST.append_batch(part(1), path, "second")
    ST.stage_batch(part(2), path, "third")
    return ST.read_log(spark, path).select("id", "is_sql_injection", "created_at")


@register("verdict_triage", _verdict_log_with("rec AS (" + _triage_sql_select() + ")")
          + "SELECT status, severity, issues_found, vulnerability_type, description, count(*) AS n FROM rec GROUP BY ALL")
def verdict_triage(spark, sf_dir):
    return TR.triage(_store_logs(spark, sf_dir)).groupBy(
        "status", "severity", "issues_found", "vulnerability_type", "description").agg(F.count(F.lit(1)).alias("n"))


@register("verdict_feedback_corpus", _verdict_log_with(O.feedback_logs_cte()) + """SELECT l.id AS query_log_id, l.query,
  CAST(x.actual_label AS INTEGER) AS label
FROM (SELECT query_log_id, arg_max(actual_label, (created_at, id)) AS actual_label
      FROM feedback_logs GROUP BY query_log_id) x
JOIN query_logs l ON l.id = x.query_log_id""")
def verdict_feedback_corpus(spark, sf_dir):
    logs = _store_logs(spark, sf_dir).drop("log_date")
    return LG.feedback_corpus(_store_feedback(spark, logs).drop("log_date"), logs)


@register("daily_table", _verdict_log_with(O.feedback_logs_cte(),
    """l AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS total_queries,
                 count_if(is_sql_injection) AS sql_injections_detected FROM query_logs GROUP BY 1)""",
    """f AS (SELECT CAST(created_at AS DATE) AS date,
                 count_if(feedback_type = 'false_positive') AS false_positives,
                 count_if(feedback_type = 'false_negative') AS false_negatives FROM feedback_logs GROUP BY 1)""")
          + """SELECT coalesce(l.date, f.date) AS date, coalesce(total_queries, 0) AS total_queries,
  coalesce(sql_injections_detected, 0) AS sql_injections_detected,
  coalesce(false_positives, 0) AS false_positives, coalesce(false_negatives, 0) AS false_negatives
FROM l FULL OUTER JOIN f ON l.date = f.date""")
def daily_table(spark, sf_dir):
    """The daily table, written twice: the second write replaces its days."""
    logs = _store_logs(spark, sf_dir).drop("log_date")
    daily, path = LG.daily_statistics(logs, _store_feedback(spark, logs).drop("log_date")), _shared(spark, "daily")
    LG.write_daily_statistics(daily, path)
    LG.write_daily_statistics(daily, path)
    return spark.read.parquet(path).drop("updated_at")


# --- §2.9 A1-A4, §2.10 O1/O2, §2.7 joins, K3 --------------------------------------------

STATS_SQL = O.with_("feedback_logs", extra=[
    "anchor AS (SELECT max(created_at) - INTERVAL 7 DAY AS since FROM query_logs)"]) + """SELECT
  (SELECT count(*) FROM query_logs, anchor WHERE created_at >= since) AS total_queries,
  (SELECT count_if(is_sql_injection) FROM query_logs, anchor WHERE created_at >= since) AS sql_injections_detected,
  (SELECT count_if(feedback_type = 'false_positive') FROM feedback_logs, anchor WHERE created_at >= since) AS false_positives,
  (SELECT count_if(feedback_type = 'false_negative') FROM feedback_logs, anchor WHERE created_at >= since) AS false_negatives,
  7 AS days"""


@register("stats_last_n_days", STATS_SQL)
def stats_last_n_days(spark, sf_dir):
    return LG.statistics(T.query_logs(spark, sf_dir), T.feedback_logs(spark, sf_dir), days=7)


@register("daily_statistics", O.with_("feedback_logs", extra=[
    """l AS (SELECT CAST(created_at AS DATE) AS date, count(*) AS total_queries,
                 count_if(is_sql_injection) AS sql_injections_detected FROM query_logs GROUP BY 1)""",
    """f AS (SELECT CAST(created_at AS DATE) AS date,
                 count_if(feedback_type = 'false_positive') AS false_positives,
                 count_if(feedback_type = 'false_negative') AS false_negatives FROM feedback_logs GROUP BY 1)"""])
          + """SELECT coalesce(l.date, f.date) AS date, coalesce(total_queries, 0) AS total_queries,
  coalesce(sql_injections_detected, 0) AS sql_injections_detected,
  coalesce(false_positives, 0) AS false_positives, coalesce(false_negatives, 0) AS false_negatives
FROM l FULL OUTER JOIN f ON l.date = f.date""")
def daily_statistics(spark, sf_dir):
    return LG.daily_statistics(T.query_logs(spark, sf_dir), T.feedback_logs(spark, sf_dir))


@register("daily_touched", f"""WITH daily AS ({ORACLE['daily_statistics']}), edge AS (
  SELECT max(date) - 2 AS since FROM daily WHERE total_queries > 0)
SELECT daily.*, date >= since AS recounted FROM daily, edge""")
def daily_touched(spark, sf_dir):
    """Daily counters after a second batch that holds the last days only: those
    days are read and written again, the others stay as the first run left them."""
    logs, feedback, daily = (_shared(spark, n) for n in ("daily_logs", "daily_feedback", "daily"))
    rows, marks = T.query_logs(spark, sf_dir), T.feedback_logs(spark, sf_dir)
    since = rows.select(F.date_sub(F.max(F.to_date("created_at")), 2)).first()[0]
    day = F.to_date("created_at")
    ST.append_batch(rows.where(day < since), logs, "early")
    ST.append_batch(marks.where(day < since), feedback, "early")
    ST.roll_up(spark, logs, feedback, daily)
    ST.append_batch(rows.where(day >= since), logs, "late")
    ST.append_batch(marks.where(day >= since), feedback, "late")
    again = ST.roll_up(spark, logs, feedback, daily)
    return spark.read.parquet(f"{daily}/data").select(
        "date", "total_queries", "sql_injections_detected", "false_positives", "false_negatives",
        F.col("date").isin(again).alias("recounted"))


@register("recent_logs", O.with_("query_logs")
          + "SELECT * FROM query_logs ORDER BY created_at DESC, id DESC LIMIT 100")
def recent_logs(spark, sf_dir):
    return LG.recent(T.query_logs(spark, sf_dir), 100)


@register("recent_injections", O.with_("query_logs")
          + "SELECT * FROM query_logs WHERE is_sql_injection ORDER BY created_at DESC, id DESC LIMIT 100")
def recent_injections(spark, sf_dir):
    return LG.recent(T.query_logs(spark, sf_dir), 100, is_injection=True)


@register("recent_logs_count", O.with_("query_logs") + """SELECT count(*) AS n_logs FROM
  (SELECT id FROM query_logs WHERE NOT is_sql_injection ORDER BY created_at DESC, id DESC LIMIT 100)""")
def recent_logs_count(spark, sf_dir):
    page = LG.recent(T.query_logs(spark, sf_dir), 100, is_injection=False)
    return page.agg(F.count(F.lit(1)).alias("n_logs"))


def _feedback_join_sql(lookback: int | None) -> str:
    logs = ("query_logs" if lookback is None else
            f"(SELECT * FROM query_logs ORDER BY created_at DESC, id DESC LIMIT {lookback})")
    exp = ("CASE WHEN l.is_sql_injection AND NOT f.actual_label THEN 'false_positive' "
           "WHEN NOT l.is_sql_injection AND f.actual_label THEN 'false_negative' ELSE 'correct' END")
    return O.with_("feedback_logs") + f"""SELECT f.id, f.query_log_id, l.id IS NOT NULL AS log_found,
  f.actual_label, l.is_sql_injection AS predicted_label, f.feedback_type,
  CASE WHEN l.id IS NOT NULL THEN {exp} END AS expected_type,
  CASE WHEN l.id IS NOT NULL THEN {exp} = f.feedback_type END AS type_consistent,
  f.created_at
FROM feedback_logs f LEFT JOIN {logs} l ON f.query_log_id = l.id"""


@register("feedback_join", _feedback_join_sql(None))
def feedback_join(spark, sf_dir):
    return LG.feedback_join(T.feedback_logs(spark, sf_dir), T.query_logs(spark, sf_dir))


@register("feedback_join_bucketed", _feedback_join_sql(None))
def feedback_join_bucketed(spark, sf_dir):
    """The same against a copy of the log bucketed by id: the log is not shuffled."""
    path = _shared(spark, "logs_by_id")
    logs = ST.by_id(T.query_logs(spark, sf_dir), f"logs_{path.rpartition('-')[2]}", path, buckets=8)
    return LG.feedback_join(T.feedback_logs(spark, sf_dir), logs)


@register("feedback_lookback", _feedback_join_sql(LG.FEEDBACK_LOOKBACK))
def feedback_lookback(spark, sf_dir):
    return LG.feedback_join(T.feedback_logs(spark, sf_dir), T.query_logs(spark, sf_dir),
                            lookback=LG.FEEDBACK_LOOKBACK)


@register("feedback_orphans", O.with_("feedback_logs") + """SELECT f.* FROM feedback_logs f
WHERE NOT EXISTS (SELECT 1 FROM query_logs l WHERE l.id = f.query_log_id)""")
def feedback_orphans(spark, sf_dir):
    return LG.feedback_orphans(T.feedback_logs(spark, sf_dir), T.query_logs(spark, sf_dir))


@register("feedback_corpus", O.with_("feedback_logs") + """SELECT l.id AS query_log_id, l.query,
  CAST(x.actual_label AS INTEGER) AS label
FROM (SELECT query_log_id, arg_max(actual_label, (created_at, id)) AS actual_label
      FROM feedback_logs GROUP BY query_log_id) x
JOIN query_logs l ON l.id = x.query_log_id""")
def feedback_corpus(spark, sf_dir):
    return LG.feedback_corpus(T.feedback_logs(spark, sf_dir), T.query_logs(spark, sf_dir))


@register("blocked_requests", O.with_("query_logs") + """SELECT id, query, ip_address, user_agent, endpoint,
  created_at AS blocked_at, 'SQL injection detected' AS reason
FROM query_logs WHERE is_sql_injection""")
def blocked_requests(spark, sf_dir):
    return LG.blocked_requests(T.query_logs(spark, sf_dir))


# --- §2.9 A5-A9, §2.11 M1, §2.1 S2-S4 --------------------------------------------------

@register("class_balance", O.with_("requests") + "SELECT label, count(*) AS n FROM requests GROUP BY label")
def class_balance(spark, sf_dir):
    return EV.class_balance(T.requests(spark, sf_dir))


METRICS_SQL_BODY = """SELECT model_id, tp, fp, fn, tn,
  CASE WHEN tp + fp + fn + tn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) ELSE 0.0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1_score
FROM (SELECT model_id, count_if(label = 1 AND prediction = 1) AS tp, count_if(label <> 1 AND prediction = 1) AS fp,
             count_if(label = 1 AND prediction <> 1) AS fn, count_if(label <> 1 AND prediction <> 1) AS tn
      FROM predictions GROUP BY model_id)"""


@register("model_metrics", O.with_("predictions") + METRICS_SQL_BODY)
def model_metrics(spark, sf_dir):
    return EV.binary_metrics(T.predictions(spark, sf_dir))


@register("best_model", O.with_("predictions", extra=["m AS (" + METRICS_SQL_BODY + ")"])
          + """SELECT model_id, f1_score FROM m ORDER BY f1_score DESC, model_id LIMIT 1""")
def best_model(spark, sf_dir):
    return EV.best_model(EV.binary_metrics(T.predictions(spark, sf_dir)))


@register("seed_summary", O.with_("seed_predictions", extra=[
    """acc AS (SELECT seed, model_id,
                CASE WHEN count(prediction) > 0 THEN CAST(count_if(prediction = label) AS DOUBLE) / count(prediction) END AS accuracy,
                max(error) AS error
              FROM seed_predictions GROUP BY seed, model_id)"""]) + """SELECT model_id,
  round(avg(accuracy), 9) AS mean_accuracy,
  round(CASE WHEN count(accuracy) = 1 THEN 0.0 WHEN count(accuracy) > 1 THEN stddev_samp(accuracy) END, 9) AS stdev_accuracy,
  count(accuracy) AS n_seeds, count_if(error IS NOT NULL) AS n_failed
FROM acc GROUP BY model_id""")
def seed_summary(spark, sf_dir):
    return EV.seed_summary(EV.seed_accuracy(T.seed_predictions(spark, sf_dir)))


def _scaler_sql() -> str:
    cols = O.features_select("t.query", FEATURES, round_ratios=None)
    dbl = [f"CAST({c.rsplit(' AS ', 1)[0]} AS DOUBLE) AS {c.rsplit(' AS ', 1)[1]}" for c in cols]
    return (O.with_("requests", extra=[O.depth_cte("dp", "requests", "request_id", "query"),
                                       "fx AS (SELECT " + ",\n".join(dbl)
                                       + " FROM requests t LEFT JOIN dp ON dp.request_id = t.request_id)"])
            + """SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_pop,
  round(stddev_samp(value), 6) AS std_samp
FROM (UNPIVOT fx ON COLUMNS(*) INTO NAME feature VALUE value) GROUP BY feature""")


@register("scaler_stats", _scaler_sql())
def scaler_stats(spark, sf_dir):
    fx = featurize(T.requests(spark, sf_dir).select("request_id", "query"), keep=[])
    return EV.scaler_statistics(fx, FEATURE_NAMES, digits=6)


SPLIT_SQL_BODY = """SELECT request_id, label, rn <= k AS is_test FROM (
  SELECT request_id, label,
         row_number() OVER (PARTITION BY label ORDER BY md5(CAST(request_id AS VARCHAR) || '|42')) AS rn,
         ceil(count(*) OVER (PARTITION BY label) * 0.2) AS k
  FROM requests)"""


@register("stratified_split", O.with_("requests") + SPLIT_SQL_BODY)
def stratified_split_q(spark, sf_dir):
    r = T.requests(spark, sf_dir).select("request_id", "label")
    return stratified_split(r, "request_id", "label", test_size=0.2, seed=42)


def _draw_sql(k: str, seed: int, tag: str) -> str:
    return f"CAST(('0x' || substr(md5(CAST({k} AS VARCHAR) || '|{seed}|{tag}'), 1, 8)) AS BIGINT)"


TURN_KEY_SQL = "conv_id || '-' || turn"


def _augment_sql(seed: int = 42) -> str:
    from ..sources.templates import ATTACK_TEMPLATES
    att = "[" + ", ".join(O.s(x) for x in ATTACK_TEMPLATES) + "]"
    d = {t: _draw_sql("key", seed, t) for t in ("label", "attack", "vary", "num")}
    return f"""SELECT key,
  CASE WHEN is_attack AND vary < 3 THEN text || ' ' || {att}[ai + 1]
       WHEN is_attack THEN {att}[ai + 1] || ' ' || text
       WHEN vary < 5 THEN replace(text, '1', CAST(num AS VARCHAR)) ELSE text END AS query,
  CASE WHEN is_attack THEN 1 ELSE 0 END AS label, CAST(CASE WHEN is_attack THEN ai ELSE -1 END AS INTEGER) AS tid
FROM (SELECT key, text, {d['label']} % 2 = 1 AS is_attack, {d['attack']} % {len(ATTACK_TEMPLATES)} AS ai,
        {d['vary']} % 10 AS vary, {d['num']} % 99 + 1 AS num
      FROM (SELECT {TURN_KEY_SQL} AS key, coalesce(text, '') AS text FROM conversations))"""


def _turn_corpus(spark, sf_dir):
    return CO.augment(T.table(spark, sf_dir, "conversations"), F.concat_ws("-", "conv_id", "turn"), "text", seed=42)


@register("augment_corpus", _augment_sql())
def augment_corpus(spark, sf_dir):
    """Every conversation turn as a safe or an attacked sample."""
    return _turn_corpus(spark, sf_dir)


@register("shuffle_corpus", f"SELECT key, label, {_draw_sql('key', 42, 'order')} AS draw FROM ({_augment_sql()})")
def shuffle_corpus(spark, sf_dir):
    return CO.shuffle(_turn_corpus(spark, sf_dir).select("key", "label"), "key", seed=42)


@register("template_group_split", f"""SELECT tid, label, count(*) AS n, CASE WHEN label = 1 THEN
  ceil((SELECT count(DISTINCT tid) FROM ({_augment_sql()}) WHERE label = 1) * 0.2) >= row_number() OVER (
    PARTITION BY label ORDER BY md5(CAST(tid AS VARCHAR) || '|42')) ELSE false END AS is_test
FROM ({_augment_sql()}) GROUP BY tid, label""")
def template_group_split(spark, sf_dir):
    """Split by template: the samples of one attack template stay on one side."""
    corpus = _turn_corpus(spark, sf_dir)
    attacks = corpus.where("label = 1").select("tid", "label").distinct()
    sides = stratified_split(attacks, "tid", "label", test_size=0.2, seed=42).select("tid", "is_test")
    return (corpus.groupBy("tid", "label").agg(F.count(F.lit(1)).alias("n"))
            .join(F.broadcast(sides), "tid", "left")  # one row per template
            .withColumn("is_test", F.coalesce("is_test", F.lit(False))))


#: Spellings written into the labelled file; the last two are not accepted.
WRITTEN_SPELLINGS = {0: [*CO.SAFE_SPELLINGS, "benign"], 1: [*CO.ATTACK_SPELLINGS, "SQL_INJECTION"]}


def _spelled_label_sql() -> str:
    arrays = {k: "[" + ", ".join(O.s(x) for x in v) + "]" for k, v in WRITTEN_SPELLINGS.items()}
    n = len(WRITTEN_SPELLINGS[0])
    return (O.with_("requests") + f"""SELECT request_id, query, raw_label,
  CASE WHEN raw_label IN ({', '.join(O.s(x) for x in CO.SAFE_SPELLINGS)}) THEN 0
       WHEN raw_label IN ({', '.join(O.s(x) for x in CO.ATTACK_SPELLINGS)}) THEN 1 END AS label
FROM (SELECT request_id, query, CASE WHEN label = 1 THEN {arrays[1]}[request_id % {n} + 1]
                              ELSE {arrays[0]}[request_id % {n} + 1] END AS raw_label FROM requests)""")


def _spelled(spark, sf_dir):
    """Requests as a training file has them: other column names, spelled labels."""
    r = T.requests(spark, sf_dir)
    pick = lambda k: F.element_at(F.array(*[F.lit(x) for x in WRITTEN_SPELLINGS[k]]),
                                  (F.col("request_id") % len(WRITTEN_SPELLINGS[0]) + 1).cast("int"))
    return r.select("request_id", F.col("query").alias("Payload"),
                    F.when(F.col("label") == 1, pick(1)).otherwise(pick(0)).alias("Class"))


@register("label_normalise", f"SELECT query, label, count(*) AS n FROM ({_spelled_label_sql()}) WHERE label IS NOT NULL GROUP BY ALL")
def label_normalise(spark, sf_dir):
    """The accepted rows of the file, by text and label."""
    good, _ = CO.labelled(_spelled(spark, sf_dir))
    return good.groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))


@register("reject_labels", f"SELECT raw_label, count(*) AS n FROM ({_spelled_label_sql()}) WHERE label IS NULL GROUP BY ALL")
def reject_labels(spark, sf_dir):
    """Rows whose label has no accepted spelling, set aside."""
    _, bad = CO.labelled(_spelled(spark, sf_dir))
    return bad.groupBy("raw_label").agg(F.count(F.lit(1)).alias("n"))


_RESOLVED = {"labels": (None, None), "conversations": ("text", None), "documents": ("text", None),
             "events": (None, None)}


@register("column_resolve", " UNION ALL ".join(
    f"SELECT '{t}' AS name, {O.s(q) if q else 'CAST(NULL AS VARCHAR)'} AS text_column, "
    f"{O.s(lab) if lab else 'CAST(NULL AS VARCHAR)'} AS label_column, count(*) AS n FROM {t}"
    for t, (q, lab) in _RESOLVED.items())
    + " UNION ALL SELECT 'training file', 'Payload', 'Class', count(*) FROM events")
def column_resolve(spark, sf_dir):
    """Text and label column that each table resolves to, and its rows."""
    tables = [(t, T.table(spark, sf_dir, t)) for t in _RESOLVED] + [("training file", _spelled(spark, sf_dir))]
    out = []
    for name, df in tables:
        q, lab = CO.resolve_columns(df.columns)
        out.append(df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("name"), F.lit(q).cast("string").alias("text_column"),
            F.lit(lab).cast("string").alias("label_column"), "n"))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


# --- §2.11 machine learning ---------------------------------------------------------------
# Fitted models have no SQL twin; the facts that any right run must show have.

F1_FLOOR = 0.9


def _split_facts_sql(model: str) -> str:
    return O.with_("requests") + f"""SELECT '{model}' AS model, count_if(NOT is_test) AS n_train,
  count_if(is_test) AS n_test, count_if(is_test AND label = 1) AS attacks, count_if(is_test AND label = 0) AS safe,
  true AS f1_reached
FROM ({SPLIT_SQL_BODY})"""


def _train_eval(learner: str):
    def run(spark, sf_dir):
        from . import ml
        corpus = T.requests(spark, sf_dir).select("request_id", "query", "label")
        metrics, _models, _data = ml.train_evaluate(spark, corpus, "request_id", learners=[learner])
        return metrics.select("model", "n_train", "n_test", (F.col("tp") + F.col("fn")).alias("attacks"),
                              (F.col("tn") + F.col("fp")).alias("safe"),
                              (F.col("f1_score") >= F1_FLOOR).alias("f1_reached"))
    return run


for _name, _learner in [("train_eval_logistic_regression", "LogisticRegression"),
                        ("train_eval_random_forest", "RandomForest"),
                        ("train_eval_svm_rff", "SVM_rff"),
                        ("train_eval_gradient_boosting", "GradientBoosting"),
                        ("train_eval_xgboost_gbt", "XGBoost_gbt")]:
    register(_name, _split_facts_sql(_learner))(_train_eval(_learner))


@register("screen_with_model", O.with_("requests", extra=verdict_ctes()) + """SELECT r.request_id, v.route, r.label,
  v.params_scored, v.note, true AS consistent
FROM requests r JOIN verdicts v ON v.request_id = r.request_id""")
def screen_with_model(spark, sf_dir):
    """Fit logistic regression on the training side of requests, then screen
    every request with it (raw texts whole, URLs per parameter)."""
    from . import ml
    from ..operators.score import ModelScorer
    corpus = T.requests(spark, sf_dir).select("request_id", "query", "label")
    _m, models, _d = ml.train_evaluate(spark, corpus, "request_id", learners=["LogisticRegression"])
    v = screen(spread(T.requests(spark, sf_dir)), key="request_id", col="query",
               scorer=ModelScorer(models["LogisticRegression"]), carry=["request_id", "label"])
    p, inj = F.col("probability_injection"), F.col("is_sql_injection")
    consistent = (p.between(0, 1) & (inj == (p > 0.5)) & (F.col("probability_safe") == 1 - p)
                  & (F.col("vulnerable_parameter").isNull() | (F.col("route") == "url")))
    return v.select("request_id", "route", "label", "params_scored", "note", consistent.alias("consistent"))


@register("trained_from_file", O.with_("requests", extra=verdict_ctes()) + f"""SELECT v.route, count(*) AS n,
  sum(v.params_scored)::BIGINT AS params_scored, true AS consistent, 'LogisticRegression' AS model_name,
  {len(FEATURE_NAMES)} AS n_features, 1 AS n_candidates
FROM requests r JOIN verdicts v ON v.request_id = r.request_id GROUP BY v.route""")
def trained_from_file(spark, sf_dir):
    """Write a labelled CSV file, train from it, publish, load the published
    model and screen every request with it."""
    from . import ml
    from ..operators.score import ModelScorer
    base = _shared(spark, "training")
    spelled = _spelled(spark, sf_dir).where(~F.col("Class").isin([v[-1] for v in WRITTEN_SPELLINGS.values()]))
    (spelled.select("Payload", "Class").write.option("header", True).option("quoteAll", True).option("escape", '"')
     .csv(f"{base}/labelled"))
    metrics = ml.train_job(spark, f"{base}/model", path=f"{base}/labelled", learners=["LogisticRegression"])
    model, info = ml.load(spark, f"{base}/model")
    v = screen(spread(T.requests(spark, sf_dir)), scorer=ModelScorer(model))
    p, inj = F.col("probability_injection"), F.col("is_sql_injection")
    return v.groupBy("route").agg(
        F.count(F.lit(1)).alias("n"), F.sum("params_scored").alias("params_scored"),
        F.every(p.between(0, 1) & (inj == (p > 0.5))).alias("consistent")).select(
        "*", F.lit(info["model_name"]).alias("model_name"), F.lit(info["feature_count"]).alias("n_features"),
        F.lit(metrics.count()).alias("n_candidates"))


EXPERIMENT_SEEDS = (0, 1, 2, 3, 4)


@register("experiments", O.with_("requests") + f"""SELECT model_id, {len(EXPERIMENT_SEEDS)} AS n_seeds, 0 AS n_failed,
  true AS accurate, ceil(attacks * 0.2)::BIGINT + ceil((n - attacks) * 0.2)::BIGINT AS n_test
FROM (SELECT count(*) AS n, count_if(label = 1) AS attacks FROM requests),
  (SELECT unnest(['RandomForest', 'XGBoost_gbt', 'GradientBoosting', 'LogisticRegression', 'SVM_rff']) AS model_id)""")
def experiments(spark, sf_dir):
    """The whole grid of five seeds and five learners at default settings, 200
    rounds or trees each, summed up per model."""
    from . import ml
    corpus = T.requests(spark, sf_dir).select("request_id", "query", "label")
    rows = ml.experiments(spark, corpus, "request_id", EXPERIMENT_SEEDS)
    summary = EV.seed_summary(rows.withColumnRenamed("model", "model_id"))
    n_test = stratified_split(corpus.select("request_id", "label"), "request_id", "label", 0.2, 0).select(F.count_if("is_test"))
    return summary.select("model_id", "n_seeds", "n_failed", (F.col("mean_accuracy") >= F1_FLOOR).alias("accurate"),
                          n_test.scalar().alias("n_test"))


# --- §2.12 streaming (file stream of events, run to completion) -------------------------

@register("stream_screen", O.with_("requests", extra=verdict_ctes()) + """SELECT v.request_id, v.route,
  v.is_sql_injection, v.confidence, v.probability_injection, v.vulnerable_parameter, r.endpoint
FROM verdicts v JOIN requests r ON r.request_id = v.request_id""")
def stream_screen(spark, sf_dir):
    from ..streaming.jobs import run_screen_stream
    log_path, _ = run_screen_stream(spark, sf_dir)
    return spark.read.parquet(log_path).select(
        "request_id", "route", "is_sql_injection", "confidence", "probability_injection",
        "vulnerable_parameter", "endpoint")


@register("stream_block", O.with_("requests", extra=verdict_ctes()) + """SELECT v.request_id AS id, r.query,
  r.endpoint, r.created_at AS blocked_at, 'SQL injection detected' AS reason
FROM verdicts v JOIN requests r ON r.request_id = v.request_id WHERE v.is_sql_injection""")
def stream_block(spark, sf_dir):
    from ..streaming.jobs import run_screen_stream
    _, blocked = run_screen_stream(spark, sf_dir)
    return spark.read.parquet(blocked).select("id", "query", "endpoint", "blocked_at", "reason")


_COUNTERS_SQL = O.with_("requests", extra=verdict_ctes()) + """SELECT count(*) AS total_queries,
  count_if(is_sql_injection) AS injections_detected, count_if(error IS NOT NULL) AS invalid,
  coalesce(sum(params_scored), 0)::BIGINT AS params_scored FROM verdicts"""


@register("screen_counted", _COUNTERS_SQL)
def screen_counted(spark, sf_dir):
    """Counters of a batch, observed while its verdicts are written: one scan, no second scoring."""
    from ..operators.score import counter_row, observed
    verdicts, counters = observed(screen(T.requests(spark, sf_dir)))
    verdicts.write.parquet(_shared(spark, "verdicts"))
    return counter_row(spark, counters)


@register("stream_counted", _COUNTERS_SQL)
def stream_counted(spark, sf_dir):
    """The counters that each micro-batch stored beside its verdicts, added up."""
    from ..streaming.jobs import run_screen_stream
    log_path, _ = run_screen_stream(spark, sf_dir)
    rows = spark.read.parquet(f"{log_path.rpartition('/')[0]}/counters")
    return rows.agg(*[F.sum(c).alias(c) for c in ("total_queries", "injections_detected", "invalid", "params_scored")])


@register("stream_daily", O.with_("query_logs") + """SELECT CAST(created_at AS DATE) AS date,
  count(*) AS total_queries, count_if(is_sql_injection) AS sql_injections_detected
FROM query_logs GROUP BY 1""")
def stream_daily(spark, sf_dir):
    from ..streaming.jobs import run_daily_counter_stream
    return spark.read.parquet(run_daily_counter_stream(spark, sf_dir))


@register("stream_daily_late", O.with_("query_logs") + """SELECT CAST(created_at AS DATE) AS date, count(*) AS n FROM query_logs GROUP BY 1""")
def stream_daily_late(spark, sf_dir):
    """Rows by day, counted or late: none is lost."""
    from ..streaming.jobs import daily_totals, run_late_table_stream
    totals = daily_totals(spark, run_late_table_stream(spark, sf_dir))
    return totals.select("date", (F.col("total_queries") + F.col("late_rows")).alias("n"))
