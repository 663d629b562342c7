"""Triage columns derived from a verdict: status, severity, texts, filters.

All columns are plain expressions over one row, so they add no stage to the
plan. Percentages follow the browser conventions of the original report:
``Math.round`` (half up) for whole percents, one or two decimals otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .score import THRESHOLD, WARNING_THRESHOLD  # noqa: F401  (re-exported)

# ---------------------------------------------------------------------------
# Status names, severities, issue counts, description texts,
# vulnerability types, export header and report recommendations.
# ---------------------------------------------------------------------------
STATUS_VULNERABLE, STATUS_WARNING, STATUS_SAFE = "vulnerable", "warning", "safe"
SEVERITY = {STATUS_VULNERABLE: "High", STATUS_WARNING: "Medium", STATUS_SAFE: "Low"}
ISSUES = {STATUS_VULNERABLE: 3, STATUS_WARNING: 1, STATUS_SAFE: 0}
TEXT_VULNERABLE = "The model detected SQL injection characteristics. Confidence: %d%%."
TEXT_WARNING = ("Suspicious patterns detected (Injection probability %s%%). "
                "Manual review recommended.")
TEXT_SAFE = "No SQL injection characteristics detected. Confidence: %d%%."
TYPE_INJECTION, TYPE_POTENTIAL, TYPE_NONE = "SQL Injection", "Potential SQL Injection", "None"
EXPORT_HEADER = ["URL", "Status", "Issues Found", "Severity", "Confidence",
                 "Injection Probability", "Scan Date", "Log ID"]
RECOMMENDATIONS = [
    "1. Use parameterized queries or prepared statements",
    "2. Implement input validation and sanitization",
    "3. Use ORM frameworks when possible",
    "4. Apply principle of least privilege to database accounts",
    "5. Enable SQL error message suppression in production",
]
REPORT_TITLE = "SQL INJECTION SCREENING - REPORT"
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]
SCAN_DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _truthy(x: Column) -> Column:
    """A number that is present, not NaN and not zero."""
    return x.isNotNull() & ~F.isnan(x) & (x != 0)


def confidence_used(conf: Column, prob: Column) -> Column:
    """Confidence, else the injection probability, else 0 (zero falls through)."""
    return (F.when(_truthy(conf), conf).when(_truthy(prob), prob).otherwise(F.lit(0.0)))


def half_up_percent(x: Column) -> Column:
    return F.floor(x * 100 + F.lit(0.5)).cast("long")


def fixed(x: Column, digits: int) -> Column:
    """``x`` with a number of decimals, rounded by its exact binary value; an
    exact tie goes to the larger magnitude.

    The fraction is cut into three runs of 26 bits, each a whole number, so
    scaling by 10^digits and the carries between the runs are exact in 64 bits.
    Bits below the third run belong to fractions that round to zero anyway.
    """
    run, scale = float(1 << 26), 10 ** digits
    size = F.abs(x)
    whole = F.floor(size)
    first = (size - whole) * run
    second = (first - F.floor(first)) * run
    third = (second - F.floor(second)) * run
    high, mid, low = ((F.floor(v) * scale).cast("long") for v in (first, second, third))
    carry = F.shiftright(F.shiftleft(mid, 26) + low, 52)
    n = whole.cast("long") * scale + F.shiftright(high + carry + (1 << 25), 26)
    out = F.concat(((n - n % scale) / scale).cast("decimal(20,0)").cast("string"), F.lit("."),
                   F.lpad((n % scale).cast("string"), digits, "0"))
    return F.when(x < 0, F.concat(F.lit("-"), out)).otherwise(out)


def status(is_injection: Column, prob: Column) -> Column:
    p = F.coalesce(F.when(~F.isnan(prob), prob), F.lit(0.0))
    return (F.when(F.coalesce(is_injection, F.lit(False)), F.lit(STATUS_VULNERABLE))
             .when(p >= WARNING_THRESHOLD, F.lit(STATUS_WARNING))
             .otherwise(F.lit(STATUS_SAFE)))


def _by_status(st: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = (F.when(st == k, F.lit(v)) if out is None else out.when(st == k, F.lit(v)))
    return out


def description(st: Column, conf: Column, prob: Column) -> Column:
    pct = half_up_percent(confidence_used(conf, prob))
    p = F.coalesce(F.when(~F.isnan(prob), prob), F.lit(0.0))
    return (F.when(st == STATUS_VULNERABLE, F.format_string(TEXT_VULNERABLE, pct))
             .when(st == STATUS_WARNING, F.format_string(TEXT_WARNING, fixed(p * 100, 1)))
             .otherwise(F.format_string(TEXT_SAFE, pct)))


def vulnerability_type(is_injection: Column, st: Column) -> Column:
    return (F.when(F.coalesce(is_injection, F.lit(False)), F.lit(TYPE_INJECTION))
             .when(st == STATUS_WARNING, F.lit(TYPE_POTENTIAL))
             .otherwise(F.lit(TYPE_NONE)))


def percent_text(x: Column) -> Column:
    """Two decimals and '%', or 'N/A' when missing."""
    d = x.cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit("N/A")).otherwise(F.concat(fixed(d * 100, 2), F.lit("%")))


def html_escape(x: Column) -> Column:
    out = x
    for ch, rep in HTML_ESCAPES:  # '&' first
        out = F.replace(out, F.lit(ch), F.lit(rep))
    return out


def triage(verdicts: DataFrame, id_col: str = "id", text_col: str = "query",
           ts_col: str = "created_at") -> DataFrame:
    """Result records: one per verdict, with status, severity and texts."""
    inj, conf, prob = F.col("is_sql_injection"), F.col("confidence"), F.col("probability_injection")
    st = status(inj, prob)
    return verdicts.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("url"),
        F.date_format(F.col(ts_col), SCAN_DATE_FORMAT).alias("scan_date"),
        st.alias("status"),
        _by_status(st, SEVERITY).alias("severity"),
        _by_status(st, ISSUES).cast("long").alias("issues_found"),
        description(st, conf, prob).alias("description"),
        vulnerability_type(inj, st).alias("vulnerability_type"),
        conf.alias("confidence"),
        F.col("probability_safe"),
        prob.alias("probability_injection"),
        inj.alias("is_sql_injection"),
        F.col(id_col).alias("log_id"),
    )


def filter_status(records: DataFrame, wanted: str | None) -> DataFrame:
    """'' or None keeps all rows, otherwise case-insensitive status equality."""
    if not wanted:
        return records
    return records.where(F.lower(F.col("status")) == F.lit(wanted))


def export_lines(records: DataFrame) -> DataFrame:
    """CSV export rows as typed columns (write with ``write_export``)."""
    return records.select(
        F.col("url").alias("URL"),
        F.col("status").alias("Status"),
        F.col("issues_found").alias("Issues Found"),
        F.col("severity").alias("Severity"),
        percent_text(F.col("confidence")).alias("Confidence"),
        percent_text(F.col("probability_injection")).alias("Injection Probability"),
        F.col("scan_date").alias("Scan Date"),
        F.col("log_id").alias("Log ID"),
    )


def write_export(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header; quotes inside URLs are escaped properly."""
    (export_lines(records).write.mode(mode)
     .option("header", True).option("quoteAll", True).option("escape", '"')
     .csv(path))


def report_text(records: DataFrame, title: str = REPORT_TITLE, generated_at: Column | None = None) -> DataFrame:
    """One plain-text report per record (column ``report``).

    ``generated_at`` (default: now) is the time the report states.
    """
    generated = F.date_format(F.current_timestamp() if generated_at is None else generated_at, SCAN_DATE_FORMAT)
    lines = [
        F.lit(title), F.lit("=" * 30), F.lit(""),
        F.concat(F.lit("URL: "), F.col("url")),
        F.concat(F.lit("Scan Date: "), F.col("scan_date")),
        F.concat(F.lit("Status: "), F.col("status")),
        F.concat(F.lit("Severity: "), F.col("severity")),
        F.concat(F.lit("Issues Found: "), F.col("issues_found").cast("string")),
        F.concat(F.lit("Confidence: "), percent_text(F.col("confidence"))),
        F.concat(F.lit("Injection Probability: "), percent_text(F.col("probability_injection"))),
        F.concat(F.lit("Log ID: "), F.coalesce(F.col("log_id").cast("string"), F.lit("N/A"))),
        F.lit(""), F.lit("VULNERABILITY DETAILS:"), F.col("description"), F.lit(""),
        F.lit("RECOMMENDATIONS:"), *[F.lit(r) for r in RECOMMENDATIONS],
        F.lit(""), F.concat(F.lit("Report Generated: "), generated),
    ]
    return records.select("id", F.concat_ws("\n", *lines).alias("report"))


def write_reports(records: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """One text record per result (reports contain newlines: JSON keeps them)."""
    report_text(records, **options).write.mode(mode).json(path)


def scan_summary(records: DataFrame) -> DataFrame:
    """Last scan time, URLs scanned and injections detected."""
    return records.agg(F.max("scan_date").alias("last_scan"),
                       F.count(F.lit(1)).alias("urls_scanned"),
                       F.count_if(F.col("is_sql_injection")).alias("injections_detected"))
