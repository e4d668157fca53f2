"""Outcome columns: status classes, severities, error texts, soft 404 pages and run states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severity weights (fixed values).
SEVERITY_WEIGHTS = {"gone": 1.0, "not_found": 1.0, "soft_not_found": 0.9, "server_error": 0.8, "redirect_chain": 0.4, "redirect_single": 0.15, "ok": 0.0, "blocked": 0.0, "unknown": 0.0}
CRITICAL = ("gone", "not_found", "soft_not_found", "server_error", "redirect_chain")
#: Signals of a soft 404 in a lower-case body, in order (fixed values).
SOFT404_SIGNALS = ("no entity selected", "page not found", "404", "not found", "no results", "no data found", "does not exist")
#: Bytes of a body that are looked at, and bytes below which it is short.
BODY_LIMIT, SHORT_BODY = 65_536, 1_000


def status_class(status: Column) -> Column:
    return (
        F.when(status.isNull(), "error").when(status.between(200, 299), "ok").when(status.between(300, 399), "redirect")
        .when(status.between(400, 499), "client_error").when(status >= 500, "server_error")
    )


def classify_outcome(status: Column, is_soft404: Column, hops: Column | None = None, is_blocked: Column | None = None) -> Column:
    hops = F.coalesce(hops, F.lit(1)) if hops is not None else F.lit(1)
    blocked = F.coalesce(is_blocked, F.lit(False)) if is_blocked is not None else F.lit(False)
    return (
        F.when(blocked, "blocked").when(status.isNull(), "unknown").when(status.isin(429, 403), "blocked").when(status == 410, "gone")
        .when(status == 404, "not_found").when(status >= 500, "server_error")
        .when(status.between(300, 399), F.when(hops > 1, "redirect_chain").otherwise("redirect_single"))
        .when(status.between(200, 299), F.when(F.coalesce(is_soft404, F.lit(False)), "soft_not_found").otherwise("ok"))
        .otherwise("unknown")
    )


def severity_weight(severity: Column, weights: dict[str, float]) -> Column:
    """Weight of a class; a class without a finite weight is an error."""
    import math

    if any(not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be finite")
    out = None
    for name, weight in weights.items():
        out = F.when(severity == name, F.lit(float(weight))) if out is None else out.when(severity == name, F.lit(float(weight)))
    return out.otherwise(F.raise_error(F.concat(F.lit("no weight for severity "), F.coalesce(severity, F.lit("null")))).cast("double"))


def is_absence_of_evidence(severity: Column) -> Column:
    return severity.isin("blocked", "unknown")


def classify_error(text: Column) -> Column:
    """Cause of a failed request, by its message."""
    t = F.lower(F.coalesce(text, F.lit("")))

    def any_of(*parts: str) -> Column:
        out = t.contains(parts[0])
        for p in parts[1:]:
            out = out | t.contains(p)
        return out

    return (
        F.when(any_of("timeout", "etimedout"), "timeout").when(any_of("enotfound", "eai_again"), "dns").when(any_of("econnrefused"), "connection_refused")
        .when(any_of("cert", "tls", "ssl"), "tls").when(any_of("abort"), "aborted").otherwise("unknown")
    )


def detect_soft404(body: Column) -> Column:
    """struct(is_soft404, matched_signal, is_short_body) of a page body."""
    size = F.octet_length(body)
    head = F.lower(F.when(size > BODY_LIMIT, F.substring(body, 1, BODY_LIMIT)).otherwise(body))
    signal = None
    for s in SOFT404_SIGNALS:
        hit = head.rlike(r"(?<![0-9a-z])404(?![0-9a-z])") if s == "404" else head.contains(s)
        signal = F.when(hit, s) if signal is None else signal.when(hit, s)
    short = (size < SHORT_BODY) & (size < BODY_LIMIT)
    return F.struct((signal.isNotNull() | short).alias("is_soft404"), signal.alias("matched_signal"), short.alias("is_short_body"))


#: What an error code in a run's status reason says, tested in this order; the first two are the operator's fault, the rest the site's.
ERROR_CODES = {
    "EACCES": "local storage is not writable", "ENOENT": "a file or directory is missing", "ECONNREFUSED": "the server refused the connection",
    "ENOTFOUND": "the host name has no address", "ETIMEDOUT": "the server did not answer in time", "ECONNRESET": "the server reset the connection",
}


def run_failure_reason(reason: Column) -> Column:
    """struct(stage, cause, summary) of a run's status reason; stage and cause are null where the reason doesn't name them."""
    pattern = r"(?s)^STAGE_EXHAUSTED_RETRIES:([A-Z]+):(.*)$"
    stage = F.nullif(F.regexp_extract(reason, pattern, 1), F.lit(""))
    message = F.regexp_extract(reason, pattern, 2)
    cause = None
    for code, text in ERROR_CODES.items():
        cause = F.when(message.contains(code), text) if cause is None else cause.when(message.contains(code), text)
    summary = (
        F.when(reason.isNull(), "").when(stage.isNull(), "failed unexpectedly")
        .when(cause.isNull(), F.concat(F.lit("failed in "), F.lower(stage))).otherwise(F.concat(F.lit("failed in "), F.lower(stage), F.lit(": "), cause))
    )
    return F.struct(stage.alias("stage"), cause.alias("cause"), summary.alias("summary"))


def project_run_state(status: Column, total_urls: Column) -> Column:
    return F.when(status.isNull(), "never_run").when(status.isin("pending", "running"), "in_flight").when(F.coalesce(total_urls, F.lit(0)) == 0, "no_urls").otherwise("measured")


def trend_percent(current: Column, previous: Column) -> Column:
    return F.when(previous.isNull() | (previous == 0), None).otherwise((current - previous) / F.nullif(previous, F.lit(0)) * 100)


def coverage_fraction(requests: Column, population: Column) -> Column:
    return F.when(population > 0, F.try_divide(requests, population))
