"""URL columns: hosts, paths, segments, templates, shapes and stable hashes. All are native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PARAM = "{param}"
#: FNV-1a with 32 bits (fixed values of the algorithm).
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def normalize_host(host: Column) -> Column:
    """Lower case, without a leading ``www.``."""
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once per row, however often ``then`` uses it; the optimizer can't unfold it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved."""

    def resolved(parts: Column) -> Column:
        kept = F.aggregate(
            parts, F.array().cast("array<string>"),
            lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.array_append(done, s)),
        )
        ends = F.element_at(parts, -1).isin(".", "..")
        return F.concat(F.lit("/"), F.array_join(F.when(ends, F.array_append(kept, "")).otherwise(kept), "/"))

    dotted = path.contains("/.") & path.rlike(r"/\.\.?(/|$)")
    return F.when(dotted, let(F.slice(F.split(path, "/"), 2, F.lit(1 << 30)), resolved)).otherwise(path)


def _percent_encoded(text: Column) -> Column:
    """Characters outside ASCII as percent-encoded UTF-8."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    coded = F.transform(letters, lambda c: F.when(F.ascii(c) > 127, F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "%$1")).when(c == " ", F.lit("%20")).otherwise(c))
    return F.when(text.rlike(r"[^\x21-\x7e]"), F.array_join(coded, "")).otherwise(text)


def _without_www(host: Column) -> Column:
    return F.when(host.startswith("www."), F.substring(host, 5, 1 << 30)).otherwise(host)


#: Scheme, authority, path, query and fragment of an absolute URL, and what stands between the parts that a split takes apart: no character of any text.
_PARTS, _CUT = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", "\uffff"


def _url_parts(url: Column) -> Column:
    """[scheme, authority, path, query] of an absolute URL, by one match; other text is one part."""
    return F.split(F.regexp_replace(url, _PARTS, f"$1{_CUT}$2{_CUT}$3{_CUT}$4"), _CUT)


def _absolute(raw: Column, base_url: Column) -> Column:
    """``raw``, which isn't an absolute URL with an authority, against the base; what has a scheme stays as it is."""

    def against(base: Column) -> Column:
        scheme, authority, path = (F.get(base, i) for i in range(3))
        origin, path = F.concat(scheme, F.lit("://"), authority), F.when(path == "", "/").otherwise(path)
        return (
            F.when(F.size(base) < 4, raw).when(raw.startswith("//"), F.concat(scheme, F.lit(":"), raw)).when(raw.startswith("/"), F.concat(origin, raw))
            .when(raw.startswith("?") | raw.startswith("#"), F.concat(origin, path, raw)).otherwise(F.concat(origin, F.regexp_replace(path, r"[^/]*$", ""), raw))
        )

    return F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), raw).otherwise(let(_url_parts(base_url), against))


def _host_of(authority: Column) -> Column:
    """The host of an authority in lower case, ``""`` if there is none."""
    host = F.when(authority.rlike(r"[@:\[\]\s]"), F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:\s]+)(?::\d*)?$", 1)).otherwise(authority)
    return F.coalesce(F.lower(host), F.lit(""))


def parse_loc(loc: Column, base_url: Column, expected_host: Column) -> Column:
    """struct(kind, path, segments, source_url, detected_host) of one location.

    kind is matched, foreign (another host than expected, ``www.`` aside) or
    unparseable (blank, or no URL even against the base). path holds the query
    string and no fragment; segments are the non-empty parts of the path alone.
    Every step is computed once and handed on, so a location costs a few matches.
    """

    def told(raw: Column, parts: Column, host: Column) -> Column:
        other = _without_www(host) != normalize_host(expected_host)
        kind = F.when(raw.isNull() | (raw == "") | (host == ""), "unparseable").when(other, "foreign").otherwise("matched")
        own = F.when(F.get(parts, F.lit(2)) == "", "/").otherwise(F.get(parts, F.lit(2)))
        # a question mark alone is no query
        query = F.when(F.length(F.get(parts, F.lit(3))) > 1, _percent_encoded(F.get(parts, F.lit(3)))).otherwise("")

        def finished(kind: Column) -> Column:
            path = F.when(kind == "matched", _percent_encoded(_without_dots(own)))
            return let(path, lambda p: F.struct(
                kind.alias("kind"), F.concat(p, query).alias("path"), F.filter(F.split(p, "/"), lambda s: s != "").alias("segments"),
                F.when(raw == "", loc).otherwise(raw).alias("source_url"), F.when(kind == "foreign", _without_www(host)).alias("detected_host"),
            ))

        return let(kind, finished)

    def located(raw: Column) -> Column:
        own = let(_url_parts(raw), lambda parts: F.when(F.size(parts) >= 4, parts).otherwise(_url_parts(_absolute(raw, base_url))))
        return let(own, lambda parts: let(_host_of(F.when(F.size(parts) >= 4, F.get(parts, F.lit(1)))), lambda host: told(raw, parts, host)))

    return let(F.trim(loc), located)


def stable_hash(text: Column) -> Column:
    """FNV-1a over the characters of an ASCII string, as a long from 0 to 2**32 - 1."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def value_shape(value: Column) -> Column:
    """Letter runs as ``a``, digits as 9 (at most twelve in a row), all else as it is."""
    out = F.regexp_replace(F.regexp_replace(value, "[A-Za-z]+", "a"), "[0-9]", "9")
    return F.regexp_replace(out, "9{13,}", "9" * 12)


def path_shape(path: Column) -> Column:
    """Shape of a path without its query."""
    return value_shape(F.substring_index(path, "?", 1))


def template_segments(template: Column) -> Column:
    return F.filter(F.split(template, "/"), lambda s: s != "")


def template_arity(template: Column) -> Column:
    return F.size(template_segments(template))


def template_param_count(template: Column) -> Column:
    return F.size(F.filter(template_segments(template), lambda s: s == PARAM))


def rate_limit_key(url: Column) -> Column:
    """Lower-case host with its port, or ``invalid``."""
    found = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#\s]+)(?:[/?#]|$)", 1))
    return F.when(found.isNull() | (found == ""), "invalid").otherwise(found)


def register(spark: SparkSession) -> None:
    """The scalar functions as temporary SQL functions of the session."""
    bodies = {
        "stable_hash(x STRING) RETURNS BIGINT": f"aggregate(transform(filter(split(x, ''), c -> c <> ''), c -> cast(ascii(c) AS BIGINT)), {FNV_OFFSET}L, (h, c) -> ((h ^ c) * {FNV_PRIME}L) & 4294967295L)",
        "value_shape(x STRING) RETURNS STRING": "regexp_replace(regexp_replace(regexp_replace(x, '[A-Za-z]+', 'a'), '[0-9]', '9'), '9{13,}', '999999999999')",
        "path_shape(x STRING) RETURNS STRING": "regexp_replace(regexp_replace(regexp_replace(substring_index(x, '?', 1), '[A-Za-z]+', 'a'), '[0-9]', '9'), '9{13,}', '999999999999')",
        "normalize_host(x STRING) RETURNS STRING": "regexp_replace(lower(x), '^www[.]', '')",
        "status_class(x INT) RETURNS STRING": "CASE WHEN x IS NULL THEN 'error' WHEN x BETWEEN 200 AND 299 THEN 'ok' WHEN x BETWEEN 300 AND 399 THEN 'redirect' WHEN x BETWEEN 400 AND 499 THEN 'client_error' WHEN x >= 500 THEN 'server_error' END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
