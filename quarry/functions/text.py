"""Scalar string / number / date Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import dims


# The code points that Unicode calls white space.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")


def strip_ws(text: Column) -> Column:
    """Strip every kind of white space at both ends (``trim`` strips blanks only).

    Each end is read once; a pattern such as ``\\s+$`` would start anew at every inner run of blanks.
    """
    return F.trim(text, F.lit(WHITE_SPACE))


def slugify(text: Column) -> Column:
    """lower; ``_`` and space -> ``-``; drop other chars; collapse and strip ``-``."""
    s = F.lower(text)
    s = F.regexp_replace(s, r"[_ ]", "-")
    s = F.regexp_replace(s, r"[^a-z0-9-]", "")
    s = F.regexp_replace(s, r"-+", "-")
    return F.regexp_replace(s, r"^-+|-+$", "")


def edge_key(src: Column, dst: Column) -> Column:
    """``src->dst``."""
    return F.concat_ws("->", src, dst)


def function_name(slug: Column) -> Column:
    """slug with ``-`` replaced by ``_``."""
    return F.translate(slug, "-", "_")


def token_estimate(text: Column) -> Column:
    """``max(1, len // 4)``."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def format_duration_s(s: Column) -> Column:
    """seconds -> ``1h 1m 1s`` (zero parts dropped; ``<= 0`` -> ``0s``)."""
    h, m, sec = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    parts = F.concat_ws(" ",
                        F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))),
                        F.when(m > 0, F.concat(m.cast("string"), F.lit("m"))),
                        F.when((sec > 0) | ((h == 0) & (m == 0)), F.concat(sec.cast("string"), F.lit("s"))))
    return F.when(s <= 0, F.lit("0s")).otherwise(parts)


def format_duration_ms(ms: Column) -> Column:
    """milliseconds -> ``Nms`` below one second, else the seconds form."""
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))) \
        .otherwise(format_duration_s(F.floor(ms / 1000)))


def ratio_1dp(n: Column, d: int) -> Column:
    """``n / d`` with one decimal, ties to even on the exact value (integer ``n``, ``d`` a power of two).

    ``n / d`` is exact in binary, so this equals formatting the float with
    ``.1f``; integer arithmetic keeps it exact and JVM-side.
    """
    n = n.cast("long")
    tenths, rem = F.floor(n * 10 / d).cast("long"), (n * 10) % d
    up = (rem * 2 > d) | ((rem * 2 == d) & (tenths % 2 == 1))
    t = tenths + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def format_size(n: Column) -> Column:
    """bytes -> ``N B`` / ``x.y KB`` / ``x.y MB``."""
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
            .when(n < 1024 * 1024, F.concat(ratio_1dp(n, 1024), F.lit(" KB")))
            .otherwise(F.concat(ratio_1dp(n, 1024 * 1024), F.lit(" MB"))))


def format_datetime(raw: Column) -> Column:
    """F8: null -> ``N/A``; ISO text (``Z`` allowed) -> ``yyyy-MM-dd HH:mm``; unparsable kept.

    The time is shown as written: an offset is not converted, so it is cut off before parsing.
    """
    local = F.regexp_replace(raw, r"(?<=\d)(Z|[+-]\d{2}:?\d{2}(:?\d{2}(\.\d+)?)?)$", "")
    dated = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), local)
    ts = F.try_to_timestamp(dated)
    return F.when(raw.isNull(), F.lit("N/A")).otherwise(F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), raw))


def output_preview(text: Column, limit: int = 200) -> Column:
    """node-output text preview: over ``limit`` chars gets ``...``."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def content_preview(text: Column, limit: int = 200) -> Column:
    """message content preview: first ``limit`` chars."""
    return F.substring(text, 1, limit)


def event_preview(payload_json: Column, limit: int = 100) -> Column:
    """preview of an event payload: its ``text``, else ``content``, else ``response`` (200 characters), else the payload itself (``limit``)."""
    v = F.try_parse_json(payload_json)
    text = F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ("text", "content", "response")])
    return F.coalesce(output_preview(text), output_preview(payload_json, limit))


def parse_json_object(text: Column) -> tuple[Column, Column]:
    """null -> ``{}``; invalid or non-object -> error text. Returns ``(json, error)``."""
    v = F.try_parse_json(text)
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    value = F.when(text.isNull(), F.lit("{}")).when(is_obj, F.to_json(v))
    err = (F.when(text.isNull(), F.lit(None))
           .when(v.isNull(), F.lit("Invalid JSON"))
           .when(~is_obj, F.lit("Input must be a JSON object")))
    return value, err


def is_uuid(s: Column) -> Column:
    """Strict 8-4-4-4-12 hex, case-insensitive."""
    return F.coalesce(s.rlike(dims.UUID_PATTERN), F.lit(False))


def error_class(code: Column) -> Column:
    """HTTP status -> error class name (fixed mapping; >= 500 server error)."""
    return (F.when(code.isin(400, 422), "ValidationError").when(code == 401, "AuthenticationError")
            .when(code == 403, "AuthorizationError").when(code == 404, "NotFoundError")
            .when(code == 409, "ConflictError").when(code == 429, "RateLimitError")
            .when(code >= 500, "ServerError").otherwise("APIError"))


def error_message(body_json: Column, code: Column) -> Column:
    """message from ``detail``, ``detail.detail`` or ``error.message``; else a default with the status."""
    v = F.try_parse_json(body_json)
    detail = F.try_variant_get(v, "$.detail", "variant")
    text = F.when(F.schema_of_variant(detail) == "STRING", F.try_variant_get(v, "$.detail", "string")).when(
        F.schema_of_variant(detail).startswith("OBJECT"), F.try_variant_get(v, "$.detail.detail", "string")).otherwise(
        F.try_variant_get(v, "$.error.message", "string"))
    return F.coalesce(F.nullif(text, F.lit("")), F.concat(F.lit("API request failed with status "), code.cast("string")))


def retry_after(body_json: Column, code: Column) -> Column:
    """whole seconds from ``retry_after`` of a 429 answer, else null."""
    return F.when(code == 429, F.try_variant_get(F.try_parse_json(body_json), "$.retry_after", "int"))


def mapped_values(rows: DataFrame, key: str, body: str, mappings: list[tuple[str, str]]) -> DataFrame:
    """``(variable, jsonPath)`` mappings of a JSON body -> one row ``(key, variable, value)`` each; a missing path is null."""
    v = F.try_parse_json(F.col(body))
    picked = [F.struct(F.lit(name).alias("variable"), F.try_variant_get(v, path if path.startswith("$") else f"$.{path}", "string").alias("value")) for name, path in mappings]
    return rows.select(key, F.inline(F.array(*picked)))
