"""File-name and file-size Column functions."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import dims


def file_ext(filename: Column | str) -> Column:
    """Lower-cased last suffix of the last path segment ('' when none).

    A leading dot alone (``.bashrc``) is not a suffix, matching path-suffix
    rules: the dot must follow at least one character of the name.
    """
    return F.lower(raw_ext(filename))


def raw_ext(filename: Column | str) -> Column:
    """Last suffix as written: a dot with at least one character before it."""
    return F.regexp_extract(basename(filename), r"^.+(\.[^.]+)$", 1)


def basename(path: Column | str) -> Column:
    return F.regexp_extract(F.col(path) if isinstance(path, str) else path, r"([^/]*)$", 1)


def with_format_tier(files: DataFrame, filename_col: str = "filename") -> DataFrame:
    """Add ``ext`` and ``tier`` (null when the suffix has no tier)."""
    tiers = F.broadcast(dims.format_tiers(files.sparkSession))  # fixed ~24 rows
    return (files.withColumn("ext", file_ext(filename_col))
            .join(tiers, "ext", "left"))


def ingestable(files: DataFrame, filename_col: str = "filename") -> DataFrame:
    """Keep files whose suffix is in the tiers or the direct-parse set."""
    exts = F.broadcast(dims.ingestable_exts(files.sparkSession))
    return (files.withColumn("_ext", file_ext(filename_col))
            .join(exts, F.col("_ext") == exts.ext, "left_semi").drop("_ext"))


def size_reason(filename: Column, n_bytes: Column) -> Column:
    """Rejection text when ``n_bytes`` is over the limit, else null."""
    from quarry.functions.text import ratio_1dp

    max_mb = dims.MAX_FILE_SIZE_BYTES / (1024 * 1024)
    msg = F.concat(F.lit("File "), filename, F.lit(" ("), ratio_1dp(n_bytes, 1024 * 1024),
                   F.lit(f" MB) exceeds the {max_mb:.0f} MB limit for document parsing. "
                         "Consider splitting the document or using a text-only strategy."))
    return F.when(n_bytes > F.lit(dims.MAX_FILE_SIZE_BYTES), msg)


def route_lane(ext: Column, n_bytes: Column, route_spreadsheets: bool = True) -> Column:
    """``tabular`` / ``rejected`` / ``direct`` / ``primary``.

    With spreadsheet routing on, tabular suffixes win before the size guard
    (so they are never size-checked); with it off ``.csv`` is direct.
    """
    guard = n_bytes > F.lit(dims.MAX_FILE_SIZE_BYTES)
    chain = F.when(guard, "rejected").when(ext.isin(dims.DIRECT_PARSE_EXTS), "direct") \
        .otherwise("primary")
    if route_spreadsheets:
        return F.when(ext.isin(dims.TABULAR_ROUTE_EXTS), "tabular").otherwise(chain)
    return chain


def parse_options(ext: Column, vlm_preset: str | None = None,
                  timeout_s: int = dims.DOCUMENT_TIMEOUT_S) -> Column:
    """P5: converter options as ``MAP<STRING,STRING>`` (list values comma-joined).

    Precedence: audio > tabular > VLM preset > standard; the standard set
    adds OCR + PDF backend for ``.pdf`` and OCR for raster images.
    """
    def m(d: dict) -> Column:
        return F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])

    fmts = "json,md,doctags"
    t = str(timeout_s)
    audio = m({"to_formats": fmts, "pipeline": "asr", "document_timeout": t,
               "abort_on_error": "false"})
    tabular = m({"to_formats": fmts, "do_table_structure": "true", "include_images": "false",
                 "table_mode": "accurate", "pipeline": "standard",
                 "image_export_mode": "placeholder", "document_timeout": t,
                 "abort_on_error": "false"})
    standard = {"to_formats": fmts, "do_table_structure": "true", "include_images": "true",
                "table_mode": "accurate", "pipeline": "standard",
                "image_export_mode": "embedded", "document_timeout": t,
                "abort_on_error": "false"}
    pdf = m({**standard, "do_ocr": "true", "pdf_backend": "dlparse_v2"})
    image = m({**standard, "do_ocr": "true"})
    out = F.when(ext.isin(dims.FORMAT_TIERS["audio"]), audio) \
        .when(ext.isin(dims.FORMAT_TIERS["tabular"]), tabular)
    if vlm_preset:
        vlm = m({"to_formats": fmts, "do_table_structure": "true", "include_images": "true",
                 "pipeline": "vlm", "vlm_pipeline_preset": vlm_preset,
                 "image_export_mode": "embedded", "document_timeout": t,
                 "abort_on_error": "false"})
        return out.otherwise(vlm)
    return out.when(ext == ".pdf", pdf).when(ext.isin(dims.FORMAT_TIERS["image"]), image) \
        .otherwise(m(standard))


def map_to_text(m: Column) -> Column:
    """Deterministic ``k=v;k=v`` rendering of a map, keys sorted."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


# Suffix rules of the MIME convention: short forms, and suffixes that only tell the encoding.
ARCHIVE_SUFFIXES = {".svgz": ".svg.gz", ".tgz": ".tar.gz", ".taz": ".tar.gz", ".tz": ".tar.gz", ".tbz2": ".tar.bz2", ".txz": ".tar.xz"}
ENCODING_SUFFIXES = [".gz", ".Z", ".bz2", ".xz", ".br"]


def content_types(spark: SparkSession) -> DataFrame:
    """P14 dimension: the MIME table that comes with Python, without the host's own files (bounded, broadcast)."""
    rows = sorted(mimetypes.MimeTypes(filenames=()).types_map[True].items())
    return spark.createDataFrame(rows, "ext string, content_type string")


def typed_ext(filename_col: str) -> Column:
    """The suffix that tells the type: short archive forms are written out, then an encoding suffix is dropped."""
    ext = raw_ext(filename_col)
    name = F.col(filename_col)
    long = F.create_map(*[F.lit(x) for kv in ARCHIVE_SUFFIXES.items() for x in kv])
    name = F.coalesce(F.concat(F.substring(name, F.lit(1), F.length(name) - F.length(ext)), long[F.lower(ext)]), name)
    base, last = F.regexp_extract(name, r"([^/]*)$", 1), r"^.+(\.[^.]+)$"
    outer = F.regexp_extract(base, last, 1)
    inner = F.regexp_extract(F.substring(base, F.lit(1), F.length(base) - F.length(outer)), last, 1)
    return F.when(outer.isin(ENCODING_SUFFIXES), inner).otherwise(outer)


def with_content_type(files: DataFrame, filename_col: str = "filename") -> DataFrame:
    """MIME type by suffix (exact case first, then lower case), default octet-stream."""
    ct = content_types(files.sparkSession)
    exact = F.broadcast(ct.select(F.col("ext").alias("_e1"), F.col("content_type").alias("_ct1")))
    lower = F.broadcast(ct.select(F.col("ext").alias("_e2"), F.col("content_type").alias("_ct2")))
    return (files.withColumn("_raw", typed_ext(filename_col))
            .join(exact, F.col("_raw") == F.col("_e1"), "left")
            .join(lower, F.lower(F.col("_raw")) == F.col("_e2"), "left")
            .withColumn("content_type", F.coalesce("_ct1", "_ct2", F.lit("application/octet-stream")))
            .drop("_raw", "_e1", "_ct1", "_e2", "_ct2"))


def upload_ok(ext: Column, n_bytes: Column, accepted: Column, max_bytes: Column) -> Column:
    """Suffix in the accepted list (case-insensitive, dot optional) and size <= max.

    A null list or null limit accepts anything on that axis.
    """
    norm = F.transform(accepted, lambda f: F.lower(
        F.when(F.startswith(f, F.lit(".")), f).otherwise(F.concat(F.lit("."), f))))
    fmt_ok = F.when(accepted.isNull(), True).otherwise(F.array_contains(norm, ext))
    size_ok = F.when(max_bytes.isNull(), True).otherwise(n_bytes <= max_bytes)
    return fmt_ok & size_ok


def direct_parse_text(content: Column) -> Column:
    """bytes -> text, invalid UTF-8 replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def sanitize_text(text: Column) -> Column:
    """remove NUL characters."""
    return F.replace(text, F.lit("\u0000"), F.lit(""))
