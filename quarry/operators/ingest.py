"""Document ingest: lanes, element producers, page batches, tables, outcomes.

Element schema (every lane produces it, U1 unions them):
``doc_id BIGINT, pos INT, type STRING, text STRING, filename STRING,
page_number INT, text_as_html STRING, lane STRING``.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.files import (direct_parse_text, file_ext, route_lane,
                                    sanitize_text, size_reason, with_format_tier)

ELEMENT_COLS = ["doc_id", "pos", "type", "text", "filename", "page_number", "text_as_html", "lane"]
ELEMENT_SCHEMA = ("doc_id bigint, pos int, type string, text string, filename string, "
                  "page_number int, text_as_html string, lane string")


def with_lanes(files: DataFrame, route_spreadsheets: bool = True) -> DataFrame:
    """P1 + P3 + P4 over the scan schema: adds ``ext, tier, lane, reject_reason``."""
    return (with_format_tier(files)
            .withColumn("lane", route_lane(F.col("ext"), F.col("length"), route_spreadsheets))
            .withColumn("reject_reason",
                        F.when(F.col("lane") == "rejected",
                               size_reason(F.col("filename"), F.col("length")))))


def direct_elements(files: DataFrame) -> DataFrame:
    """one NarrativeText element per direct-lane file (bad UTF-8 -> U+FFFD)."""
    return files.select(
        "doc_id", F.lit(0).alias("pos"), F.lit("NarrativeText").alias("type"),
        direct_parse_text(F.col("content")).alias("text"), "filename",
        F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("text_as_html"),
        F.lit("direct").alias("lane"))


# ------------------------------------------------------------------ G5 markup
_BLOCK_TYPES = {"h1": "Title", "h2": "Title", "h3": "Title", "h4": "Title", "h5": "Title",
                "h6": "Title", "p": "NarrativeText", "li": "ListItem", "pre": "NarrativeText",
                "blockquote": "NarrativeText", "table": "Table"}
_SKIP = {"script", "style", "title", "noscript", "template"}
_BREAKS = {"div", "article", "section", "body", "nav", "footer", "header", "main", "ul", "ol", "dl", "form", "hr"}
SLICE_ROWS = 20_000


class _Walk(HTMLParser):
    """Collects ``(type, text)`` in document order; end tags that HTML lets a page omit may be missing.

    ``head`` ends at ``body`` or the first block; a new cell or row ends the
    open one; a table inside a cell adds its text to that cell.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.buf: list[str] = []
        self.block: str | None = None
        self.skipped: list[str] = []
        self.in_head = False
        self.tables: list[dict] = []

    def flush(self):
        text = " ".join("".join(self.buf).split())
        if text:
            self.out.append((_BLOCK_TYPES.get(self.block or "", "NarrativeText"), text))
        self.buf = []

    def end_cell(self):
        t = self.tables[-1]
        if t["cell"] is not None:
            t["row"].append(" ".join("".join(t["cell"]).split()))
            t["cell"] = None

    def end_row(self):
        self.end_cell()
        t = self.tables[-1]
        if t["row"]:
            t["rows"].append(" | ".join(t["row"]))
        t["row"] = []

    def end_table(self):
        self.end_row()
        rows = self.tables.pop()["rows"]
        if self.tables:
            self.handle_data(" " + " ".join(rows) + " ")
        elif rows:
            self.out.append(("Table", "\n".join(rows)))

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skipped.append(tag)
            return
        if tag == "head":
            self.in_head = True
            return
        if tag == "body" or tag in _BLOCK_TYPES or tag in _BREAKS:
            self.in_head = False
            if tag != "body" and self.skipped[-1:] == ["title"]:
                self.skipped.pop()
        if self.in_head or self.skipped:
            return
        if tag == "table":
            if not self.tables:
                self.flush()
                self.block = None
            self.tables.append({"rows": [], "row": [], "cell": None})
        elif self.tables:
            if tag in ("td", "th"):
                self.end_cell()
                self.tables[-1]["cell"] = []
            elif tag in ("tr", "thead", "tbody", "tfoot"):
                self.end_row()
            elif tag == "br" or tag in _BLOCK_TYPES or tag in _BREAKS:
                self.handle_data(" ")
        elif tag in _BLOCK_TYPES:
            self.flush()
            self.block = tag
        elif tag in _BREAKS:
            self.flush()
            self.block = None
        elif tag == "br":
            self.buf.append(" ")

    def handle_endtag(self, tag):
        if tag in _SKIP:
            if tag in self.skipped:
                del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag):]
            return
        if tag == "head":
            self.in_head = False
        elif self.tables:
            if tag in ("td", "th"):
                self.end_cell()
            elif tag in ("tr", "thead", "tbody", "tfoot"):
                self.end_row()
            elif tag == "table":
                self.end_table()
        elif tag == self.block:
            self.flush()
            self.block = None
        elif tag in _BREAKS:
            self.flush()
            self.block = None

    def handle_data(self, data):
        if self.skipped or (self.in_head and not data.strip()):
            return
        if self.in_head:  # text ends an open head too
            self.in_head = False
        if self.tables:
            if self.tables[-1]["cell"] is not None:
                self.tables[-1]["cell"].append(data)
        else:
            self.buf.append(data)

    def finish(self):
        self.close()
        while self.tables:
            self.end_table()
        self.flush()
        return self.out


def _html_elements(html: str) -> list[tuple[str, str]]:
    """``[(type, text)]`` of one page in document order."""
    walk = _Walk()
    walk.feed(html or "")
    return walk.finish()


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Element rows in frames of at most ``SLICE_ROWS`` rows, so a batch of documents is never held whole."""
    while part := list(islice(rows, SLICE_ROWS)):
        yield pd.DataFrame(part, columns=ELEMENT_COLS).astype({"doc_id": "int64", "pos": "int32", "page_number": "Int32"})


def _markup_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield from _frames((doc_id, i, t, text, filename, None, None, "markup") for b in batches
                       for doc_id, html, filename in zip(b["doc_id"], b["html"], b["filename"])
                       for i, (t, text) in enumerate(_html_elements(html)))


def markup_to_elements(docs: DataFrame, html_col: str = "html") -> DataFrame:
    """HTML text -> Title / NarrativeText / ListItem / Table element rows.

    Runs per Arrow batch in ``mapInPandas`` (no shuffle); each document is
    parsed whole, so work spreads by input partition.
    """
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                      F.col(html_col).alias("html"),
                      (F.col("filename") if "filename" in docs.columns else F.lit(None).cast("string"))
                      .alias("filename"))
    return src.mapInPandas(_markup_batches, ELEMENT_SCHEMA)


def union_lanes(*frames: DataFrame) -> DataFrame:
    """All lanes in one element table (missing columns become null)."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out.withColumn("text", sanitize_text(F.col("text")))


def _pipe_table(text: str) -> str:
    """CSV text -> pipe table: blank rows dropped, first row the header, others fitted to its width."""
    lines, width = [], 0
    for row in csv.reader(io.StringIO(text, newline="")):
        cells = [c.replace("\r\n", " ").replace("\n", " ").replace("|", "\\|").strip() for c in row]
        if not any(cells):
            continue
        width = width or len(cells)
        lines.append("| " + " | ".join((cells + [""] * width)[:width]) + " |")
        if len(lines) == 1:
            lines.append("| " + " | ".join(["---"] * width) + " |")
    return "\n".join(lines)


def _csv_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(sys.maxsize)
    tables = ((d, _pipe_table((t or "").replace("\0", "")), f) for b in batches for d, t, f in zip(b["doc_id"], b["text"], b["filename"]))
    yield from _frames((d, 0, "Table", t, f, None, t, "tabular") for d, t, f in tables if t)


def tabular_elements(files: DataFrame) -> DataFrame:
    """Tabular lane for ``.csv``: one Table element per file with a non-blank row (text and markdown alike)."""
    src = files.select(F.col("doc_id").cast("bigint").alias("doc_id"), direct_parse_text(F.col("content")).alias("text"), "filename")
    return src.mapInPandas(_csv_batches, ELEMENT_SCHEMA)


MARKUP_EXTS = [".html", ".htm"]


def ingest_elements(files: DataFrame, route_spreadsheets: bool = True) -> DataFrame:
    """S1 -> P1-P4 -> (F2 | G5 | tabular) -> U1 -> F1 for the lanes that run locally.

    Direct-lane files become one element each, ``.html/.htm`` files of the
    primary lane go through the markup walk, ``.csv`` files of the tabular lane
    become tables. All other files are rows of ``ingest_rejects``.
    """
    laned = with_lanes(files, route_spreadsheets)
    direct = direct_elements(laned.where(F.col("lane") == "direct"))
    html = laned.where((F.col("lane") == "primary") & F.col("ext").isin(MARKUP_EXTS))
    markup = markup_to_elements(html.withColumn("html", direct_parse_text(F.col("content"))))
    tables = tabular_elements(laned.where((F.col("lane") == "tabular") & (F.col("ext") == ".csv")))
    return union_lanes(direct, markup, tables)


def ingest_rejects(files: DataFrame, route_spreadsheets: bool = True) -> DataFrame:
    """``(doc_id, filename, lane, reason)`` for each file that ``ingest_elements`` leaves out.

    Files over the size limit keep their message; the rest need a parser of
    their own (X1) for their suffix.
    """
    laned = with_lanes(files, route_spreadsheets)
    local = ((F.col("lane") == "direct") | ((F.col("lane") == "primary") & F.col("ext").isin(MARKUP_EXTS))
             | ((F.col("lane") == "tabular") & (F.col("ext") == ".csv")))
    reason = F.coalesce("reject_reason", F.concat(F.lit("no local parser for "), F.when(F.col("ext") == "", "files without suffix").otherwise(F.col("ext"))))
    return laned.where(~local).select("doc_id", "filename", "lane", reason.alias("reason"))


def parser_hook(files: DataFrame, parse_fn) -> DataFrame:
    """Run ``parse_fn(bytes, filename) -> [ {type, text, metadata} ]`` per file.

    The callable runs inside ``mapInPandas`` on each Arrow batch; failures of
    one file become a single ``Error`` element, never a failed job.
    """
    def parsed(doc_id, content, filename) -> list[tuple]:
        try:
            rows = []
            for i, e in enumerate(parse_fn(bytes(content) if content is not None else b"", filename) or []):
                md = e.get("metadata") or {}
                rows.append((doc_id, i, e.get("type"), e.get("text"), filename, md.get("page_number"), md.get("text_as_html"), "hook"))
            return rows
        except Exception as exc:  # noqa: BLE001 - failure is a row
            return [(doc_id, 0, "Error", f"{type(exc).__name__}: {exc}", filename, None, None, "hook")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(row for b in batches for args in zip(b["doc_id"], b["content"], b["filename"]) for row in parsed(*args))

    return files.select("doc_id", "content", "filename").mapInPandas(run, ELEMENT_SCHEMA)


__all__ = ["with_lanes", "direct_elements", "markup_to_elements", "union_lanes",
           "ingest_elements", "ingest_rejects", "tabular_elements", "parser_hook", "file_ext"]
