"""Registered ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import dims
from quarry.functions import files as ff
from quarry.operators import chunking, ingest
from quarry.operators import chunk_udtf as chunk_table
from quarry.plans.catalog import query
from quarry.plans.sqlgen import ext_sql, in_list, q, values
from quarry.sources import fixtures as fx
from quarry.sources.files import files_from_table
from quarry.sources.tables import table

EXT = ext_sql("filename")
TIERS_SQL = values([(e, t) for t, es in dims.FORMAT_TIERS.items() for e in es], ["ext2", "tier"])
INGESTABLE = sorted({e for es in dims.FORMAT_TIERS.values() for e in es} | set(dims.DIRECT_PARSE_EXTS))
LANE_SQL = (f"CASE WHEN ext IN {in_list(dims.TABULAR_ROUTE_EXTS)} THEN 'tabular' "
            f"WHEN n_bytes > {dims.MAX_FILE_SIZE_BYTES} THEN 'rejected' "
            f"WHEN ext IN {in_list(dims.DIRECT_PARSE_EXTS)} THEN 'direct' ELSE 'primary' END")
LANE_OFF_SQL = (f"CASE WHEN n_bytes > {dims.MAX_FILE_SIZE_BYTES} THEN 'rejected' "
                f"WHEN ext IN {in_list(dims.DIRECT_PARSE_EXTS)} THEN 'direct' ELSE 'primary' END")


def _files(spark, sf):
    return files_from_table(fx.v_files(spark, sf))


@query("scan_files", f"""
SELECT doc_id, filename, n_bytes, cast(octet_length(encode(content)) AS BIGINT) AS content_bytes
FROM v_files""")
def scan_files(spark, sf):
    f = _files(spark, sf)
    return f.select("doc_id", "filename", F.col("length").alias("n_bytes"),
                    F.octet_length("content").cast("bigint").alias("content_bytes"))


@query("format_tier", f"""
SELECT doc_id, filename, ext, tier FROM (SELECT doc_id, filename, {EXT} AS ext FROM v_files) f
LEFT JOIN {TIERS_SQL} ON f.ext = t.ext2""")
def format_tier(spark, sf):
    return ff.with_format_tier(_files(spark, sf)).select("doc_id", "filename", "ext", "tier")


@query("ingestable_filter", f"""
SELECT doc_id, filename FROM v_files WHERE {EXT} IN {in_list(INGESTABLE)}""")
def ingestable_filter(spark, sf):
    return ff.ingestable(_files(spark, sf)).select("doc_id", "filename")


@query("size_guard", f"""
SELECT doc_id, filename, n_bytes, n_bytes <= {dims.MAX_FILE_SIZE_BYTES} AS accepted,
  CASE WHEN n_bytes > {dims.MAX_FILE_SIZE_BYTES} THEN concat('File ', filename, ' (', printf('%.1f', n_bytes / 1048576.0),
  ' MB) exceeds the 50 MB limit for document parsing. Consider splitting the document or using a text-only strategy.') END AS reason
FROM v_files""")
def size_guard(spark, sf):
    f = _files(spark, sf)
    return f.select("doc_id", "filename", F.col("length").alias("n_bytes"),
                    (F.col("length") <= dims.MAX_FILE_SIZE_BYTES).alias("accepted"),
                    ff.size_reason(F.col("filename"), F.col("length")).alias("reason"))


@query("route_documents", f"""
SELECT doc_id, filename, {LANE_SQL} AS lane, {LANE_OFF_SQL} AS lane_unrouted
FROM (SELECT doc_id, filename, n_bytes, {EXT} AS ext FROM v_files) f""")
def route_documents(spark, sf):
    f = _files(spark, sf).withColumn("ext", ff.file_ext("filename"))
    return f.select("doc_id", "filename",
                    ff.route_lane(F.col("ext"), F.col("length"), True).alias("lane"),
                    ff.route_lane(F.col("ext"), F.col("length"), False).alias("lane_unrouted"))


def _opts_sql() -> str:
    fmts = "json,md,doctags"
    t = str(dims.DOCUMENT_TIMEOUT_S)
    std = {"to_formats": fmts, "do_table_structure": "true", "include_images": "true",
           "table_mode": "accurate", "pipeline": "standard", "image_export_mode": "embedded",
           "document_timeout": t, "abort_on_error": "false"}
    audio = {"to_formats": fmts, "pipeline": "asr", "document_timeout": t, "abort_on_error": "false"}
    tab = {"to_formats": fmts, "do_table_structure": "true", "include_images": "false",
           "table_mode": "accurate", "pipeline": "standard", "image_export_mode": "placeholder",
           "document_timeout": t, "abort_on_error": "false"}

    def txt(d):
        return q(";".join(f"{k}={v}" for k, v in sorted(d.items())))

    return (f"CASE WHEN ext IN {in_list(dims.FORMAT_TIERS['audio'])} THEN {txt(audio)} "
            f"WHEN ext IN {in_list(dims.FORMAT_TIERS['tabular'])} THEN {txt(tab)} "
            f"WHEN ext = '.pdf' THEN {txt({**std, 'do_ocr': 'true', 'pdf_backend': 'dlparse_v2'})} "
            f"WHEN ext IN {in_list(dims.FORMAT_TIERS['image'])} THEN {txt({**std, 'do_ocr': 'true'})} "
            f"ELSE {txt(std)} END")


@query("parse_options", f"""
SELECT doc_id, ext, {_opts_sql()} AS options FROM (SELECT doc_id, {EXT} AS ext FROM v_files) f""")
def parse_options(spark, sf):
    f = _files(spark, sf).withColumn("ext", ff.file_ext("filename"))
    return f.select("doc_id", "ext", ff.map_to_text(ff.parse_options(F.col("ext"))).alias("options"))


def _ct_sql() -> str:
    import mimetypes
    return values(sorted(mimetypes.MimeTypes(filenames=()).types_map[True].items()), ["e", "ct"])


@query("content_type", f"""
SELECT f.doc_id, f.filename, coalesce(a.ct, b.ct, 'application/octet-stream') AS content_type
FROM (SELECT doc_id, filename, CASE WHEN lower(filename) LIKE '%.tgz' OR filename LIKE '%.tar.gz' THEN '.tar'
  ELSE regexp_extract(regexp_extract(filename, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1) END AS raw FROM v_files) f
LEFT JOIN {_ct_sql().replace(' AS t(', ' AS a(')} ON f.raw = a.e
LEFT JOIN {_ct_sql().replace(' AS t(', ' AS b(')} ON lower(f.raw) = b.e""")
def content_type(spark, sf):
    return ff.with_content_type(_files(spark, sf)).select("doc_id", "filename", "content_type")


@query("direct_parse", f"""
SELECT doc_id, 'NarrativeText' AS type, content AS text FROM
(SELECT doc_id, content, n_bytes, {EXT} AS ext FROM v_files) f WHERE {LANE_SQL} = 'direct'""")
def direct_parse(spark, sf):
    laned = ingest.with_lanes(_files(spark, sf))
    return ingest.direct_elements(laned.where(F.col("lane") == "direct")).select("doc_id", "type", "text")


@query("sanitize_text", """
SELECT doc_id, replace(text, chr(0), '') AS text, cast(length(replace(text, chr(0), '')) AS INTEGER) AS n_chars
FROM documents""")
def sanitize_text(spark, sf):
    d = table(spark, sf, "documents")
    t = ff.sanitize_text(F.col("text"))
    return d.select("doc_id", t.alias("text"), F.length(t).alias("n_chars"))


@query("markup_to_elements")
def markup_to_elements(spark, sf):
    """G5 on ``pages.html``: element rows per page (literal cases in tests)."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "html", F.col("url").alias("filename"))
    return ingest.markup_to_elements(p).select("doc_id", "pos", "type", "text")


@query("union_lanes", f"""
SELECT doc_id, cast(0 AS INTEGER) AS pos, CASE WHEN lane = 'primary' THEN 'markup' ELSE lane END AS lane,
  CASE WHEN lane = 'tabular' THEN 'Table' ELSE 'NarrativeText' END AS type
FROM (SELECT doc_id, content, ext, {LANE_SQL} AS lane FROM (SELECT doc_id, content, n_bytes, {EXT} AS ext FROM v_files) f) x
WHERE lane = 'direct' OR (regexp_matches(content, '\\S') AND ((lane = 'primary' AND ext IN ('.html', '.htm')) OR (lane = 'tabular' AND ext = '.csv')))""")
def union_lanes(spark, sf):
    """Direct-lane texts, markup elements of ``.html`` files and tables of ``.csv`` files in one table."""
    el = ingest.ingest_elements(_files(spark, sf))
    return el.select("doc_id", "pos", "lane", "type")


@query("ingest_rejects", f"""
SELECT doc_id, filename, lane, CASE WHEN lane = 'rejected' THEN concat('File ', filename, ' (', printf('%.1f', n_bytes / 1048576.0),
  ' MB) exceeds the 50 MB limit for document parsing. Consider splitting the document or using a text-only strategy.')
  ELSE concat('no local parser for ', CASE WHEN ext = '' THEN 'files without suffix' ELSE ext END) END AS reason
FROM (SELECT *, {LANE_SQL} AS lane FROM (SELECT doc_id, filename, n_bytes, {EXT} AS ext FROM v_files) f) x
WHERE NOT (lane = 'direct' OR (lane = 'primary' AND ext IN ('.html', '.htm')) OR (lane = 'tabular' AND ext = '.csv'))""")
def ingest_rejects(spark, sf):
    """Every file that gives no element, with the reason."""
    return ingest.ingest_rejects(_files(spark, sf))


# Elements with their section number and heading path of three levels.
SECTION_SQL = """sec AS (SELECT *, sum(CASE WHEN type = 'Title' THEN 1 ELSE 0 END) OVER w AS section_no,
    coalesce(max(CASE WHEN level = 1 THEN pos END) OVER w, -1) AS p1, coalesce(max(CASE WHEN level = 2 THEN pos END) OVER w, -1) AS p2,
    coalesce(max(CASE WHEN level = 3 THEN pos END) OVER w, -1) AS p3, last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w AS t1,
    last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN level = 3 THEN text END IGNORE NULLS) OVER w AS t3
  FROM v_elements WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
el AS (SELECT doc_id, pos, type, text, section_no, nullif(concat_ws(' > ', CASE WHEN p1 > -1 THEN nullif(t1, '') END, CASE WHEN p2 > p1 THEN nullif(t2, '') END,
    CASE WHEN p3 > greatest(p1, p2) THEN nullif(t3, '') END), '') AS section_title FROM sec)"""


@query("section_path", f"WITH {SECTION_SQL} SELECT doc_id, pos, type, cast(section_no AS BIGINT) AS section_no, section_title FROM el")
def section_path(spark, sf):
    return chunking.section_path(fx.elements(spark, sf)).select(
        "doc_id", "pos", "type", "section_no", "section_title")


# Content elements with their section; costs in tokens of four characters.
CONTENT_SQL = SECTION_SQL + """,
content AS (SELECT *, greatest(1, length(text) // 4) AS cost, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY pos) AS i
  FROM el WHERE type <> 'Title' AND regexp_matches(text, '\\S'))"""
# Chunks (doc_id, section_no, section_title, first_pos, max_cost, body) -> pieces -> rows.
CHUNK_ROWS_SQL = """pieces AS (SELECT *, CASE WHEN max_cost > {budget} THEN substr(body, piece * 4 * {budget} + 1, 4 * {budget}) ELSE body END AS part
  FROM (SELECT *, unnest(range(0, CASE WHEN max_cost > {budget} THEN cast(ceil(length(body) / (4.0 * {budget})) AS BIGINT) ELSE 1 END)) AS piece FROM chunks) p),
texts AS (SELECT *, concat_ws(chr(10), section_title, part) AS text FROM pieces)
SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY first_pos, piece) AS INTEGER) AS chunk_no, text,
  cast(greatest(1, length(text) // 4) AS INTEGER) AS tokens, section_title, cast(NULL AS INTEGER) AS page_number, 'text' AS chunk_type
FROM texts WHERE regexp_matches(text, '\\S')"""


@query("chunk_documents", f"""WITH RECURSIVE {CONTENT_SQL},
fold(doc_id, section_no, i, pos, acc, chunk) AS (
  SELECT doc_id, section_no, i, pos, least(cost, 513), 1 FROM content WHERE i = 1
  UNION ALL
  SELECT c.doc_id, c.section_no, c.i, c.pos, CASE WHEN c.cost > 512 THEN 513 WHEN f.acc + c.cost > 512 THEN c.cost ELSE f.acc + c.cost END,
    f.chunk + CASE WHEN f.acc + c.cost > 512 THEN 1 ELSE 0 END
  FROM fold f JOIN content c ON c.doc_id = f.doc_id AND c.section_no = f.section_no AND c.i = f.i + 1),
chunks AS (SELECT c.doc_id, c.section_no, c.section_title, min(c.pos) AS first_pos, max(c.cost) AS max_cost, string_agg(c.text, chr(10) ORDER BY c.pos) AS body
  FROM content c JOIN fold f ON f.doc_id = c.doc_id AND f.section_no = c.section_no AND f.i = c.i GROUP BY c.doc_id, c.section_no, c.section_title, f.chunk),
{CHUNK_ROWS_SQL.format(budget=512)}""")
def chunk_documents(spark, sf):
    """W2 over every line element of every document."""
    return chunking.chunk_documents(fx.elements(spark, sf))


@query("chunk_udtf", f"""WITH {CONTENT_SQL},
chunks AS (SELECT doc_id, section_no, section_title, pos AS first_pos, cost AS max_cost, text AS body FROM content),
{CHUNK_ROWS_SQL.format(budget=128)}""")
def chunk_udtf(spark, sf):
    """The chunker as a SQL table function: budget 128 tokens, peers not merged."""
    chunk_table.register(spark)
    call = "SELECT * FROM chunk_elements(TABLE({elements}) PARTITION BY doc_id ORDER BY (pos), 128, false, 'chars4')"
    return spark.sql(call, elements=fx.elements(spark, sf))


# One element per file here: texts as they are, pages without markup, tables of unquoted rows.
TIER_SQL = rf"""WITH f AS (SELECT doc_id, content, n_bytes, {EXT} AS ext FROM v_files), g AS (SELECT *, {LANE_SQL} AS lane FROM f WHERE ext IN {in_list(INGESTABLE)}),
lines AS (SELECT doc_id, i, list_transform(string_split(all_lines[i], ','), lambda c: replace(regexp_replace(c, '^\s+|\s+$', '', 'g'), '|', '\|')) AS cells
  FROM (SELECT doc_id, string_split(content, chr(10)) AS all_lines FROM g WHERE lane = 'tabular' AND ext = '.csv') x, LATERAL (SELECT unnest(generate_series(1, len(all_lines))) AS i) y),
full_rows AS (SELECT *, row_number() OVER w AS k, first_value(len(cells)) OVER w AS width FROM lines WHERE len(list_filter(cells, lambda c: c <> '')) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
texts AS (SELECT doc_id, content AS text FROM g WHERE lane = 'direct'
  UNION ALL SELECT doc_id, trim(regexp_replace(content, '\s+', ' ', 'g')) FROM g WHERE lane = 'primary' AND ext IN ('.html', '.htm')
  UNION ALL SELECT doc_id, string_agg(concat('| ', array_to_string(list_resize(cells, width, ''), ' | '), ' |',
    CASE WHEN k = 1 THEN concat(chr(10), '| ', array_to_string(list_resize(CAST([] AS VARCHAR[]), width, '---'), ' | '), ' |') ELSE '' END), chr(10) ORDER BY k) FROM full_rows GROUP BY doc_id),
sized AS (SELECT doc_id, length(text) AS n FROM texts WHERE regexp_matches(text, '\S')),
counted AS (SELECT doc_id, CASE WHEN n // 4 > 512 THEN cast(ceil(n / 2048.0) AS BIGINT) ELSE 1 END AS n_chunks,
  CASE WHEN n // 4 > 512 THEN (n // 2048) * 512 + CASE WHEN n % 2048 > 0 THEN greatest(1, (n % 2048) // 4) ELSE 0 END ELSE greatest(1, n // 4) END AS tokens FROM sized)
SELECT t.tier, g.lane, count(*) AS n_files, cast(coalesce(sum(n_chunks), 0) AS BIGINT) AS n_chunks, cast(coalesce(sum(tokens), 0) AS BIGINT) AS tokens
FROM g LEFT JOIN {TIERS_SQL} ON g.ext = t.ext2 LEFT JOIN counted USING (doc_id) GROUP BY t.tier, g.lane"""


@query("chunks_per_tier", TIER_SQL)
def chunks_per_tier(spark, sf):
    """Flagship: files -> P1-P4 -> F2 | G5 -> U1 -> F1 -> W1/W2 -> chunk counts per tier and lane."""
    files = _files(spark, sf)
    laned = ingest.with_lanes(ff.ingestable(files))
    el = ingest.ingest_elements(ff.ingestable(files))
    chunks = chunking.chunk_documents(el.select("doc_id", "pos", "type", "text", "page_number"))
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"))
    return (laned.select("doc_id", "tier", "lane").join(per_doc, "doc_id", "left")
            .groupBy("tier", "lane")
            .agg(F.count("*").alias("n_files"),
                 F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("bigint").alias("n_chunks"),
                 F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens")))


LABEL_SQL = "CASE pos % 5 WHEN 0 THEN 'section_header' WHEN 4 THEN 'list_item' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'caption' ELSE 'group' END"


@query("label_to_type", f"""SELECT doc_id, pos, label, CASE label WHEN 'section_header' THEN 'Title' WHEN 'list_item' THEN 'ListItem'
  WHEN 'paragraph' THEN 'NarrativeText' WHEN 'caption' THEN 'NarrativeText' ELSE 'container' END AS element_type
FROM (SELECT doc_id, pos, {LABEL_SQL} AS label FROM v_elements) x""")
def label_to_type(spark, sf):
    """layout labels -> element types through the fixed label map; unmapped labels are containers."""
    from quarry import dims
    el = fx.elements(spark, sf).withColumn("label", F.expr(LABEL_SQL))
    return el.select("doc_id", "pos", "label",
                     F.coalesce(F.element_at(dims.label_map_column(), F.col("label")), F.lit("container"))
                     .alias("element_type"))


def _paragraph_hook(content: bytes, filename: str):
    """Example user parser: blank-line separated paragraphs (first one as Title)."""
    text = content.decode("utf-8", errors="replace")
    paras = [p for p in text.split("\n\n") if p.strip()] or [text]
    return [{"type": "Title" if i == 0 else "NarrativeText", "text": p, "metadata": {"filename": filename}}
            for i, p in enumerate(paras)]


@query("parser_hook", f"""
SELECT doc_id, cast(i - 1 AS INTEGER) AS pos, CASE WHEN i = 1 THEN 'Title' ELSE 'NarrativeText' END AS type, paras[i] AS text
FROM (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE [content] END AS paras FROM (
  SELECT doc_id, content, list_filter(string_split(content, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S')) AS p
  FROM (SELECT doc_id, content, n_bytes, {EXT} AS ext FROM v_files) f
  WHERE {LANE_SQL} = 'primary' AND ext IN {in_list(INGESTABLE)} AND ext NOT IN ('.html', '.htm')) y) z,
LATERAL (SELECT unnest(generate_series(1, len(paras))) AS i) g""")
def parser_hook(spark, sf):
    """Ingestable primary-lane files that have no local parser go through a user callable in ``mapInPandas``."""
    laned = ingest.with_lanes(ff.ingestable(_files(spark, sf)))
    prim = laned.where((F.col("lane") == "primary") & ~F.col("ext").isin(".html", ".htm"))
    return ingest.parser_hook(prim, _paragraph_hook).select("doc_id", "pos", "type", "text")


@query("layout_to_elements", """WITH l AS (SELECT doc_id, pos, text, pos // 4 AS g, pos % 4 AS k FROM v_elements),
visits AS (SELECT doc_id, pos, text, g, CASE k WHEN 0 THEN 0 ELSE k + 1 END AS step FROM l
  UNION ALL SELECT doc_id, pos, text, g, 1 FROM l WHERE k = 3),
typed AS (SELECT *, CASE WHEN pos % 9 = 8 THEN 'Table' WHEN pos % 7 = 6 THEN 'Image' WHEN pos % 5 = 0 THEN 'Title' WHEN pos % 5 = 4 THEN 'ListItem'
  WHEN pos % 5 = 3 THEN 'Header' ELSE 'NarrativeText' END AS type FROM visits),
made AS (SELECT *, CASE WHEN type = 'Table' THEN concat('| ', text, ' |  |', chr(10), '| --- | --- |') ELSE text END AS shown FROM typed)
SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY g, step) - 1 AS INTEGER) AS pos, type, shown AS text, cast(g + 1 AS INTEGER) AS page_number,
  CASE WHEN type = 'Table' THEN concat('<table><tr><th colspan="2">', text, '</th></tr></table>') END AS text_as_html,
  CASE WHEN type = 'Image' THEN concat('AA', cast(pos AS VARCHAR)) END AS image_base64, CASE WHEN type = 'Image' THEN 'image/png' END AS filetype
FROM made WHERE shown <> '' OR type = 'Image'""")
def layout_to_elements(spark, sf):
    """G3 + F20: layout records of all documents -> elements in reading order."""
    from quarry.operators import layout
    return layout.layout_to_elements(fx.v_layouts(spark, sf))
