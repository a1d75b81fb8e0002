"""Registered page-batch, table and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import files as ff
from quarry.functions import text as tf
from quarry.operators import outcomes, tables
from quarry.plans.catalog import query
from quarry.sources import fixtures as fx
from quarry.sources.tables import table

BATCH = 20


@query("page_ranges", f"""SELECT doc_id, start_page, CASE WHEN batched THEN least(start_page + {BATCH - 1}, pages) ELSE pages END AS end_page,
  CASE WHEN batched THEN concat('pages ', cast(start_page AS VARCHAR), '-', cast(least(start_page + {BATCH - 1}, pages) AS VARCHAR))
       ELSE 'whole document' END AS label, batched
FROM (SELECT doc_id, pages, pages > {BATCH} AS batched,
  unnest(CASE WHEN pages > {BATCH} THEN generate_series(1, pages, {BATCH}) ELSE [1] END) AS start_page FROM v_pages) x""")
def page_ranges(spark, sf):
    return outcomes.page_ranges(fx.v_pages(spark, sf), BATCH)


def _batches(spark, sf):
    r = outcomes.page_ranges(fx.v_pages(spark, sf), BATCH)
    return r.select(
        "doc_id", "start_page", "label",
        ((F.col("doc_id") + F.col("start_page")) % 7 == 0).alias("failed"),
        F.transform(F.sequence(F.col("start_page"), F.col("end_page")),
                    lambda p: F.concat(F.lit("page "), p.cast("string"))).alias("elements"),
        F.when(F.col("start_page") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("dt"), F.col("start_page").cast("string"))).alias("doctags"),
        F.when(F.col("start_page") % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("# Part "), F.col("start_page").cast("string"))).alias("md"),
        F.concat(F.lit('{"start":'), F.col("start_page").cast("string"), F.lit("}")).alias("json"))


MERGE_SQL = f"""WITH r AS (SELECT doc_id, pages, start_page, CASE WHEN batched THEN least(start_page + {BATCH - 1}, pages) ELSE pages END AS end_page,
  CASE WHEN batched THEN concat('pages ', cast(start_page AS VARCHAR), '-', cast(least(start_page + {BATCH - 1}, pages) AS VARCHAR))
       ELSE 'whole document' END AS label
  FROM (SELECT doc_id, pages, pages > {BATCH} AS batched,
    unnest(CASE WHEN pages > {BATCH} THEN generate_series(1, pages, {BATCH}) ELSE [1] END) AS start_page FROM v_pages) x),
b AS (SELECT *, (doc_id + start_page) % 7 = 0 AS failed FROM r),
m AS (SELECT doc_id,
  cast(coalesce(sum(end_page - start_page + 1) FILTER (WHERE NOT failed), 0) AS INTEGER) AS n_elements,
  coalesce(string_agg(concat('dt', cast(start_page AS VARCHAR)), chr(10) ORDER BY start_page) FILTER (WHERE NOT failed AND start_page % 3 <> 0), '') AS doctags,
  coalesce(string_agg(concat('# Part ', cast(start_page AS VARCHAR)), chr(10) || chr(10) ORDER BY start_page) FILTER (WHERE NOT failed AND start_page % 4 <> 1), '') AS md,
  coalesce(string_agg(label, ',' ORDER BY start_page) FILTER (WHERE failed), '') AS failed_batches,
  cast(count_if(failed) AS INTEGER) AS n_failed
  FROM b GROUP BY doc_id)"""


def _merged(spark, sf):
    return outcomes.merge_page_batches(_batches(spark, sf))


@query("merge_page_batches", MERGE_SQL + " SELECT doc_id, n_elements, doctags, md, failed_batches, n_failed FROM m")
def merge_page_batches(spark, sf):
    m = _merged(spark, sf)
    return m.select("doc_id", F.size("elements").alias("n_elements"), "doctags", "md",
                    F.array_join("failed_batches", ",").alias("failed_batches"), "n_failed")


@query("document_outcome", MERGE_SQL + """ SELECT doc_id, CASE WHEN n_elements = 0 AND n_failed > 0 THEN 'failed'
  WHEN n_failed > 0 THEN 'partial' WHEN n_elements = 0 THEN 'empty' ELSE 'parsed' END AS outcome FROM m""")
def document_outcome(spark, sf):
    return outcomes.document_outcome(_merged(spark, sf)).select("doc_id", "outcome")


# one table per nation and thousand customers, so a table stays small whatever the number of customers
TABLE_ID = "sheet + 100 * cast(floor(row_no / 1000) as bigint)"
TABLE_SQL = "sheet + 100 * (row_no // 1000)"


def _cells(spark, sf):
    r = fx.v_rows(spark, sf)
    r0 = (F.col("row_no") % 50).cast("int")
    base = r.select(F.expr(TABLE_ID).alias("table_id"), "row_no", r0.alias("r0"), "c0", "c1")
    a = base.select("table_id", (F.col("row_no") * 2).alias("cell_no"), F.col("c0").alias("text"), "r0",
                    F.lit(0).alias("c0"))
    b = base.where(F.col("c1").isNotNull()).select("table_id", (F.col("row_no") * 2 + 1).alias("cell_no"),
                                                   F.col("c1").alias("text"), "r0", F.lit(1).alias("c0"))
    return a.unionByName(b)


def _shapes(spark, sf):
    r = fx.v_rows(spark, sf)
    rows = F.max((F.col("row_no") % 50).cast("int")) + 1
    return r.groupBy(F.expr(TABLE_ID).alias("table_id")).agg(rows.alias("num_rows"), F.lit(2).alias("num_cols")).withColumn(
        "num_rows", F.when(F.col("table_id") % 10 == 3, 0).otherwise(F.col("num_rows")))


CELLS_SQL = f"""cells AS (SELECT {TABLE_SQL} AS table_id, row_no * 2 AS cell_no, c0 AS text, cast(row_no % 50 AS INTEGER) AS r0, 0 AS c0 FROM v_rows
  UNION ALL SELECT {TABLE_SQL}, row_no * 2 + 1, c1, cast(row_no % 50 AS INTEGER), 1 FROM v_rows WHERE c1 IS NOT NULL),
shapes AS (SELECT {TABLE_SQL} AS table_id, CASE WHEN ({TABLE_SQL}) % 10 = 3 THEN 0 ELSE cast(max(row_no % 50) + 1 AS INTEGER) END AS num_rows, 2 AS num_cols
  FROM v_rows GROUP BY {TABLE_SQL})"""


@query("cells_to_markdown", f"""WITH {CELLS_SQL},
g AS (SELECT table_id, r0, c0, arg_max(text, cell_no) AS text FROM cells GROUP BY ALL),
grid AS (SELECT s.table_id, r.r0, c.c0, s.num_cols FROM shapes s, LATERAL (SELECT unnest(range(0, s.num_rows)) AS r0) r,
  LATERAL (SELECT unnest(range(0, s.num_cols)) AS c0) c),
f AS (SELECT grid.table_id, grid.r0, grid.c0, grid.num_cols, coalesce(g.text, '') AS text FROM grid
  LEFT JOIN g ON g.table_id = grid.table_id AND g.r0 = grid.r0 AND g.c0 = grid.c0),
l AS (SELECT table_id, r0, concat('| ', string_agg(text, ' | ' ORDER BY c0), ' |',
  CASE WHEN r0 = 0 THEN concat(chr(10), '| ', array_to_string(list_transform(range(0, any_value(num_cols)), lambda i: '---'), ' | '), ' |') ELSE '' END) AS line
  FROM f GROUP BY table_id, r0)
SELECT s.table_id, coalesce(string_agg(line, chr(10) ORDER BY r0), '') AS markdown FROM shapes s LEFT JOIN l ON l.table_id = s.table_id GROUP BY s.table_id""")
def cells_to_markdown(spark, sf):
    return tables.cells_to_markdown(_cells(spark, sf), _shapes(spark, sf))


@query("cells_to_html", f"""WITH {CELLS_SQL},
c AS (SELECT table_id, cell_no, r0, c0, concat(CASE WHEN r0 = 0 THEN '<th' ELSE '<td' END,
  CASE WHEN row_no7 THEN ' rowspan="2"' ELSE '' END, '>', coalesce(text, ''), CASE WHEN r0 = 0 THEN '</th>' ELSE '</td>' END) AS h
  FROM (SELECT *, (cell_no // 2) % 7 = 0 AS row_no7 FROM cells) x),
rows AS (SELECT s.table_id, r.r0 FROM shapes s, LATERAL (SELECT unnest(range(0, s.num_rows)) AS r0) r),
tr AS (SELECT rows.table_id, rows.r0, concat('<tr>', coalesce(string_agg(c.h, '' ORDER BY c.c0, c.cell_no), ''), '</tr>') AS tr
  FROM rows LEFT JOIN c ON c.table_id = rows.table_id AND c.r0 = rows.r0 GROUP BY rows.table_id, rows.r0)
SELECT s.table_id, concat('<table>', coalesce(string_agg(tr, '' ORDER BY r0), ''), '</table>') AS html FROM shapes s LEFT JOIN tr ON tr.table_id = s.table_id GROUP BY s.table_id""")
def cells_to_html(spark, sf):
    """A10: header cells on row 0; rows whose source row_no % 7 == 0 span two rows."""
    c = _cells(spark, sf)
    c = c.select("table_id", "cell_no", "text", "r0", "c0",
                 F.when(F.floor(F.col("cell_no") / 2) % 7 == 0, F.col("r0") + 2).alias("r1"),
                 (F.col("c0") + 1).alias("c1"), (F.col("r0") == 0).alias("header"))
    return tables.cells_to_html(c, _shapes(spark, sf))


@query("sheet_to_markdown", r"""WITH r AS (SELECT sheet % 5 + 100 * (row_no // 1000) AS workbook, sheet AS sheet_no, concat('sheet', cast(sheet AS VARCHAR)) AS title, row_no,
  regexp_replace(replace(replace(coalesce(CASE WHEN row_no % 11 = 0 THEN NULL ELSE c0 END, ''), chr(10), ' '), '|', '\|'), '^\s+|\s+$', '', 'g') AS a,
  regexp_replace(replace(replace(coalesce(c1, ''), chr(10), ' '), '|', '\|'), '^\s+|\s+$', '', 'g') AS b FROM v_rows),
nb AS (SELECT *, row_number() OVER (PARTITION BY workbook, sheet_no ORDER BY row_no) AS k FROM r WHERE a <> '' OR b <> ''),
s AS (SELECT workbook, sheet_no, title, string_agg(concat('| ', a, ' | ', b, ' |', CASE WHEN k = 1 THEN concat(chr(10), '| --- | --- |') ELSE '' END),
  chr(10) ORDER BY row_no) AS body FROM nb GROUP BY ALL)
SELECT workbook, 'Table' AS type, trim(string_agg(concat('## ', title, chr(10), chr(10), body), chr(10) || chr(10) ORDER BY sheet_no)) AS text
FROM s GROUP BY workbook""")
def sheet_to_markdown(spark, sf):
    """Customers as workbook rows (a workbook per thousand customers and nation % 5, a sheet per nation), two cells per row."""
    r = fx.v_rows(spark, sf)
    rows = r.select(F.expr("sheet % 5 + 100 * cast(floor(row_no / 1000) as bigint)").alias("workbook"), F.col("sheet").alias("sheet_no"),
                    F.concat(F.lit("sheet"), F.col("sheet").cast("string")).alias("title"), "row_no",
                    F.array(F.when(F.col("row_no") % 11 == 0, F.lit(None)).otherwise(F.col("c0")), F.col("c1")).alias("cells"))
    return tables.sheet_to_markdown(rows)


@query("format_size", """SELECT doc_id, CASE WHEN b < 1024 THEN concat(cast(b AS VARCHAR), ' B')
  WHEN b < 1048576 THEN concat(printf('%.1f', b / 1024.0), ' KB') ELSE concat(printf('%.1f', b / 1048576.0), ' MB') END AS size_text
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 40 ELSE n_chars * 4000 END AS b FROM documents) x""")
def format_size(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 3
    b = F.when(k == 0, F.col("n_chars")).when(k == 1, F.col("n_chars") * 40).otherwise(F.col("n_chars") * 4000)
    return d.select("doc_id", tf.format_size(b).alias("size_text"))


@query("format_datetime", """SELECT event_id, CASE WHEN raw IS NULL THEN 'N/A'
  WHEN raw = 'soon' THEN raw ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS shown
FROM (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN 'Z' WHEN 3 THEN '+02:00' WHEN 4 THEN '-05:30' WHEN 1 THEN NULL ELSE 'soon' END AS raw FROM events) x""")
def format_datetime(spark, sf):
    """F8 on times in UTC, with two offsets (shown as written), null and no time at all."""
    e = table(spark, sf, "events")
    k, stamp = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (F.when(k == 0, F.concat(stamp, F.lit("Z"))).when(k == 3, F.concat(stamp, F.lit("+02:00")))
           .when(k == 4, F.concat(stamp, F.lit("-05:30"))).when(k == 1, F.lit(None).cast("string")).otherwise(F.lit("soon")))
    return e.select("event_id", tf.format_datetime(raw).alias("shown"))


MAPPINGS = [("k_value", "k"), ("same", "$.k"), ("absent", "x.y")]


@query("json_mappings", """SELECT event_id, variable, CASE WHEN variable <> 'absent' THEN json_extract_string(props, '$.k') END AS value
FROM events, (VALUES ('k_value'), ('same'), ('absent')) v(variable)""")
def json_mappings(spark, sf):
    """a table of response-variable mappings over ``events.props``."""
    return tf.mapped_values(table(spark, sf, "events"), "event_id", "props", MAPPINGS)


BODY_SQL = """CASE event_id % 6 WHEN 0 THEN concat('{"detail":"d', cast(event_id AS VARCHAR), '"}') WHEN 1 THEN '{"detail":{"detail":"inner"}}'
  WHEN 2 THEN '{"error":{"message":"m"},"retry_after":7}' WHEN 3 THEN 'no json' WHEN 4 THEN '{"detail":null,"retry_after":"12"}' ELSE NULL END"""


@query("error_detail", f"""SELECT event_id, code, CASE event_id % 6 WHEN 0 THEN concat('d', cast(event_id AS VARCHAR)) WHEN 1 THEN 'inner' WHEN 2 THEN 'm'
  ELSE concat('API request failed with status ', cast(code AS VARCHAR)) END AS message,
  CASE WHEN code = 429 THEN CASE event_id % 6 WHEN 2 THEN 7 WHEN 4 THEN 12 END END AS retry_after
FROM (SELECT event_id, CASE WHEN event_id % 4 = 2 THEN 429 ELSE cast(400 + event_id % 150 AS INTEGER) END AS code FROM events) x""")
def error_detail(spark, sf):
    """message and retry time of error answers."""
    e = table(spark, sf, "events").select("event_id", F.expr("cast(CASE WHEN event_id % 4 = 2 THEN 429 ELSE 400 + event_id % 150 END as int)").alias("code"),
                                          F.expr(BODY_SQL.replace("VARCHAR", "STRING")).alias("body"))
    return e.select("event_id", "code", tf.error_message(F.col("body"), F.col("code")).alias("message"), tf.retry_after(F.col("body"), F.col("code")).alias("retry_after"))


@query("token_estimate", "SELECT doc_id, cast(greatest(1, length(text) // 4) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark, sf):
    """F5 over all documents."""
    return table(spark, sf, "documents").select("doc_id", tf.token_estimate(F.col("text")).alias("tokens"))


@query("registry_freshness", """SELECT s_suppkey AS key, source, CASE source WHEN 'fetch' THEN concat('new', cast(s_suppkey AS VARCHAR)) WHEN 'none' THEN NULL
  ELSE concat('old', cast(s_suppkey AS VARCHAR)) END AS registry, source = 'stale' AS is_stale
FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'none' WHEN s_suppkey % 7 <> 0 AND s_suppkey % 50 <= 24 AND s_suppkey % 5 <> 0 THEN 'cache'
  WHEN s_suppkey % 3 <> 0 THEN 'fetch' WHEN s_suppkey % 7 <> 0 THEN 'stale' ELSE 'none' END AS source FROM supplier) x""")
def registry_freshness(spark, sf):
    """caches of 0 to 49 hours (some of another host, some missing) and fetches of which a third failed."""
    from quarry.operators.preflight import registry_freshness as fresh

    s, k = table(spark, sf, "supplier"), F.col("s_suppkey")
    now = F.lit("2024-06-10 00:00:00").cast("timestamp")
    requests = s.select(k.alias("key"), F.when(k % 11 != 0, F.lit("https://api.example.org")).alias("host"), now.alias("now"))
    caches = s.where(k % 7 != 0).select(k.alias("key"), F.when(k % 5 == 0, F.lit("https://old.example.org")).otherwise(F.lit("https://api.example.org//")).alias("host"),
                                       F.timestamp_seconds(F.unix_timestamp(now) - k % 50 * 3600).alias("fetched_at"), F.concat(F.lit("old"), k.cast("string")).alias("registry"))
    fetched = s.where(k % 3 != 0).select(k.alias("key"), F.concat(F.lit("new"), k.cast("string")).alias("registry"))
    return fresh(requests, caches, fetched)


@query("error_class", """SELECT doc_id, attempt, code, CASE WHEN code IN (400, 422) THEN 'ValidationError'
  WHEN code = 401 THEN 'AuthenticationError' WHEN code = 403 THEN 'AuthorizationError' WHEN code = 404 THEN 'NotFoundError'
  WHEN code = 409 THEN 'ConflictError' WHEN code = 429 THEN 'RateLimitError' WHEN code >= 500 THEN 'ServerError'
  ELSE 'APIError' END AS error_class
FROM (SELECT doc_id, attempt, cast(substr(result, 6) AS INTEGER) AS code FROM v_attempts WHERE starts_with(result, 'http_')) x""")
def error_class(spark, sf):
    """HTTP status -> error class over the attempt log's HTTP failures."""
    a = fx.v_attempts(spark, sf).where(F.col("result").startswith("http_"))
    code = F.substring("result", 6, 3).cast("int")
    return a.select("doc_id", "attempt", code.alias("code"), tf.error_class(code).alias("error_class"))


@query("parse_json_object", """SELECT event_id, CASE WHEN raw IS NULL THEN '{}' WHEN json_valid(raw) AND json_type(raw) = 'OBJECT'
  THEN json(raw) END AS value,
  CASE WHEN raw IS NULL THEN NULL WHEN NOT json_valid(raw) THEN 'Invalid JSON'
       WHEN json_type(raw) <> 'OBJECT' THEN 'Input must be a JSON object' END AS error
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN NULL WHEN 2 THEN '[1,2]' ELSE 'nope{' END AS raw FROM events) x""")
def parse_json_object(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.lit(None).cast("string")) \
        .when(k == 2, F.lit("[1,2]")).otherwise(F.lit("nope{"))
    value, err = tf.parse_json_object(raw)
    return e.select("event_id", value.alias("value"), err.alias("error"))


@query("upload_check", """SELECT doc_id, filename, CASE WHEN doc_id % 4 = 0 THEN true
  ELSE list_contains(['.pdf', '.txt', '.md'], ext) END AND n_bytes <= 20000000 AS accepted
FROM (SELECT doc_id, filename, n_bytes, lower(regexp_extract(regexp_extract(filename, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)) AS ext
  FROM v_files) x""")
def upload_check(spark, sf):
    """Files against a node's accepted formats (``pdf``, ``.TXT``, ``md``; any when unset) and 20 MB max."""
    f = fx.v_files(spark, sf)
    accepted = F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("array<string>")) \
        .otherwise(F.array(F.lit("pdf"), F.lit(".TXT"), F.lit("md")))
    return f.select("doc_id", "filename",
                    ff.upload_ok(ff.file_ext("filename"), F.col("n_bytes"), accepted, F.lit(20_000_000)).alias("accepted"))
