"""The stand-in views as ANSI SQL, for the DuckDB oracle.

``with_views(sql)`` prefixes a query with exactly the CTEs it mentions
(and their dependencies), so every oracle query is self-contained.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "v_line": """SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey,
  max(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag
  FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "v_nodes": """SELECT l_orderkey AS workflow_id, l_linenumber AS pos, concat('n', cast(l_linenumber AS VARCHAR)) AS slug,
  CASE l_partkey % 6 WHEN 0 THEN 'plain_txt_input' WHEN 1 THEN 'llm_call' WHEN 2 THEN 'retrieve'
  WHEN 3 THEN 'rag_agent' WHEN 4 THEN 'structured_output' ELSE 'document_extraction' END AS type
  FROM v_line""",
    "v_workflows": """SELECT l_orderkey AS workflow_id, concat('n', cast(min(l_linenumber) AS VARCHAR)) AS entry,
  concat('n', cast(max(l_linenumber) + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS exit
  FROM v_line GROUP BY l_orderkey""",
    "v_edges": """SELECT workflow_id, concat('n', cast(pos AS VARCHAR)) AS src, concat('n', cast(nxt AS VARCHAR)) AS dst, 'STATIC' AS type
  FROM (SELECT l_orderkey AS workflow_id, l_linenumber AS pos, l_returnflag,
        coalesce(lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), l_linenumber + 1) AS nxt
        FROM v_line) t
  WHERE l_returnflag <> 'R'
  UNION ALL SELECT l_orderkey, concat('n', cast(l_linenumber AS VARCHAR)), concat('n', cast(min_ln AS VARCHAR)),
    CASE WHEN l_returnflag = 'A' THEN 'RECURSIVE' ELSE 'STATIC' END
  FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS min_ln
        FROM v_line) u
  WHERE l_quantity > 45""",
    "v_refs": """SELECT l_orderkey AS workflow_id, concat('n', cast(l_linenumber AS VARCHAR)) AS node,
  concat('agent:', CASE WHEN l_linenumber % 4 = 0 THEN 'nobody' ELSE upper(s_name) END) AS ref
  FROM v_line JOIN supplier ON l_suppkey = s_suppkey""",
    "v_templates": """SELECT l_orderkey AS workflow_id, concat('n', cast(l_linenumber AS VARCHAR)) AS node,
  CASE WHEN l_partkey % 7 = 0 THEN 'Nothing to fill in'
       WHEN l_partkey % 5 = 0 THEN concat('From {{n', cast(l_linenumber - 1 AS VARCHAR), '}} on')
       ELSE concat('Use {{n', cast(l_linenumber - 1 AS VARCHAR), '.output.text}} then {{n', cast(l_suppkey % 9 AS VARCHAR), '.output.files}}') END AS template
  FROM v_line""",
    "v_branches": """SELECT l_orderkey AS join_id, l_linenumber AS seq, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity END AS v
  FROM v_line""",
    "v_attempts": """SELECT l_orderkey AS doc_id, l_linenumber AS attempt,
  CASE l_partkey % 6 WHEN 0 THEN 'success' WHEN 1 THEN 'connection_error' WHEN 2 THEN 'read_timeout'
  WHEN 3 THEN 'http_503' WHEN 4 THEN 'http_422' ELSE 'failure' END AS result
  FROM v_line""",
    "v_pages": """SELECT doc_id, cast(floor(n_chars / 300.0) AS BIGINT) + 1 AS pages FROM documents""",
    "v_files": """SELECT doc_id, concat('f', cast(doc_id AS VARCHAR), CASE doc_id % 8 WHEN 0 THEN '.txt' WHEN 1 THEN '.md'
  WHEN 2 THEN '.PDF' WHEN 3 THEN '.xlsx' WHEN 4 THEN '.csv' WHEN 5 THEN '.html' WHEN 6 THEN '.exe'
  ELSE CASE doc_id % 24 WHEN 7 THEN '.tar.gz' WHEN 15 THEN '.TGZ' ELSE '' END END) AS filename,
  text AS content, n_chars * 4000 AS n_bytes
  FROM documents""",
    "v_run_events": """SELECT concat('r', cast(user_id AS VARCHAR), '-', cast(month(ts)*100 + day(ts) AS VARCHAR)) AS run_id,
  event_id AS seq, ts,
  CASE event_type WHEN 'signup' THEN 'STEP_STARTED' WHEN 'click' THEN 'step_finished' WHEN 'error' THEN 'STEP_ERROR'
  WHEN 'view' THEN 'STATE_DELTA' ELSE CASE WHEN event_id % 3 = 0 THEN 'RUN_FINISHED'
  WHEN event_id % 3 = 1 THEN 'WAITING_FOR_REVIEW' WHEN event_id % 2 = 0 THEN 'STATE_SNAPSHOT' ELSE 'MYSTERY' END END AS event_type,
  concat('n', cast(event_id % 4 AS VARCHAR)) AS node_id,
  CASE WHEN event_id % 2 = 0 THEN cast(floor(value * 10) AS BIGINT) END AS duration_ms
  FROM events""",
    "v_event_lines": """SELECT run_id, seq, ts,
  CASE WHEN seq % 7 = 0 THEN ': keep-alive' WHEN seq % 11 = 0 THEN 'data: not-json'
  ELSE concat('data: {"type":"', event_type, '","node_id":"', node_id, '"',
    CASE WHEN duration_ms IS NOT NULL THEN concat(',"duration_ms":', cast(duration_ms AS VARCHAR)) ELSE '' END,
    CASE WHEN event_type = 'STATE_DELTA' THEN concat(',"delta":[{"op":"', CASE WHEN seq % 5 = 0 THEN 'remove' ELSE 'replace' END,
      '","path":"/node_outputs/', node_id, CASE seq % 8 WHEN 3 THEN '/part' WHEN 4 THEN '~1x~0' ELSE '' END, '","value":"v', cast(seq AS VARCHAR), '"}]')
      WHEN event_type = 'STATE_SNAPSHOT' THEN concat(',"snapshot":{"node_outputs":{"', node_id, '":"s', cast(seq AS VARCHAR), '"}}') ELSE '' END, '}') END AS line
  FROM v_run_events""",
    "v_rows": """SELECT c_nationkey AS sheet, c_custkey AS row_no, c_name AS c0,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat(c_mktsegment, '|x') END AS c1
  FROM customer""",
    "v_elements": """SELECT doc_id, cast(pos - 1 AS INTEGER) AS pos,
  CASE WHEN (pos - 1) % 5 = 0 THEN 'Title' WHEN (pos - 1) % 5 = 4 THEN 'ListItem' ELSE 'NarrativeText' END AS type,
  text, CASE WHEN (pos - 1) % 5 = 0 THEN cast(((pos - 1) // 5) % 3 + 1 AS INTEGER) END AS level
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) x""",
    "v_node_cfg": """SELECT l_orderkey AS workflow_id, concat('n', cast(l_linenumber AS VARCHAR)) AS slug,
  CASE l_partkey % 6 WHEN 0 THEN 'plain_txt_input' WHEN 1 THEN 'llm_call' WHEN 2 THEN 'retrieve'
  WHEN 3 THEN 'rag_agent' WHEN 4 THEN 'structured_output' ELSE 'document_extraction' END AS type,
  l_linenumber AS ln, l_quantity / 20 AS temperature, (l_linenumber - 2) * 100 AS maxTokens,
  l_linenumber - 2 AS topK, l_quantity / 40 AS scoreThreshold,
  CASE WHEN l_linenumber % 3 <> 0 THEN concat('agent-', cast(l_suppkey AS VARCHAR)) END AS agent_name,
  l_linenumber % 2 = 1 AS has_kb_names,
  concat('{{n', cast(l_partkey % 8 AS VARCHAR), '.output.note}}', 'Use {{n', cast(l_linenumber - 1 AS VARCHAR), '.output.text}} then {{n', cast(l_suppkey % 9 AS VARCHAR), '.output.files}}') AS template
  FROM v_line""",
    "v_events": """SELECT run_id, seq, ts, body, coalesce(json_extract_string(body, '$.type'), 'UNKNOWN') AS event_type,
  upper(coalesce(json_extract_string(body, '$.type'), 'UNKNOWN')) AS etype
  FROM (SELECT run_id, seq, ts, trim(substr(trim(line), 6)) AS body FROM v_event_lines
        WHERE starts_with(trim(line), 'data:')) x
  WHERE json_valid(body) AND json_type(body) = 'OBJECT'""",
    "v_runs": """SELECT o_orderkey AS run_id, o_orderkey AS workflow_id,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'running' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE
    CASE o_orderkey % 3 WHEN 0 THEN 'waiting_for_review' WHEN 1 THEN 'WAITING_FOR_INPUT' ELSE 'RUNNING' END END AS execution_status,
  'n1' AS current_node_id, o_custkey % 4 AS hist_n, o_custkey % 3 AS out_n,
  o_orderdate AS started_at, o_custkey AS workspace_id, o_orderpriority AS priority
  FROM orders""",
}

_ORDER = list(VIEWS)


def _deps(name: str) -> list[str]:
    body = VIEWS[name]
    return [v for v in _ORDER if v != name and re.search(rf"\b{v}\b", body)]


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs it (transitively) mentions, in dependency order."""
    needed: list[str] = []

    def visit(v: str) -> None:
        if v in needed:
            return
        for d in _deps(v):
            visit(d)
        needed.append(v)

    for v in _ORDER:
        if re.search(rf"\b{v}\b", sql):
            visit(v)
    if not needed:
        return sql
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in needed)
    body = sql.lstrip()
    head = body[:40].upper()
    if head.startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].lstrip()}"
    if head.startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH'):].lstrip()}"
    return f"WITH {ctes}\n{sql}"
