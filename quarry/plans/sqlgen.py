"""Small helpers that render fixed Python tables as SQL text for the oracle."""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], cols: list[str]) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else ("NULL" if v is None else str(v))
                                     for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({', '.join(cols)})"


def in_list(items: list[str]) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


EXT_SQL = "lower(regexp_extract(regexp_extract({c}, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1))"


def ext_sql(col: str) -> str:
    return EXT_SQL.format(c=col)
