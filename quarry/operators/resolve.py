"""Name <-> id resolution, template rewriting and snapshot sync.

Catalog lookups are hash joins on ``lower(name)`` after the catalog is
reduced to one row per name (``min_by``/``max_by`` on its position), so a
name repeated many times never fans out. Substring search joins on one rare
n-gram of each term and verifies the hit, so work grows with the candidates
of that n-gram, not with the square of a name's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import dims
from quarry.functions.text import is_uuid, slugify, strip_ws
from quarry.session import spread


def uuid_of(*cols: Column) -> Column:
    """Deterministic UUID-shaped id from key columns (md5 laid out 8-4-4-4-12)."""
    h = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def _name_index(catalog: DataFrame, pick: str) -> DataFrame:
    """One row per ``lower(name)``: first (``min``) or last (``max``) catalog position wins."""
    by = F.min_by if pick == "first" else F.max_by
    return catalog.groupBy(F.lower("name").alias("lname")).agg(by("id", "pos").alias("cat_id"))


def resolve_names(refs: DataFrame, cache: DataFrame, catalog: DataFrame, pick: str = "first") -> DataFrame:
    """``refs(key, name)`` -> id by UUID literal, then cache, then catalog.

    ``cache(key, id)`` is keyed like the refs; ``catalog(pos, name, id)`` is
    matched case-insensitively, ``pick='first'`` (J2) or ``'last'`` (J15).
    """
    r = refs.select("key", "name").distinct()
    cat = _name_index(catalog, pick)
    j = (r.join(cache.select("key", F.col("id").alias("cache_id")), "key", "left")
         .join(cat, F.lower(F.col("name")) == cat.lname, "left"))
    uuid_lit = F.when(is_uuid(F.col("name")), F.col("name"))
    rid = F.coalesce(uuid_lit, F.col("cache_id"), F.col("cat_id"))
    by = (F.when(uuid_lit.isNotNull(), "uuid").when(F.col("cache_id").isNotNull(), "cache")
          .when(F.col("cat_id").isNotNull(), "catalog"))
    return j.select("key", "name", rid.alias("id"), by.alias("resolved_by"))


def available_names(catalog: DataFrame, kind: str) -> DataFrame:
    """One row per catalog: ``catalog, n_available, names`` in catalog order; an unnamed entry is ``(unnamed)``."""
    entries = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", F.lit("(unnamed)")).alias("name"))))
    one = catalog.agg(F.count("*").alias("n_available"), F.array_join(F.transform(entries, lambda e: e["name"]), ", ").alias("names"))
    return one.select(F.lit(kind).alias("catalog"), "n_available", "names")


def unresolved_names(resolved: DataFrame, catalog: DataFrame, kind: str = "agent") -> DataFrame:
    """Refs with no id: ``key, name, n_available, catalog, message``.

    The names that the message announces are the row of ``available_names`` for
    ``catalog``; they are kept once, not once per reference.
    """
    n = catalog.agg(F.count("*")).scalar()
    start = F.concat(F.lit(f"Cannot resolve {kind} '"), F.col("name"), F.lit("'. "))
    message = F.when(F.col("n_available") > 0, F.concat(start, F.lit(f"Available {kind}s:"))).otherwise(F.concat(start, F.lit(f"No {kind}s available in this organization.")))
    return resolved.where(F.col("id").isNull()).select("key", "name", n.alias("n_available"), F.lit(kind).alias("catalog")).withColumn("message", message)


def reverse_resolve(lists: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(owner, pos, id)`` id lists -> names only when every id resolves, else ids kept."""
    names = catalog.select(F.col("id"), F.col("name").alias("_nm"))
    j = lists.join(names, "id", "left")
    g = j.groupBy("owner").agg(
        F.bool_and(F.col("_nm").isNotNull()).alias("all_resolved"),
        F.array_sort(F.collect_list(F.struct("pos", "id", "_nm"))).alias("items"))
    out = F.when(F.col("all_resolved"), F.transform("items", lambda x: x["_nm"])) \
        .otherwise(F.transform("items", lambda x: x["id"]))
    return g.select("owner", "all_resolved", F.array_join(out, ",").alias("values"))


def reverse_resolve_one(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """J4, scalar form: ``(owner, id)`` -> the name of each id, or the id itself where the catalog lacks it."""
    names = catalog.groupBy("id").agg(F.min_by("name", "pos").alias("_nm"))
    return refs.join(names, "id", "left").select("owner", F.coalesce("_nm", "id").alias("value"), F.col("_nm").isNotNull().alias("resolved"))


GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """Distinct substrings of ``size`` characters; the empty string for size 0."""
    n = F.length(text) - size + 1
    starts = F.when((size > 0) & (n > 0), F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.substring(text, i, size))
    return F.when(size == 0, F.array(F.lit(""))).otherwise(F.array_distinct(cut))


def find_by_name(terms: DataFrame, names: DataFrame) -> DataFrame:
    """``terms(term)`` against catalog entries ``names(id, name)``, case-insensitive.

    One exact entry is found; else the entries whose name contains the term
    decide: 0 none, 1 found, more ambiguous. Entries are counted, not names,
    so two entries of one name are ambiguous; the empty term matches all.
    Each name is indexed by its distinct n-grams (length 0 to 3); a term is
    joined on its rarest n-gram of length ``min(3, length)`` and verified.
    """
    lname = F.lower("name")
    sizes = F.array(*[F.lit(i) for i in range(GRAM + 1)])
    index = names.where("name is not null").select("id", "name", F.explode(F.flatten(F.transform(sizes, lambda k: _grams(lname, k)))).alias("gram"))
    common = index.groupBy("gram").agg(F.count("*").alias("n"))
    t = terms.where("term is not null").select("term", F.lower("term").alias("lterm")).distinct()
    parts = t.select("term", "lterm", F.explode(_grams(F.col("lterm"), F.least(F.lit(GRAM), F.length("lterm")))).alias("gram"))
    # a gram that no name has settles its term: no entry can contain it
    rare = (parts.join(common, "gram", "left").groupBy("term", "lterm")
            .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")))
    hits = rare.join(index, "gram").where(F.contains(lname, F.col("lterm")))
    exact = lname == F.col("lterm")
    g = hits.groupBy("term").agg(
        F.count_if(exact).alias("n_exact"), F.count("*").alias("n_matches"),
        F.min(F.when(exact, F.struct("id", "name"))).alias("one_exact"), F.min(F.struct("id", "name")).alias("one"))
    out = t.join(g, "term", "left").fillna({"n_exact": 0, "n_matches": 0})
    verdict = (F.when((F.col("n_exact") == 1) | (F.col("n_matches") == 1), "found")
               .when(F.col("n_matches") == 0, "none").otherwise("ambiguous"))
    match = F.when(F.col("n_exact") == 1, F.col("one_exact")).when(F.col("n_matches") == 1, F.col("one"))
    return out.select("term", verdict.alias("verdict"), match["id"].alias("match_id"), match["name"].alias("match"),
                      F.col("n_matches").cast("bigint").alias("n_matches"))


def catalog_listing(workflows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Workflows left-joined to metadata; missing name -> ``Workflow `` + first 8 id chars."""
    j = workflows.join(metadata, "id", "left")
    return j.select("id", F.coalesce(F.col("name"), F.concat(F.lit("Workflow "), F.substring("id", 1, 8))).alias("name"))


def pair_by_position(defs: DataFrame, response: DataFrame, tasks: int | None = None) -> DataFrame:
    """Definition edges and response ids paired by index within a workflow; extras ignored.

    ``tasks`` fixes the number of tasks that share a shuffle, here and below
    (``session.tasks_for``); by default it is the session's.
    """
    on = ["workflow_id", "pos"]
    return spread(defs, tasks, *on).join(spread(response, tasks, *on), on)


def snapshot_diff(defn: DataFrame, stored: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(workflow_id, key)`` in definition vs stored map -> kept / added / removed, plus mode."""
    on = ["workflow_id", "key"]
    d = spread(defn.select(*on, F.lit(True).alias("_d")), tasks, *on)
    s = spread(stored.select(*on, "id", F.lit(True).alias("_s")), tasks, *on)
    has_map = spread(stored.select("workflow_id"), tasks, "workflow_id").distinct().withColumn("_m", F.lit(True))
    j = spread(d.join(s, on, "full_outer"), tasks, "workflow_id").join(has_map, "workflow_id", "left")
    change = F.when(F.col("_d") & F.col("_s"), "kept").when(F.col("_d"), "added").otherwise("removed")
    mode = F.when(F.col("_m"), "update").otherwise("create")
    return j.select("workflow_id", "key", "id", change.alias("change"), mode.alias("mode"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _issued(bases: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unique slugs for the ordered bases of one workflow per row; a counter per base keeps it linear."""
    for batch in bases:
        out = []
        for items in batch:
            seen, following, slugs = set(), {}, []
            for base in items:
                slug, k = base, following.get(base, 2)
                while slug in seen:
                    slug, k = f"{base}_{k}", k + 1
                following[base] = k
                seen.add(slug)
                slugs.append(slug)
            out.append(slugs)
        yield pd.Series(out, dtype=object)


def unique_slugs(nodes: DataFrame) -> DataFrame:
    """Per workflow in ``pos`` order: base slug, then ``_2``, ``_3``... against all slugs issued so far.

    Base = ``lower(strip(function_name))`` when set, else ``slugify(type)``.
    One workflow's nodes are one row (a definition is bounded).
    """
    own = strip_ws(F.coalesce(F.col("function_name"), F.lit("")))
    base = F.when(own != "", F.lower(own)).otherwise(slugify(F.col("type")))
    items = (nodes.withColumn("base", base).groupBy("workflow_id")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "base"))).alias("items")))
    out = items.withColumn("slugs", _issued(F.transform("items", lambda x: x["base"])))
    z = out.select("workflow_id", F.explode(F.arrays_zip(
        F.transform("items", lambda x: x["pos"]).alias("pos"), F.col("slugs").alias("slug"))).alias("z"))
    return z.select("workflow_id", F.col("z.pos").alias("pos"), F.col("z.slug").alias("slug"))


def splice_refs(texts: DataFrame, key: list[str], text_col: str, pattern: str, lookup: DataFrame, on: list[str], out: str) -> DataFrame:
    """Replace each ``pattern`` match of a text by ``{{`` + the looked-up value; matches without one stay.

    ``lookup(*on, old, new)`` holds one row per (on, old). Matches are rows that
    join the lookup, so no map is copied onto a text.
    """
    found = texts.select(*key, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("ref_no", "raw"))
    found = found.withColumn("old", F.substring("raw", 3, 1 << 30)).join(lookup, [*on, "old"], "left")
    new = F.coalesce(F.concat(F.lit("{{"), F.col("new")), F.col("raw"))
    g = found.select(*key, "ref_no", new.alias("value")).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("ref_no", "value"))).alias("_vals"))
    pieces = F.split(F.col(text_col), pattern)
    values = F.concat(F.transform(F.coalesce("_vals", F.array().cast("array<struct<ref_no:int,value:string>>")), lambda v: v["value"]),
                      F.array(F.lit("")))
    text = F.array_join(F.zip_with(pieces, values, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return texts.join(g, key, "left").withColumn(out, text).drop("_vals")


def rewrite_refs(texts: DataFrame, id_map: DataFrame, text_col: str = "template") -> DataFrame:
    """``{{slug`` -> ``{{id``, with or without a following path; unknown slugs are kept.

    ``texts(workflow_id, node, ...)`` has one row per (workflow, node);
    ``id_map(workflow_id, slug, id)``: of several ids for a slug the smallest is taken.
    """
    lookup = id_map.groupBy("workflow_id", F.col("slug").alias("old")).agg(F.min("id").alias("new"))
    return splice_refs(texts, ["workflow_id", "node"], text_col, dims.SLUG_REF_PATTERN, lookup, ["workflow_id"], "rewritten")


def restore_refs(texts: DataFrame, id_map: DataFrame, functions: DataFrame, text_col: str = "template") -> DataFrame:
    """F13 reversed: ``{{id`` -> ``{{slug``, then ``{{functionName.`` -> ``{{slug.``; unknown ones are kept.

    ``functions(workflow_id, function_name, slug)`` maps the mixed-case names.
    """
    key = ["workflow_id", "node"]
    ids = id_map.groupBy("workflow_id", F.col("id").alias("old")).agg(F.min("slug").alias("new"))
    names = functions.groupBy("workflow_id", F.col("function_name").alias("old")).agg(F.min("slug").alias("new"))
    once = splice_refs(texts, key, text_col, dims.UUID_REF_PATTERN, ids, ["workflow_id"], "restored")
    return splice_refs(once, key, "restored", dims.FUNCTION_REF_PATTERN, names, ["workflow_id"], "restored")


def render_template(texts: DataFrame, outputs: DataFrame, text_col: str = "template", tasks: int | None = None) -> DataFrame:
    """substitute ``{{slug.output.field}}`` with upstream output values; a missing value -> error row.

    ``outputs(workflow_id, slug, field, value)``: of several values of a field the smallest is taken. Returns ``(workflow_id, node, rendered, missing)``
    where ``missing`` lists unresolved references (rendered is null then); a
    text without references is rendered as it is.
    """
    key, pattern = ["workflow_id", "node"], dims.VAR_REF_PATTERN
    refs = texts.select(*key, F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))).alias("ref_no", "raw"))
    refs = refs.withColumn("slug", F.regexp_extract("raw", pattern, 1)).withColumn("path", F.regexp_extract("raw", pattern, 2))
    refs = refs.withColumn("field", F.regexp_extract("path", r"^output\.(.+)$", 1))
    place = ["workflow_id", "slug", "field"]
    known = spread(outputs, tasks, *place).groupBy(*place).agg(F.min("value").alias("value"))
    r = spread(spread(refs.drop("raw"), tasks, *place).join(known, place, "left"), tasks, *key)
    lost = F.when(F.col("value").isNull(), F.concat(F.col("slug"), F.lit("."), F.col("path")))
    g = r.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("ref_no", "value"))).alias("vals"),
        F.array_sort(F.collect_list(lost)).alias("missing"))
    j = spread(texts, tasks, *key).join(g, key, "left")
    missing = F.coalesce("missing", F.array().cast("array<string>"))
    values = F.concat(F.transform(F.coalesce("vals", F.array().cast("array<struct<ref_no:int,value:string>>")), lambda v: v["value"]),
                      F.array(F.lit("")))
    rendered = F.array_join(F.zip_with(F.split(F.col(text_col), pattern), values,
                                       lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return j.select(*key, F.when(F.size(missing) == 0, rendered).alias("rendered"), F.array_join(missing, ",").alias("missing"))


def route_rows(rows: DataFrame, edges: DataFrame, column_values: Column, keys: list[str] | None = None) -> DataFrame:
    """Rows leave their router over its matching CONDITIONAL edges and all its STATIC edges.

    ``rows`` and ``edges`` share the router ``keys`` (default ``src``; add the
    workflow where there are several); ``edges(*keys, dst, type, condition)``
    has conditions like ``route == "x"``; ``column_values`` is a
    ``MAP<STRING,STRING>`` of the row's routable columns. Both parts are joins
    on the router, the first on (column, literal) too.
    """
    keys = keys or ["src"]
    rule = r'^\s*(\w+)\s*==\s*"(.*)"\s*$'
    cond = edges.where((F.col("type") == "CONDITIONAL") & F.col("condition").rlike(rule)).select(
        *keys, "dst", F.regexp_extract("condition", rule, 1).alias("column"), F.regexp_extract("condition", rule, 2).alias("literal"))
    static = edges.where(F.col("type") == "STATIC").select(*keys, "dst")
    kv = rows.select("*", F.explode(column_values).alias("column", "literal"))
    hit = kv.join(cond, [*keys, "column", "literal"]).drop("column", "literal")
    return hit.unionByName(rows.join(static, keys))
