"""configs against the JSON Schema of their node type, at any depth.

A registry's schemas become two small tables: rules ``(type, place, kind, arg)``
and links from a place to the places of its properties, items and further
properties. A ``$ref`` is a link to the definition's own place, so schemas may
recurse. Configs are first renamed as the service spells them (F15); then one
level of values after the other is joined to the rules of its place and opened
with ``variant_explode`` where the place has links. What rules ask of a value
(type, size, keys, text) is read once a value, not once a rule. Rounds are the
depth that both config and schema reach.

Rules: type (one or several), anyOf (of types), enum, const, required, closed
objects (``additionalProperties: false``), minimum, maximum, their exclusive
forms, lengths of strings and arrays, pattern. Violations are found with
built-in functions; only they are put into words by a small Python function,
since messages show values as Python does. Types without a schema and configs
that are not JSON objects give no rows.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import configs
from quarry.session import BROADCAST_LIMIT_BYTES, stage_and_count
from quarry.sources import registry as reg

KINDS = ["type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems", "pattern"]
LEVEL = ["workflow_id", "node", "utype", "place", "path", "v"]


def flatten(snapshot: dict) -> tuple[list[tuple], list[tuple]]:
    """Rules ``(utype, place, kind, arg)`` and links ``(utype, place, how, name, child)``; place 0 is the config itself."""
    rules: list[tuple] = []
    links: list[tuple] = []
    for t in snapshot["all_node_types"]:
        schema = t.get("config_json_schema")
        if not schema or not t.get("type"):
            continue
        utype = t["type"].upper()
        shared = {**(snapshot.get("schema_definitions") or {}), **(schema.get("$defs") or {})}
        places: dict[str, int] = {}
        todo: list[tuple[int, dict]] = []

        def target(part: dict, shared=shared) -> dict:
            seen = set()
            while isinstance(part, dict) and "$ref" in part and part["$ref"] not in seen:
                seen.add(part["$ref"])
                part = {**shared.get(str(part["$ref"]).rsplit("/", 1)[-1], {}), **{k: v for k, v in part.items() if k != "$ref"}}
            return part

        def place(part: dict, places=places, todo=todo) -> int:
            # equal parts share a place; a definition that refers to itself is met again as the same text
            key = json.dumps(part, sort_keys=True)
            if key not in places:
                places[key] = len(places)
                todo.append((places[key], part))
            return places[key]

        place(schema)
        while todo:
            at, part = todo.pop()
            part = target(part)
            for one in part.get("allOf") or []:
                part = {**target(one), **part}
            rules += [(utype, at, k, json.dumps(part[k])) for k in KINDS if k in part]
            rules += [(utype, at, "required", json.dumps(f)) for f in part.get("required") or []]
            options = [target(o) for o in part.get("anyOf") or []]
            if options and all("type" in o for o in options):
                rules.append((utype, at, "anyOf", json.dumps([o["type"] for o in options])))
            known = part.get("properties") or {}
            links += [(utype, at, "property", name, place(p)) for name, p in known.items() if isinstance(p, dict)]
            if isinstance(part.get("items"), dict):
                links.append((utype, at, "item", None, place(part["items"])))
            extra = part.get("additionalProperties")
            if isinstance(extra, dict):
                links.append((utype, at, "extra", None, place(extra)))
            elif extra is False:
                rules.append((utype, at, "closed", json.dumps(list(known))))
    return rules, links


@lru_cache(1 << 14)
def explain(kind: str, value: str, arg: str, utype: str) -> tuple[str, str | None]:
    """Message and suggested fix of one violation."""
    wanted, fix = json.loads(arg), None
    shown = repr(json.loads(value)) if value is not None else ""
    if kind == "required":
        return f"{wanted!r} is a required property", f"Add the required field {wanted!r} to your {utype} config"
    if kind == "closed":
        extra = [k for k in json.loads(value) if k not in wanted]
        return f"Additional properties are not allowed ({', '.join(map(repr, extra))} {'was' if len(extra) == 1 else 'were'} unexpected)", None
    if kind == "type":
        fix = f"Change the value to type {wanted!r}"
        wanted = wanted if isinstance(wanted, list) else [wanted]
        return f"{shown} is not of type {', '.join(map(repr, wanted))}", fix
    if kind == "anyOf":
        return f"{shown} is not valid under any of the given schemas", f"Expected {' or '.join(str(w) for w in wanted)}"
    if kind == "const":
        return f"{wanted!r} was expected", None
    words = {"enum": f"is not one of {wanted!r}", "minimum": f"is less than the minimum of {wanted!r}", "maximum": f"is greater than the maximum of {wanted!r}",
             "exclusiveMinimum": f"is less than or equal to the minimum of {wanted!r}", "exclusiveMaximum": f"is greater than or equal to the maximum of {wanted!r}",
             "minLength": "should be non-empty" if wanted == 1 else "is too short", "minItems": "should be non-empty" if wanted == 1 else "is too short",
             "maxLength": "is expected to be empty" if wanted == 0 else "is too long", "maxItems": "is expected to be empty" if wanted == 0 else "is too long", "pattern": f"does not match {wanted!r}"}
    return f"{shown} {words[kind]}", None


def json_type(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return (F.when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
            .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("null"))


def _facts(level: DataFrame) -> DataFrame:
    """What rules ask of the values of a level, in place of the values."""
    v, own = F.col("v"), F.col("own")
    level = level.withColumn("own", json_type(v))
    return level.select("workflow_id", "node", "utype", "place", "path", "own", F.when(own.isin("integer", "number"), F.try_variant_get(v, "$", "double")).alias("number"),
                        F.when(own == "string", F.try_variant_get(v, "$", "string")).alias("text"), F.when(own == "array", F.size(F.try_variant_get(v, "$", "array<variant>"))).alias("size"),
                        F.when(own == "object", F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))).alias("keys"), F.to_json(v).alias("same"))


def _readable(rules: DataFrame) -> DataFrame:
    """Rules with their argument as what it is: a ``bound``, one value (``one``) or several (``names``)."""
    kind, arg = F.col("kind"), F.col("arg")
    listed = F.when(arg.startswith("["), F.from_json(arg, "array<string>")).otherwise(F.from_json(F.concat(F.lit("["), arg, F.lit("]")), "array<string>"))
    options = F.from_json(arg, "array<variant>")
    several = F.flatten(F.transform(options, lambda o: F.coalesce(F.try_variant_get(o, "$", "array<string>"), F.array(F.try_variant_get(o, "$", "string")))))
    names = F.when(kind == "type", listed).when(kind == "anyOf", several).when(kind == "enum", F.transform(options, lambda o: F.to_json(o))).when(kind == "closed", F.from_json(arg, "array<string>"))
    one = F.when(kind == "const", F.to_json(F.try_parse_json(arg))).when(kind.isin("required", "pattern"), F.get_json_object(F.concat(F.lit('{"p":'), arg, F.lit("}")), "$.p"))
    return rules.select("utype", "place", "kind", "arg", F.try_variant_get(F.try_parse_json(arg), "$", "double").alias("bound"), one.alias("one"), names.alias("names"))


def _violated() -> Column:
    """Whether a value (``_facts``) breaks a rule (``_readable``); a rule for another type of value never does."""
    own, number, text, size, keys, same = (F.col(c) for c in ("own", "number", "text", "size", "keys", "same"))
    bound, one, names = F.col("bound"), F.col("one"), F.col("names")
    is_one = F.array_contains(names, own) | ((own == "integer") & F.array_contains(names, F.lit("number"))) | ((own == "number") & (number == F.floor(number)) & F.array_contains(names, F.lit("integer")))
    rules = {"type": ~is_one, "anyOf": ~is_one, "enum": ~F.array_contains(names, same), "const": same != one,
             "minimum": number < bound, "maximum": number > bound, "exclusiveMinimum": number <= bound, "exclusiveMaximum": number >= bound,
             "minLength": F.length(text) < bound, "maxLength": F.length(text) > bound, "minItems": size < bound, "maxItems": size > bound, "pattern": ~F.rlike(text, one),
             "required": ~F.array_contains(keys, one), "closed": F.size(F.array_except(keys, names)) > 0}
    out = F.lit(False)
    for k, broken in rules.items():
        out = F.when(F.col("kind") == k, broken).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _small(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return F.broadcast(df) if sum(len(str(r)) for r in rows) <= BROADCAST_LIMIT_BYTES else df


def _roots(nodes: DataFrame, config_col: str, utypes: list[str]) -> DataFrame:
    """The renamed config of every node of these types as one value."""
    def entry(e: Column) -> Column:
        key = F.to_json(F.array(e["key"]))
        return F.concat(F.substring(key, F.lit(2), F.length(key) - 2), F.lit(":"), e["value"])

    asked = lambda d: d["sound"] & d["type"].isin(utypes)
    rows = configs.renamed(nodes, config_col).where(F.exists("docs", asked))
    text = F.concat(F.lit("{"), F.array_join(F.transform("entries", entry), ","), F.lit("}"))
    # a node without a key has no entries of its own
    text = F.when(F.col("workflow_id").isNotNull() & F.col("slug").isNotNull(), text).otherwise(F.lit("{}"))
    rows = rows.select("workflow_id", "slug", F.try_parse_json(text).alias("v"), F.inline_outer(F.filter("docs", asked)))
    return rows.select("workflow_id", F.col("slug").alias("node"), F.col("type").alias("utype"), F.lit(0).alias("place"), F.lit("").alias("path"), "v")


def schema_rules(nodes: DataFrame, snapshot: dict | None = None, config_col: str = "config") -> DataFrame:
    """``nodes(workflow_id, slug, type, config)`` -> ``workflow_id, node, field, kind, message, suggestion``.

    ``field`` is the path of the value (``a.0.b``), ``(root)`` for the config itself.
    A node is one row of ``(workflow_id, slug)``.
    """
    spark = nodes.sparkSession
    rules, links = flatten(snapshot or reg.SAMPLE)
    rule_table = _small(_readable(spark.createDataFrame(rules, "utype string, place int, kind string, arg string")), rules)
    inside: dict[tuple, list] = {}
    for t, p, how, name, child in links:
        at = inside.setdefault((t, p), [{}, None, None])
        if how == "property":
            at[0][name] = child
        else:
            at[1 if how == "item" else 2] = child
    link_table = _small(spark.createDataFrame([(t, p, *at) for (t, p), at in inside.items()], "utype string, place int, properties map<string,int>, item int, extra int"), links)
    # levels are staged as columns: the names in a document, which each of its values carries, are kept once a file
    places = _small(spark.createDataFrame(sorted({(t, p) for t, p, *_ in rules + links}), "utype string, place int"), rules + links)
    level, n = stage_and_count(_roots(nodes, config_col, sorted({t for t, *_ in rules + links})).join(places, ["utype", "place"], "left_semi").select(*LEVEL))
    parts = []
    while n:
        broken = _facts(level).join(rule_table, ["utype", "place"]).where(_violated())
        value = F.when(F.col("kind") == "closed", F.to_json("keys")).when(F.col("kind") != "required", F.col("same"))
        parts.append(broken.select("workflow_id", "node", "utype", "path", "kind", "arg", value.alias("value")))
        inner = level.join(link_table, ["utype", "place"]).lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        child = F.coalesce(F.try_element_at("properties", F.col("key")), F.when(F.col("key").isNull(), F.col("item")).otherwise(F.col("extra")))
        step = F.coalesce("key", F.col("pos").cast("string"))
        path = F.when(F.col("path") == "", step).otherwise(F.concat("path", F.lit("."), step))
        inner = inner.where(child.isNotNull()).select("workflow_id", "node", "utype", child.alias("place"), path.alias("path"), F.col("value").alias("v"))
        level, n = stage_and_count(inner.join(places, ["utype", "place"], "left_semi").select(*LEVEL))

    @F.pandas_udf("message string, suggestion string")
    def words(kind: pd.Series, value: pd.Series, arg: pd.Series, utype: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([explain(*row) for row in zip(kind, value, arg, utype)], columns=["message", "suggestion"])

    if not parts:
        return spark.createDataFrame([], "workflow_id bigint, node string, field string, kind string, message string, suggestion string")
    found = reduce(DataFrame.union, parts).withColumn("w", words("kind", "value", "arg", "utype"))
    return found.select("workflow_id", "node", F.when(F.col("path") == "", "(root)").otherwise(F.col("path")).alias("field"), "kind", "w.message", "w.suggestion")
