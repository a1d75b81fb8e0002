"""Config records between their spellings (F15 rename, F16 merge, F17 parameters) and whole definitions.

A config is a JSON object per node. It becomes one row per key with the key's
place in the document; fixed field tables are joined on (type, key), and
``max_by``/``min_by`` on the place settles collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import dims
from quarry.functions.text import function_name
from quarry.operators.resolve import splice_refs
from quarry.session import stage

KEY = ["workflow_id", "slug"]


def _entries(nodes: DataFrame, *columns: str) -> DataFrame:
    """``workflow_id, slug, type, source, pos, key, value``: top-level entries of each column in document order, values as JSON text.

    A document is read once into a map. One that is no sound value (a key
    twice) gives its keys without values. The whole documents are moved to
    their node, so that grouping by node and further columns moves no entries.
    """
    def entries(c: str) -> Column:
        found = F.map_entries(F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, "map<string,variant>")))
        bare = F.transform(F.json_object_keys(c), lambda k: F.struct(k.alias("key"), F.lit(None).cast("variant").alias("value")))
        return F.transform(F.coalesce(found, bare), lambda e, i: F.struct(F.lit(c).alias("source"), i.alias("pos"), e["key"].alias("key"), e["value"].alias("value")))

    every = F.concat(*[F.coalesce(entries(c), F.array().cast("array<struct<source:string,pos:int,key:string,value:variant>>")) for c in columns])
    placed = nodes.select(*KEY, F.upper("type").alias("type"), *columns).repartition(*KEY)
    # an inner explode would have Spark filter by the same entries first, and so read the documents twice
    return placed.select(*KEY, "type", F.inline_outer(every)).where("source is not null").withColumn("value", F.to_json("value"))


def _literal_map(table: dict, value) -> Column:
    return F.create_map(*[c for k, v in table.items() for c in (F.lit(k), value(v))])


def renamed(nodes: DataFrame, column: str = "config") -> DataFrame:
    """F15, a row a node: ``workflow_id, slug, docs, entries``.

    ``entries`` are the ``(key, value JSON text)`` under their service names; of keys of one
    name the later one in the document wins. ``docs(type, sound)`` has one part for each of
    the node's rows, ``sound`` where its document is a JSON object. A document is
    read, renamed and settled inside its row; only whole documents are moved.
    """
    placed = nodes.select(*KEY, F.upper("type").alias("type"), column).repartition(*KEY)
    dropped = F.try_element_at(_literal_map(dims.CLIENT_ONLY_FIELDS, lambda ks: F.array(*map(F.lit, ks))), F.col("type"))
    names = F.try_element_at(_literal_map(dims.SCHEMA_ALIASES, lambda m: _literal_map(m, F.lit)), F.col("type"))
    good = F.try_parse_json(column).isNotNull()
    found = F.transform(F.map_entries(F.when(good, F.from_json(column, "map<string,variant>"))), lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")))
    bare = F.transform(F.json_object_keys(column), lambda k: F.struct(k.alias("key"), F.lit(None).cast("string").alias("value")))
    every = F.transform(F.coalesce(found, bare), lambda e, i: F.struct(e["key"].alias("key"), i.alias("pos"), e["value"].alias("value")))
    kept = F.filter(every, lambda e: ~F.coalesce(F.array_contains("dropped", e["key"]), F.lit(False)))
    named = F.transform(kept, lambda e: F.struct(F.coalesce(F.try_element_at("names", e["key"]), e["key"]).alias("key"), e["pos"].alias("pos"), e["value"].alias("value")))
    sound = F.coalesce(good & F.startswith(F.ltrim(F.col(column), F.lit(" \t\r\n")), F.lit("{")), F.lit(False))
    rows = placed.withColumns({"dropped": dropped, "names": names}).select(*KEY, F.struct("type", sound.alias("sound")).alias("doc"), F.coalesce(named, F.array().cast("array<struct<key:string,pos:int,value:string>>")).alias("own"))
    grouped = rows.groupBy(*KEY).agg(F.collect_list(F.struct("doc", "own")).alias("rows"))
    merged = grouped.select(*KEY, F.transform("rows", lambda r: r["doc"]).alias("docs"), F.array_sort(F.flatten(F.transform("rows", lambda r: r["own"]))).alias("all"))
    last = F.filter("all", lambda e, i: F.coalesce(F.get("all", i + 1)["key"] != e["key"], F.lit(True)))
    return merged.select(*KEY, "docs", F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))).alias("entries"))


def rename_config(nodes: DataFrame, column: str = "config") -> DataFrame:
    """``workflow_id, slug, key, value`` with client-only keys dropped and the others renamed by node type.

    Keys of one new name collide: the later one in the document wins.
    """
    # an inner explode would have Spark filter by the same entries first, and so settle them twice
    return renamed(nodes, column).select(*KEY, F.inline_outer("entries")).where("key is not null")


def _empty(value: Column) -> Column:
    return F.coalesce(value, F.lit("null")).isin("null", '""', "[]")


def merge_config(nodes: DataFrame) -> DataFrame:
    """F16: ``nodes(workflow_id, slug, type, parameters, config)`` -> ``workflow_id, slug, key, value``.

    Parameters come first (the last listed field wins a target), config fills
    what is left (the first listed field wins). Empty dependency references are
    dropped. Where nothing matches, the config itself without its UI keys stays.
    """
    fields = [(source, t, i, k, v or k) for source, table in (("parameters", dims.PARAMETER_FIELDS), ("config", dims.CONFIG_FIELDS)) for t, m in table.items() for i, (k, v) in enumerate(m.items())]
    table = F.broadcast(nodes.sparkSession.createDataFrame(fields, "source string, type string, rule int, key string, target string"))
    rows = _entries(nodes, "parameters", "config").join(table, ["source", "type", "key"])
    rows = rows.where(~(F.col("key").isin(dims.DEPENDENCY_FIELDS) & _empty(F.col("value"))))
    rule = lambda source: F.when(F.col("source") == source, F.col("rule"))
    merged = rows.groupBy(*KEY, "target").agg(F.max_by("value", rule("parameters")).alias("_p"), F.min_by("value", rule("config")).alias("_c"))
    merged = merged.select(*KEY, F.col("target").alias("key"), F.coalesce("_p", "_c").alias("value"))
    left = _entries(nodes, "config").where(~F.col("key").isin(dims.UI_FIELDS)).join(merged.select(*KEY).distinct(), KEY, "left_anti")
    return merged.unionByName(left.select(*KEY, "key", "value"))


def node_parameters(nodes: DataFrame, id_map: DataFrame) -> DataFrame:
    """``nodes(workflow_id, slug, type, label, config)`` -> stored parameters ``workflow_id, slug, key, value`` (JSON text).

    Every node has ``type``, ``label`` (its slug if unset) and ``function_name``;
    config keys follow ``PARAMETER_RULES``. ``id_map(workflow_id, slug, id)`` turns
    references into ids; in ``headers`` and ``callParams`` the whole object is rewritten.
    """
    rules = {t.upper(): {k: (target, i, mode) for i, (k, target, mode) in enumerate(rules)} for t, rules in dims.PARAMETER_RULES.items()}
    rule = lambda r: F.struct(F.lit(r[0]).alias("target"), F.lit(r[1]).alias("rule"), F.lit(r[2]).alias("mode"))
    known = F.try_element_at(_literal_map(rules, lambda m: _literal_map(m, rule)), F.upper("type"))
    # a document is read and its parameters picked inside its row; only these are moved
    parsed = F.try_parse_json("config")
    bare = F.transform(F.json_object_keys("config"), lambda k: F.struct(k.alias("key"), F.lit(None).cast("variant").alias("value")))
    entries = F.coalesce(F.map_entries(F.try_variant_get(parsed, "$", "map<string,variant>")), bare)

    def pick(e: Column) -> Column:
        r, value = F.try_element_at("known", e["key"]), F.to_json(e["value"])
        carried = (F.when(r["mode"] == "true", F.lit("true"))
                   .when((r["mode"] == "list") & ~value.startswith("["), F.concat(F.lit("["), value, F.lit("]"))).otherwise(value))
        return F.struct(r["target"].alias("target"), r["rule"].alias("rule"), carried.alias("value"), r["mode"].alias("mode"))

    own = F.transform(F.filter(entries, lambda e: F.try_element_at("known", e["key"]).isNotNull()), pick)
    own = F.coalesce(own, F.array().cast("array<struct<target:string,rule:int,value:string,mode:string>>"))
    rows = nodes.withColumn("known", known).select(*KEY, F.struct("type", "label").alias("doc"), own.alias("own")).repartition(*KEY)
    grouped = rows.groupBy(*KEY).agg(F.collect_list(F.struct("doc", "own")).alias("rows"))
    merged = grouped.select(*KEY, F.transform("rows", lambda r: r["doc"]).alias("docs"), F.array_sort(F.flatten(F.transform("rows", lambda r: r["own"]))).alias("all"))
    first = F.filter("all", lambda e, i: F.coalesce(F.get("all", i - 1)["target"] != e["target"], F.lit(True)))
    picked = stage(merged.select(*KEY, "docs", first.alias("picked")))  # read three times below

    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))

    def text(c: Column) -> Column:
        listed = F.to_json(F.array(c))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    types = _literal_map(dims.PARAMETER_TYPES, F.lit)
    none = F.array().cast("array<struct<key:string,value:string>>")

    def common(d: Column) -> Column:
        three = F.array(entry(F.lit("type"), text(F.coalesce(F.try_element_at(types, d["type"]), d["type"]))), entry(F.lit("label"), text(F.coalesce(F.nullif(d["label"], F.lit("")), F.col("slug")))),
                        entry(F.lit("function_name"), text(function_name(F.col("slug")))))
        return F.concat(three, F.when(d["type"] == "llm_call", F.array(entry(F.lit("variables"), F.lit("[]")))).otherwise(none))

    asks = F.exists("docs", lambda d: d["type"] == "plain_txt_input") & F.col("workflow_id").isNotNull() & F.col("slug").isNotNull()
    prompts = F.when(asks, F.transform(F.filter("picked", lambda e: e["target"] == "prompt"), lambda e: entry(F.lit("text"), F.lit('""')))).otherwise(none)
    carried = F.transform(F.filter("picked", lambda e: e["mode"] != "refs"), lambda e: entry(e["target"], e["value"]))
    refs = picked.select(*KEY, F.inline_outer(F.filter("picked", lambda e: e["mode"] == "refs"))).where("target is not null").select(*KEY, "target", "value")
    refs = splice_refs(refs, [*KEY, "target"], "value", dims.SLUG_REF_PATTERN, id_map.groupBy("workflow_id", F.col("slug").alias("old")).agg(F.min("id").alias("new")), ["workflow_id"], "value")
    plain = picked.select(*KEY, F.inline_outer(F.concat(F.flatten(F.transform("docs", common)), carried, prompts)))
    return plain.unionByName(refs.select(*KEY, F.col("target").alias("key"), "value"))


def assemble_definition(workflows: DataFrame, nodes: DataFrame, edges: DataFrame, id_map: DataFrame) -> DataFrame:
    """Flat tables -> one nested record per workflow: ``workflow_id, json, unknown_edges``.

    ``nodes(workflow_id, pos, slug, type)`` in ``pos`` order; ids from
    ``id_map(workflow_id, slug, id)``. Edges that name an unknown node are left
    out and counted. A definition is one bounded record.
    """
    ids = id_map.groupBy("workflow_id", "slug").agg(F.min("id").alias("id"))
    n = nodes.join(ids, ["workflow_id", "slug"])
    item = F.struct("pos", F.struct("id", F.upper("type").alias("config_type"), function_name(F.col("slug")).alias("function_name"),
                                    F.lit(dims.NODE_TIMEOUT_S).alias("timeout_seconds"), F.struct(F.lit(dims.NODE_RETRIES).alias("max_retries")).alias("retry_policy")).alias("node"),
                    F.col("type").alias("kind"))
    per = n.groupBy("workflow_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def ports(without: list[str], name: str) -> Column:
        kept = F.filter("items", lambda x: ~x["kind"].isin(without))
        return F.transform(kept, lambda x: F.struct(x["node"]["id"].alias("node_id"), F.lit(name.removeprefix("node_").removesuffix("s")).alias(f"{name[5:-1]}_name"), F.lit(0).alias("sequence_order")))

    def end(c: str) -> DataFrame:
        return ids.select("workflow_id", F.col("slug").alias(c), F.col("id").alias(f"{c}_id"))

    e = edges.join(end("src"), ["workflow_id", "src"], "left").join(end("dst"), ["workflow_id", "dst"], "left")
    known = F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()
    edge = F.struct(F.col("src_id").alias("source_node_id"), F.col("dst_id").alias("target_node_id"), F.coalesce("type", F.lit("STATIC")).alias("edge_type"))
    links = e.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.when(known, edge))).alias("edges"), F.count_if(~known).alias("unknown_edges"))
    w = workflows.join(end("entry"), ["workflow_id", "entry"], "left").join(end("exit"), ["workflow_id", "exit"], "left")
    rec = w.join(per, "workflow_id", "left").join(links, "workflow_id", "left")
    record = F.struct(F.struct(F.col("entry_id").alias("entry_point"), F.col("exit_id").alias("exit_point")).alias("workflow"),
                      F.transform("items", lambda x: x["node"]).alias("nodes"), ports(dims.NO_OUTPUT_TYPES, "node_outputs").alias("node_outputs"),
                      ports(dims.NO_INPUT_TYPES, "node_inputs").alias("node_inputs"), F.coalesce("edges", F.array().cast("array<struct<source_node_id:string,target_node_id:string,edge_type:string>>")).alias("edges"))
    return rec.select("workflow_id", F.to_json(record).alias("json"), F.coalesce("unknown_edges", F.lit(0)).alias("unknown_edges"))
