"""Stand-in inputs derived from the driver tables.

The driver tables hold no workflow graphs, run logs or file stores, so these
functions give rows in the schemas the operators expect. They only shape
input; every operator is correct on any data of the same schema and takes
nothing from how these rows are made. Where a caller needs several of them, it
may hand them one staged ``line`` (the rows of ``v_line``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import spread
from quarry.sources.tables import table


def _n(c):
    return F.concat(F.lit("n"), c.cast("string"))


def v_line(spark: SparkSession, sf: str, tasks: int | None = None) -> DataFrame:
    li = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"), tasks, "l_orderkey")
    return li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("l_partkey"),
        F.min("l_suppkey").alias("l_suppkey"),
        F.max("l_quantity").alias("l_quantity"),
        F.min("l_returnflag").alias("l_returnflag"),
    )


def v_nodes(spark: SparkSession, sf: str, line: DataFrame | None = None) -> DataFrame:
    line = v_line(spark, sf) if line is None else line
    t = F.col("l_partkey") % 6
    node_type = (F.when(t == 0, "plain_txt_input").when(t == 1, "llm_call")
                 .when(t == 2, "retrieve").when(t == 3, "rag_agent")
                 .when(t == 4, "structured_output").otherwise("document_extraction"))
    return line.select(
        F.col("l_orderkey").alias("workflow_id"),
        F.col("l_linenumber").alias("pos"),
        _n(F.col("l_linenumber")).alias("slug"),
        node_type.alias("type"),
    )


def v_workflows(spark: SparkSession, sf: str, line: DataFrame | None = None) -> DataFrame:
    line = v_line(spark, sf) if line is None else line
    bump = F.when(F.col("l_orderkey") % 10 == 0, 1).otherwise(0)
    return line.groupBy("l_orderkey").agg(
        F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi")
    ).select(
        F.col("l_orderkey").alias("workflow_id"),
        _n(F.col("lo")).alias("entry"),
        _n(F.col("hi") + bump).alias("exit"),
    )


def v_edges(spark: SparkSession, sf: str, line: DataFrame | None = None) -> DataFrame:
    line = v_line(spark, sf) if line is None else line
    by_wf = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    chain = (line.withColumn("nxt", F.coalesce(F.lead("l_linenumber").over(by_wf),
                                               F.col("l_linenumber") + 1))
             .where(F.col("l_returnflag") != "R")
             .select(F.col("l_orderkey").alias("workflow_id"),
                     _n(F.col("l_linenumber")).alias("src"), _n(F.col("nxt")).alias("dst"),
                     F.lit("STATIC").alias("type")))
    back = (line.withColumn("min_ln", F.min("l_linenumber").over(Window.partitionBy("l_orderkey")))
            .where(F.col("l_quantity") > 45)
            .select(F.col("l_orderkey").alias("workflow_id"),
                    _n(F.col("l_linenumber")).alias("src"), _n(F.col("min_ln")).alias("dst"),
                    F.when(F.col("l_returnflag") == "A", "RECURSIVE").otherwise("STATIC").alias("type")))
    return chain.unionByName(back)


def v_refs(spark: SparkSession, sf: str) -> DataFrame:
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    name = F.when(F.col("l_linenumber") % 4 == 0, F.lit("nobody")).otherwise(F.upper("s_name"))
    return (v_line(spark, sf).join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
            .select(F.col("l_orderkey").alias("workflow_id"),
                    _n(F.col("l_linenumber")).alias("node"),
                    F.concat(F.lit("agent:"), name).alias("ref")))


def v_templates(spark: SparkSession, sf: str, line: DataFrame | None = None) -> DataFrame:
    """Texts with two references, with a bare slug (every 5th part) or with none (every 7th)."""
    line = v_line(spark, sf) if line is None else line
    two = F.concat(F.lit("Use {{n"), (F.col("l_linenumber") - 1).cast("string"),
                   F.lit(".output.text}} then {{n"), (F.col("l_suppkey") % 9).cast("string"), F.lit(".output.files}}"))
    text = (F.when(F.col("l_partkey") % 7 == 0, F.lit("Nothing to fill in"))
            .when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("From {{n"), (F.col("l_linenumber") - 1).cast("string"), F.lit("}} on")))
            .otherwise(two))
    return line.select(F.col("l_orderkey").alias("workflow_id"), _n(F.col("l_linenumber")).alias("node"), text.alias("template"))


def v_branches(spark: SparkSession, sf: str) -> DataFrame:
    return v_line(spark, sf).select(
        F.col("l_orderkey").alias("join_id"), F.col("l_linenumber").alias("seq"),
        F.when(F.col("l_returnflag") == "N", F.lit(None)).otherwise(F.col("l_quantity")).alias("v"),
    )


def v_attempts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("l_partkey") % 6
    result = (F.when(t == 0, "success").when(t == 1, "connection_error")
              .when(t == 2, "read_timeout").when(t == 3, "http_503")
              .when(t == 4, "http_422").otherwise("failure"))
    return v_line(spark, sf).select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("attempt"),
        result.alias("result"))


def v_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", (F.floor(F.col("n_chars") / 300.0).cast("bigint") + 1).alias("pages"))


def v_files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 8
    ext = (F.when(k == 0, ".txt").when(k == 1, ".md").when(k == 2, ".PDF").when(k == 3, ".xlsx")
           .when(k == 4, ".csv").when(k == 5, ".html").when(k == 6, ".exe")
           .when(F.col("doc_id") % 24 == 7, ".tar.gz").when(F.col("doc_id") % 24 == 15, ".TGZ").otherwise(""))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), ext).alias("filename"),
        F.col("text").alias("content"),
        (F.col("n_chars") * 4000).alias("n_bytes"),
    )


def v_run_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    et = F.col("event_type")
    k = F.col("event_id") % 3
    mapped = (F.when(et == "signup", "STEP_STARTED").when(et == "click", "step_finished")
              .when(et == "error", "STEP_ERROR").when(et == "view", "STATE_DELTA")
              .otherwise(F.when(k == 0, "RUN_FINISHED").when(k == 1, "WAITING_FOR_REVIEW")
                         .when(F.col("event_id") % 2 == 0, "STATE_SNAPSHOT").otherwise("MYSTERY")))
    return ev.select(
        F.concat(F.lit("r"), F.col("user_id").cast("string"), F.lit("-"),
                 (F.month("ts") * 100 + F.dayofmonth("ts")).cast("string")).alias("run_id"),
        F.col("event_id").alias("seq"),
        F.col("ts"),
        mapped.alias("event_type"),
        _n(F.col("event_id") % 4).alias("node_id"),
        F.when(F.col("event_id") % 2 == 0, F.floor(F.col("value") * 10).cast("bigint")).alias("duration_ms"),
    )


def event_run_states(spark: SparkSession, sf: str) -> DataFrame:
    """State rows of the runs in ``v_run_events``: status from the number of events."""
    n = v_run_events(spark, sf).groupBy("run_id").agg(F.count("*").alias("n"))
    k = F.col("n") % 4
    return n.select("run_id", F.concat(F.lit("w"), k.cast("string")).alias("workflow_id"),
                    F.when(k == 0, "COMPLETED").when(k == 1, "running").otherwise("RUNNING").alias("status"),
                    F.when(k == 2, "WAITING_FOR_INPUT").when(k == 3, "failed").alias("execution_status"))


def event_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(run_id, seq, line)`` text lines: data lines, keep-alives and junk."""
    e = v_run_events(spark, sf)
    body = F.concat(
        F.lit('data: {"type":"'), F.col("event_type"), F.lit('","node_id":"'), F.col("node_id"),
        F.lit('"'),
        F.when(F.col("duration_ms").isNotNull(),
               F.concat(F.lit(',"duration_ms":'), F.col("duration_ms").cast("string"))).otherwise(F.lit("")),
        F.when(F.col("event_type") == "STATE_DELTA",
               F.concat(F.lit(',"delta":[{"op":"'),
                        F.when(F.col("seq") % 5 == 0, F.lit("remove")).otherwise(F.lit("replace")),
                        F.lit('","path":"/node_outputs/'), F.col("node_id"),
                        F.when(F.col("seq") % 8 == 3, F.lit("/part")).when(F.col("seq") % 8 == 4, F.lit("~1x~0")).otherwise(F.lit("")),
                        F.lit('","value":"v'), F.col("seq").cast("string"), F.lit('"}]')))
        .when(F.col("event_type") == "STATE_SNAPSHOT",
              F.concat(F.lit(',"snapshot":{"node_outputs":{"'), F.col("node_id"), F.lit('":"s'), F.col("seq").cast("string"), F.lit('"}}'))).otherwise(F.lit("")),
        F.lit("}"))
    line = (F.when(F.col("seq") % 7 == 0, F.lit(": keep-alive"))
            .when(F.col("seq") % 11 == 0, F.lit("data: not-json")).otherwise(body))
    return e.select("run_id", "seq", "ts", line.alias("line"))


def v_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_nationkey").alias("sheet"), F.col("c_custkey").alias("row_no"),
        F.col("c_name").alias("c0"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit(None))
        .otherwise(F.concat(F.col("c_mktsegment"), F.lit("|x"))).alias("c1"))


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, pos, type, text, level)``: one element per text line of a document; headings of three levels in turn."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    x = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    p = F.col("pos") % 5
    etype = F.when(p == 0, "Title").when(p == 4, "ListItem").otherwise("NarrativeText")
    level = F.when(p == 0, F.floor(F.col("pos") / 5) % 3 + 1).cast("int")
    return x.select("doc_id", F.col("pos").cast("int").alias("pos"), etype.alias("type"), "text", level.alias("level"))


def runs_from_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Run state rows: one run per order; its workflow is the order's graph (``v_nodes``)."""
    o = table(spark, sf, "orders")
    st, k = F.col("o_orderstatus"), F.col("o_orderkey")
    status = F.when(st == "F", "COMPLETED").when(st == "O", "RUNNING").otherwise("running")
    exec_status = (F.when(st == "F", "COMPLETED").when(st == "O", "RUNNING")
                   .otherwise(F.when(k % 3 == 0, "waiting_for_review").when(k % 3 == 1, "WAITING_FOR_INPUT")
                              .otherwise("RUNNING")))
    hist_n = (F.col("o_custkey") % 4).cast("int")
    out_n = (F.col("o_custkey") % 3).cast("int")
    history = F.transform(F.sequence(F.lit(1), hist_n), lambda i: F.concat(F.lit("n"), i.cast("string")))
    outputs = F.map_from_arrays(
        F.transform(F.sequence(F.lit(1), out_n), lambda i: F.concat(F.lit("n"), i.cast("string"))),
        F.transform(F.sequence(F.lit(1), out_n), lambda i: F.lit("out")))
    return o.select(
        k.alias("run_id"), k.alias("workflow_id"), status.alias("status"),
        exec_status.alias("execution_status"), F.lit("n1").alias("current_node_id"),
        F.when(F.upper(exec_status) == "WAITING_FOR_INPUT", F.lit("n1")).alias("waiting_input_node_id"),
        F.when(F.upper(exec_status) == "WAITING_FOR_REVIEW", F.lit("n2")).alias("review_node_id"),
        F.when(hist_n > 0, history).otherwise(F.array().cast("array<string>")).alias("execution_history"),
        F.when(out_n > 0, outputs).otherwise(F.create_map().cast("map<string,string>")).alias("node_outputs"),
        F.col("o_orderdate").alias("started_at"), F.col("o_custkey").alias("workspace_id"),
        F.col("o_orderpriority").alias("priority"))


def v_node_configs(spark: SparkSession, sf: str, line: DataFrame | None = None) -> DataFrame:
    """``(workflow_id, slug, type, config JSON)``: numbers from ``v_line`` so some break each rule."""
    line = v_line(spark, sf) if line is None else line
    ln, q = F.col("l_linenumber"), F.col("l_quantity")
    t = F.col("l_partkey") % 6
    node_type = (F.when(t == 0, "plain_txt_input").when(t == 1, "llm_call")
                 .when(t == 2, "retrieve").when(t == 3, "rag_agent")
                 .when(t == 4, "structured_output").otherwise("document_extraction"))
    template = F.concat(F.lit("Use {{n"), (ln - 1).cast("string"), F.lit(".output.text}} then {{n"),
                        (F.col("l_suppkey") % 9).cast("string"), F.lit(".output.files}}"))
    cfg = F.to_json(F.struct(
        F.concat(F.lit("{{n"), (F.col("l_partkey") % 8).cast("string"), F.lit(".output.note}}")).alias("zz_note"),
        F.lit("m1").alias("model"),
        template.alias("template"),
        (q / 20).alias("temperature"),
        ((ln - 2) * 100).alias("maxTokens"),
        (ln - 2).alias("topK"),
        (q / 40).alias("scoreThreshold"),
        F.when(ln % 3 != 0, F.concat(F.lit("agent-"), F.col("l_suppkey").cast("string"))).alias("agent_name"),
        F.when(ln % 2 == 1, F.array(F.concat(F.lit("kb-"), (F.col("l_partkey") % 7).cast("string"))))
        .alias("knowledge_base_names"),
        F.when(ln % 3 == 0, F.lit(0.9)).alias("topP"),
        F.when(ln % 4 == 0, F.lit("x")).alias("extractionPrompt"),
        F.when(ln % 5 == 0, F.lit(True)).alias("disableRAG"),
        F.create_map(F.lit("{{ghost.output.x}}"), F.lit("key only")).alias("meta"),
    ))
    return line.select(F.col("l_orderkey").alias("workflow_id"), _n(ln).alias("slug"),
                       node_type.alias("type"), cfg.alias("config"))


def v_stored_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """``(workflow_id, slug, type, parameters, config)`` as stored by a service: some references empty, some configs unmapped."""
    line = v_line(spark, sf)
    ln, pk = F.col("l_linenumber"), F.col("l_partkey")
    t = pk % 6
    node_type = (F.when(t == 0, "plain_txt_input").when(t == 1, "llm_call").when(t == 2, "retrieve")
                 .when(t == 3, "rag_agent").when(t == 4, "structured_output").otherwise("mystery"))
    params = F.concat(F.lit('{"systemPrompt":"P'), ln.cast("string"), F.lit('","topK":'), ln.cast("string"),
                      F.when(ln % 2 == 0, F.lit(',"system_prompt":"Q"')).otherwise(F.lit("")),
                      F.when(ln % 3 == 0, F.lit(',"agentId":""')).otherwise(F.lit(',"agentId":"a1"')),
                      F.when(ln % 2 == 1, F.lit(',"knowledgeBaseId":[]')).otherwise(F.lit("")), F.lit("}"))
    config = F.concat(F.lit('{"type":"ui","agent_id":"c'), ln.cast("string"), F.lit('","knowledge_base_ids":["k"],"knowledge_base_id":'),
                      F.when(ln % 4 == 1, F.lit("null")).otherwise(F.lit('"kb"')), F.lit(',"model":"m","other":{"x":[1,2]}}'))
    return line.select(F.col("l_orderkey").alias("workflow_id"), _n(ln).alias("slug"), node_type.alias("type"), params.alias("parameters"), config.alias("config"))


def v_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """``(doc_id, layout)``: one layout record per document from its lines.

    Four lines form a group; a group's first line also refers to its fourth, and
    the body has an unknown reference. Every 7th line is a picture, every 9th a table of one cell.
    """
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    ref = lambda kind, no: F.struct(F.concat(F.lit(f"#/{kind}/"), no.cast("string")).alias("$ref"))
    group_of = lambda i: F.floor(i / 4).cast("int")

    def item(i, text):
        label = (F.when(i % 9 == 8, "table").when(i % 7 == 6, "picture").when(i % 5 == 0, "section_header").when(i % 5 == 4, "list_item")
                 .when(i % 5 == 1, "paragraph").when(i % 5 == 2, "caption").otherwise("page_header"))
        cell = F.struct(text.alias("text"), F.lit(0).alias("start_row_offset_idx"), F.lit(0).alias("start_col_offset_idx"),
                        F.lit(1).alias("end_row_offset_idx"), F.lit(2).alias("end_col_offset_idx"), F.lit(True).alias("column_header"))
        return F.struct(
            F.concat(F.lit("#/texts/"), i.cast("string")).alias("self_ref"), label.alias("label"),
            F.when(i % 3 == 0, F.lit("")).otherwise(text).alias("text"), text.alias("orig"),
            F.array(F.struct((group_of(i) + 1).alias("page_no"))).alias("prov"),
            F.when(i % 7 == 6, F.struct(F.concat(F.lit("data:image/png;base64,AA"), i.cast("string")).alias("uri"), F.lit("image/png").alias("mimetype"))).alias("image"),
            F.when(i % 4 == 0, F.array(ref("texts", i + 3))).alias("children"),
            F.when(i % 9 == 8, F.struct(F.lit(1).alias("num_rows"), F.lit(2).alias("num_cols"), F.array(cell).alias("table_cells"))).alias("data"))

    # the lines are moved to their document, not the items made of them
    per = d.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("lines"), (F.max(group_of(F.col("pos"))) + 1).alias("n_groups"))
    group = lambda no: F.struct(F.concat(F.lit("#/groups/"), no.cast("string")).alias("self_ref"), F.lit("list").alias("label"),
                                F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ref("texts", no * 4 + k)).alias("children"))
    numbers = F.sequence(F.lit(0), F.col("n_groups") - 1)
    body = F.struct(F.concat(F.transform(numbers, lambda n: ref("groups", n)), F.array(ref("nowhere", F.lit(0)))).alias("children"))
    return per.select("doc_id", F.to_json(F.struct(body.alias("body"), F.transform("lines", lambda x: item(x["pos"], x["text"])).alias("texts"), F.transform(numbers, group).alias("groups"))).alias("layout"))
