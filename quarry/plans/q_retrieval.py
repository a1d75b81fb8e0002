"""Registered retrieval and reducer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import reducers as rd
from quarry.operators import retrieval as rt
from quarry.plans.catalog import query
from quarry.sources import fixtures as fx
from quarry.sources.tables import table

SELECTED_BASES = [1, 3, 5, 7]


def _corpus(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").alias("source"))


def _queries(spark, sf):
    """The stated query set: every row whose id is divisible by 20, against all rows."""
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


L1_SQL = """SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, cast(source AS INTEGER) AS source, round(score, 6) AS score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, c.label AS source, s.score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY s.score DESC, c.vec_id) AS rank
  FROM embeddings q, embeddings c,
  LATERAL (SELECT list_cosine_similarity(cast(q.embedding AS DOUBLE[]), cast(c.embedding AS DOUBLE[])) AS score) s
  WHERE q.vec_id % 20 = 0 AND s.score >= 0.2) x WHERE rank <= 5"""


@query("retrieve_top_k", L1_SQL)
def retrieve_top_k(spark, sf):
    """L1: the query set against the whole corpus; k=5, scoreThreshold=0.2."""
    r = rt.retrieve_top_k(_queries(spark, sf), _corpus(spark, sf), k=5, threshold=0.2)
    return r.select("query_id", "rank", "vec_id", "source", F.round("score", 6).alias("score"))


@query("retrieve_results", f"""SELECT query_id, cast(count(*) AS INTEGER) AS n, string_agg(concat(cast(rank AS VARCHAR), ':', cast(t.vec_id AS VARCHAR), ':', coalesce(md5(d.text), '-'), ':', coalesce(d.lang, '-')), ' ' ORDER BY rank) AS results
FROM ({L1_SQL}) t LEFT JOIN documents d ON d.doc_id = t.vec_id GROUP BY query_id""")
def retrieve_results(spark, sf):
    """L1 with the content (a document's text, shown as its hash) and metadata (its language) of every result."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content"), F.struct("lang").alias("metadata"))
    top = rt.retrieve_top_k(_queries(spark, sf), _corpus(spark, sf), k=5, threshold=0.2)
    shown = F.transform("results", lambda r: F.concat_ws(":", r["rank"].cast("string"), r["vec_id"].cast("string"), F.coalesce(F.md5(r["content"]), F.lit("-")), F.coalesce(r["metadata"]["lang"], F.lit("-"))))
    return rt.with_content(top, docs).select("query_id", F.size("results").alias("n"), F.array_join(shown, " ").alias("results"))


L2_SQL = """SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, cast(source AS INTEGER) AS source, round(score, 6) AS score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, c.label AS source, s.score,
    row_number() OVER (PARTITION BY q.vec_id, c.label ORDER BY s.score DESC, c.vec_id) AS rank
  FROM embeddings q, embeddings c,
  LATERAL (SELECT list_cosine_similarity(cast(q.embedding AS DOUBLE[]), cast(c.embedding AS DOUBLE[])) AS score) s
  WHERE q.vec_id % 20 = 0 AND c.label IN (1, 3, 5, 7)) x WHERE rank <= 3"""


@query("retrieve_per_source", L2_SQL)
def retrieve_per_source(spark, sf):
    """L2: top-3 per (query, knowledge base) over the selected bases (label = base)."""
    bases = spark.createDataFrame([(b,) for b in SELECTED_BASES], "source int")
    corpus = _corpus(spark, sf).join(F.broadcast(bases), "source", "left_semi")
    r = rt.retrieve_top_k(_queries(spark, sf), corpus, k=3, threshold=-1.0, per_source=True)
    return r.select("query_id", "rank", "vec_id", "source", F.round("score", 6).alias("score"))


@query("reduce_list_append", """SELECT join_id, string_agg(coalesce(cast(v AS VARCHAR), 'null'), ',' ORDER BY seq) AS "values"
FROM v_branches GROUP BY join_id""")
def reduce_list_append(spark, sf):
    r = rd.reduce_list_append(fx.v_branches(spark, sf))
    return r.select("join_id", F.array_join(F.transform("values", lambda x: F.coalesce(x.cast("string"), F.lit("null"))),
                                            ",").alias("values"))


@query("reduce_dict_merge", """SELECT join_id, key, arg_max_null(value, seq) AS value FROM (
  SELECT join_id, seq, concat('k', cast(seq % 3 AS VARCHAR)) AS key, v AS value FROM v_branches) x GROUP BY join_id, key""")
def reduce_dict_merge(spark, sf):
    """A2: each branch outputs ``{k<seq%3>: v}``; later branches win per key."""
    b = fx.v_branches(spark, sf)
    e = b.select("join_id", "seq", F.concat(F.lit("k"), (F.col("seq") % 3).cast("string")).alias("key"),
                 F.col("v").alias("value"))
    return rd.reduce_dict_merge(e)


@query("reduce_dict_map", """SELECT join_id, string_agg(concat(key, '=', coalesce(cast(value AS VARCHAR), 'null')), ';' ORDER BY key) AS merged FROM (
  SELECT join_id, key, arg_max_null(value, seq) AS value FROM (SELECT join_id, seq, concat('k', cast(seq % 3 AS VARCHAR)) AS key, v AS value FROM v_branches) x
  GROUP BY join_id, key) y GROUP BY join_id""")
def reduce_dict_map(spark, sf):
    """A2: the merged map of each join."""
    m = rd.merged_dicts(reduce_dict_merge(spark, sf))
    text = F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("null"))))
    return m.select("join_id", F.array_join(text, ";").alias("merged"))


@query("reduce_sum", "SELECT join_id, round(coalesce(sum(v), 0) + 10.0, 6) AS total FROM v_branches GROUP BY join_id")
def reduce_sum(spark, sf):
    r = rd.reduce_sum(fx.v_branches(spark, sf), initial=10.0)
    return r.select("join_id", F.round("total", 6).alias("total"))


@query("reduce_first", "SELECT join_id, arg_min(v, seq) FILTER (WHERE v IS NOT NULL) AS first_v FROM v_branches GROUP BY join_id")
def reduce_first(spark, sf):
    return rd.reduce_first(fx.v_branches(spark, sf))


@query("reduce_last", "SELECT join_id, arg_max_null(v, seq) AS last_v FROM v_branches GROUP BY join_id")
def reduce_last(spark, sf):
    return rd.reduce_last(fx.v_branches(spark, sf))


@query("reduce_null", "SELECT join_id, cast(NULL AS DOUBLE) AS result FROM v_branches GROUP BY join_id")
def reduce_null(spark, sf):
    return rd.reduce_null(fx.v_branches(spark, sf))


@query("custom_reducer", "SELECT join_id, round(median(v), 6) AS result FROM v_branches GROUP BY join_id")
def custom_reducer(spark, sf):
    """The ``median`` reducer registered as a grouped-aggregate pandas UDF."""
    r = rd.reduce_custom(fx.v_branches(spark, sf), "median")
    return r.select("join_id", F.round("result", 6).alias("result"))
