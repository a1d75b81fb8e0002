"""W1 section path and W2 chunking (X3 is the pluggable variant).

Chunk rule (our contract):
  * Title elements open a section; the section path joins the headings above
    it (W1). Titles are headings, not chunk content.
  * Content elements (non-blank text) cost ``greatest(1, length div 4)``.
  * Walk a section by ``pos``; open a new chunk when the chunk is empty or
    when adding the element would pass ``max_tokens``.
  * An element costing more than ``max_tokens`` is its own chunk and is cut
    into pieces of ``4 * max_tokens`` characters, one chunk each.
  * Chunk text = section path line + newline + element texts joined by a
    newline; ``tokens = greatest(1, length(text) div 4)`` of the final text.
  * ``merge_peers=False`` gives one chunk per element.

Scale: everything is keyed by ``doc_id`` first. A document is bounded by the
file-size guard (50 MB), so per-document groups are bounded. The greedy
fold runs JVM-side with ``aggregate`` over the sorted ``(pos, cost)`` ints of
one section and emits only chunk start positions; texts never enter it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip_ws, token_estimate

DEFAULT_MAX_TOKENS = 512


# Distinct heading levels up to which each has window columns of its own.
WINDOW_LEVELS = 12


def _path_fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Heading paths of sorted elements: a stack of the titles that are open."""
    doc, number, stack = None, 0, []
    for b in batches:
        numbers, paths = [], []
        for d, kind, level, text in zip(b["doc_id"], b["type"], b["_level"], b["text"]):
            if d != doc:
                doc, number, stack = d, 0, []
            if kind == "Title":
                number += 1
                stack = [*(s for s in stack if s[0] < level), (level, text)]
            numbers.append(number)
            paths.append(" > ".join(t for _, t in stack if t) or None)
        yield b.drop(columns="_level").assign(section_no=numbers, section_title=paths)


def section_path(elements: DataFrame) -> DataFrame:
    """Add ``section_no`` and ``section_title`` to ``(doc_id, pos, type, text[, level])``.

    ``section_title`` is the heading path: the latest Title of each level that
    no Title of a higher rank has followed, joined by `` > ``, empty ones left
    out. A Title without a ``level`` has level 1; there may be any number of
    levels: up to ``WINDOW_LEVELS`` that occur are window columns, more are
    folded in one sorted pass per document.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_title = F.col("type") == "Title"
    level, levels = F.lit(1), [1]
    if "level" in elements.columns:
        level = F.greatest(F.lit(1), F.coalesce(F.col("level"), F.lit(1)))
        levels = sorted(r[0] for r in elements.where(is_title).select(level.alias("l")).distinct().limit(WINDOW_LEVELS + 1).collect()) or [1]
    if len(levels) > WINDOW_LEVELS:
        rows = elements.withColumn("_level", level).repartition("doc_id").sortWithinPartitions("doc_id", "pos")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in elements.schema)
        return rows.select(*elements.columns, "_level").mapInPandas(_path_fold, f"{schema}, section_no long, section_title string")
    used = len(levels)
    out = elements.withColumn("section_no", F.sum(is_title.cast("int")).over(w))
    at = [F.max(F.when(is_title & (level == i), F.struct("pos", "text"))).over(w) for i in levels]
    out = out.withColumns({f"_h{i}": c for i, c in enumerate(at)})
    parts, above = [], F.lit(-1)
    for i in range(used):
        here = F.coalesce(F.col(f"_h{i}.pos"), F.lit(-1))
        parts.append(F.when(here > above, F.nullif(F.col(f"_h{i}.text"), F.lit(""))))
        above = F.greatest(above, here)
    path = F.concat_ws(" > ", *parts)
    return out.withColumn("section_title", F.nullif(path, F.lit(""))).drop(*[f"_h{i}" for i in range(used)])


def _chunk_starts(content: DataFrame, max_tokens: int) -> DataFrame:
    """Greedy fold per (doc, section) -> one row per chunk start ``(doc_id, section_no, pos, chunk_idx)``."""
    b = F.lit(max_tokens)
    items = (content.groupBy("doc_id", "section_no")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "cost"))).alias("items")))
    init = F.struct(F.lit(0).alias("acc"), F.array().cast("array<int>").alias("starts"))

    def step(s, e):
        new_chunk = (s["acc"] == 0) | (s["acc"] + e["cost"] > b)
        acc = (F.when(e["cost"] > b, b + 1).when(new_chunk, e["cost"])
               .otherwise(s["acc"] + e["cost"]))
        starts = F.when(new_chunk, F.concat(s["starts"], F.array(e["pos"]))).otherwise(s["starts"])
        return F.struct(acc.alias("acc"), starts.alias("starts"))

    folded = items.select("doc_id", "section_no",
                          F.aggregate("items", init, step)["starts"].alias("starts"))
    return folded.select("doc_id", "section_no",
                         F.posexplode("starts").alias("chunk_idx", "pos"))


def chunk_documents(elements: DataFrame, max_tokens: int = DEFAULT_MAX_TOKENS,
                    merge_peers: bool = True) -> DataFrame:
    """``(doc_id, pos, type, text[, page_number][, level])`` -> chunk rows.

    Output: ``doc_id, chunk_no, text, tokens, section_title, page_number, chunk_type``.
    """
    if "page_number" not in elements.columns:
        elements = elements.withColumn("page_number", F.lit(None).cast("int"))
    level = ["level"] if "level" in elements.columns else []
    el = section_path(elements.select("doc_id", "pos", "type", "text", "page_number", *level))
    content = (el.where((F.col("type") != "Title") & (strip_ws(F.col("text")) != ""))
               .withColumn("cost", token_estimate(F.col("text"))))

    if merge_peers:
        starts = _chunk_starts(content, max_tokens)
        w = (Window.partitionBy("doc_id", "section_no").orderBy("pos")
             .rowsBetween(Window.unboundedPreceding, 0))
        assigned = (content.join(starts, ["doc_id", "section_no", "pos"], "left")
                    .withColumn("chunk_idx", F.max("chunk_idx").over(w)))
    else:
        assigned = content.withColumn("chunk_idx", F.col("pos"))

    piece = 4 * max_tokens
    chunks = (assigned.groupBy("doc_id", "section_no", "chunk_idx")
              .agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("items"),
                   F.first("section_title").alias("section_title"),
                   F.min_by("page_number", F.when(F.col("page_number").isNotNull(), F.col("pos")))
                   .alias("page_number"),
                   F.min("pos").alias("first_pos"),
                   F.max("cost").alias("max_cost"))
              .withColumn("body", F.array_join(F.transform("items", lambda x: x["text"]), "\n")))
    # An oversized element is cut in one pass over its text.
    cut = F.regexp_extract_all(F.col("body"), F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    pieces = F.when(F.col("max_cost") > max_tokens, cut).otherwise(F.array("body"))
    chunks = chunks.select("*", F.posexplode(pieces).alias("piece", "part")).drop("body").withColumnRenamed("part", "body")
    text = F.concat_ws("\n", F.col("section_title"), F.col("body"))
    out = chunks.withColumn("text", text).where(strip_ws(F.col("text")) != "")
    w_doc = Window.partitionBy("doc_id").orderBy("first_pos", "piece")
    return out.select(
        "doc_id",
        F.row_number().over(w_doc).cast("int").alias("chunk_no"),
        "text",
        token_estimate(F.col("text")).alias("tokens"),
        "section_title",
        "page_number",
        F.lit("text").alias("chunk_type"),
    )
