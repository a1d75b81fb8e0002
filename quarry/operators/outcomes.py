"""Per-document outcomes: retry attempts (A17), page batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import dims


def attempt_class(result):
    """Retry on connection errors, read timeouts, 5xx and unknown errors; stop on 4xx/failure/skipped."""
    return (F.when(result == "success", "success")
            .when(result.isin("failure", "skipped") | result.rlike(r"^http_4[0-9][0-9]$"), "terminal")
            .otherwise("retry"))


def attempt_outcome(attempts: DataFrame, max_attempts: int = dims.MAX_ATTEMPTS, wait_s: int = dims.RETRY_WAIT_S,
                    deadline_s: int | None = None) -> DataFrame:
    """Attempt log ``(doc_id, attempt, result[, started_s])`` -> final outcome per document.

    Within the first ``max_attempts`` attempts (and, given ``deadline_s``,
    those started by then, in seconds since the document's start) the first
    success or terminal result decides; otherwise the document is
    ``exhausted``, or ``timed_out`` if the deadline stopped it. A retried
    attempt ``a`` waits ``wait_s * a`` seconds. Logged attempts beyond the
    policy decide nothing and are counted in ``n_past_policy``.
    """
    late = F.lit(False) if deadline_s is None else F.col("started_s") > deadline_s
    a = attempts.withColumn("cls", attempt_class(F.col("result"))).withColumn("late", late)
    a = a.withColumn("inside", (F.col("attempt") <= max_attempts) & ~F.col("late"))
    deciding = F.col("inside") & (F.col("cls") != "retry")
    g = a.groupBy("doc_id").agg(
        F.min(F.when(deciding, F.col("attempt"))).alias("decided"),
        F.min_by(F.col("result"), F.when(deciding, F.col("attempt"))).alias("decided_result"),
        F.max(F.when(F.col("inside"), F.col("attempt"))).alias("last_attempt"),
        F.count_if(~F.col("inside")).alias("n_past_policy"),
        F.bool_or(F.col("late") & (F.col("attempt") <= max_attempts)).alias("stopped"),
        F.collect_list(F.when(F.col("inside") & (F.col("attempt") < max_attempts), F.col("attempt"))).alias("atts"))
    used = F.coalesce(F.col("decided"), F.col("last_attempt"))
    waits = F.aggregate(F.filter("atts", lambda x: x < used), F.lit(0).cast("bigint"), lambda acc, x: acc + x * wait_s)
    outcome = (F.when(F.col("decided").isNotNull(), F.when(F.col("decided_result") == "success", "success").otherwise("failed"))
               .when(F.col("stopped"), "timed_out").otherwise("exhausted"))
    return g.select("doc_id", used.alias("attempts_used"), outcome.alias("outcome"), waits.alias("wait_s"), "n_past_policy")


def page_ranges(docs: DataFrame, batch_pages: int) -> DataFrame:
    """``(doc_id, pages)`` -> one row per page range; small documents stay whole.

    Documents with more than ``batch_pages`` pages split into 1-based
    ``[s, min(s+n-1, pages)]``; others get one ``whole`` row.
    """
    n = batch_pages
    split = F.col("pages") > n
    starts = F.when(split, F.sequence(F.lit(1).cast("bigint"), F.col("pages"), F.lit(n).cast("bigint"))) \
        .otherwise(F.array(F.lit(1).cast("bigint")))
    x = docs.select("doc_id", "pages", split.alias("batched"), F.explode(starts).alias("start_page"))
    end = F.when(F.col("batched"), F.least(F.col("start_page") + (n - 1), F.col("pages"))).otherwise(F.col("pages"))
    label = F.when(F.col("batched"), F.concat(F.lit("pages "), F.col("start_page").cast("string"), F.lit("-"),
                                              end.cast("string"))).otherwise(F.lit("whole document"))
    return x.select("doc_id", "start_page", end.alias("end_page"), label.alias("label"), "batched")


def merge_page_batches(batches: DataFrame) -> DataFrame:
    """Per document in ``start_page`` order: concat elements, join doctags / markdown, list failures.

    Input ``(doc_id, start_page, elements ARRAY, doctags, md, json, failed BOOLEAN, label)``.
    Ordering happens on a bounded per-document list (pages of one document).
    """
    b = batches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "start_page", "failed", "label", "elements", "doctags", "md", "json"))).alias("bs"))
    ok = F.filter("bs", lambda x: ~x["failed"])
    return b.select(
        "doc_id",
        F.flatten(F.transform(ok, lambda x: x["elements"])).alias("elements"),
        # empty parts add no separator
        F.array_join(F.filter(F.transform(ok, lambda x: x["doctags"]), lambda t: t != ""), "\n").alias("doctags"),
        F.array_join(F.filter(F.transform(ok, lambda x: x["md"]), lambda t: t != ""), "\n\n").alias("md"),
        F.transform(ok, lambda x: x["json"]).alias("json"),
        F.transform(F.filter("bs", lambda x: x["failed"]), lambda x: x["label"]).alias("failed_batches"),
        F.size(F.filter("bs", lambda x: x["failed"])).alias("n_failed"))


def document_outcome(merged: DataFrame) -> DataFrame:
    """Failed (no elements and a failed batch) / partial / empty / parsed."""
    n_el = F.size("elements")
    return merged.withColumn("outcome", F.when((n_el == 0) & (F.col("n_failed") > 0), "failed")
                             .when(F.col("n_failed") > 0, "partial")
                             .when(n_el == 0, "empty").otherwise("parsed"))
