"""URL filter: longest-rule verdicts, else gradient-boosted trees on lexical features.

Rules are ``(verdict, "host/path")`` pairs; a rule fits its host and all
subdomains where the url's path starts with the rule's path, and the longest
fitting rule decides. Urls that no rule fits go to a boosted-tree model
(``pyspark.ml``), trained on labelled urls: by default those that a rule
labels, up to ``max_train`` distinct urls of them by hash (the bound of the sample
is a parameter; every url is scored).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower

# Fixed by the task: verdict and rule.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]

FEATURES = ["f_length", "f_host_length", "f_labels", "f_depth", "f_digits", "f_params", "f_entropy",
            "f_path_digits", "f_last_length", "f_has_fragment", "f_has_dot", "f_suffix_rate", "f_suffix_count",
            "f_head_rate", "f_head_count"]


def parsed(urls: DataFrame) -> DataFrame:
    """Add ``host`` and ``path`` (both empty for null urls or urls without ``://``)."""
    u = F.coalesce(F.col("url"), F.lit(""))
    return (urls.withColumn("host", ascii_lower(F.regexp_extract(u, "(?s)^.*?://([^/?#]*)", 1)))
            .withColumn("path", F.regexp_extract(u, "(?s)^.*?://[^/?#]*([^?#]*)", 1)))


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (nulls if none fits).

    The rule list is a bounded parameter, so it becomes one expression: no
    explode, no join, no hot host.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(rules, key=lambda r: len(r[1])):
        host, _, rest = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def _entropy(c: Column) -> Column:
    """Shannon entropy of the characters."""
    chars = F.split(c, "")
    total = F.length(c).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)).cast("double"))
    bits = F.aggregate(counts, F.lit(0.0), lambda s, n: s - n / total * F.log2(n / total))
    return F.when(total > 0, bits).otherwise(F.lit(0.0))


def lexical(urls: DataFrame) -> DataFrame:
    """Lexical features of a parsed url table; ``suffix`` and ``head`` are keys for label statistics."""
    u, path = F.coalesce(F.col("url"), F.lit("")), F.col("path")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    d = {
        "f_length": F.length(u), "f_host_length": F.length("host"), "f_labels": F.size(F.split("host", r"\.")),
        "f_depth": F.size(parts), "f_digits": _digits(u) / F.greatest(F.lit(1), F.length(u)),
        "f_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "f_entropy": _entropy(u),
        "f_path_digits": _digits(path), "f_last_length": F.length(last), "f_has_fragment": F.col("url").contains("#").cast("int"),
        "f_has_dot": last.contains(".").cast("int"),
    }
    urls = urls.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in d.items()})
    return urls.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1)).withColumn("head", F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")))


@dataclass
class UrlModel:
    """Trees plus the label statistics they read; ``trees`` is None without two classes."""

    trees: GBTClassificationModel | None
    suffixes: DataFrame | None
    heads: DataFrame | None
    constant: float


def _rates(labelled: DataFrame, key: str, keep: int) -> DataFrame:
    """Smoothed block rate per key of the ``keep`` most frequent keys of all labelled rows."""
    got = labelled.groupBy(key).agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    got = got.orderBy(F.desc("n"), key).limit(keep)
    return got.select(key, ((F.col("k") + 1) / (F.col("n") + 2)).alias(f"f_{key}_rate"), F.log1p("n").alias(f"f_{key}_count"))


def _joined(rows: DataFrame, model: UrlModel) -> DataFrame:
    # both tables are at most max_keys rows long by construction
    rows = rows.join(F.broadcast(model.suffixes), "suffix", "left").join(F.broadcast(model.heads), "head", "left")
    return rows.fillna({"f_suffix_rate": 0.5, "f_suffix_count": 0.0, "f_head_rate": 0.5, "f_head_count": 0.0})


def _sampled(labelled: DataFrame, label: float, distinct: int, most: int) -> DataFrame:
    """At most ``most`` distinct urls of one label, those that hash lowest, with the number of their rows (``n``).

    Thinned by hash before the shuffle, to about four times as many distinct
    urls as are wanted; a hot url is counted where it is read.
    """
    h = F.pmod(F.xxhash64("url"), F.lit(1 << 40))
    rows = labelled.where(F.col("label") == label)
    if distinct > 4 * most:
        rows = rows.where(h < F.lit((1 << 40) * 4 * most // distinct))
    return rows.groupBy("url", "label").agg(F.count("*").alias("n")).orderBy(h, "url").limit(most)


def train(labelled: DataFrame, max_train: int = 20000, max_keys: int = 1000, trees: int = 12, depth: int = 4) -> UrlModel:
    """Fit on a table ``url, label`` (1 = block).

    The trees see at most ``max_train`` distinct urls, as many of each class as
    there are, up to half of that number; a url weighs as many rows as it has,
    and a class as many as it has in the table. Suffix and first-path
    statistics come from all labelled rows.
    """
    rows = labelled.select("url", F.col("label").cast("double").alias("label")).where("label is not null")
    seen = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.approx_count_distinct("url").alias("urls")).collect()}
    if len(seen) < 2:
        return UrlModel(None, None, None, next(iter(seen), 0.0))
    spark = rows.sparkSession
    keyed = lexical(parsed(rows)).select("suffix", "head", "label")
    fixed = []
    for key in ("suffix", "head"):
        got = _rates(keyed, key, max_keys)
        fixed.append(spark.createDataFrame(got.collect(), got.schema))
    model = UrlModel(None, fixed[0], fixed[1], 0.0)
    parts = [_sampled(rows, label, r["urls"], max_train // len(seen)) for label, r in sorted(seen.items())]
    sample = lexical(parsed(reduce(DataFrame.union, parts))).persist()
    held = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    share = F.lit(1.0)
    for label, r in seen.items():
        share = F.when(F.col("label") == label, F.lit(r["n"] / held[label])).otherwise(share)
    total = sum(r["n"] for r in seen.values())
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(_joined(sample.withColumn("weight", F.col("n") * share / F.lit(total)), model)).select("features", "label", "weight")
    model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=7, stepSize=0.3, weightCol="weight").fit(vectors.coalesce(2))
    sample.unpersist()
    return model


def score(urls: DataFrame, model: UrlModel) -> DataFrame:
    """Add ``block_score`` (0 to 1) to a parsed url table."""
    if model.trees is None:
        return urls.withColumn("block_score", F.lit(float(model.constant)))
    kept = urls.columns
    rows = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(_joined(lexical(urls), model))
    m = model.trees
    m = m.setFeaturesCol("__features").setPredictionCol("__prediction").setRawPredictionCol("__raw").setProbabilityCol("__probability")
    return m.transform(rows).select(*kept, vector_to_array("__probability")[1].alias("block_score"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` for every url.

    Null, empty and malformed urls have empty host and path, fit no rule and
    are judged by the trees like any other. Repeated rows are each judged. Where
    the rules label no urls, or one class only, the model is the constant of
    that class (allow for an empty table). Extra columns are ignored.
    """
    rows = parsed(pages.select("page_id", "url"))
    name, verdict = rule_of(rules)
    rows = rows.withColumn("rule", name).withColumn("__by_rule", verdict)
    labelled = rows.where("rule is not null").select("url", F.when(F.col("__by_rule") == "block", 1.0).otherwise(0.0).alias("label"))
    scored = score(rows, train(labelled))
    by_model = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("__by_rule", by_model).alias("verdict"), "block_score")
