import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import urls


def brute(url):
    u = url or ""
    if "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best[1] if best else None, best[0] if best else None


URLS = [None, "", "nothing", "http://", "://x", "http://Example.ORG/es/1", "https://a.example.org/en/12?x=1&y=2#f", "http://org", "http://org/", "http://xorg/", "http://a.com/fr/",
        "http://a.com/de/x", "http://com/de/", "http://a.com?fr=/de/", "http://a.net/a/b/c.html#/x", "http://É.org/ü", "x://y://z/de/", "http://a.net/" + "q" * 50_000, "http://a.b.c.example.org/es/a\nb", "http://a.com#/de/"]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u) for i, u in enumerate(URLS)]
    rows += [(100 + i, f"http://h{i % 7}.example.{t}/{p}/{i}{'?a=1&b=2' * (i % 3)}") for i, (t, p) in enumerate((t, p) for _ in range(12) for t in ("com", "net", "org") for p in ("en", "de", "es", "fr"))]
    rows += [(None, "http://a.net/x"), (100, "http://dup.net/")]
    return rows, spark.createDataFrame([(*r, "h", "s", 1.0) for r in rows], "page_id long, url string, host string, suffix string, f_length double")


def test_rules_and_verdicts(pages):
    got = urls.judge(pages[1]).collect()
    assert len(got) == len(pages[0])
    want = sorted((str(i), *brute(u)[:3]) for i, u in pages[0])
    assert sorted((str(r.page_id), r.host, r.path, r.rule) if r.rule else (str(r.page_id), r.host, r.path, None) for r in got if r.rule) == [w for w in want if w[3]]
    assert sorted((str(r.page_id), r.host, r.path) for r in got) == sorted(w[:3] for w in want)
    by = {rule: v for v, rule in urls.RULES}
    assert all(r.verdict == by[r.rule] for r in got if r.rule)
    assert {r.verdict for r in got} <= {"allow", "block"}
    # no rule blocks a french page
    free = [r for r in got if r.host.endswith(".net")]
    assert {r.verdict for r in free if r.path.startswith("/fr/")} == {"allow"}


def test_trees_learn_held_out_labels(spark):
    rows = [(f"http://site{i % 50}.example/{'a/' * (i % 4)}page{i}" + ("?id=%d&session=%d&utm=%d" % (i, i * 7919, i * 104729) if i % 2 else ""), float(i % 2)) for i in range(400)]
    model = urls.train(spark.createDataFrame(rows[:300], "url string, label double"))
    got = urls.score(urls.parsed(spark.createDataFrame([(u, y) for u, y in rows[300:]], "url string, label double")), model).collect()
    assert sum((r.block_score >= 0.5) == (r.label == 1) for r in got) > 0.95 * len(got)


def test_one_class_and_empty(spark, pages):
    only = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.net/")], "page_id long, url string")
    assert {r.verdict for r in urls.judge(only).collect()} == {"allow"}
    assert urls.judge(pages[1].limit(0)).collect() == []


def test_many_rows_of_few_urls(spark):
    """Two classes of few, often repeated urls both reach the trees; a hot url does not push the others out."""
    hot = spark.range(300_000).select(F.concat(F.lit("http://a.example/"), (F.col("id") % 2).cast("string")).alias("url"), F.lit(0.0).alias("label"))
    rare = spark.createDataFrame([(f"http://b.example/x{i % 2}?q=1&r=2&s=3", 1.0) for i in range(40)], "url string, label double")
    model = urls.train(hot.union(rare), max_train=400)
    assert model.trees is not None
    got = urls.score(urls.parsed(spark.createDataFrame([("http://a.example/0", 0), ("http://b.example/x1?q=1&r=2&s=3", 1)], "url string, label int")), model).collect()
    assert all((r.block_score >= 0.5) == (r.label == 1) for r in got)
    assert {r.suffix: r.f_suffix_count for r in model.suffixes.collect()}["example"] > 12  # log of all 300,040 rows
