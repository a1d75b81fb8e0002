import pytest
from pyspark.sql import functions as F
from test_decontam import brute as brute_hits
from test_decontam import words
from test_simhash import groups, slow_fingerprint

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, docs, hard_docs, tmp_path_factory):
    """A folder with the three tables that the stages read; two items occur in documents."""
    at = tmp_path_factory.mktemp("tables")
    docs.write.parquet(f"{at}/documents.parquet")
    texts = dict(hard_docs)
    items = [(1, " ".join(words(texts[6])[2:14])), (2, " ".join(words(texts[30])[:10])), (3, None), (4, "nowhere in these documents at all my dear reader of tests")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    labels = [(d, 0 if d % 2 else 1, 0) for d, _ in hard_docs if d is not None and d < 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), items


def test_stages_take_effect(spark, docs, hard_docs, folder):
    at, items = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "personal_data", "packing"]
    rows = lambda d: sorted((str(r.doc_id), r.text or "") for r in d.collect())
    kept = corpus_pipeline.quality_stage(spark, docs, at)
    assert kept.columns == docs.columns and set(rows(kept)) <= set(rows(docs))

    alone = corpus_pipeline.near_dedup_stage(spark, docs, at)
    fp = {(d, t): slow_fingerprint(t) for d, t in hard_docs}
    root = groups(fp.values())
    first = {}
    for (d, t), f in fp.items():
        if d is not None:
            first[root[f]] = min(d, first.get(root[f], d))
    want = {(str(d), t or "") for (d, t), f in fp.items() if first.get(root[f]) == d}
    assert rows(alone) == sorted(want) and alone.columns == docs.columns

    clean = corpus_pipeline.decontamination_stage(spark, docs, at)
    bad = {r[0] for r in brute_hits(hard_docs, items, 10) if r[5]}
    assert bad and rows(clean) == sorted((str(d), t or "") for d, t in hard_docs if str(d) not in bad)

    told = spark.createDataFrame([(1, "mail a.b@c.de now", "en", "s", 17), (2, None, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.personal_data_stage(spark, told, at).collect()}
    assert got == {1: ("mail [EMAIL] now", 16), 2: (None, 0)}

    packed = corpus_pipeline.packing_stage(spark, docs, at)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == len({d for d, _ in hard_docs if d is not None})


def test_run(spark, folder, no_docs, tmp_path):
    got = corpus_pipeline.run(spark, folder[0])
    assert 0 < got.count() < 70
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_of_one_id_are_told_apart(spark, tmp_path):
    """Rows of one doc_id, or of none, are dropped for what their own text holds."""
    far = ["one two three four five six seven", "red green blue white black grey pink", "north south east west up down left"]
    rows = [(None, far[0]), (None, far[1]), (None, far[1]), (3, "a copy of this text stays once"), (7, "a copy of this text stays once"), (7, "but this one is alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda d: sorted((str(r.doc_id), r.text) for r in d.collect())
    assert kept(corpus_pipeline.near_dedup_stage(spark, docs, "")) == sorted((str(d), t) for d, t in {*rows} - {rows[4]})
    spark.createDataFrame([(1, far[0]), (2, rows[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert kept(corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))) == sorted((str(d), t) for d, t in rows[1:5])
