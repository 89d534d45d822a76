"""The stages on a small corpus with planted cases, and each against what it should keep."""

import corpus_pipeline
from panelforge.llm import decontaminate, neardup

from ..conftest import SMALL


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SMALL).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
    for before in kept[1:5]:
        assert before.columns == docs.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    gone = docs.join(kept[1], "doc_id", "left_anti").join(labels, "doc_id")
    assert gone.where("toxic = 0").count() == 0
    found = neardup.components(kept[1])
    assert {r.doc_id for r in kept[2].collect()} == {r.doc_id for r in found.where("n_shingles = 0 OR doc_id = component_id").collect()}
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    clean = {r.doc_id: r.text for r in kept[2].collect()}
    hit = {r.doc_id for r in decontaminate.match_spans(kept[2], bench).collect() if r.spans}
    for r in kept[3].collect():
        assert (r.text != clean[r.doc_id]) == (r.doc_id in hit)
    assert kept[5].count() == kept[4].count() and set(kept[5].columns) == {*docs.columns, "shard", "slot"}


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def through(spark, docs, folder):
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(folder / str(i)))
        docs = spark.read.parquet(str(folder / str(i)))
    return docs


def test_odd_rows(spark, prose, tmp_path):
    texts = prose(3, 40, 91)
    rows = [
        (1, texts[0], None, None, None), (1, texts[0], None, None, None), (None, texts[0], "en", "a", 5), (None, texts[1], "en", "a", 5), (None, texts[1], "en", "b", 5),
        (2, None, None, "a", None), (3, "", "en", None, 0), (None, None, None, None, None), (4, texts[2], "en", "a", 1),
    ]
    spec = "doc_id long, text string, lang string, source string, n_chars long, key long, times long, size long, head string"
    out = through(spark, spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], spec), tmp_path)
    assert {"key", "times", "size", "head", "shard", "slot"} <= set(out.columns)
    assert {(r.doc_id, r.text) for r in out.collect() if r.text} <= {(1, texts[0]), (None, texts[1]), (4, texts[2])}
    kept = spark.read.parquet(str(tmp_path / "1"))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(1, texts[0]), (0, texts[1]), (4, texts[2]), (2, ""), (3, ""), (0, "")])


def test_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert through(spark, docs, tmp_path).count() == 0
