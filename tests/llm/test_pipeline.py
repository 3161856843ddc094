"""The pipeline: each stage's decisions take effect, and clean documents stay."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from glimmer.llm import common, quality
from glimmer.llm.common import table
from tests.conftest import SMALL


def test_stages(spark):
    labels = {r["doc_id"]: r for r in table(spark, SMALL, "labels").collect()}
    docs = table(spark, SMALL, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "minhash", "packing"]
    seen = [{r[0] for r in docs.select("doc_id").collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.cut(stage(spark, docs, SMALL))
        assert docs.columns == before.columns
        seen.append({r[0] for r in docs.select("doc_id").collect()})
        assert seen[-1] <= seen[-2]
    good = [i for i in seen[0] if i in labels and labels[i]["quality"] == 1]
    assert np.mean([i in seen[1] for i in good]) > 0.95
    assert not [i for i in seen[1] if i in labels and labels[i]["quality"] == 0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).select("doc_id").distinct()
    assert {r[0] for r in packed.collect()} == seen[-1]
    # dedup keeps one of each group: nothing is left to link
    again = corpus_pipeline.dedup_stage(spark, docs, SMALL)
    assert again.count() == docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


CLASH = ("score", "node", "x", "row", "word", "label", "held_out", "kept_id", "many", "of", "part", "ids", "top", "keys")


def test_each_row_is_judged_on_its_own(spark):
    labels = {r["doc_id"]: r for r in table(spark, SMALL, "labels").collect()}
    texts = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    kinds = {"good": next(t for i, t in texts.items() if i in labels and labels[i]["quality"] == 1 and not labels[i]["toxic"] and len(t) > 200), "junk": next(t for i, t in texts.items() if i in labels and labels[i]["quality"] == 0)}
    long = " ".join(f"{w} and the rest." for w in kinds["good"].split()) * (3_000_000 // (4 * len(kinds["good"])))
    a, b, c, d, e = range(10**6, 10**6 + 5)
    rows = [(a, kinds["good"]), (a, kinds["junk"]), (None, kinds["good"]), (None, kinds["junk"]), (b, None), (c, ""), (d, " \n\t"), (a, kinds["good"]), (e, long)]
    odd = lambda df: df.where(f"doc_id is null or doc_id >= {a}")
    # the labelled documents are there to learn from
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(table(spark, SMALL, "documents").select("doc_id", "text"))
    for name in CLASH:
        docs = docs.withColumn(name, F.lit("clash"))
    docs = corpus_pipeline.cut(docs.repartition(3))
    kept = corpus_pipeline.quality_stage(spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.where("score <> 'clash'").count() == 0
    scores = {r["text"]: r["score"] for r in scores_of(spark, texts, kinds)}
    assert scores[kinds["junk"]] < 0.3 <= scores[kinds["good"]]
    got = [(r["doc_id"], r["text"]) for r in odd(kept).collect()]
    assert kinds["junk"] not in [t for _, t in got]
    assert sorted(map(repr, [g for g in got if g[1] == kinds["good"]])) == sorted(map(repr, [r for r in rows if r[1] == kinds["good"]]))
    clean = corpus_pipeline.toxicity_stage(spark, docs, SMALL)
    assert clean.columns == docs.columns
    groups = {}
    for r in odd(clean).collect():
        groups.setdefault(r["text"], []).append(r["doc_id"])
    # rows of one text go or stay together
    assert all(sorted(map(repr, ids)) == sorted(repr(i) for i, t in rows if t == text) for text, ids in groups.items())
    one = [(r["doc_id"], r["text"]) for r in corpus_pipeline.dedup_stage(spark, odd(docs), SMALL).select("doc_id", "text").collect()]
    assert sorted(map(repr, (i for i, _ in one))) == sorted(map(repr, [a, None, None, b, c, d, e]))
    packed = corpus_pipeline.packing_stage(spark, odd(docs), SMALL).collect()
    assert sum(r["length"] for r in packed if r["doc_id"] in (b, c, d)) == 3
    assert {r["doc_id"] for r in packed} == {a, None, b, c, d, e} and sum(r["start"] == 0 for r in packed) == len(rows)


def scores_of(spark, texts, kinds):
    ids = {t: i for i, t in texts.items()}
    wanted = {ids[t]: t for t in kinds.values()}
    got = quality.quality_scores(table(spark, SMALL, "documents"), table(spark, SMALL, "labels")).where(F.col("doc_id").isin(list(wanted))).collect()
    return [{"text": wanted[r["doc_id"]], "score": r["score"]} for r in got]


def test_run_equals_its_stages(spark):
    """The whole pipeline packs the same documents, whole, as its stages one by one."""
    docs = table(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut(stage(spark, docs, SMALL))
    sizes = lambda df: {r["doc_id"]: r["n"] for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes(corpus_pipeline.run(spark, SMALL)) == sizes(docs)


def test_run_on_empty_tables(spark, tmp_path):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    for name, d, lab in (("nothing", docs.limit(0), labels.limit(0)), ("unlabelled", docs, labels.limit(0)), ("unwritten", docs.limit(0), labels)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        lab.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/nothing").count() == corpus_pipeline.run(spark, f"{tmp_path}/unwritten").count() == 0
    # without labels nothing is known to be bad: what is left are all documents but near-duplicates
    kept = {r[0] for r in corpus_pipeline.dedup_stage(spark, docs, SMALL).select("doc_id").collect()}
    assert {r[0] for r in corpus_pipeline.run(spark, f"{tmp_path}/unlabelled").select("doc_id").distinct().collect()} == kept


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])


def test_stages_send_python_little_at_once(spark):
    """Batches go by bytes, so long texts take an executor no more memory than short ones; a lower limit of the user's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    default = spark.conf.get(name)
    docs = corpus_pipeline.cut(table(spark, SMALL, "documents").limit(20).withColumn("text", F.repeat(F.lit("words of a text. "), 20_000)).coalesce(1))
    most = lambda: max(r["n"] for r in docs.select("doc_id", "text").mapInArrow(_sizes, "n long").collect())
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, "64m")
            assert most() > 6_000_000
            stage(spark, docs, SMALL)
            assert most() < 2_400_000
        spark.conf.set(name, "1k")
        corpus_pipeline.packing_stage(spark, docs, SMALL)
        assert spark.conf.get(name) == "1k"
    finally:
        spark.conf.set(name, default)


def test_what_a_worker_keeps():
    """A task leaves no table of powers behind, and hashes are the same without."""
    data = np.frombuffer(b"one two three four five six", np.uint8)
    before = common.shingle_sets(data, np.array([0, len(data)]))
    assert sum(p.nbytes for p in common._POWERS) > 30e6
    list(common.tidy(lambda batches: batches)(iter([])))
    assert not common._POWERS
    assert all(np.array_equal(a, b) for a, b in zip(before, common.shingle_sets(data, np.array([0, len(data)])), strict=True))
