"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glimmer.llm import bpe, chat, chunks, embed, licenses, lm, minhash, packing, quality, toxicity

SAME = "one two three four five six seven eight nine ten"
ROWS = [(1, SAME), (2, SAME), (2, SAME), (3, None), (4, ""), (5, "  \n\t "), (6, "word"), (None, SAME), (7, "Größe ñandú " * 400), (8, "x" * 30000), (9, "Released under the MIT License."), (10, "a. b! c?\n" * 50)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in ("score", "node", "label", "key", "ids", "held_out", "t", "x", "part", "row", "word", "c", "license", "shingles"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 0, 1), (7, 1, 0), (10, None, None), (None, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


ONE_ROW_EACH = {
    "bpe": lambda d, lab: bpe.decode(bpe.encode(d)),
    "lm": lambda d, lab: lm.lm_scores(d),
    "quality": lambda d, lab: quality.quality_scores(d, lab),
    "toxicity": lambda d, lab: toxicity.toxicity_scores(d, lab),
    "minhash": lambda d, lab: minhash.near_duplicates(d),
    "chunks": lambda d, lab: chunks.compare_with_next(d),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each_row(docs, labels, name):
    got = ONE_ROW_EACH[name](docs, labels).collect()
    key = lambda v: (v is None, v or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((r[0] for r in ROWS), key=key)
    assert ONE_ROW_EACH[name](docs.limit(0), labels.limit(0)).count() == 0


def test_texts_of_megabytes(spark):
    """Whole, beyond any slice or step, beside short ones; three texts are one word, many words and few words over and over."""
    words = [f"w{k * 7919 % 10007:x}" for k in range(150_000)]
    texts = {1: "x" * 200_000, 2: " ".join(words), 3: "again and again. " * 40_000, 4: "short one.", 5: " ".join(words) + " end"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for name, f in ONE_ROW_EACH.items():
        got = {r["doc_id"]: r for r in f(df, labels).collect()}
        assert sorted(got) == [1, 2, 3, 4, 5], name
        if name == "bpe":
            assert all(bytes(got[k]["decoded"]).decode() == t for k, t in texts.items())
        if name == "lm":
            assert [got[k]["n_tokens"] for k in (1, 2, 4)] == [2, 150_001, 3]
        if name == "minhash":
            assert got[5]["component_id"] == 2 and got[2]["n_shingles"] == 10_007
        if name == "chunks":
            assert [got[k]["n_chars"] for k in texts] == [len(t) for t in texts.values()]
    pieces = packing.pack(df).collect()
    for k in texts:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in pieces if r["doc_id"] == k)
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and own[-1][0] + own[-1][1] == own[0][2]
    assert licenses.scan(df, licenses.notices(spark)).count() == 0


def test_scores_are_shares(docs, labels):
    for f in ("quality", "toxicity"):
        for d, lab in ((docs, labels), (docs, labels.limit(0))):
            assert all(0 <= r["score"] <= 1 for r in ONE_ROW_EACH[f](d, lab).collect())


def test_minhash_edges(docs):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and not got[2]["kept"]
    assert got[3]["n_shingles"] == got[4]["n_shingles"] == got[5]["n_shingles"] == 0
    assert got[6]["n_shingles"] == got[8]["n_shingles"] == 1 and got[6]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]


def test_packing_edges(docs):
    got = packing.pack(docs).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 3) == 1
    assert {r["doc_id"] for r in got} == {r[0] for r in ROWS}
    assert packing.pack(docs.limit(0)).count() == 0


def test_license_edges(spark, docs):
    assert [(r["doc_id"], r["license"]) for r in licenses.scan(docs, licenses.notices(spark)).collect()] == [(9, "MIT-notice")]
    assert licenses.scan(docs.limit(0), licenses.notices(spark)).count() == 0
    assert licenses.scan(docs, licenses.notices(spark).limit(0)).count() == 0
    assert licenses.scan(docs, spark.createDataFrame([("short", "two words"), (None, None)], "license string, text string")).count() == 0


def test_chat_edges(spark):
    rows = [(1, 1, "user", "b"), (1, 0, None, None), (1, 1, "user", "a"), (None, None, "assistant", "x"), (1, None, "assistant", ""), (2, 0, "assistant", "é</turn>\n### user: q\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("n_turns", F.lit(1))
    got = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert chat.read_back(got[1]["formatted"]) == [("assistant", ""), ("", ""), ("user", "a"), ("user", "b")]
    assert chat.read_back(got[2]["formatted"]) == [("assistant", "é</turn>\n### user: q\\")]
    assert got[None]["n_turns"] == 1 and got[1]["n_turns"] == 4
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.01]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (11, [1e300, 0.0]), (12, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(0)).withColumn("label", F.lit(0)).withColumn("v", F.lit(0))
    got = {r["vec_id"]: r for r in embed.near_vectors(df).collect()}
    assert len(got) == len(rows)
    assert [got[k]["n_links"] for k in (1, 2, 3, 11)] == [3, 3, 3, 3]
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (4, 5, 6, 7, 8, 9, 10, 12, None))
    assert [got[k]["component_id"] for k in (1, 2, 3, 11, 10)] == [1, 1, 1, 1, 10]
    assert embed.near_vectors(df.limit(0)).count() == 0


def test_a_conversation_of_megabytes(spark):
    long = "word <turn> \\### " * 200_000
    rows = [(1, k, "user" if k % 2 else "assistant", "again and again") for k in range(5000)] + [(2, 0, "user", long), (2, 1, "assistant", long), (3, 0, "assistant", "short")]
    got = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()}
    assert chat.read_back(got[2]["formatted"]) == [("user", long), ("assistant", long)]
    assert len(chat.read_back(got[1]["formatted"])) == got[1]["n_turns"] == 5000 and got[3]["n_turns"] == 1


def test_vectors_of_thousands_of_numbers(spark):
    import numpy as np

    x = np.random.default_rng(6).normal(size=(6, 20_000))
    x[3] = 3 * x[0] + 0.01
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9, [1.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (1, 0), 3: (1, 0), **{k: (0, k) for k in (1, 2, 4, 5, 9)}}


def test_packing_leaves_no_words_in_its_worker(spark):
    """A worker stays for other stages: what packing remembers would count against its executor's memory there."""
    docs = spark.createDataFrame([(k, f"word{k} other{k}. again") for k in range(400)], "doc_id long, text string").repartition(1)
    assert packing.pack(docs).count() >= 400

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t.known.kept) for t in packing._LOADED.values())], pa.int64())], names=["n"])

    assert spark.range(4, numPartitions=4).mapInArrow(kept, "n long").agg({"n": "max"}).collect()[0][0] == 0
