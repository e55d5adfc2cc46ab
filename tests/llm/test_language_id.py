import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from webtally.llm import language_id, queries
from webtally.llm.language_id import Model, grams_of, identify, identify_held_out, train


def plain_grams(text):
    b = text.lower().encode()
    return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}


@pytest.mark.parametrize("text", ["", "a", "aB", "aaaa", "Él nîño", "日本語テキスト", "x" * 5000 + "yz"])
def test_grams_are_distinct_and_whole(text):
    grams = grams_of(text)
    assert len(grams) == len(set(grams.tolist())) == len(plain_grams(text))


def test_scores_equal_the_kernel_of_the_landmarks():
    texts = ["the cat sat", "le chat noir", "a", "the chat"]
    sets = [grams_of(t) for t in texts]
    codes = np.unique(np.concatenate(sets)).astype(np.int32)
    incidence = np.zeros((len(codes), len(texts)))
    for i, g in enumerate(sets):
        incidence[np.searchsorted(codes, g), i] = 1 / np.sqrt(len(g))
    got = Model(list(map(str, range(4))), codes, incidence).scores(texts + ["xyz le"])
    for i, a in enumerate(texts + ["xyz le"]):
        for j, b in enumerate(texts):
            x, y = plain_grams(a), plain_grams(b)
            assert got[i, j] == pytest.approx(len(x & y) / np.sqrt(len(x) * len(y)), abs=1e-6)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = {r["doc_id"]: r for r in queries.op5_language_id(spark, folder).collect()}
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert rows.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    held = [i for i, r in rows.items() if r["held_out"]]
    assert sum(rows[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_does_not_learn_from_held_out_documents(spark):
    texts = {"a": "lorem ipsum dolor", "b": "qwrt zxcv bnmk"}
    rows = [(i, texts["ab"[i % 2]], "ab"[i % 2]) for i in range(200)]
    lied = [(i, t, "c" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows]
    schema = "doc_id bigint, text string, lang string"
    one, two = (identify_held_out(spark.createDataFrame(x, schema)).collect() for x in (rows, lied))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert {r["lang_pred"] for r in one} == {"a", "b"}
    assert all(r["lang_pred"] == "ab"[r["doc_id"] % 2] for r in one)


def test_edge_cases(spark):
    rows = [(i, ["the cat and the dog", "le chat et le chien"][i % 2], ["en", "fr"][i % 2], "x") for i in range(100)]
    rows += [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, " 12 -- ٣ ²", "fr", "x"), (None, "le chat", None, "x"),
             (1003, "the dog " * 100_000, None, "x"), (1004, "the dog", "en", None), (1004, "the dog", "en", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, language string")
    found = identify_held_out(df).collect()
    assert len(found) == len(rows)
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in found if r["doc_id"] is None or r["doc_id"] >= 1000), key=str)
    assert got == [(1000, "und"), (1001, "und"), (1002, "und"), (1003, "en"), (1004, "en"), (1004, "en"), (None, "fr")]
    assert all(r["score"] == 0 for r in found if r["lang_pred"] == "und")
    assert identify_held_out(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify_held_out(unlabelled).collect()} == {"und"}
    model = train(df.where("doc_id < 100").selectExpr("doc_id", "lang AS language", "text"))
    assert model.languages == ["en", "fr"]
    assert identify(df.limit(3), model).count() == 3
    assert language_id.has_letter("1é") and not language_id.has_letter("1 _")
