import zlib

import numpy as np
import pytest
from helpers import DOCUMENTS, documents

from beleg.llm import language

FOLDER = "/root/testdata/sf0.01"


def grams(text):
    folded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    while "  " in folded:
        folded = folded.replace("  ", " ")
    return folded


def test_kernel_counts_common_grams():
    scratch = np.zeros(language.PLACES, dtype=np.uint8)
    rows = {t: language.present(t, scratch) for t in ("ab ab", "AB!! ab", "xyz xyz", "é")}
    assert set(rows["ab ab"]) == set(rows["AB!! ab"]) and not scratch.any()
    # a, b, space, ab, "b ", " a", "ab ", "b a", " ab", "ab a", "b ab"
    assert len(rows["ab ab"]) == 11
    model = language.fit([("x", 1, rows["ab ab"]), ("y", 2, rows["xyz xyz"])], 1)
    kernel = model.kernel([rows["ab ab"], rows["xyz xyz"]])
    common = len(set(rows["ab ab"]) & set(rows["xyz xyz"]))
    assert kernel == pytest.approx(np.array([[1, common / np.sqrt(11 * len(rows["xyz xyz"]))], [common / np.sqrt(11 * len(rows["xyz xyz"])), 1]]))


@pytest.mark.parametrize("text", [None, "", " ", "12 345 %%", "½ ² 7", "\n"])
def test_no_letter(text):
    assert language.present(text, np.zeros(language.PLACES, dtype=np.uint8)) is None


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: r for r in language.judge(docs.select("doc_id", "text", "lang")).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert got.keys() == truth.keys()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r["held_out"]]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)


def test_prediction_reads_only_text_and_learns_only_from_training_rows(spark):
    base = [(i, t, lang, "s", None) for i, (t, lang) in enumerate([("the cat and the dog " + "x" * k, "aa") for k in range(40)] + [("una gata y un perro " + "y" * k, "bb") for k in range(40)])]
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, s, n) for i, t, lang, s, n in base]
    extra = [(1000, None, "aa", "s", None), (1001, "123", "aa", "s", None), (1001, "123", "aa", "s", None), (None, "the dog", None, None, None)]
    a, b = ([tuple(r) for r in language.judge(spark.createDataFrame(rows + extra, DOCUMENTS)).collect()] for rows in (base, swapped))
    assert sorted(a, key=str) == sorted(b, key=str)
    by_id = {r[0]: r for r in a}
    assert by_id[1000][2:] == by_id[1001][2:] == ("und", 0.0) and len(a) == 84
    assert by_id[None][1:3] == (False, "aa")


def test_one_row_of_each_id_is_learnt_from(spark, monkeypatch):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [(i, f"the cat {'x' * i}", "aa", "s", None) for i in ids[:20]]
    copies = [(ids[0], f"the dog {'y' * k}" if k % 2 else "12", "aa", "s", None) for k in range(500)]
    sizes, fit = [], language.fit
    monkeypatch.setattr(language, "fit", lambda sample, *settings: sizes.append([r[:2] for r in sample]) or fit(sample, *settings))
    for per_language in (160, 5):
        language.train(spark.createDataFrame(rows + copies, DOCUMENTS).repartition(3), per_language)
    assert [(len(s), len(set(s))) for s in sizes] == [(20, 20), (5, 5)]


def test_nothing_to_learn_from(spark):
    docs = documents(spark, ["some text"])
    assert [tuple(r)[2:] for r in language.judge(docs).collect()] == [("und", 0.0)]
    assert language.judge(docs.filter("doc_id < 0")).collect() == []


def test_other_columns_pass(spark):
    docs = documents(spark, ["some text"]).selectExpr("*", "array(1) AS held_out")
    out = language.predict(docs, language.train(docs), "l", "s")
    assert out.columns == [*docs.columns, "l", "s"]
