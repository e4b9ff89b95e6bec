"""The gazetteer against a search of every place of every text."""

import random
import re

from beleg.operators.extraction import gazetteer_mentions


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def slow(texts, labels):
    out = []
    for i, text in texts:
        have = words_of(text or "")
        for label in labels:
            want = words_of(label)
            out += [(i, at, label) for at in range(len(have) - len(want) + 1) if want and have[at:at + len(want)] == want]
    return sorted(out)


def found(spark, texts, labels, parts=3):
    docs = spark.createDataFrame(texts, "doc_id string, text string").repartition(parts)
    rows = gazetteer_mentions(docs, spark.createDataFrame([(x,) for x in labels], "label string")).collect()
    return sorted((r["doc_id"], r["position"], r["label"]) for r in rows)


def test_equals_a_search_of_every_place(spark):
    draw = random.Random(21)
    vocabulary = [f"w{i}" for i in range(12)] + ["rare", "Straße", "É9"]
    texts = [(f"d{i}", " ".join(draw.choice(vocabulary) + draw.choice(["", ",", ".", "-"]) for _ in range(draw.randint(0, 80)))) for i in range(40)]
    labels = {" ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 4))) for _ in range(60)}
    # Labels of up to 12 words are cut out of the texts, so that they occur, at their starts and ends too.
    for i, (_, text) in enumerate(texts[:12]):
        have, n = text.split(), i + 1
        if len(have) >= n:
            labels |= {" ".join(have[:n]), " ".join(have[-n:])}
    labels = sorted(labels)
    want = slow(texts, labels)
    assert len(want) > 200 and max(len(words_of(x[2])) for x in want) == 12
    assert found(spark, texts, labels) == want


def test_marks_repeats_and_nothing(spark):
    texts = [("a", "C++ and c, c"), ("b", None), ("c", ""), ("d", "one two one two one"), ("e", "two one")]
    labels = ["c++", "C", "one two one", "?!", ""]
    assert found(spark, texts, labels) == slow(texts, labels)
    assert found(spark, texts, ["c++", "C", "two"]) == slow(texts, ["c++", "C", "two"])
    assert found(spark, texts, ["?!"]) == []
