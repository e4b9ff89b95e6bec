import hashlib
import random
import re

from helpers import documents

from beleg.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(rows, items):
    windows = []
    for i, t in items:
        w = words_of(t)
        windows += [(str(i), w[k:k + 10]) for k in range(max(1, len(w) - 9))] if w else []
    out = {}
    for i, t in rows:
        w, hit, found = words_of(t), set(), set()
        for item, window in windows:
            for k in range(len(w) - len(window) + 1):
                if w[k:k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    found.add(item)
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def sample():
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("abcdé") for _ in range(3)) for _ in range(40)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(12, 30)))) for i in range(20)]
    items += [(50, "Short one"), (51, "..."), (52, None), (53, items[0][1]), (100, items[1][1][:80])]
    rows = []
    for i in range(60):
        parts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60)))]
        if i % 3 == 0:
            w = draw.choice(items[:20])[1].split()
            k = draw.randint(0, len(w) - 11)
            parts.insert(0, ", ".join(w[k:k + draw.randint(9, 30)]).upper())
        rows.append((i, " ".join(parts)))
    return rows + [(70, "a SHORT\none!"), (71, None), (72, ""), (73, "?? --"), (74, items[2][1] * 3)], items


def test_judge_equals_brute_force(spark):
    rows, items = sample()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block_pairs in (200_000, 60):  # one pass, and several
        got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.judge(documents(spark, rows), benchmark, block_pairs=block_pairs).collect()}
        assert got == slow(rows, items)


def test_removal(spark):
    rows, items = sample()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows).selectExpr("*", "1 as n_words", "2 as hit_ranges", "3 as hit_items")
    want = slow(rows, items)
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, w in want.items() if not w[4]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, benchmark, remove="spans").collect()}
    assert {i for i in cut if cut[i] != dict(rows)[i]} == {i for i, w in want.items() if w[4]}
    assert cut[70] == "a !"
    assert all(len(words_of(cut[i])) == w[0] - w[1] for i, w in want.items())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.judge(documents(spark, ["a b"]), empty).collect()] == [(0, 2, 0, 0, hashlib.sha256(b"").hexdigest(), False)]
    assert decontaminate.judge(documents(spark, []).filter("doc_id < 0"), empty).collect() == []
