import random

import pytest
import xxhash
from helpers import documents, union_find

from beleg.llm import simhash


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \n\t", "One", "one", "Two words", "É a b c", " x y z", "a b c d e f g", "x " * 1000, "w" * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def near_copies():
    draw = random.Random(3)
    base = [" ".join(draw.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(draw.randrange(60)) for _ in range(250)) for _ in range(25)]
    texts = list(base)
    for t in base:
        for _ in range(5):
            words = t.split()
            words[draw.randrange(len(words))] = "other"
            texts.append(" ".join(words))
    return texts + TEXTS + base[:4]


def want_components(rows):
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    links = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= 2]
    return prints, union_find([i for i, _ in rows], links)


def test_judge_equals_all_pairs(spark):
    rows = list(enumerate(near_copies()))
    prints, want = want_components(rows)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.judge(documents(spark, rows)).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints}
    assert len(set(want.values())) < len(rows) - 20


def test_chain_of_fingerprints_in_one_bucket(spark):
    """Fingerprints that share a half, most of them far apart: nothing is lost without comparing all pairs."""
    draw = random.Random(9)
    marks = {draw.getrandbits(8) << 3 for _ in range(60)} | {1 << 33, (1 << 33) + 3, (1 << 33) + 12 + 3}
    found = {r["id"]: r["component"] for r in simhash.link_fingerprints(spark.createDataFrame([(m,) for m in marks], "fp long")).collect()}
    links = [(a, b) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= 2]
    assert found == union_find({x for p in links for x in p}, links)


def test_equal_halves_are_no_pairs(spark, monkeypatch):
    """1,000 fingerprints that share their low half: every link is found, in blocks of 64, and few rows are returned."""
    draw, returned = random.Random(4), []
    marks = {draw.getrandbits(20) << 40 for _ in range(1000)}
    marks |= {m ^ (1 << draw.randrange(32, 63)) for m in draw.sample(sorted(marks), 40)}
    whole = simhash._verify_rest
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 64)
    monkeypatch.setattr(simhash, "_verify_rest", lambda rest: returned.append(whole(rest)) or returned[-1])
    found = {r["id"]: r["component"] for r in simhash.link_fingerprints(spark.createDataFrame([(m,) for m in marks], "fp long")).collect()}
    links = [(a, b) for a in marks for b in marks if a < b and (a ^ b).bit_count() <= 2]
    assert found == union_find({x for p in links for x in p}, links)
    assert len(links) >= 40 and returned[0].count() < 10_000


def test_rows_that_differ_in_another_column(spark):
    """Whichever way rows are dealt, the same of those equal in doc_id and text stays."""
    rows = [(1, "a b c d e", lang, "s", 9) for lang in ("en", "de", "fr")]
    kept = set()
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        kept |= {tuple(r) for parts in (1, 3) for r in simhash.keep_one(docs.repartition(parts)).collect()}
    assert len(kept) == 1


def test_keep_one(spark):
    rows = [(5, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (9, "quite another text of words"), (None, None), (8, None)]
    docs = documents(spark, rows).selectExpr("*", "1 as k1", "'x' as fp", "'y' as row", "2 as component")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, "a b c d e"), (8, None), (9, "quite another text of words")]


def test_empty_table(spark):
    empty = documents(spark, []).filter("doc_id < 0")
    assert simhash.judge(empty).collect() == [] and simhash.keep_one(empty).collect() == []
