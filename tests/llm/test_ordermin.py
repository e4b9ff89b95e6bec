import hashlib
import random
import struct
from collections import Counter

import pytest
import xxhash
from helpers import documents

from beleg.llm import ordermin


def chain(parts):
    seed = 42
    for data in parts:
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return seed


def slow_fingerprint(text):
    words = text.split()
    if not words:
        return " ".join(["-"] * ordermin.SKETCHES)
    grams = [words[i:i + 3] for i in range(max(1, len(words) - 2))]
    seen, best = Counter(), {}
    for pos, gram in enumerate(grams):
        kmer = chain(w.encode() for w in gram) >> 28
        h = chain([struct.pack("<Q", kmer), struct.pack("<i", seen[kmer])])
        seen[kmer] += 1
        stratum = h % (ordermin.SKETCHES * ordermin.TUPLE)
        best[stratum] = min(best.get(stratum, (1 << 70, 0)), (h >> 33, pos))
    out = []
    for i in range(ordermin.SKETCHES):
        own = sorted((pos, s << 31 | h) for s, (h, pos) in best.items() if s % ordermin.SKETCHES == i)
        out.append(f"{chain([','.join(f'{h:X}' for _, h in own).encode()]):016x}" if own else "-")
    return " ".join(out)


def slow_likeness(a, b):
    pairs = [(x, y) for x, y in zip(a.split(), b.split()) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0


def sample():
    draw = random.Random(8)
    texts = [" ".join(draw.choice("ab cd ef gh ij é kl".split()) for _ in range(draw.randint(0, 80))) for _ in range(60)]
    texts += [None, "", "  \n", "one", "one two", "x " * 3000, "tab\tand\nline  end "]
    ids = draw.sample(range(-500, 500), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("bucket_rows", [5, 2000])
def test_judge_equals_brute_force(spark, bucket_rows):
    rows = sample()
    got = {r["doc_id"]: r for r in ordermin.judge(documents(spark, rows).selectExpr("*", "1 AS bucket", "2 AS at", "3 AS last"), bucket_rows).collect()}
    assert len(got) == len(rows)
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        r, own = got[i], slow_fingerprint(text)
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own, slow_fingerprint(edited))
        assert r["near_edited"] == pytest.approx(slow_likeness(own, slow_fingerprint(edited)))
        assert r["near_next"] == pytest.approx(slow_likeness(own, slow_fingerprint(following)))


def test_order_and_occurrences_matter(spark):
    a = " ".join(f"w{i}" for i in range(200))
    b = " ".join(f"w{i}" for i in [*range(100, 200), *range(100)])
    rows = [(0, a), (1, b), (2, a + " " + a), (3, a)]
    prints = {r["doc_id"]: r["fingerprint"] for r in ordermin.judge(documents(spark, rows)).collect()}
    assert prints[0] == prints[3] and slow_likeness(prints[0], prints[1]) < 0.8 and slow_likeness(prints[0], prints[2]) < 0.5


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b c d"), (4, "x y z"), (4, "x y z"), (4, "b b b")]
    got = ordermin.judge(documents(spark, rows), bucket_rows=1).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == [(-1, 7), (4, 5), (4, 5), (4, 5)]
    assert ordermin.judge(documents(spark, []).filter("doc_id < 0")).collect() == []
    (one,) = ordermin.judge(documents(spark, ["just one text"])).collect()
    assert one["near_next"] == 1.0
