import hashlib
import random
import re

from helpers import documents

from beleg.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def slow(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


FIXED = [
    None, "", "a@b", "a@b.c@d.e", "x@y.z.", "é.a@b-c.de.", "@a.b", "..@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 00255.1.2.3 1.2.3",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "0" * 12, "0" * 20, "+1 (555) 010-2345", "+1 2", "+123456789012345", "+1234567890123456",
    "++1 555 010 2345 +", "+1 555-010-2345.", "mail:ab@cd.ef,4111111111111111", "a" * 20000, "1" * 3000, "a@" * 2000, "1." * 3000, "+1" + " " * 3000, "1.2.3.99999999999999999999"]


def test_base_spans_fixed():
    for text in FIXED:
        assert [f"{k}:{a}:{b}" for a, b, k in personal.base_spans(text)] == slow(text), text


def test_base_spans_random():
    draw = random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choice("0123459@@..a-+ ()%é\n") for _ in range(draw.randint(0, 60)))
        assert [f"{k}:{a}:{b}" for a, b, k in personal.base_spans(text)] == slow(text), text


def test_judge_base(spark):
    got = {r["doc_id"]: r for r in personal.judge(documents(spark, FIXED).selectExpr("*", "1 AS base", "2 AS row")).collect()}
    for i, text in enumerate(FIXED):
        want = slow(text)
        assert [got[i][f"n_{k}"] for k in personal.KINDS] == [sum(s.startswith(k + ":") for s in want) for k in personal.KINDS]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(got[i]["spans"].split(",")) or not want
    assert personal.judge(documents(spark, []).filter("doc_id < 0")).collect() == []


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"please write me at user{i}@host{i}.example.org today" for i in range(30)]
    texts += ["please write me at joe97[at]example[dot]org today", "please write me at joe97[at]example[dot]org today", "please see me at room2049b today", "we counted 123456x things"]
    got = {r["doc_id"]: r["spans"] for r in personal.judge(documents(spark, texts)).collect()}
    start = texts[30].index("joe97")
    assert got[30] == got[31] == f"email:{start}:{start + len('joe97[at]example[dot]org')}"
    assert got[33] == ""
    assert all(got[i].count(":") == 2 for i in range(30))
