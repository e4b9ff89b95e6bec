import heapq
import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256
from itertools import product

import pytest
from pyspark.sql import functions as F

from beleg.llm import conversations as conv

COLUMNS = "conv_id long, turn long, role string, text string"


def edits_of(rows):
    """(cost, edits) by shortest paths over (row, state); rows: (initial, must go, truncated)."""
    asked = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, path, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, path
        heapq.heappush(heap, (cost + 5, path + "I", i, asked[state]))
        if i < len(rows):
            initial, gone, cut = rows[i]
            heapq.heappush(heap, (cost + 2, path + "D", i + 1, state))
            if not gone:
                if initial == asked[state] or initial == "s" and state == "":
                    heapq.heappush(heap, (cost + 5 * cut, path + "K", i + 1, initial))
                heapq.heappush(heap, (cost + 1 + 5 * cut, path + "R", i + 1, asked[state]))


def all_edits(rows, most):
    """The same by trying every string of edits up to a number of them."""
    found = []
    for n in range(most + 1):
        for path in product("DIKR", repeat=n):
            roles, cost, i = "", 0, 0
            for e in path:
                want = {"": "u", "s": "u", "u": "a", "a": "u"}.get(roles[-1:], "u")
                if e == "I":
                    roles, cost = roles + want, cost + 5
                    continue
                if i == len(rows):
                    break
                initial, gone, cut = rows[i]
                i += 1
                if e == "D":
                    cost += 2
                elif gone:
                    break
                else:
                    roles, cost = roles + (initial if e == "K" else want), cost + 5 * cut + (e == "R")
            else:
                if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
                    found.append((cost, "".join(path)))
    return min(found)


def code_of(rows):
    return bytes({"s": 1, "u": 2, "a": 3}.get(i, 0) + (4 if gone else 8 if cut else 0) for i, gone, cut in rows)


def random_rows(rng, n):
    rows = [(rng.choice("sua?uaua"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
    return [(i, gone, cut and not gone) for i, gone, cut in rows]


def test_search_equals_all_edit_strings():
    rng = random.Random(1)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(0, 3))
        assert conv.search(code_of(rows), conv.START, conv.CLOSED) == all_edits(rows, 7) == edits_of(rows)


def test_search_equals_shortest_paths():
    rng = random.Random(2)
    for _ in range(600):
        rows = random_rows(rng, rng.randint(0, 40))
        assert conv.search(code_of(rows), conv.START, conv.CLOSED) == edits_of(rows)


def test_states_that_cannot_be_reached_have_no_path():
    assert conv.search(bytes([2]), conv.USER, conv.START) is None
    assert conv.search(bytes([2, 3]), conv.START, conv.SYSTEM) is None
    assert conv.search(bytes([1, 4]), conv.START, conv.SYSTEM) == (2, "KD")
    assert conv.search(bytes([2]), conv.START, conv.START) == (2, "D")


def damaged(rows):
    out = []
    for c, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(c, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def brute(rows, ids):
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r)
    out = {}
    for c in ids:
        own = sorted(by_id[c], key=lambda r: (r[1] is not None, r[1] or 0, r[2], sha256(r[3].encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, path = edits_of([(r[2][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(own, faults)])
        state, said, i = "", [], 0
        for e in path:
            want = "assistant" if state == "u" else "user"
            if e == "I":
                said.append((want, ""))
            else:
                role, text = own[i][2:]
                i += 1
                if e == "D":
                    continue
                said.append((role if e == "K" else want, text))
            state = said[-1][0][0]
        turns = {r[1] for r in own if r[1] is not None}
        initials = [r[2][:1] for r in own]
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, path, sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest())
    return out


def sample(seed, n_conversations, longest):
    rng, rows = random.Random(seed), []
    for c in range(n_conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice([("user", "assistant")[turn % 2]] * 6 + ["system", "user", "tool", None, "", "Assistant"])
            text = rng.choice(["Yes.", "No!", "Maybe", " \t\n", "", None, "x?", f"text {turn}.", f"cut {turn}", "é. ", "Line.\n\n"])
            for _ in range(rng.choice([1, 1, 1, 1, 1, 3])):
                rows.append((None if c == 0 else c * 37, None if rng.random() < 0.05 else turn + (turn > 3) * 2, role, text))
    rng.shuffle(rows)
    return rows


def found(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_query_equals_brute_force(spark):
    rows = sample(4, 60, 12)
    table = spark.createDataFrame(rows, COLUMNS)
    for c in ("digest", "code", "number", "audit", "place", "kind"):
        table = table.withColumn(c, F.lit("clash"))
    got = conv.judge(table.repartition(4))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert got.count() == len({r[0] for r in rows})
    assert found(got) == brute(damaged(rows), {r[0] for r in rows})


@pytest.mark.parametrize("segment_rows", [1, 2, 5, 64])
def test_segments_don_t_change_the_answer(spark, segment_rows):
    rows = [tuple(" " if v is None and k > 1 else v for k, v in enumerate(r)) for r in sample(segment_rows, 8, 60)]
    rows += [(99, 1, "user", "again and again")] * 30
    got = found(conv.audit(spark.createDataFrame(rows, COLUMNS).repartition(3), segment_rows))
    assert got == brute(rows, {r[0] for r in rows})


def test_repaired_rows_are_what_is_hashed(spark):
    rows = [tuple(" " if v is None and k > 1 else v for k, v in enumerate(r)) for r in sample(11, 20, 10)]
    table, said = spark.createDataFrame(rows, COLUMNS), defaultdict(list)
    for r in conv.repair(table).orderBy("place").collect():
        said[r["conv_id"]].append(r)
    for c, values in found(conv.audit(table)).items():
        assert sha256("\n".join(f"{r['role']}:{r['text']}" for r in said[c]).encode()).hexdigest() == values[-1]
        assert "".join(r["edit"] for r in said[c]) == values[-2].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in said[c]))


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = conv.judge(spark.createDataFrame([(gone, 0, "user", "Hello.")], COLUMNS)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", sha256().hexdigest())]
    assert conv.judge(spark.createDataFrame([], COLUMNS)).collect() == []
    assert conv.repair(spark.createDataFrame([], COLUMNS)).collect() == []
