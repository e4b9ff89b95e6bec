from collections import Counter, defaultdict

import pytest
from helpers import documents

from beleg.llm import mix


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 5}, {"a": 1, "b": 1, "c": 7, "d": 2}, dict(mix.WEIGHTS)])
def test_period_meets_every_window(weights):
    total, given = sum(weights.values()), Counter()
    for stream, i, release, deadline, slot in mix.period(weights):
        assert release <= slot < deadline and i == given[stream]
        given[stream] += 1
        assert all(abs(given[s] - a * (slot + 1) / total) < 1 for s, a in weights.items())
    assert given == weights


def test_phases_use_every_block_once():
    blocks, seen, slots = {"a": 100, "b": 7, "c": 33, "d": 0, "e": 1}, Counter(), []
    for first, times, size, shares, start in mix.phases(blocks, {"a": 2, "b": 5, "c": 1, "d": 9, "e": 4}):
        assert size == sum(shares.values()) and first == sum(n for n in slots)
        slots.append(times * size)
        for s, a in shares.items():
            assert start[s] == seen[s]
            seen[s] += times * a
    assert +seen == +Counter(blocks)


def test_mix_follows_targets_and_keeps_all_rows(spark):
    rows = [(i, f"text {i}") for i in range(600)] + [(None, None), (3, "text 3"), (3, "text 3")]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN 'big' WHEN doc_id % 3 = 0 THEN 'mid' WHEN doc_id % 5 = 0 THEN NULL ELSE 'rest' END AS source", "1 AS slot", "2 AS row", "3 AS phase")
    weights = {"big": 2, "mid": 5, mix.OTHER: 3}
    out = mix.mix(docs, weights, block_docs=4, bucket_rows=50)
    assert out.columns[:6] == docs.columns and out.columns[-2:] == ["_slot", "place"]
    got = out.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["_slot"]].append(r)
        assert r["release"] <= r["_slot"] < r["deadline"]
    assert sorted(slots) == list(range(len(slots)))
    given, total = Counter(), sum(weights.values())
    for slot in sorted(slots):
        streams = {(r["stream"], r["block"]) for r in slots[slot]}
        assert len(streams) == 1 and [r["place"] for r in sorted(slots[slot], key=lambda r: r["place"])] == list(range(len(slots[slot])))
        stream, block = streams.pop()
        assert block == given[stream]
        given[stream] += 1
        if slot < 48:  # mid runs out after that
            assert all(abs(given[s] - w * (slot + 1) / total) < 1 for s, w in weights.items())
    for r in got:
        assert r["stream"] == (r["source"] if r["source"] in weights else mix.OTHER)


def test_same_order_for_other_partitioning(spark):
    docs = documents(spark, [f"t{i}" for i in range(90)])
    a = [(r["doc_id"], r["slot"], r["place"]) for r in mix.mix(docs.repartition(7), bucket_rows=20).collect()]
    b = [(r["doc_id"], r["slot"], r["place"]) for r in mix.mix(docs.coalesce(1), bucket_rows=20).collect()]
    assert sorted(a) == sorted(b)


def test_empty_table_and_bad_weights(spark):
    empty = documents(spark, []).filter("doc_id < 0")
    assert mix.mix(empty).collect() == []
    with pytest.raises(ValueError):
        mix.mix(empty, {"a": 0})
