"""Repair of conversation structure by iterative-deepening A*.

Rows of a conversation are taken by turn. A row's first fault counts: blank (no character but ASCII white space), duplicate (role
and text were there before), truncated (the last such character is none of ``.!?``). Edits are Keep (0), Rerole to user or
assistant (1), Delete (2, required for blank and duplicate), Insert of an empty user or assistant row (5); a truncated row that
stays costs 5 more. The cheapest edits that give role initials ``(s?(ua)+)?`` are sought; among equally cheap ones those whose
initials, in order, are the ASCII-least string.

The search goes depth first in ASCII order of the edits under a cost bound, which grows to the least cost that went beyond it.
States that failed are kept in a transposition table with the cost that is now known to be needed from there, so a state is
entered again only with more to spend. The first accepting path is the answer. The lower bound to start with is 2 for each row
that is blank, duplicate or truncated; a conversation's end, or the state at a segment's end, is the goal.

A conversation may be long: it is cut into segments of ``segment_rows`` rows. An Insert belongs to the row after it, so edits of a
segment end with its last row and no edit string begins another one of the same segment; the best edits of the whole are then
made of the best edits of segments between each pair of states at their ends, and equally cheap choices are decided in the first
segment where they differ. Where a conversation is one segment, as nearly always, there is one search.

Rows are dealt by ranges of (conversation, turn), so a hot conversation lies in many tasks. Equal rows are counted before they are
shuffled. Only what needs a whole conversation in order goes through one task, and flows through it: the hash of the repaired
text (SHA-256 has one state) and the audit, which is a value of one row by contract.

Defined results: a null role or text is one space (so a null text is blank), as are null parts of the damage key. Null turns come
first; rows of one turn go by role, then by the SHA-256 of their text. A null conv_id is a conversation. Repeated rows are
duplicates of the first. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from beleg.llm.tables import cut_lineage

SEGMENT_ROWS = 512
SOLID = r"[^\x20\x09-\x0D]"
DELETE, INSERT, KEEP, REROLE = "DIKR"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5

# States: nothing yet, after system, after user, after assistant; CLOSED is a goal: a whole conversation.
START, SYSTEM, USER, ASSISTANT, CLOSED = range(5)
_ASKED = (USER, USER, ASSISTANT, USER)  # the role that may be inserted or written over
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_NEVER = 1 << 60

# A row for the search: its initial as a state (0 for any other), and whether it has to go or is truncated.
FINE, MUST_GO, CUT_OFF = 0, 4, 8
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


def _kept(state: int, initial: int) -> bool:
    return initial == SYSTEM and state == START or initial != 0 and initial != SYSTEM and initial == _ASKED[state]


def search(rows: bytes, start: int, goal: int) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest, then ASCII-least path from one state to the goal, or None if there is none."""
    n = len(rows)
    rest = [0] * (n + 1)
    last_system = -1
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (DELETE_COST if rows[i] & (MUST_GO | CUT_OFF) else 0)
        if last_system < 0 and rows[i] & 3 == SYSTEM and not rows[i] & MUST_GO:
            last_system = i
    needed: dict[int, int] = {}

    def least(i: int, state: int) -> int:
        """What is known to be needed from here to the goal."""
        if goal < USER and state > goal or goal == SYSTEM and state == START and i > last_system:
            return _NEVER  # no way back to these states
        if i == n and goal != CLOSED:
            return 0 if state == goal else _NEVER
        return max(rest[i], needed.get(i * 4 + state, 0))

    def moves(i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        if i < n:
            row = rows[i]
            extra = TRUNCATED_COST if row & CUT_OFF else 0
            yield DELETE, DELETE_COST, i + 1, state
            yield INSERT, INSERT_COST, i, _ASKED[state]
            if not row & MUST_GO:
                if _kept(state, row & 3):
                    yield KEEP, KEEP_COST + extra, i + 1, row & 3
                yield REROLE, REROLE_COST + extra, i + 1, _ASKED[state]
        elif goal == CLOSED:
            yield INSERT, INSERT_COST, i, _ASKED[state]

    def reached(i: int, state: int) -> bool:
        return i == n and (state in (START, ASSISTANT) if goal == CLOSED else state == goal)

    if reached(0, start):
        return 0, ""
    while (bound := least(0, start)) < _NEVER:
        # Of each open state: place, state, what is left to spend, its moves, and the least that any of them is known to need.
        path, stack = [], [[0, start, bound, moves(0, start), _NEVER]]
        while stack:
            top = stack[-1]
            for edit, cost, i, state in top[3]:
                more = cost + least(i, state)
                if more > top[2]:
                    top[4] = min(top[4], more)
                elif reached(i, state):
                    return bound, "".join(path) + edit
                else:
                    path.append(edit)
                    stack.append([i, state, top[2] - cost, moves(i, state), _NEVER])
                    break
            else:
                stack.pop()
                i, state, left, _, found = top
                needed[i * 4 + state] = max(needed.get(i * 4 + state, 0), found)
                if stack:
                    edit, above = path.pop(), stack[-1]
                    cost = above[2] - left
                    above[4] = min(above[4], cost + least(i, state))
    return None


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by CRC-32 of ``conv_id:turn`` modulo 20 a row is dropped, emptied, robbed of its sentence ends, repeated, or given to the user."""
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    coded = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).filter("code <> 0")
    return coded.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _units(conversations: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, what the search has to know of the first copy, and what counts are made of."""
    rows = conversations.select("conv_id", F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    units = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    units = units.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("has_turn", F.col("turn").isNotNull()).withColumn("turn", F.coalesce("turn", F.lit(0)))
    units = cut_lineage(units.withColumn("has_id", F.col("conv_id").isNotNull()), "units")
    # Only what was said more than once can have been said before.
    again = units.groupBy("has_id", "conv_id", "role", "digest").agg(F.min(F.struct("has_turn", "turn")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(F.col("has_id").alias("h"), F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    joined = units.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left").drop("h", "c", "r", "d")
    blank = ~F.col("text").rlike(SOLID)
    later = F.coalesce(F.col("first") < F.struct("has_turn", "turn"), F.lit(False))
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0) + F.when(blank | later, MUST_GO).when(cut, CUT_OFF).otherwise(FINE)
    return joined.withColumn("blank", blank).withColumn("code", code).drop("first")


KEY = ("has_id", "conv_id", "has_turn", "turn", "role", "digest")
_PATH = "array<struct<p int, q int, cost long, audit string, place int>>"
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "turns")


def _segment_schema(conv_type: T.DataType) -> T.StructType:
    schema = T.StructType([T.StructField("has_id", T.BooleanType()), T.StructField("conv_id", conv_type)])
    for name, kind in (("has_turn", "boolean"), ("turn", "long"), ("role", "string"), ("digest", "binary"), ("number", "long"), ("opens", "boolean"), ("closes", "boolean"), ("head", "int"), ("tail", "int"),
                       ("low", "long"), ("high", "long"), ("end_turn", "long"), *((c, "long") for c in _COUNTS), ("paths", _PATH)):
        schema.add(name, T._parse_datatype_string(kind))
    return schema


def _paths(rows: bytes, opens: bool, closes: bool) -> list[dict]:
    """The best edits between each pair of states; of those that begin in one state, their places in ASCII order."""
    out = []
    for p in (START,) if opens else range(4):
        found = [(*r, q) for q in ((CLOSED,) if closes else range(4)) if (r := search(rows, p, q))]
        out += [{"p": p, "q": q, "cost": cost, "audit": audit, "place": k} for k, (cost, audit, q) in enumerate(sorted(found, key=lambda r: r[1]))]
    return out


def _segments(units: DataFrame, segment_rows: int) -> DataFrame:
    """The segments of all conversations with their best edits and their part of the counts."""
    spark, schema = units.sparkSession, _segment_schema(units.schema["conv_id"].dataType)
    n, target = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), to_arrow_schema(schema)
    slim = units.select(*KEY, "copies", "blank", "code").repartitionByRange(n, *KEY).sortWithinPartitions(*KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, opens, number, seg = None, False, 0, None

        def begin(key: tuple) -> dict:
            return dict(zip(KEY, key)) | {"number": number, "opens": opens and not number, "codes": bytearray(), "inits": [], "low": None, "high": None, "end_turn": None} | dict.fromkeys(_COUNTS, 0)

        def end(seg: dict, closes: bool) -> dict:
            codes, inits = bytes(seg.pop("codes")), seg.pop("inits")
            allowed = ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
            return seg | {"closes": closes, "rows": len(codes), "head": inits[0], "tail": inits[-1], "illegal": sum(p not in allowed for p in zip(inits, inits[1:])), "paths": _paths(codes, seg["opens"], closes)}

        done: list[dict] = []
        first = True
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *key, copies, blank, code in zip(*columns):
                if conv is None or key[:2] != conv:
                    if seg:
                        done.append(end(seg, True))
                    # What a task begins with may be the middle of a conversation.
                    conv, opens, number, seg, first = key[:2], not first, 0, None, False
                for copy in range(copies):
                    if seg and len(seg["codes"]) >= segment_rows:
                        done.append(end(seg, False))
                        number, seg = number + 1, None
                    seg = seg or begin(key)
                    seg["codes"].append(code if copy == 0 else code & 3 | MUST_GO)
                    seg["inits"].append(code & 3)
                    if blank:
                        seg["blank"] += 1
                    elif copy or code & MUST_GO:
                        seg["duplicate"] += 1
                    elif code & CUT_OFF:
                        seg["truncated"] += 1
                    if key[2]:
                        turn = key[3]
                        seg["turns"] += seg["end_turn"] != turn
                        seg["low"], seg["high"], seg["end_turn"] = seg["low"] if seg["low"] is not None else turn, turn, turn
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=target)
                done = []
        if seg:
            yield pa.RecordBatch.from_pylist([end(seg, False)], schema=target)

    return slim.mapInArrow(run, schema)


def _choose(segments: DataFrame) -> DataFrame:
    """For conversations of several segments: which path is taken in each. A few numbers of each segment are held."""
    conv_type = segments.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("has_id", T.BooleanType()), T.StructField("conv_id", conv_type)]).add("has_turn", "boolean").add("turn", "long").add("role", "string").add("digest", "binary").add("number", "long").add("p", "integer").add("q", "integer")
    target = to_arrow_schema(schema)
    light = segments.select(*KEY, "number", F.transform("paths", lambda x: F.struct(x["p"], x["q"], x["cost"], x["place"])).alias("paths"))
    dealt = light.repartition("has_id", "conv_id").sortWithinPartitions(*KEY, "number")

    def best(keys: list[tuple], paths: list[list[tuple]]) -> pa.RecordBatch:
        ends = {CLOSED: 0} | {q: INSERT_COST * len(_CLOSING[q]) for q in range(4)}
        need = [ends]
        for steps in reversed(paths):
            now: dict[int, int] = {}
            for p, q, cost, _ in steps:
                if q in need[-1]:
                    now[p] = min(now.get(p, _NEVER), cost + need[-1][q])
            need.append(now)
        need.reverse()
        state, rows = START, []
        for k, (key, steps) in enumerate(zip(keys, paths)):
            _, q = min((place, q) for p, q, cost, place in steps if p == state and q in need[k + 1] and cost + need[k + 1][q] == need[k][state])
            rows.append((*key, state, q))
            state = q
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, keys, paths = None, [], []
        for batch in batches:
            for *key, steps in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if key[:2] != conv and keys:
                    yield best(keys, paths)
                    keys, paths = [], []
                conv = key[:2]
                keys.append(tuple(key))
                paths.append([tuple(s.values()) for s in steps])
        if keys:
            yield best(keys, paths)

    return dealt.mapInArrow(run, schema)


def _with_edits(units: DataFrame, segment_rows: int) -> DataFrame:
    """Segments with the edits that are taken in them."""
    segments = cut_lineage(_segments(units, segment_rows), "segments")
    alone = segments.filter("opens AND closes").withColumn("path", F.element_at("paths", 1))
    several = segments.filter("NOT (opens AND closes)")
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*KEY, "number")]
    taken = several.alias("s").join(_choose(several).alias("t"), on).select("s.*", F.expr("filter(s.paths, x -> x.p = t.p AND x.q = t.q)[0]").alias("path"))
    return alone.unionByName(taken).drop("paths")


def _apply(conversations: DataFrame, rows_out: bool, segment_rows: int) -> DataFrame:
    units = cut_lineage(_units(conversations), "units")
    edited = _with_edits(units, segment_rows)
    conv_type = units.schema["conv_id"].dataType
    edits = edited.select(*KEY, F.lit(0).alias("kind"), "number", *(F.col(c) for c in ("head", "tail", "low", "high", "end_turn", *_COUNTS)), F.col("path.audit").alias("audit"), F.col("path.cost").alias("cost"), F.col("path.q").alias("q"))
    lines = units.select(*KEY, F.lit(1).alias("kind"), "copies", "text")
    # Segments come before the rows they begin with; a row's edits are at hand when it comes.
    both = edits.unionByName(lines, allowMissingColumns=True).repartition("has_id", "conv_id").sortWithinPartitions(*KEY, "kind", "number")
    both = both.select("has_id", "conv_id", "role", "kind", "copies", "text", "audit", "cost", "q", "head", "tail", "low", "high", "end_turn", *_COUNTS)
    if rows_out:
        schema = T.StructType([T.StructField("conv_id", conv_type)]).add("place", "long").add("role", "string").add("text", "string").add("edit", "string")
    else:
        schema = T.StructType([T.StructField("conv_id", conv_type)])
        for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
            schema.add(c, "long")
        schema.add("audit", "string").add("repaired_sha256", "string")
    target = to_arrow_schema(schema)

    class Conversation:
        """One conversation as it flows by: at most a segment's edits wait, and what is said is hashed at once."""

        def __init__(self, conv_id):
            self.conv_id, self.state, self.waiting, self.at, self.audit = conv_id, START, "", 0, []
            self.hash, self.place, self.sums, self.cost = sha256(), 0, dict.fromkeys(_COUNTS, 0), 0
            self.low = self.high = self.end_turn = self.tail = None

        def segment(self, r: dict) -> None:
            for c in _COUNTS:
                self.sums[c] += r[c]
            if self.tail is not None:
                self.sums["illegal"] += (self.tail, r["head"]) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))
            self.tail = r["tail"]
            if r["low"] is not None:
                self.sums["turns"] -= r["low"] == self.end_turn
                self.low, self.high, self.end_turn = r["low"] if self.low is None else self.low, r["high"], r["end_turn"]
            self.cost += r["cost"]
            self.waiting, self.at = self.waiting[self.at:] + r["audit"], 0
            if not rows_out:
                self.audit.append(r["audit"])
            self.last = r["q"]

        def say(self, role: str, text: str, edit: str) -> Iterator[tuple]:
            if rows_out:
                yield self.conv_id, self.place, role, text, edit
            else:
                self.hash.update((("\n" if self.place else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.place += 1

        def insert(self) -> Iterator[tuple]:
            self.state = _ASKED[self.state]
            yield from self.say(_NAMES[self.state], "", INSERT)

        def row(self, role: str, text: str, copies: int) -> Iterator[tuple]:
            while copies:
                edit = self.waiting[self.at]
                self.at += 1
                if edit == INSERT:
                    yield from self.insert()
                    continue
                copies -= 1
                if edit == KEEP:
                    self.state = _INITIALS[role[0]]
                    yield from self.say(role, text, KEEP)
                elif edit == REROLE:
                    self.state = _ASKED[self.state]
                    yield from self.say(_NAMES[self.state], text, REROLE)

        def close(self) -> Iterator[tuple]:
            closing = self.waiting[self.at:]
            if self.last != CLOSED:
                closing = _CLOSING[self.last]
                self.audit.append(closing)
                self.cost += INSERT_COST * len(closing)
            for _ in closing:
                yield from self.insert()
            if not rows_out:
                gaps = 0 if self.low is None else self.high - self.low + 1 - self.sums["turns"]
                yield (self.conv_id, gaps, *(self.sums[c] for c in ("blank", "duplicate", "truncated", "illegal")), self.cost, "".join(self.audit), self.hash.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(target)], schema=target)

        now, key, rows = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["has_id"], r["conv_id"]) != key:
                    if now:
                        rows += now.close()
                    key, now = (r["has_id"], r["conv_id"]), Conversation(r["conv_id"])
                if r["kind"] == 0:
                    now.segment(r)
                else:
                    rows += now.row(r["role"], r["text"], r["copies"])
            yield out(rows)
            rows = []
        if now:
            yield out(list(now.close()))

    return both.mapInArrow(run, schema)


def repair(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The repaired conversations: conv_id, place, role, text, and the edit that made the row."""
    return _apply(conversations, True, segment_rows)


def audit(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    return _apply(conversations, False, segment_rows)


def judge(conversations: DataFrame) -> DataFrame:
    """audit() of the damaged table for every conv_id of the whole one; zeros where no row is left."""
    found = cut_lineage(audit(damage(conversations)), "audits")
    ids = conversations.select("conv_id").distinct().alias("i")
    joined = ids.join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    counts = [_or(F.col(f"f.{c}"), 0).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("i.conv_id", *counts, _or(F.col("f.audit"), "").alias("audit"), _or(F.col("f.repaired_sha256"), sha256().hexdigest()).alias("repaired_sha256"))


def _or(value: Column, other: int | str) -> Column:
    return F.coalesce(value, F.lit(other).cast("long") if isinstance(other, int) else F.lit(other))
