import hashlib
import random

from helpers import documents, union_find

from beleg.llm import lines


def shingles(s):
    return {s[i:i + 8] for i in range(max(1, len(s) - 7))}


def slow(rows):
    """Kept text of each (doc_id, text), all pairs of distinct lines compared."""
    places = [(i, n, " ".join(raw.lower().split())) for i, t in rows if t is not None for n, raw in enumerate(t.split("\n"))]
    distinct = sorted({p[2] for p in places if p[2]})
    sets = {d: shingles(d) for d in distinct}
    links = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1:] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group, first = union_find(distinct, links), {}
    for i, n, line in sorted(places):
        if line:
            first.setdefault(group[line], (i, n))
    kept = set(first.values())
    out = {}
    for i, t in rows:
        if t is not None:
            out[i] = "\n".join(raw for n, raw in enumerate(t.split("\n")) if not raw.split() or (i, n) in kept)
    return out


def sample():
    draw = random.Random(11)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(300)]
    line = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 30))) for _ in range(120)]
    rows = []
    for i in range(60):
        own = []
        for _ in range(draw.randint(1, 8)):
            s = draw.choice(line)
            if draw.random() < 0.3:
                at = draw.randrange(len(s))
                s = s[:at] + "Z" + s[at + 1:]
            own.append(s.upper() if draw.random() < 0.1 else s)
        rows.append((i, "\n".join(own)))
    return rows + [(100, ""), (101, "\n \n"), (102, "x"), (103, "X  "), (104, "Of\n\nof\n"), (105, "y" * 30000), (106, "y" * 29990)]


def test_equals_all_pairs(spark):
    rows = sample()
    want = slow(rows)
    got = {r["doc_id"]: r["text"] for r in lines.dedupe_lines(documents(spark, rows)).collect()}
    assert got == {i: t for i, t in want.items() if t.split() or not dict(rows)[i].split()}
    digest = {r["doc_id"]: (r["n_removed"], r["text_sha256"]) for r in lines.judge(documents(spark, rows)).collect()}
    assert len(digest) == len(rows)
    for i, t in rows:
        assert digest[i][1] == hashlib.sha256(want[i].encode()).hexdigest(), i
        assert digest[i][0] == sum(bool(x.split()) for x in t.split("\n")) - sum(bool(x.split()) for x in want[i].split("\n"))


def test_a_full_filter_loses_nothing(spark):
    rows = sample()[:30]
    got = {r["doc_id"]: r["text"] for r in lines.dedupe_lines(documents(spark, rows), filter_bits=64).collect()}
    assert got == {i: t for i, t in slow(rows).items() if t.split()}


def test_nulls_repeats_and_clashing_names(spark):
    docs = documents(spark, [(1, None), (2, "same line of words\nown"), (2, "same line of words\nown"), (None, "same line of words\nlast")])
    docs = docs.selectExpr("*", "1 as k1", "2 as keep", "3 as n_blank", "4 as copy", "5 as row")
    out = lines.dedupe_lines(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in out.collect()), key=str) == [(0, "last"), (1, None), (2, "same line of words\nown")]
    assert lines.dedupe_lines(docs.filter("doc_id > 5")).collect() == []


def test_band_keys_meet_at_the_stated_similarity():
    draw, met, n = random.Random(2), 0, 300
    for _ in range(n):
        a = "".join(draw.choice("abcdefghijklmnop ") for _ in range(400))
        b = a
        while len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) > 0.83:
            at = draw.randrange(len(b))
            b = b[:at] + "#" + b[at + 1:]
        x, y = lines.band_keys([a, b])
        met += bool((x == y).any())
    assert met >= 0.96 * n


def test_a_large_group_of_near_copies(spark):
    """Hundreds of lines in one bucket, some near each other only: blocks of lines lose no link."""
    draw = random.Random(7)
    word = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base, rows = [draw.choice(word) for _ in range(40)], []
    for i in range(300):
        own = list(base)
        for _ in range(draw.randint(1, 4)):
            own[draw.randrange(40)] = draw.choice(word)
        rows.append((i, " ".join(own)))
    got = {r["doc_id"] for r in lines.dedupe_lines(documents(spark, rows)).collect()}
    want = {i for i, t in slow(rows).items() if t}
    assert got == want


def test_rows_that_differ_in_another_column(spark):
    """Whichever way rows are dealt, the same of those equal in doc_id and text keeps the lines."""
    rows = [(1, "a line of words\nand one more", lang, "s", 9) for lang in ("en", "de", "fr")]
    kept = set()
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long")
        kept |= {tuple(r) for parts in (1, 3) for r in lines.dedupe_lines(docs.repartition(parts)).collect()}
    assert len(kept) == 1


def test_a_text_of_many_lines(spark):
    """A long text that loses some of its lines is cut once, not once for each line that stays."""
    own = [f"number {i} of the lines, {i * 7919 % 10007} {i * 104729 % 99991}" for i in range(20_000)]
    text = "\n".join(own[:10_000] + ["", own[5].upper()] + own[10_000:])
    got = [r["text"] for r in lines.dedupe_lines(documents(spark, [(1, text)]), limit=0.999).collect()]
    assert got == ["\n".join(own[:10_000] + [""] + own[10_000:])]


def test_line_table_has_each_line_of_a_batch_once(spark):
    """The first place stays, wherever the batch has it: least doc_id, nulls last, then line number; blank lines all stay."""
    docs = spark.createDataFrame([(None, "Same  line"), (7, "other\nsame line\n \nSAME line"), (3, "x\nsame line"), (9, "same line\n")], "doc_id long, text string").coalesce(1)
    rows = lines.line_table(docs).collect()
    same, blank = lines._line_id("same line"), [(r.doc_id, r.line_no) for r in rows if r.low is None]
    assert [(r.doc_id, r.line_no) for r in rows if (r.high, r.low) == same] == [(3, 1)]
    assert sorted(blank) == [(7, 2), (9, 1)] and len(rows) == 5
    assert all((r.bands is None) == (r.low is None) for r in rows)
    plan = lines.dedupe_lines(docs, counts=("n", "m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftOuter") < plan.index("Window [row_number")


def test_numbers_stand_for_shingles_exactly():
    rng = random.Random(5)
    alphabets = ("abc ", "aé ß", "ab\0c", "a–b c", "a😀b", "\ud800ab", " \t\x85\xa0a Σσ\n", "".join(map(chr, range(1, 300))))
    for alphabet in alphabets * 30:
        made = ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(6)]
        made += [line[:-1] or "a" for line in made]
        text = "\n".join(made)
        assert lines.normalised_lines(text) == [lines.normalise(line) for line in text.split("\n")]
        numbers, features = lines._feature_arrays(made), [lines._features(line) for line in made]
        assert [len(x) for x in numbers] == [len(x) for x in features]
        pairs = [(i, j) for i in range(len(made)) for j in range(i)]
        assert [lines._n_common(numbers[i], numbers[j]) for i, j in pairs] == [len(features[i] & features[j]) for i, j in pairs]
        left, right = ([made[p[k]] for p in pairs] for k in (0, 1))
        found = next(lines._similar(0.6)([i for i, _ in pairs], [j for _, j in pairs], left, right))
        assert list(zip(found["a"], found["b"])) == [(i, j) for i, j in pairs if len(features[i] & features[j]) >= 0.6 * len(features[i] | features[j])]
