from __future__ import annotations

import random

from beleg.operators import charts as C

WORDS = ["Tonnage", "Fleet_size", "Loss (t)", "Hull age", "Crew", "Ölpreis", "Speed kn"]
NOTES = {  # text -> whether it discloses an estimate without claiming exactness
    "": False, "Note: drawn by hand.": False, "Source: harbour master": False, "Sources: two logs, both approximate": True, "Note: geschätzt": True,
    "Estimated Data Ranges: none": True, "Note: estimated, but printed on the bars": False, "Source: a Schätzung of exact figures": False,
}


def made_cell(rng):
    """(raw, value, min, max, kind)"""
    a, b = rng.randint(0, 899), rng.randint(900, 999) / 10
    return rng.choice([
        (str(a), float(a), None, None, "exact"), (f"-{b}", -b, None, None, "exact"), (f"{a}'000", a * 1000.0, None, None, "exact"), (f"{a}{rng.choice(['-', ' – ', '—'])}{b}", None, float(a), b, "range"),
        ("", None, None, None, "text"), ("-", None, None, None, "text"), (f"ca {a}", None, None, None, "text"), (f"{a}%", None, None, None, "text")])


def made_chart(rng):
    """The text of a block, and what is in it by construction."""
    names = [rng.choice(WORDS) for _ in range(rng.randint(1, 5))]
    columns = [n if names[:k].count(n) == 0 else f"{n} ({names[:k].count(n) + 1})" for k, n in enumerate(names)]
    note, disclosed = rng.choice(list(NOTES.items()))
    kinds, rows, spelled, years = rng.choice([("exact",), ("range",), ("exact", "range", "text"), ("exact", "text")]), [], [], set()
    for _ in range(rng.randint(1, 6)):
        year, remark = rng.randint(1850, 2060), rng.choice(["", "", "", " (plan)"])
        cells = [c for c in (made_cell(rng) for _ in range(60)) if c[4] in kinds][:rng.randint(0, len(names) + 1)]
        row = [(f"{year}{remark}", None, None, None, "text") if remark else (str(year), float(year), None, None, "exact"), *cells]
        spelled.append(f"{year}{remark}," + ",".join(c[0] for c in cells))
        row += [("", None, None, None, "text")] * (len(names) - len(row))
        rows.append(row[:len(names)] if cells or len(names) > 1 else row[:1])
        if not remark and year >= 1900:
            years.add(year)
    found = {c[4] for row in rows for c in row[1:]} - {"text"}
    precision = "mixed" if len(found) != 1 else "estimated" if found == {"range"} or disclosed else "exact"
    return ",".join(rng.choice(["", " "]) + n for n in names) + " " + " ".join(spelled) + (" " + note if note else ""), columns, rows, precision, sorted(years), note or None


def parse(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return C.charts_from_passages(df).orderBy("i", "block_pos").collect()


def block(text):
    return f"<data>{text}</data>"


def test_blocks_closed_and_open(spark):
    rng, texts, want = random.Random(6), [], []
    for i in range(80):
        closed = [rng.choice(["k", "two words", " 1,2\n3 ", "", " "]) for _ in range(rng.randint(0, 3))]
        tail = rng.choice([None, None, "", " \n", "rest 1,", " open "])
        texts.append("".join(rng.choice(["", "between ", "\n"]) + f"<data>{c}</data>" for c in closed) + rng.choice(["", " after"]) + ("" if tail is None else f"<data>{tail}"))
        found = [(c.strip(), False) for c in closed] + ([(tail.strip(), True)] if tail and tail.strip() else [])
        want += [(i, k, *f) for k, f in enumerate(found)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [(r.i, r.block_pos, r.raw_block, r.is_truncated) for r in C.extract_blocks(df).orderBy("i", "block_pos").collect()] == want


def test_titles(spark):
    df = spark.createDataFrame([("<title> A </title><title>B</title>",), ("none",), ("<title>  </title>",)], "text string")
    assert [r.title for r in C.extract_title(df).collect()] == ["A", None, None]


def test_charts_are_what_they_were_made_of(spark):
    rng = random.Random(30)
    made = [made_chart(rng) for _ in range(250)]
    for (text, columns, rows, precision, years, note), chart in zip(made, parse(spark, *(block(m[0]) for m in made)), strict=True):
        assert chart["columns"] == columns and chart.note == note, text
        assert [[tuple(c) for c in r] for r in chart.rows] == rows, text
        assert (chart.row_count, chart.precision, chart.is_estimate) == (len(rows), precision, precision != "exact"), text
        assert (chart.years_covered.years if chart.years_covered else []) == years, text


def test_severed_value_is_not_invented(spark):
    for k in range(1, 4):
        text = "<title>Hull</title><data>Year,Crew,Age " + " ".join(f"{1960 + i},{i},{i + 1}" for i in range(k)) + " 1990,"
        chart = parse(spark, text)[0]
        assert chart.is_truncated and chart.title == "Hull" and chart.row_count == k + 1
        assert [c.value for c in chart.rows[-1]] == [1990.0, None, None]


def test_marks_of_other_tools_are_text(spark):
    """A control character in a block starts no row."""
    for mark in ("\u0001", "\u0002", "\u0002!", "\u0002?\u0001", "\u0001\u00021960"):
        chart = parse(spark, block(f"Year,Crew 1960,4{mark}5 1961,6"))[0]
        assert [[c.raw for c in r] for r in chart.rows] == [["1960", f"4{mark}5"], ["1961", "6"]]


def test_repeated_columns_extra_cells_and_year_like_values(spark):
    chart = parse(spark, block("Year,A,A 2020,1'797.8 2021,1'800.0,3,4 2002,2003,5"))[0]
    assert chart["columns"] == ["Year", "A", "A (2)"]
    assert [[c.raw for c in r] for r in chart.rows] == [["2020", "1'797.8", ""], ["2021", "1'800.0", "3"], ["2002", "", ""], ["2003", "5", ""]]
    assert chart.rows[0][1].value == 1797.8


def test_unparseable_blocks_are_dropped(spark):
    assert parse(spark, block("no rows at all"), block(""), block("2020,1 2021,2")) == []


def test_column_bases_fall_back_to_the_passage_with_one_data_column(spark):
    two, three = parse(spark, "Verkauf " + block("Year,Value 2020,1"), "Verkauf " + block("Year,Value,Annual_Installation_MW 2020,1,2"))
    assert [b.basis for b in two.column_bases["Value"]] == ["sales"] and two.column_bases["Year"] == []
    assert three.column_bases["Value"] == [] and [b.basis for b in three.column_bases["Annual_Installation_MW"]] == ["installed_annual"]


def test_cells_in_long_form(spark):
    df = spark.createDataFrame([(1, block("Year,V 2020,1 2021,-"))], "id int, text string")
    cells = C.chart_cells(C.charts_from_passages(df), "id").orderBy("row_idx", "col_idx").collect()
    assert [(c.row_idx, c.col_idx, c.column, c.raw, c.kind) for c in cells] == [
        (0, 0, "Year", "2020", "exact"), (0, 1, "V", "1", "exact"), (1, 0, "Year", "2021", "exact"), (1, 1, "V", "-", "text")]
