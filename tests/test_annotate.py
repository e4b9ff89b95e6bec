from __future__ import annotations

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from beleg.operators import annotate as A


def evaluate(spark, expression, *texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, text string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("text"))).collect()]


def test_bases(spark):
    got = evaluate(
        spark, A.bases,
        "Verkauf von Booten, Total installierte Motoren: 77, davon 60 installiert",
        "Im Hafen lagen Ende 2009 rund 31 Kräne, 4 davon hinzugebaut.",
        "Der Kran wurde 2006 installiert.", "Salt_Production_t", "Cumulative_Berths",
        "JÄHRLICH  installierte Bojen", "", None, "reproductions regenerated",
    )
    named = [[(b.basis, b.evidence) for b in r] for r in got]
    assert named == [
        [("sales", "Verkauf"), ("installed_cumulative", "Total installierte")],
        [("installed_annual", "hinzugebaut"), ("installed_cumulative", "Ende 2009 rund")],
        [], [("production", "Production")], [("installed_cumulative", "Cumulative")],
        [("installed_annual", "JÄHRLICH installierte")], [], [], [],
    ]


def test_first_pattern_in_order_gives_the_evidence(spark):
    assert evaluate(spark, A.bases, "sold first, then Absatz")[0][0].evidence == "Absatz"


UNITS = "MW MWp MWh GW GWh kW kWh TW TWh TJ GJ PJ MJ m2 m² km2".split()
PROGRAMMES = "Energiestrategie Energieperspektiven Perspektiven Strategie Szenarien Szenario Programm Agenda".split()


def year_phrase(rng):
    """A phrase and the years that it has as data points, by the kind of the phrase."""
    year, kind = rng.randint(1900, 2100), rng.randrange(7)
    other = rng.choice([rng.randint(1800, 1899), rng.randint(2101, 2199), rng.randint(1, 1799), rng.randint(2200, 99999)])
    return [
        (f"von {year} an", {year}), (f"{other} Stück", set()), (f"{year}{rng.choice(['', ' '])}{rng.choice(UNITS)} mehr", set()),
        (f"{rng.choice([rng.choice(PROGRAMMES), rng.choice(PROGRAMMES).upper()])} {year}{rng.choice(['', '+'])} gilt", set()),
        (f"{year}.{rng.randint(0, 9)} je", set()), (f"{rng.randint(1, 9)}'{year} oder {year}'000", set()), (f"({year}; {year}:", {year}),
    ][kind]


def test_years_covered(spark):
    rng = random.Random(20)
    made = [("", set())] + [(" und ".join(p[0] for p in phrases), set().union(*(p[1] for p in phrases))) for phrases in ([year_phrase(rng) for _ in range(rng.randint(1, 5))] for _ in range(300))]
    for (text, years), got in zip(made, evaluate(spark, A.years_covered, *(m[0] for m in made))):
        assert (got.years if got else []) == sorted(years), text
        if got:
            assert (got.min, got.max) == (min(years), max(years))


def test_truncation(spark):
    made = {None: 0, "": 0, "\t\n": 0}
    for opening, middle, ending in product(["", "</row> ", "\n</x1>"], ["a <data>b</data> c", "a <data>b c", "a b</data> c", "<data><data>a</data> b", "plain"], [*":,=~-–", *">.!?%\"')]7", "x", "é", ";", "…"]):
        for space in ("", " ", "\n"):
            unclean = ending not in ">.!?%\"')]7"
            made[opening + middle + ending + space] = bool(opening) + (middle.count("<data>") != middle.count("</data>")) + unclean
    for (text, n), got in zip(made.items(), evaluate(spark, A.truncation_reasons, *made)):
        assert len(got) == n, text


def test_projection(spark):
    assert evaluate(
        spark, A.is_projection, "was estimated at 70 ships", "This bar is hatched.", "kamen 2011 rund 412 Schiffe.", None,
        "geschätzt auf 8 für 2040", "unprojected",
    ) == [True, True, False, False, True, False]


def test_extraction_method(spark):
    rows = [
        ("heights estimated based on visual interpretation", None, "chart_visual_read"),
        ("numbers as labeled on the chart", None, "chart_label"),
        ("<analysis> <image_type> Data\nTable </image_type>", None, "table"),
        ("<image_type>Table</image_type> values were read off the figure", None, "chart_visual_read"),
        ("Year,V 1990,0-5", "estimated", "chart_visual_read"), ("Year,V 2001,1", "exact", None), ("", "estimated", None),
    ]
    df = spark.createDataFrame(rows, "text string, precision string, want string")
    got = A.with_extraction_method(df).collect()
    assert [r.extraction_method for r in got] == [r.want for r in got]


def test_document_names(spark):
    df = spark.createDataFrame([(n,) for n in (
        "2013-05-17_kleine-hafenkunde-band-zwei.pdf", "2013-05-17_x.PDF", "hafenkunde.pdf", "2013-05-17_karte.xlsx", "", None)], "title string")
    got = [(r.published_at, r.slug) for r in A.with_document_name(df).collect()]
    assert got == [("2013-05-17", "kleine hafenkunde band zwei"), ("2013-05-17", "x"), (None, None), (None, None), (None, None), (None, None)]


@pytest.mark.parametrize(
    "text,label,count",
    [
        ("Kai und kai, doch nicht Kaiser", "kai", 2), ("Kaié kai_1", "kai", 0), ("F++ oder f++ (F++)", "F++", 3), ("", "x", 0),
        ("abc", " ", 0), (None, "x", 0), ("ÄRA ära", "Ära", 2), (r"a \E b", r"\E", 1), ("m² m²x", "m", 0),
    ],
)
def test_mention_count(spark, text, label, count):
    df = spark.createDataFrame([(text, label)], "t string, l string")
    assert df.select(A.mention_count(F.col("t"), F.col("l"))).first()[0] == count


def test_glossary_candidates(spark):
    rng, want = random.Random(8), {}
    for n in range(1, 12):  # by number of words
        want[" ".join(rng.choices(["brake", "weg", "Übergang"], k=n))] = n <= 8
    for n in range(1, 6):  # by length
        want["q" * n] = n >= 3
        want[" " + "q" * n + "  "] = n >= 3
    for _ in range(60):  # numbers, alone or before a word, and behind one
        number = "".join(rng.choices("0123456789", k=rng.randint(1, 5))) + "".join(rng.choices(" .,%+/:-–", k=rng.randint(0, 2)))
        want |= {number + "1": False, "-" + number: False, f"{number}rails": False, f"rails {number}": True}
    want |= {"...": False, "–/–": False}
    assert dict(zip(want, evaluate(spark, A.is_glossary_candidate, *want))) == want


def test_core_source_keeps_a_null_link_only(spark):
    fields = "title string, published_at string, download_url string, file_type string, language string, media_type string, created_at string, last_updated_at string"
    df = spark.createDataFrame([(("t", None, None, "PDF", "en", None, None, None),)], f"source struct<{fields.replace(' string', ':string')}>")
    core, everything = df.select(A.source_json(F.col("source")), A.source_json(F.col("source"), "all")).first()
    assert core == '{"title":"t","download_url":null}'
    assert '"created_at":null' in everything and '"file_type":"PDF"' in everything
    with pytest.raises(ValueError):
        A.source_json(F.col("source"), "some")
    assert "text" not in A.project_passages(spark.createDataFrame([("x", 1)], "text string, n int"), "index").columns
