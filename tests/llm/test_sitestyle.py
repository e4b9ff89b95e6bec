import pytest

from beleg.llm import sitestyle

SCHEMA = "page_id long, url string, html string"


def text_of(source):
    return sitestyle.main_text(sitestyle.parse(source), frozenset())


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("plain &lt;text&gt; \n here", "plain <text> here"),
    ("<p>a<p>b<br>c&nbsp; d", "a\nb c d"), ("<p><b>a<br><p>b</p>", "a\nb"),
    ("<script>var a='</p>'</script><style>p{}</style><p>x</p><!-- no --><!-- open", "x"),
    ("<p title=\"a>b\" class='c'>x</p><p data-q=don't>it's</p>", "x\nit's"),
    ("<ul><li>a<li>b <i>c</i></ul><table><tr><td>1<td>2<tr><td>3</table>", "a\nb c\n1\n2\n3"),
    ("<nav>n</nav><header>h</header><article><h1>T</h1><p>x</p><footer>f</footer></article><aside>s</aside><footer>f</footer>", "T\nx"),
    ("<div class='ad'>a</div><div id=cookie-banner>c</div><div class='site-header'>h</div><div class='content-body'>x</div>", "x"),
    ("<article>x<div class=comments><p>nice</p></div><form>f<textarea>g</textarea></form></article>", "x"),
    ("<div hidden>h</div><div style='display: none'>h</div><p>x", "x"),
    ("a < b and c &amp d &am <3", "a < b and c & d &am <3"), ("<title>t</title>x</body></html>", "x"),
    ("<div>" * 3000 + "deep", "deep"), ("<", "<"), ("<p", ""), ("</", "</"), ("<a href=\"x>y", "y"),
])
def test_parse(source, want):
    assert text_of(source) == want


@pytest.mark.parametrize("source, want", [
    ("<svg class=icon/><article><p>x</p></article>", "x"), ("<svg><path d='m'/><p>x</p>", "x"), ("<svg><foreignObject><div>s</div></foreignObject><g></svg><p>x", "x"),
    ("<select><option>A<option>B</select><article><p>x</p></article>", "x"), ("<datalist><option>A<optgroup><option>B</datalist><p>x</p>", "x"),
    ("<video><button>b</video><article>x</article>", "x"), ("<p>Hello <button>b</button> world", "Hello world"), ("<p>Hello <button><div>b</div></button> world", "Hello\nworld"),
    ("<form id=aspnetForm><main><p>x</p><form>f</form></main></form>", "x"), ("<form id=aspnetForm><div>x</div><p>y</form>", "x\ny"), ("<form>f</form><article>x</article>", "x"),
])
def test_noise_elements_end(source, want):
    assert text_of(source) == want


def pages():
    rows = []
    for i in range(12):
        rows.append((i, f"https://Shop.example.com/{i}", f"<body><div class=bar>Free delivery</div><div class=c1><p>article {i} says word{i * 7}</p><p>part {i}</p></div><div class=b2><span>Call us</span></div>"))
    for i in range(12, 15):  # too few pages to tell
        rows.append((i, "https://small.example.com/x", f"<div class=bar>Same</div><p>text {i}</p>"))
    rows += [(20 + i, "https://copy.example.com/x", "<div class=q>copied text</div>") for i in range(9)]  # copies are no template
    rows += [(30 + i, "https://art.example.com/x", f"<article><p>the same lead</p><div class=box>Join now</div></article><i>{i}</i>") for i in range(9)]
    return [*rows, (None, None, None), (None, None, "<p>x</p>"), (1, rows[1][1], rows[1][2])]


def test_removed_branches(spark):
    df = spark.createDataFrame(pages(), SCHEMA).selectExpr("*", "1 AS host", "2 AS removed", "3 AS nodes")
    got = {}
    for r in sitestyle.judge(df).collect():
        assert r["n_chars"] == len(r["text"])
        got.setdefault(r["page_id"], []).append(r["text"])
    assert sum(map(len, got.values())) == len(pages())
    assert all(got[i] == [f"article {i} says word{i * 7}\npart {i}"] * (2 if i == 1 else 1) for i in range(12))
    assert all(got[i] == [f"Same\ntext {i}"] for i in range(12, 15))
    assert all(got[20 + i] == ["copied text"] for i in range(9))
    assert sorted(got[None]) == ["", "x"]


def test_importance_of_nodes(spark):
    """Nine distinct pages: the box says the same on all, so it goes; the plain lead stays though it does too."""
    rows = [(i, "https://art.example.com/x", f"<article><p>the same lead</p><p>own {i}</p><div class=box>Join now</div></article>") for i in range(9)]
    assert {r["text"] for r in sitestyle.judge(spark.createDataFrame(rows, SCHEMA)).collect()} == {f"the same lead\nown {i}" for i in range(9)}
    kept = sitestyle.judge(spark.createDataFrame(rows, SCHEMA), least=0.0)
    assert {r["text"] for r in kept.collect()} == {f"the same lead\nown {i}\nJoin now" for i in range(9)}


def test_plain_nodes_are_judged_by_text(spark):
    """In the article the repeated lines go and their siblings stay; outside it importance decides as well."""
    def page(i):
        return f"<article><h1>Title {i}</h1><p>own {i}</p><p>Tell your friends</p><ul><li>point {i}<li>Print this</ul></article><div class=q>rest {i} of it</div><div class=z>Join now</div>"

    rows = [(i, "https://art.example.com/x", page(i)) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in sitestyle.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: f"Title {i}\nown {i}\npoint {i}\nrest {i} of it" for i in range(9)}
    few = [(0, "https://few.example.com/x", "<article>teaser</article><div>the long text itself</div>"), (1, "https://few.example.com/x", "<article>the long text</article><div>other</div>")]
    got = {r["page_id"]: r["text"] for r in sitestyle.judge(spark.createDataFrame(few, SCHEMA)).collect()}
    assert got == {0: "teaser\nthe long text itself", 1: "the long text"}


def test_empty_table(spark):
    assert sitestyle.judge(spark.createDataFrame([], SCHEMA)).collect() == []
