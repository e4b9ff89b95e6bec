import itertools
import math
import re

from pyspark.sql import functions as F

from beleg.llm import urls

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "https://cheappills.example.com/buy/1", "<p>cheap pills now, for example example com com</p>"), (2, "http://Cheappills.example.com/de/2?x=/#y", "<p>cheap</p>"),
    (3, "https://pillscheap.example.net/x", "<b>pills</b> are cheap"), (4, "https://goodnews.example.net/en/a", "good news"), (5, "https://newsgood.example.org/fr/", "news are good"),
    (6, "https://goodnews.example.org/x/news", "good"), (7, None, None), (8, "no host", ""), (9, "https://net", "x"), (10, "https://net/", "x"), (11, "https://xnet/", "x"),
    (12, "https://a.b.net?p=/", "x"), (13, "ftp://ÀB.org/fr/É", "x"), (None, "https://goodnews.example.org/x/news", "good"), (6, "https://goodnews.example.org/x/news", "good"),
    (14, "://x.org/fr", "x"), (15, "https://example.net/en", "x"), (16, "https://" + "a" * 3000 + ".org/q", "x"), (17, "https://x.org/" + "b/" * 3000, "x")]


def slow_rule(url):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split("[/?#]", rest)[0])
    path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]):])[0]
    fits = []
    for verdict, rule in urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(rule), rule, verdict))
    return host, path, *(min(fits)[1:] if fits else (None, None))


def test_hosts_paths_and_rules(spark):
    got = urls.judge(spark.createDataFrame(PAGES, SCHEMA).withColumn("host", F.lit("x")).withColumn("tokens", F.lit(1))).collect()
    assert len(got) == len(PAGES)
    want = {(i, *slow_rule(u)[:3]) for i, u, _ in PAGES}
    assert {(r["page_id"], r["host"], r["path"], r["rule"]) for r in got} == want
    by_host = {(r["host"], r["path"]): r for r in got}
    for i, u, _ in PAGES:
        host, path, rule, verdict = slow_rule(u)
        assert by_host[host, path]["verdict"] == verdict if rule else by_host[host, path]["verdict"] in ("allow", "block")
    assert by_host["cheappills.example.com", "/buy/1"]["host_words"] == "cheap pills example com"


def test_bayes_equals_brute_force(spark):
    got = urls.judge(spark.createDataFrame(PAGES, SCHEMA)).collect()
    rows = {}
    for r in got:
        path = re.findall(r"[^\W_]+", re.sub("[0-9]+", "0", r["path"].lower()))
        rows[r["host"], r["path"]] = (r, [f"h:{w}" for w in r["host_words"].split()] + [f"p:{w}" for w in path])
    counts, docs = {"allow": {}, "block": {}}, {"allow": 0, "block": 0}
    for r, tokens in rows.values():
        if r["rule"]:
            docs[r["verdict"]] += 1
            for t in tokens:
                counts[r["verdict"]][t] = counts[r["verdict"]].get(t, 0) + 1
    vocabulary = {*counts["allow"], *counts["block"]}
    total = {k: sum(c.values()) for k, c in counts.items()}
    for r, tokens in rows.values():
        if not r["rule"]:
            odds = math.log(docs["block"] / docs["allow"])
            for t in tokens:
                if t in vocabulary:
                    p = {k: (counts[k].get(t, 0) + 1) / (total[k] + len(vocabulary)) for k in counts}
                    odds += math.log(p["block"] / p["allow"])
            assert math.isclose(r["log_odds"], odds, abs_tol=1e-9) and r["verdict"] == ("block" if odds > 0 else "allow")


def test_viterbi_equals_all_splits():
    counts = {"a": 30, "ab": 7, "abc": 3, "bc": 5, "cab": 2, "b": 1}
    total = sum(counts.values())
    unknown = math.log(10 / total)
    for piece in map("".join, itertools.chain.from_iterable(itertools.product("abcx", repeat=n) for n in range(1, 6))):
        costs = {(i, j): math.log(counts[piece[i:j]] / total) for i in range(len(piece)) for j in range(i + 1, len(piece) + 1) if piece[i:j] in counts}

        def cost(words):
            return sum(math.log(counts[w] / total) if w in counts else unknown - len(w) * math.log(10) for w in words)

        splits = []
        for mask in range(1 << (len(piece) - 1)):
            cuts = [0, *(i + 1 for i in range(len(piece) - 1) if mask >> i & 1), len(piece)]
            splits.append([piece[a:b] for a, b in zip(cuts, cuts[1:])])
        words = urls.segment(piece, costs, unknown)
        assert "".join(words) == piece and math.isclose(cost(words), max(map(cost, splits)))


def test_one_class_or_no_rows(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    only = urls.judge(pages.filter("page_id IN (3, 6)")).collect()
    assert {(r["page_id"], r["verdict"]) for r in only} == {(3, "block"), (6, "allow")}
    assert urls.judge(pages.filter("page_id < 0")).collect() == []
