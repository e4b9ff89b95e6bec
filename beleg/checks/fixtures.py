"""Inputs of the registered queries, derived from the driver's tables.

Each fixture is one SELECT in the dialect Spark and DuckDB share; ``{name}`` refers to a
driver table or another fixture. Spark evaluates them as DataFrames, the oracle as CTEs.
Every fixture covers its whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

BASE = "https://example.org/kg/"
TERMS = "https://example.org/term/"
VOCAB = "https://example.org/vocab#"
CONTENT_HASH = "sha256:" + "ab" * 32
GLOSSARY = BASE + "glossary/" + "ab" * 6
ROOT = "s3://kb/"
MODEL = "model-1"

FIXTURES: dict[str, str] = {
    # Object listing of the documents, with one side-car each.
    "objects": """
        SELECT concat(source, '/', lpad(cast(doc_id AS string), 6, '0'), '_', lang,
                      CASE doc_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.MD' WHEN 2 THEN '.json' ELSE '' END) AS key,
               n_chars AS size, md5(text) AS etag, doc_id
        FROM {documents}""",
    "listing": """
        SELECT key, size, concat('"', etag, '"') AS etag, doc_id FROM {objects}
        UNION ALL SELECT concat(key, '.metadata.json'), 10, concat('"', etag, '"'), doc_id FROM {objects}""",
    # Text objects of four kinds: plain, front matter, JSON, broken JSON.
    "text_objects": """
        SELECT doc_id, lang, source, n_chars,
               concat(source, '/', cast(doc_id AS string),
                      CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.MD' ELSE '.json' END) AS key,
               n_chars AS size, md5(text) AS etag,
               CASE doc_id % 4
                   WHEN 0 THEN text
                   WHEN 1 THEN concat('---', chr(10), 'lang: ', lang, chr(10), 'source: "', source, '"', chr(10),
                                      'chars: ', cast(n_chars AS string), chr(10), '---', chr(10), chr(10), text)
                   WHEN 2 THEN concat('{{"id": ', cast(doc_id AS string), ', "lang": "', lang,
                                      '", "ok": true, "none": null, "nested": [1, 2], "deep": {{"a": 1}}}}')
                   ELSE concat('{{broken ', text) END AS body,
               text
        FROM {documents}""",
    # Side-cars of three kinds: typed attributes, broken, empty.
    "sidecars": """
        SELECT doc_id, concat(key, '.metadata.json') AS key,
               CASE doc_id % 3
                   WHEN 0 THEN concat('{{"metadataAttributes": {{"lang": {{"value": {{"type": "STRING", "stringValue": "', source,
                                      '"}}}}, "n": {{"value": {{"type": "NUMBER", "numberValue": ', cast(n_chars AS string),
                                      '}}}}, "flag": {{"value": {{"booleanValue": true}}}}, "plain": "x"}}}}')
                   WHEN 1 THEN '{{broken' ELSE '{{}}' END AS body
        FROM {text_objects}""",
    "two_texts": """
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN lang ELSE text END AS primary_text,
               CASE doc_id % 5 WHEN 0 THEN '' WHEN 2 THEN lang ELSE text END AS fallback_text
        FROM {documents}""",
    # JSON lines with broken and blank ones between.
    "log_lines": """
        SELECT doc_id, CASE doc_id % 10 WHEN 3 THEN concat('{{"doc_id": "d', cast(doc_id AS string)) WHEN 7 THEN ' '
                   ELSE concat('{{"doc_id": "d', cast(doc_id AS string), '", "source_uri": "s3://kb/', cast(doc_id AS string),
                               '", "size_bytes": ', cast(n_chars AS string), ', "etag": "', md5(text), '"}}') END AS value
        FROM {documents}""",
    # Document names, of which some do not follow the convention.
    "docnames": """
        SELECT o_orderkey AS doc_key,
               concat(substring(cast(o_orderdate AS string), 1, 10), '_', replace(lower(p_name), ' ', '-'), '.pdf') AS title,
               substring(cast(o_orderdate AS string), 1, 10) AS published_at
        FROM (SELECT *, o_orderkey % (SELECT count(*) FROM {part}) AS part_no FROM {orders}) JOIN {part} ON p_partkey = part_no""",
    "odd_docnames": """
        SELECT doc_key, CASE doc_key % 4 WHEN 0 THEN title WHEN 1 THEN replace(title, '.pdf', '.PDF')
                   WHEN 2 THEN replace(title, '.pdf', '.xlsx') ELSE concat('x', title) END AS title
        FROM {docnames}""",
    "catalogue": """
        SELECT cast(p_partkey AS string) AS pub_id, p_name AS title,
               cast(DATE '1995-01-01' + cast(p_partkey AS int) AS string) AS pub_date,
               CASE p_size % 3 WHEN 0 THEN 'XLSX' ELSE 'PDF' END AS file_type, p_partkey AS page_pos
        FROM {part}""",
    # Longer names for the conjunctive search: brand and type words too.
    "long_docnames": """
        SELECT o_orderkey AS doc_key,
               concat(substring(cast(o_orderdate AS string), 1, 10), '_', replace(lower(p_name), ' ', '-'), '-', lower(p_type),
                      CASE o_orderkey % 3 WHEN 0 THEN '-vorabzug-der-statistik' WHEN 1 THEN '' ELSE '-tab' END, '.pdf') AS title
        FROM (SELECT *, o_orderkey % (SELECT count(*) FROM {part}) AS part_no FROM {orders}) JOIN {part} ON p_partkey = part_no""",
    "long_catalogue": """
        SELECT cast(p_partkey AS string) AS pub_id, concat(p_name, ' ', p_type, ' und Statistik') AS title,
               cast(DATE '1995-01-01' + cast(p_partkey AS int) AS string) AS pub_date,
               CASE p_size % 3 WHEN 0 THEN 'XLSX' ELSE 'PDF' END AS file_type, p_partkey AS page_pos
        FROM {part}""",
    # Passages with many equal texts and scores; the text states what the annotation must find.
    "passages": """
        SELECT l_suppkey AS query_id,
               cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) AS bigint) AS rank,
               l_discount AS score,
               concat(CASE l_partkey % 12
                          WHEN 0 THEN 'Zubau  von ' WHEN 1 THEN 'Verkauf ' WHEN 2 THEN 'Total installierte Leistung '
                          WHEN 3 THEN 'Prognose ' WHEN 4 THEN 'Annual_Installation_MW ' WHEN 5 THEN 'installiert '
                          WHEN 6 THEN 'Stromproduktion und Verkaufszahlen ' WHEN 7 THEN 'the generated sales hatched '
                          WHEN 8 THEN '</p> cumulative capacity ' WHEN 9 THEN 'neu  erstellte Anlagen, Energiestrategie 2050 '
                          WHEN 10 THEN 'rund 2''170 MWp und 2018 GWh ' ELSE '<data>Gesamtleistung ' END,
                      cast(l_partkey % 7 AS string), ' MW in ', cast(year(l_shipdate) AS string),
                      CASE l_orderkey % 5 WHEN 0 THEN '.' WHEN 1 THEN ':' WHEN 2 THEN ' rund' WHEN 3 THEN ' = ' ELSE '' END) AS text,
               concat(substring(cast(l_shipdate AS string), 1, 7), '-01_doc', cast(l_partkey % 20 AS string), '.pdf') AS title,
               CASE l_partkey % 5 WHEN 0 THEN 'chart' END AS media_type,
               cast(year(l_shipdate) AS int) AS queried_year
        FROM {lineitem}""",
    # Yearly totals per customer group, and the chart transcriptions made of them.
    "yearly": """
        SELECT o_custkey % 50 AS k, cast(year(o_orderdate) AS int) AS yr, count(*) AS n, cast(round(sum(o_totalprice)) AS bigint) AS total
        FROM {orders} GROUP BY o_custkey % 50, year(o_orderdate)""",
    "chart_blocks": """
        SELECT k, concat(CASE k % 5 WHEN 0 THEN 'Verkauf der Anlagen ' ELSE '' END,
                      '<title> Series ', cast(k AS string), ' </title> <data>Year,',
                      CASE k % 5 WHEN 0 THEN 'Value' ELSE 'newly installed (MW),Stromproduktion (GWh)' END, ' ',
                      listagg(line, ' ') WITHIN GROUP (ORDER BY yr),
                      CASE k % 3 WHEN 0 THEN ' Note: values are estimated</data>' WHEN 1 THEN '</data>' ELSE '' END) AS text
        FROM (SELECT k, yr, concat(cast(yr AS string),
                  CASE WHEN k % 5 = 0 THEN '' WHEN k % 4 >= 2 THEN concat(',', cast(100000 + n AS string), '-', cast(100005 + n AS string))
                       ELSE concat(',', cast(100000 + n AS string)) END,
                  CASE WHEN k % 4 = 3 THEN concat(',', cast(total AS string), ' - ', cast(total + 9 AS string))
                       ELSE concat(',', cast(total AS string)) END) AS line
              FROM {yearly})
        GROUP BY k""",
    "chart_passages": """
        SELECT k AS passage_id, text, concat('2001-01-01_series-', cast(k % 10 AS string), '.pdf') AS title, 'PDF' AS file_type, 'en' AS language,
               'chart' AS media_type, cast(NULL AS string) AS created_at, cast(NULL AS string) AS last_updated_at
        FROM {chart_blocks}
        UNION ALL SELECT k + 1000, concat(text, '  '), concat('2002-02-02_series-', cast(k % 10 AS string), '.pdf'), 'PDF', 'en', 'chart',
               cast(NULL AS string), cast(NULL AS string)
        FROM {chart_blocks}""",
    # The document graph: one document per order.
    "graph_docs": """
        SELECT substring(sha2(source_uri, 256), 1, 16) AS doc_id, *
        FROM (SELECT concat('s3://kb/', CASE o_orderkey % 3 WHEN 0 THEN 'misc/' ELSE '' END,
                            substring(cast(o_orderdate AS string), 1, 10), CASE o_orderkey % 2 WHEN 0 THEN '_' ELSE '-' END,
                            'order-no-', cast(o_orderkey AS string), '.pdf') AS source_uri,
                     CASE o_orderkey % 4 WHEN 0 THEN 'text/plain' ELSE 'application/pdf' END AS content_type,
                     o_orderkey % 1000 AS size_bytes, CASE o_orderstatus WHEN 'P' THEN '  ' ELSE o_orderpriority END AS text,
                     o_orderstatus = 'F' AS text_truncated, o_orderpriority, o_orderstatus, o_orderkey, o_custkey,
                     md5(cast(o_orderkey AS string)) AS etag
              FROM {orders})""",
    "facts": """
        SELECT doc_id, c_name AS s,
               CASE o_orderkey % 3 WHEN 0 THEN 'resides in' WHEN 1 THEN 'Wohnhaft in' ELSE 'supplies' END AS p, n_name AS o
        FROM {graph_docs} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
        UNION ALL
        SELECT doc_id, n_name, CASE o_orderkey % 10 WHEN 0 THEN 'belongs to' ELSE ' lies in ' END, r_name
        FROM {graph_docs} JOIN {customer} ON c_custkey = o_custkey JOIN {nation} ON n_nationkey = c_nationkey
             JOIN {region} ON r_regionkey = n_regionkey
        WHERE o_orderkey % 5 = 0""",
    # Labels per document: region names are relation ends only, never listed; some labels stand alone.
    "named": """
        SELECT doc_id, label, cast(count(*) AS bigint) AS n, true AS listed FROM (
            SELECT doc_id, s AS label FROM {facts} UNION ALL SELECT doc_id, o FROM {facts}) t
        WHERE label NOT IN (SELECT r_name FROM {region}) GROUP BY doc_id, label
        UNION ALL
        SELECT doc_id, o, cast(0 AS bigint), false FROM {facts} WHERE o IN (SELECT r_name FROM {region}) GROUP BY doc_id, o
        UNION ALL
        SELECT doc_id, concat(o_orderpriority, ' '), cast(o_orderkey % 3 AS bigint), true FROM {graph_docs} WHERE o_orderstatus = 'O'""",
    # A vocabulary over the nations: shared terms, contested and generic names.
    "vocab_alias": """
        SELECT lower(n_name) AS key, concat('term-', cast(n_nationkey % 8 AS string)) AS slug,
               CASE n_nationkey % 2 WHEN 0 THEN 'concept' ELSE 'regulation' END AS type,
               n_nationkey % 9 = 4 AS generic,
               CASE WHEN n_nationkey % 7 = 3 THEN concat('term-', cast(n_nationkey % 8 AS string), ',term-x') END AS senses
        FROM {nation}""",
    # Request log.
    "gateway_log": """
        SELECT ts, event_type AS method, value AS latency_ms,
               CASE event_type WHEN 'error' THEN CASE user_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 429 WHEN 2 THEN 401 ELSE 404 END ELSE 200 END AS status,
               concat('{{id=', cast(event_id AS string), ', jsonrpc=2.0, method=',
                      CASE WHEN event_type = 'view' THEN 'tools/list' ELSE 'tools/call' END,
                      ', params={{name=tool', cast(user_id % 4 AS string), ', arguments={{query=q', cast(user_id % 20 AS string), ', f={{b=c}}}}}}}}') AS request_body,
               CASE WHEN event_id % 50 = 0 THEN 'isError=true' ELSE 'isError=false' END AS response_body,
               CASE WHEN event_type = 'error' AND user_id % 4 = 0 THEN 'true' END AS gateway_error,
               CASE WHEN event_id % 77 = 0 THEN 'Error in target' WHEN event_id % 3 = 0 THEN 'ok' END AS log,
               lpad(cast(event_id AS string), 12, '0') AS request_id
        FROM {events}""",
    "questions": "SELECT item_id AS query_id, text AS question FROM {benchmark}",
    "doc_passages": """
        SELECT doc_id AS passage_id, text,
               concat(cast(DATE '2000-01-01' + cast(doc_id % 30 AS int) AS string), '_', lang, '-', replace(source, '.', '-'), '.pdf') AS title,
               'PDF' AS file_type, lang AS language, CASE doc_id % 3 WHEN 0 THEN 'chart' END AS media_type,
               cast(NULL AS string) AS created_at, cast(NULL AS string) AS last_updated_at
        FROM {documents}""",
    "line_passages": """
        SELECT query_id * 10000000 + rank AS passage_id, text, title,
               'PDF' AS file_type, 'de' AS language, media_type, cast(NULL AS string) AS created_at, cast(NULL AS string) AS last_updated_at
        FROM {passages}""",
}


def dependencies(name: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", FIXTURES[name])))


class Inputs:
    """Lazily derived DataFrames of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._known = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                parts = {d: getattr(self, d) for d in dependencies(name)}
                self._known[name] = self.spark.sql(FIXTURES[name], **parts)
        return self._known[name]


def duck(text: str) -> str:
    """A shared-dialect SELECT as DuckDB spells it."""
    text = re.sub(r"listagg\((\w+), '(.)'\) WITHIN GROUP \(ORDER BY (\w+)\)", r"string_agg(\1, '\2' ORDER BY \3)", text)
    return re.sub(r"sha2\(([^()]*(?:\([^()]*\)[^()]*)*), 256\)", r"sha256(\1)", text)




def with_fixtures(query: str, ctes: dict[str, str] | None = None, recursive: bool = False) -> str:
    """DuckDB text: the fixtures and named CTEs that ``query`` mentions, then the query."""
    extra = ctes or {}
    body, parts, done = query, [], set()

    def add(name: str) -> None:
        if name in done or name in TABLES:
            return
        done.add(name)
        if name in extra:
            for other in re.findall(r"\w+", extra[name]):
                if other in extra or other in FIXTURES:
                    add(other)
            parts.append(f"{name} AS (\n{extra[name]}\n)")
        else:
            for other in dependencies(name):
                add(other)
            names = {d: d for d in dependencies(name)}
            parts.append(f"{name} AS (\n{duck(FIXTURES[name].format(**names))}\n)")

    for word in re.findall(r"\w+", body):
        if word in extra or word in FIXTURES:
            add(word)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body
