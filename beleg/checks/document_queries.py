"""Queries over sources, documents, catalogue matching and incremental state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beleg.checks.fixtures import ROOT, Inputs
from beleg.checks.graph_inputs import document_records, extraction_records
from beleg.checks.oracle_parts import sql
from beleg.checks.passage_queries import core_ctes
from beleg.checks.registry import listed, query, sorted_map, stored
from beleg.functions import markers as M
from beleg.operators import annotate, catalogue, documents
from beleg.operators.extraction import extract_with, extract_with_gazetteer
from beleg.plans.search import ranked_passages
from beleg.session import shared_dir
from beleg.sources import catalogue_pages, feedback, objects, records
from beleg.sources.gateway_log import read_gateway_log


def _listing(d: Inputs) -> DataFrame:
    return objects.objects_from_listing(d.listing.withColumn("last_modified", F.lit("2024-01-01 00:00:00")))


@query("s1_list_objects", sql(r"""
    SELECT key, size, etag, lower(regexp_extract(key, '\.([^./]+)$', 1)) AS extension FROM objects"""))
def list_objects(d: Inputs) -> DataFrame:
    return _listing(d).select("key", "size", "etag", "extension")


def _text_objects(d: Inputs) -> DataFrame:
    raw = d.text_objects.select("key", "size", "etag", F.encode("body", "utf-8").alias("content"))
    listed = objects.objects_from_listing(raw.withColumn("last_modified", F.lit(None).cast("timestamp")))
    return objects.ingest_text(listed.join(raw.select("key", "content"), "key"), ROOT)


def _sidecars(d: Inputs) -> DataFrame:
    return d.sidecars.select("key", F.encode("body", "utf-8").alias("content"))


_OWN = """CASE doc_id % 4 WHEN 1 THEN 'chars=' || n_chars || ';lang=' || lang || ';source=' || source
    WHEN 2 THEN 'id=' || doc_id || ';lang=' || lang || ';none=None;ok=True' ELSE '' END"""


@query("s2_ingest_text", sql(f"""
    SELECT substring(sha256('{ROOT}' || key), 1, 16) AS doc_id, '{ROOT}' || key AS source_uri,
           CASE doc_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' ELSE 'application/json' END AS content_type,
           size AS size_bytes, md5(CASE doc_id % 4 WHEN 1 THEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') ELSE body END) AS text_digest, {_OWN} AS properties, etag
    FROM text_objects"""))
def ingest_text(d: Inputs) -> DataFrame:
    return _text_objects(d).select("doc_id", "source_uri", "content_type", "size_bytes", F.md5("text").alias("text_digest"),
                                   sorted_map(F.col("properties")).alias("properties"), "etag")


@query("s3_attach_sidecar", sql(f"""
    SELECT '{ROOT}' || t.key AS source_uri, CASE WHEN doc_id % 3 <> 0 THEN {_OWN}
           ELSE array_to_string(list_sort(list_concat(
               list_filter(string_split({_OWN}, ';'), lambda x: x <> '' AND NOT starts_with(x, 'lang=')),
               ['flag=True', 'lang=' || source, 'n=' || n_chars, 'plain=x'])), ';') END AS properties
    FROM text_objects t"""))
def attach_sidecar(d: Inputs) -> DataFrame:
    return objects.attach_sidecar(_text_objects(d), _sidecars(d)).select("source_uri", sorted_map(F.col("properties")).alias("properties"))


@query("s4_choose_extraction", sql(f"""
    SELECT doc_id, md5(chosen) AS text_digest, trim(chosen) = '' AS warned FROM (
        SELECT doc_id, CASE WHEN len(regexp_replace(primary_text, '^\\s+|\\s+$', '', 'g')) >= {M.MIN_CHARS_BEFORE_FALLBACK}
            OR len(regexp_replace(fallback_text, '^\\s+|\\s+$', '', 'g')) <= len(regexp_replace(primary_text, '^\\s+|\\s+$', '', 'g'))
            THEN primary_text ELSE fallback_text END AS chosen FROM two_texts) t"""))
def choose_extraction(d: Inputs) -> DataFrame:
    chosen = documents.choose_extraction(d.two_texts.withColumn("properties", objects.no_properties()))
    return chosen.select("doc_id", F.md5("text").alias("text_digest"), F.map_contains_key("properties", "extractionWarning").alias("warned"))


@query("s5_read_log", sql("""
    SELECT 'd' || doc_id AS doc_id, 's3://kb/' || doc_id AS source_uri, n_chars AS size_bytes, md5(text) AS etag
    FROM documents WHERE doc_id % 10 NOT IN (3, 7)"""))
def read_log(d: Inputs) -> DataFrame:
    path = shared_dir(d.spark, "lines")
    d.log_lines.select("value").write.text(path)
    return records.read_log(d.spark, path).select("doc_id", "source_uri", "size_bytes", "etag")


@query("s5b_skipped_lines", sql("SELECT cast(count_if(doc_id % 10 NOT IN (3, 7)) AS bigint) AS records, cast(count_if(doc_id % 10 = 3) AS bigint) AS skipped FROM documents"))
def skipped_lines(d: Inputs) -> DataFrame:
    return records.corrupt_count(records.parse_records(d.log_lines.select("value"), records.DOCUMENT_SCHEMA))


@query("s6_append_log", sql("""
    SELECT doc_id, source_uri, cast(size_bytes AS bigint) AS size_bytes, 'Priority Class=' || o_orderpriority || ';cust.key=' || o_custkey || ';status=' || o_orderstatus AS properties, n
    FROM graph_docs, (SELECT unnest([1, 2]) AS n) v"""))
def append_log(d: Inputs) -> DataFrame:
    path = shared_dir(d.spark, "log")
    records.append_log(document_records(d), path)
    records.append_log(document_records(d).withColumn("ingest_seq", F.lit(2).cast("bigint")), path)
    return records.read_log(d.spark, path).select("doc_id", "source_uri", "size_bytes", sorted_map(F.col("properties")).alias("properties"),
                                                  F.col("ingest_seq").cast("int").alias("n"))


_OLD = """SELECT key, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'old' ELSE etag END AS etag FROM objects WHERE doc_id % 11 <> 0"""


def _known(d: Inputs) -> DataFrame:
    """An earlier state: some objects changed since, some unknown, some without etag."""
    return d.objects.filter(F.col("doc_id") % 11 != 0).select("key", F.when(F.col("doc_id") % 13 == 0, None).when(
        F.col("doc_id") % 7 == 0, "old").otherwise(F.col("etag")).alias("etag"))


@query("s7_manifest", sql("SELECT key, etag FROM objects"))
def manifest(d: Inputs) -> DataFrame:
    path = shared_dir(d.spark, "manifest")
    records.write_manifest(_known(d), path)
    records.write_manifest(_listing(d), path)
    return records.read_manifest(d.spark, path)


@query("j5_pending_objects", sql("SELECT o.key FROM objects o LEFT JOIN known k USING (key) WHERE k.key IS NULL OR k.etag <> o.etag", known=_OLD))
def pending_objects(d: Inputs) -> DataFrame:
    known = _known(d).select(F.concat(F.lit(ROOT), "key").alias("source_uri"), "etag")
    return documents.pending_objects(_listing(d), known, ROOT).select("key")


@query("j5b_pending_by_manifest", sql("SELECT o.key FROM objects o LEFT JOIN known k USING (key) WHERE k.etag IS NULL OR k.etag <> o.etag", known=_OLD))
def pending_by_manifest(d: Inputs) -> DataFrame:
    return documents.pending_by_manifest(_listing(d), _known(d)).select("key")


_PAGE = "concat('<div class=\"list-group-item\"><strong>', p_name, ' &amp; <i>', p_type, '</i> &Uuml;bersicht</strong>', chr(10), '<p>Erschienen: ', date_text, '<br />Dateityp: ', CASE p_size % 3 WHEN 0 THEN 'xlsx' ELSE 'PDF' END, '<br />', CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat('<a href=\"/de/publication/download/', cast(p_partkey AS string), '\">DE</a>') END, '</div>')"


def _listing_pages(d: Inputs) -> DataFrame:
    """Listing pages of twenty catalogue entries each, among all the other pages."""
    entries = d.spark.sql(
        "SELECT *, date_format(DATE '1995-01-01' + cast(p_partkey AS int), 'dd.MM.yyyy') AS date_text FROM {part}", part=d.part
    )
    blocks = d.spark.sql(f"SELECT p_partkey, floor(p_partkey / 20) AS page_no, {_PAGE} AS block FROM {{entries}}", entries=entries)
    pages = blocks.groupBy("page_no").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "block"))).alias("b")).select(
        (F.col("page_no") + 1_000_000).alias("page_id"), F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("html")
    )
    return pages.unionByName(d.pages.select("page_id", "html"))


@query("s12_read_catalogue_pages", """
    SELECT cast(p_partkey AS varchar) AS pub_id, p_name || ' & ' || p_type || ' Übersicht' AS title,
           cast(DATE '1995-01-01' + cast(p_partkey AS int) AS varchar) AS pub_date,
           CASE p_size % 3 WHEN 0 THEN 'XLSX' ELSE 'PDF' END AS file_type,
           cast(p_partkey // 20 + 1000000 AS bigint) AS page, cast(p_partkey % 20 AS bigint) AS item
    FROM part WHERE p_partkey % 17 <> 0""")
def read_catalogue_pages(d: Inputs) -> DataFrame:
    pages = catalogue_pages.read_catalogue_pages(_listing_pages(d))
    return pages.withColumn("page", F.floor(F.col("page_pos") / (1 << 31)).cast("bigint")).withColumn(
        "item", (F.col("page_pos") % (1 << 31)).cast("bigint")).drop("page_pos")


@query("s12b_page_text", r"""
    SELECT page_id, len(regexp_replace(html, '<[^>]+>', '', 'g')) AS chars, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS digest FROM pages""")
def page_text(d: Inputs) -> DataFrame:
    plain = d.pages.select("page_id", catalogue_pages.strip_tags(F.col("html")).alias("t"))
    return plain.select("page_id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("digest"))


_FEEDBACK = """
    SELECT conv_id, timestamp_seconds(1704067200 + conv_id * 3600) AS ts, q.text AS user_question, a.text AS answer,
           CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' useful ' END AS user_reaction, CASE conv_id % 2 WHEN 0 THEN 'chat' END AS source,
           map('turn', cast(q.turn AS string)) AS extra
    FROM {conversations} q JOIN {answers} a USING (conv_id) WHERE q.role = 'user' AND a.role = 'assistant' AND a.turn = q.turn + 1"""

FEEDBACK_SQL = r"""
    SELECT cast(cast(make_timestamp((1704067200 + q.conv_id * 3600) * 1000000) AS date) AS varchar) AS day,
           md5(regexp_replace(q.text, '^\s+|\s+$', '', 'g')) AS question, md5(regexp_replace(a.text, '^\s+|\s+$', '', 'g')) AS answer,
           CASE q.conv_id % 3 WHEN 1 THEN 'useful' ELSE '_not provided_' END AS user_reaction,
           CASE q.conv_id % 2 WHEN 0 THEN 'chat' ELSE '_not provided_' END AS source, 'turn=' || q.turn AS extra
    FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'"""


def feedback_rows(d: Inputs) -> DataFrame:
    return d.spark.sql(_FEEDBACK, conversations=d.conversations, answers=d.conversations)


def shown_feedback(df: DataFrame) -> DataFrame:
    return df.select(F.col("day").cast("string").alias("day"), F.md5("user_question").alias("question"), F.md5("answer").alias("answer"),
                     "user_reaction", "source", sorted_map(F.col("extra")).alias("extra"))


@query("s14_append_feedback", FEEDBACK_SQL)
def append_feedback(d: Inputs) -> DataFrame:
    path = shared_dir(d.spark, "feedback")
    feedback.append_feedback(feedback_rows(d), path)
    return shown_feedback(feedback.read_feedback(d.spark, path))


def raw_log(d: Inputs) -> DataFrame:
    """The log in the shape it is delivered in."""
    return d.gateway_log.select(
        F.col("ts").cast("timestamp").alias("@timestamp"),
        F.struct(F.col("request_body").alias("requestBody"), F.col("response_body").alias("responseBody"),
                 F.col("gateway_error").alias("isError"), "log").alias("body"),
        F.lit(None).cast("string").alias("trace_id"), F.lit(None).cast("string").alias("span_id"), "request_id",
    )


@query("s15_read_gateway_log", sql("""
    SELECT request_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, request_body, response_body, gateway_error, log FROM gateway_log"""))
def gateway_log(d: Inputs) -> DataFrame:
    path = shared_dir(d.spark, "gateway-log")
    raw_log(d).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    log = read_gateway_log(d.spark, path)
    return log.select("request_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "request_body", "response_body", "gateway_error", "log")


# --- document predicates ------------------------------------------------------------------


@query("p10_document_flags", sql("SELECT doc_id, trim(text) <> '' AS has_text, text_truncated FROM graph_docs"))
def document_flags(d: Inputs) -> DataFrame:
    return annotate.with_document_flags(document_records(d)).select("doc_id", "has_text", "text_truncated")


@query("p11_dated_key", sql(r"""
    SELECT doc_key, nullif(regexp_extract(title, '^(\d{4}-\d{2}-\d{2})[_-](.+?)\.[A-Za-z0-9]+$', 1), '') AS publication_date,
           replace(nullif(regexp_extract(title, '^(\d{4}-\d{2}-\d{2})[_-](.+?)\.[A-Za-z0-9]+$', 2), ''), '-', ' ') AS title
    FROM odd_docnames"""))
def dated_key(d: Inputs) -> DataFrame:
    uris = d.odd_docnames.select("doc_key", F.concat(F.lit("s3://kb/some/path/"), "title").alias("source_uri"))
    return annotate.with_dated_key(uris).select("doc_key", "publication_date", "title")


_CANDIDATES = """
    SELECT c_name AS label_text FROM {customer} UNION ALL SELECT p_name FROM {part} UNION ALL SELECT cast(o_totalprice AS string) FROM {orders}
    UNION ALL SELECT concat(cast(o_orderkey AS string), ' GWh') FROM {orders} UNION ALL SELECT substring(r_name, 1, 2) FROM {region}
    UNION ALL SELECT concat('+', o_orderpriority, ' %') FROM {orders} UNION ALL SELECT text FROM {benchmark}"""


@query("p12_glossary_candidates", sql(r"""
    SELECT label_text, count(*) AS n FROM labels_in
    WHERE len(trim(label_text)) >= 3 AND len(list_filter(regexp_split_to_array(trim(label_text), '\s+'), lambda w: w <> '')) <= 8
      AND NOT regexp_matches(trim(label_text), '^[\d\s.,%''’‘–—+/:-]*\d[\d\s.,%''’‘–—+/:-]*$')
      AND NOT regexp_matches(trim(label_text), '^[\d\s.,''’‘+-]*\d') AND regexp_matches(label_text, '\p{L}')
    GROUP BY label_text""", labels_in=_CANDIDATES.replace("{", "").replace("}", "").replace(" AS string", " AS varchar")))
def glossary_candidates(d: Inputs) -> DataFrame:
    labels = d.spark.sql(_CANDIDATES, customer=d.customer, part=d.part, orders=d.orders, region=d.region, benchmark=d.benchmark)
    return annotate.filter_glossary_candidates(labels).groupBy("label_text").agg(F.count("*").alias("n"))


# --- catalogue ----------------------------------------------------------------------------------


_TOKENS = """list_distinct(list_filter(string_split(trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g')), ' '),
    lambda t: len(t) > 2 AND t NOT IN (""" + ", ".join(f"'{w}'" for w in M.TITLE_STOPWORDS) + ")))"

MATCHING = {
    "wanted": "SELECT DISTINCT title, substring(title, 1, 10) AS doc_date, "
              + _TOKENS.format("regexp_extract(title, '(?i)^\\d{{4}}-\\d{{2}}-\\d{{2}}_(.+)\\.pdf$', 1)").replace("{{", "{").replace("}}", "}")
              + " AS w FROM {names}",
    "held": "SELECT pub_id, pub_date, file_type, page_pos, " + _TOKENS.format("title") + " AS h FROM {catalogue}",
    "set_pairs": """SELECT w, h, len(list_intersect(w, h)) AS shared,
            len(list_intersect(h, list_transform(list_sort(list_transform(w, lambda t: {'n': -len(t), 't': t}))[1:3], lambda x: x.t))) = least(len(w), 3) AS longest
        FROM (SELECT DISTINCT w FROM wanted) a, (SELECT DISTINCT h FROM held) b WHERE len(list_intersect(w, h)) > 0""",
    "scored": """SELECT * FROM (
        SELECT title, pub_id, page_pos, shared = len(w) AS whole, longest,
               2 * (shared / len(h)) * (shared / len(w)) / ((shared / len(h)) + (shared / len(w)))
               + CASE WHEN doc_date = pub_date THEN 0.5::double ELSE 0::double END + CASE WHEN file_type = 'PDF' THEN 0.25::double ELSE 0::double END AS score
        FROM wanted JOIN set_pairs USING (w) JOIN held USING (h)) s WHERE score >= 0.65""",
}


def _matching(names: str, entries: str) -> dict[str, str]:
    return {k: v.replace("{names}", names).replace("{catalogue}", entries) for k, v in MATCHING.items()}


_BEST = """
    SELECT wanted.title, pub_id, round(score, 6) AS score FROM wanted LEFT JOIN (
        SELECT *, row_number() OVER (PARTITION BY title ORDER BY {order}) AS n FROM scored {where}) b ON b.title = wanted.title AND n = 1
    WHERE len(w) > 0"""


@query("j1_match_publications", sql(_BEST.format(order="score DESC, page_pos", where=""), **_matching("docnames", "catalogue")))
def match_publications(d: Inputs) -> DataFrame:
    return catalogue.match_publications(d.docnames, d.catalogue).select("title", "pub_id", "score")


@query("j2_match_with_fallback", sql(_BEST.format(order="whole DESC, score DESC, page_pos", where="WHERE whole OR longest"),
                                     **_matching("long_docnames", "long_catalogue")))
def match_with_fallback(d: Inputs) -> DataFrame:
    return catalogue.match_with_fallback(d.long_docnames, d.long_catalogue).select("title", "pub_id", "score")


_DOC_CATALOGUE = """
    SELECT concat(cast(doc_id AS string), '9') AS pub_id, concat(lang, 'ch ', lang, '-', source, ' ', source) AS title,
           cast(DATE '2000-01-01' + cast(doc_id % 60 AS int) AS string) AS pub_date, CASE doc_id % 3 WHEN 0 THEN 'PDF' ELSE 'XLSX' END AS file_type, doc_id AS page_pos
    FROM {documents}"""


@query("r9_attach_download_urls", sql(f"""
    SELECT query_id, pos, b.title, CASE WHEN pub_id IS NOT NULL THEN '{M.DOWNLOAD_URL_PREFIX}' || pub_id END AS download_url
    FROM best_hits b LEFT JOIN ({_BEST.format(order='score DESC, page_pos', where='')}) m ON m.title = b.title""",
    doc_catalogue=_DOC_CATALOGUE.replace("{documents}", "documents").replace("AS string", "AS varchar"),
    **_matching("doc_passages", "doc_catalogue"), **core_ctes("questions", "doc_passages", 10)))
def attach_download_urls(d: Inputs) -> DataFrame:
    publications = d.spark.sql(_DOC_CATALOGUE, documents=d.documents)
    best = ranked_passages(d.questions, d.doc_passages, 10)
    linked = catalogue.attach_download_urls(best, publications, matcher=catalogue.match_publications)
    return linked.select("query_id", F.col("pos").cast("bigint").alias("pos"), "title", "download_url")


# --- state -----------------------------------------------------------------------------------------


_VERSIONS = """
    SELECT doc_id, source_uri, cast(1 AS bigint) AS ingest_seq, 'first' AS text FROM {graph_docs}
    UNION ALL SELECT doc_id, source_uri, cast(2 + o_orderkey % 3 AS bigint), o_orderpriority FROM {graph_docs} WHERE o_orderstatus <> 'F'
    UNION ALL SELECT doc_id, source_uri, cast(9 AS bigint), 'last' FROM {graph_docs} WHERE o_orderstatus = 'P'"""


@query("t3_latest_by_id", sql("""
    SELECT doc_id, source_uri, CASE o_orderstatus WHEN 'F' THEN 'first' WHEN 'P' THEN 'last' ELSE o_orderpriority END AS text,
           cast(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 9 ELSE 2 + o_orderkey % 3 END AS bigint) AS ingest_seq
    FROM graph_docs"""))
def latest_by_id(d: Inputs) -> DataFrame:
    return documents.latest_by_id(d.spark.sql(_VERSIONS, graph_docs=d.graph_docs))


@query("j6_pending_extractions", sql("SELECT doc_id FROM graph_docs WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'"))
def pending_extractions(d: Inputs) -> DataFrame:
    done = extraction_records(d).join(d.graph_docs.filter("o_orderstatus = 'F'").select("doc_id"), "doc_id", "left_semi")
    allowed = d.graph_docs.filter("o_orderpriority <> '5-LOW'").select("source_uri")
    return documents.pending_extractions(document_records(d), done, allowed).select("doc_id")


@query("j7_retrieval_coverage", sql("""
    SELECT count(*) AS checked, cast(count_if(o_orderkey % 7 <> 0) AS bigint) AS matched FROM lineitem JOIN graph_docs ON o_orderkey = l_orderkey WHERE l_linenumber <> 3"""))
def retrieval_coverage(d: Inputs) -> DataFrame:
    hits = d.lineitem.join(d.graph_docs, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(F.col("l_linenumber") == 3, None).when(F.col("o_orderkey") % 7 == 0, F.concat("source_uri", F.lit(".old"))).otherwise(
            F.col("source_uri")).alias("uri"))
    return documents.retrieval_coverage(hits, document_records(d))


@query("j8_endpoint_coverage", sql("""
    SELECT doc_id, count(*) AS endpoints, cast(count_if(label IN (SELECT r_name FROM region)) AS bigint) AS missing FROM (
        SELECT doc_id, s AS label FROM facts UNION SELECT doc_id, o FROM facts) e GROUP BY doc_id"""))
def endpoint_coverage(d: Inputs) -> DataFrame:
    return documents.endpoint_coverage(extraction_records(d)).select(
        "doc_id", F.col("endpoints").cast("bigint").alias("endpoints"), F.col("missing").cast("bigint").alias("missing"))


@query("a1_summarize_by_extension", sql(r"""
    SELECT coalesce(nullif(e, ''), '(none)') AS extension, count(*) AS objects, cast(sum(size) AS bigint) AS bytes
    FROM (SELECT lower(regexp_extract(key, '\.([^./]+)$', 1)) AS e, size FROM objects) t GROUP BY 1
    UNION ALL SELECT '(total)', count(*), cast(sum(size) AS bigint) FROM objects"""))
def summarize_by_extension(d: Inputs) -> DataFrame:
    return documents.summarize_by_extension(_listing(d))


@query("a13_build_summary", sql("""
    SELECT (SELECT count(*) FROM graph_docs) AS documents, (SELECT cast(count_if(content_type = 'application/pdf' AND trim(text) = '') AS bigint) FROM graph_docs) AS pdfs_without_text,
           (SELECT count(DISTINCT doc_id) FROM facts) AS documents_with_extractions, (SELECT count(*) FROM lab) AS label_forms,
           (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM rel) AS relations"""))
def build_summary(d: Inputs) -> DataFrame:
    extractions = stored(d, "extractions", lambda: extraction_records(d))
    return documents.build_summary(document_records(d), extractions)


# --- extraction ----------------------------------------------------------------------------------------


def _text_documents(d: Inputs) -> DataFrame:
    return d.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


@query("u1_gazetteer", sql(r"""
    SELECT cast(doc_id AS varchar) AS doc_id, word AS label, count(*) AS mentions
    FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents) t
    WHERE word IN (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) FROM benchmark) GROUP BY ALL"""))
def gazetteer(d: Inputs) -> DataFrame:
    from beleg.functions.text import tokens
    from beleg.operators.extraction import gazetteer_mentions

    words = d.benchmark.select(F.explode(tokens(F.col("text"))).alias("label")).distinct()
    found = gazetteer_mentions(_text_documents(d), words)
    return found.groupBy("doc_id", "label").agg(F.count("*").alias("mentions"))


@query("u1b_extract_with_gazetteer", r"""
    WITH vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS label FROM benchmark),
    docs AS (SELECT cast(doc_id AS varchar) AS doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents WHERE trim(text) <> ''),
    m AS (SELECT doc_id, label, pos FROM (SELECT doc_id, unnest(t) AS label, generate_subscripts(t, 1) AS pos FROM docs) w WHERE label IN (SELECT label FROM vocabulary)),
    counted AS (SELECT doc_id, string_agg(label || '=' || n, ';' ORDER BY label) AS counts, string_agg(label, ';' ORDER BY label) AS entities
                FROM (SELECT doc_id, label, count(*) AS n FROM m GROUP BY ALL) c GROUP BY doc_id),
    steps AS (SELECT DISTINCT doc_id, label AS s, nx AS o FROM (SELECT *, lead(label) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM m) l WHERE nx <> label),
    related AS (SELECT doc_id, string_agg(s || '>' || o, ';' ORDER BY s, o) AS relations FROM steps GROUP BY doc_id)
    SELECT doc_id, md5(coalesce(entities, '')) AS entities, md5(coalesce(relations, '')) AS relations, md5(coalesce(counts, '')) AS counted
    FROM docs LEFT JOIN counted USING (doc_id) LEFT JOIN related USING (doc_id)""")
def extract_gazetteer(d: Inputs) -> DataFrame:
    from beleg.functions.text import tokens

    words = d.benchmark.select(F.explode(tokens(F.col("text"))).alias("label")).distinct()
    found = extract_with_gazetteer(_text_documents(d), words)
    relations = F.transform("relations", lambda r: F.concat(r["s"], F.lit(">"), r["o"]))
    return found.select("doc_id", F.md5(listed(F.array_sort("entities"))).alias("entities"), F.md5(F.array_join(relations, ";")).alias("relations"),
                        F.md5(sorted_map(F.col("mention_counts"))).alias("counted"))


@query("u1c_extract_with_function", sql(r"""
    SELECT cast(doc_id AS varchar) AS doc_id, count(DISTINCT word) AS entities
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]{5,}\b')) AS word FROM documents WHERE trim(text) <> '') t GROUP BY doc_id
    UNION ALL SELECT cast(doc_id AS varchar), 0 FROM documents WHERE trim(text) <> '' AND NOT regexp_matches(text, '\b[A-Z][a-z]{5,}\b')"""))
def extract_function(d: Inputs) -> DataFrame:
    import re

    word = re.compile(r"\b[A-Z][a-z]{5,}\b", re.ASCII)
    found = extract_with(_text_documents(d), lambda text: (set(word.findall(text)), set()), "capitalised words")
    return found.select("doc_id", F.size("entities").cast("bigint").alias("entities"))
