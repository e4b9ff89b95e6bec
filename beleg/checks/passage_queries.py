"""Queries over passages, charts, ranking and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beleg.checks.fixtures import Inputs
from beleg.checks.oracle_parts import bm25, sql
from beleg.checks.registry import listed, query, stored
from beleg.functions import markers as M
from beleg.operators import annotate, charts, ranking, retrieval
from beleg.operators.documents import chunk_documents
from beleg.plans import search as plans
from beleg.session import shared_dir
from beleg.sources import hits as hit_sources, postings

KEY = ("query_id", "rank")


# --- annotation ---------------------------------------------------------------------


@query("p1_document_name", sql(r"""
    SELECT doc_key, nullif(regexp_extract(title, '(?i)^(\d{4}-\d{2}-\d{2})_(.+)\.pdf$', 1), '') AS published_at,
           replace(nullif(regexp_extract(title, '(?i)^(\d{4}-\d{2}-\d{2})_(.+)\.pdf$', 2), ''), '-', ' ') AS slug
    FROM odd_docnames"""))
def document_name(d: Inputs) -> DataFrame:
    return annotate.with_document_name(d.odd_docnames).select("doc_key", "published_at", "slug")


def _re2(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''")


def _basis_sql(text: str, basis: str) -> str:
    found = ", ".join(f"nullif(regexp_extract(replace({text}, '_', ' '), '{_re2(p)}'), '')" for p in M.BASIS_PATTERNS[basis])
    return f"'{basis}=' || regexp_replace(coalesce({found}), '\\s+', ' ', 'g')"


def bases_sql(text: str) -> str:
    return "array_to_string(list_filter([" + ", ".join(_basis_sql(text, b) for b in M.BASIS_PATTERNS) + "], lambda x: x IS NOT NULL), ';')"


@query("p2_bases", sql(f"SELECT query_id, rank, {bases_sql('text')} AS bases FROM passages"))
def bases(d: Inputs) -> DataFrame:
    return annotate.with_bases(d.passages).select(*KEY, listed(F.col("bases"), "basis", "evidence").alias("bases"))


YEARS_SQL = r"""list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(
    regexp_replace(regexp_replace(regexp_replace(text, '(?i)(Energiestrategie|Energieperspektiven|Perspektiven|Strategie|Szenarien|Szenario|Programm|Agenda)\s+\d{4}\+?', ' ', 'g'),
        '\d+[''.]\d+', 'x', 'g'), '\d{4}\s*(MW|MWp|MWh|GW|GWh|kW|kWh|TW|TWh|TJ|GJ|PJ|MJ|m2|km2)\b', 'x', 'g'),
    '(1[89]\d{2}|20\d{2}|21\d{2})'), lambda y: cast(y AS int)), lambda y: y BETWEEN 1900 AND 2100)))"""


@query("p3_years_covered", sql(f"""
    SELECT query_id, rank, list_min(y) AS min_year, list_max(y) AS max_year, array_to_string(y, ';') AS years
    FROM (SELECT query_id, rank, {YEARS_SQL} AS y FROM passages) t WHERE len(y) > 0"""))
def years_covered(d: Inputs) -> DataFrame:
    covered = annotate.with_years_covered(d.passages).filter(F.col("years_covered").isNotNull())
    return covered.select(*KEY, F.col("years_covered.min").alias("min_year"), F.col("years_covered.max").alias("max_year"),
                          listed(F.col("years_covered.years")).alias("years"))


REASONS_SQL = rf"""list_filter([
    CASE WHEN regexp_matches(trim(text), '^\s*</\w+>') THEN '{M.REASON_ORPHAN_TAG}' END,
    CASE WHEN len(string_split(text, '<data>')) <> len(string_split(text, '</data>')) THEN '{M.REASON_UNBALANCED}' END,
    CASE WHEN regexp_matches(trim(text), '[:,=~]\s*$|[-–]\s*$') THEN '{M.REASON_DANGLING}'
         WHEN NOT regexp_matches(trim(text), '(?:>|[.!?%"'')\]]|\d)\s*$') THEN '{M.REASON_MID_TOKEN}' END], lambda x: x IS NOT NULL)"""


@query("p4_truncation", sql(f"""
    SELECT query_id, rank, len(r) > 0 AS is_truncated, array_to_string(r, ';') AS reasons
    FROM (SELECT query_id, rank, {REASONS_SQL} AS r FROM passages) t"""))
def truncation(d: Inputs) -> DataFrame:
    return annotate.with_truncation(d.passages).select(*KEY, "is_truncated", listed(F.col("truncation_reasons")).alias("reasons"))


@query("p5_projection", sql(f"SELECT query_id, rank, regexp_matches(text, '{_re2(M.PROJECTION)}') AS is_projection FROM passages"))
def projection(d: Inputs) -> DataFrame:
    return annotate.with_projection_flag(d.passages).select(*KEY, "is_projection")


# --- charts --------------------------------------------------------------------------


def _parsed(d: Inputs) -> DataFrame:
    return charts.charts_from_passages(d.chart_blocks)


_BODY = "trim(replace(replace(regexp_extract(text, '<data>(.*)$', 1), '</data>', ''), '<data>', ''))"


@query("c1_extract_blocks", sql(f"""
    SELECT k, 0 AS block_pos, NOT contains(text, '</data>') AS is_truncated, {_BODY} AS raw_block FROM chart_blocks"""))
def chart_blocks(d: Inputs) -> DataFrame:
    return charts.extract_blocks(d.chart_blocks).select("k", "block_pos", "is_truncated", "raw_block")


@query("c2_extract_title", sql("SELECT k, 'Series ' || k AS title FROM chart_blocks"))
def chart_title(d: Inputs) -> DataFrame:
    return charts.extract_title(d.chart_blocks).select("k", "title")


@query("c3_split_block", sql("""
    SELECT k, CASE WHEN k % 5 = 0 THEN 'Year;Value' ELSE 'Year;newly installed (MW);Stromproduktion (GWh)' END AS columns,
           CASE WHEN k % 3 = 0 THEN 'Note: values are estimated' END AS note, count(*) AS n_rows
    FROM yearly GROUP BY k"""))
def split_block(d: Inputs) -> DataFrame:
    found = charts.split_block(charts.extract_blocks(d.chart_blocks))
    return found.select("k", listed(F.col("columns")).alias("columns"), "note", F.size("row_texts").cast("bigint").alias("n_rows"))


_CELLS = """
    cells AS MATERIALIZED (
        SELECT k, yr, row_number() OVER (PARTITION BY k ORDER BY yr) - 1 AS row_idx, col_idx, raw, low, high FROM (
            SELECT k, yr, 0 AS col_idx, cast(yr AS varchar) AS raw, yr AS low, yr AS high FROM yearly
        ) UNION ALL
        SELECT k, yr, row_number() OVER (PARTITION BY k ORDER BY yr) - 1, 1, CASE WHEN k % 4 >= 2 THEN (100000 + n) || '-' || (100005 + n) ELSE cast(100000 + n AS varchar) END,
               100000 + n, CASE WHEN k % 4 >= 2 THEN 100005 + n ELSE 100000 + n END FROM yearly WHERE k % 5 <> 0
        UNION ALL
        SELECT k, yr, row_number() OVER (PARTITION BY k ORDER BY yr) - 1, CASE WHEN k % 5 = 0 THEN 1 ELSE 2 END,
               CASE WHEN k % 4 = 3 THEN total || ' - ' || (total + 9) ELSE cast(total AS varchar) END,
               total, CASE WHEN k % 4 = 3 THEN total + 9 ELSE total END FROM yearly)"""


def _cells(final: str) -> str:
    text = sql("SELECT 1 FROM yearly")
    head = text[: text.rindex("SELECT 1 FROM yearly")].rstrip()
    return f"{head},\n{_CELLS}\n{final}"


@query("c4_split_rows", _cells("SELECT k, row_idx, col_idx, raw FROM cells"))
def split_rows(d: Inputs) -> DataFrame:
    rows = charts.split_rows(charts.split_block(charts.extract_blocks(d.chart_blocks)))
    return charts.chart_cells(rows, "k").select(
        "k", F.col("row_idx").cast("bigint").alias("row_idx"), "col_idx", "raw"
    )


@query("c5_classify_cells", _cells("""
    SELECT k, row_idx, col_idx, CASE WHEN low = high THEN cast(low AS double) END AS value,
           CASE WHEN low <> high THEN cast(low AS double) END AS min, CASE WHEN low <> high THEN cast(high AS double) END AS max,
           CASE WHEN low = high THEN 'exact' ELSE 'range' END AS kind FROM cells"""))
def classify_cells(d: Inputs) -> DataFrame:
    cells = charts.chart_cells(_parsed(d), "k")
    return cells.select("k", F.col("row_idx").cast("bigint").alias("row_idx"), "col_idx", "value", "min", "max", "kind")


PRECISION_SQL = """CASE WHEN bool_and(low = high) THEN CASE WHEN k % 3 = 0 THEN 'estimated' ELSE 'exact' END
    WHEN bool_and(low <> high) THEN 'estimated' ELSE 'mixed' END"""


@query("c6_chart_precision", _cells(f"""
    SELECT k, {PRECISION_SQL} AS precision, {PRECISION_SQL} <> 'exact' AS is_estimate FROM cells WHERE col_idx > 0 GROUP BY k"""))
def chart_precision(d: Inputs) -> DataFrame:
    return _parsed(d).select("k", "precision", "is_estimate")


@query("c7_column_bases", sql("""
    SELECT DISTINCT k, 'Year' AS column_name, '' AS bases FROM yearly
    UNION ALL SELECT DISTINCT k, 'Value', 'sales=Verkauf' FROM yearly WHERE k % 5 = 0
    UNION ALL SELECT DISTINCT k, 'newly installed (MW)', 'installed_annual=newly installed' FROM yearly WHERE k % 5 <> 0
    UNION ALL SELECT DISTINCT k, 'Stromproduktion (GWh)', 'production=Stromproduktion' FROM yearly WHERE k % 5 <> 0"""))
def column_bases(d: Inputs) -> DataFrame:
    return _parsed(d).select("k", F.explode("column_bases").alias("column_name", "b")).select(
        "k", "column_name", listed(F.col("b"), "basis", "evidence").alias("bases")
    )


@query("c8_years_from_rows", sql("""
    SELECT k, min(yr) AS min_year, max(yr) AS max_year, string_agg(cast(yr AS varchar), ';' ORDER BY yr) AS years FROM yearly GROUP BY k"""))
def years_from_rows(d: Inputs) -> DataFrame:
    y = F.col("years_covered")
    return _parsed(d).select("k", y["min"].alias("min_year"), y["max"].alias("max_year"), listed(y["years"]).alias("years"))


@query("p6_extraction_method", sql("""
    SELECT k, CASE WHEN k % 4 = 3 OR k % 3 = 0 AND (k % 5 = 0 OR k % 4 < 2) OR k % 5 <> 0 AND k % 4 = 3 THEN 'chart_visual_read' END AS extraction_method
    FROM chart_blocks"""))
def extraction_method(d: Inputs) -> DataFrame:
    return annotate.with_extraction_method(charts.with_precision(charts.split_rows(charts.split_block(
        charts.extract_blocks(d.chart_blocks))))).select("k", "extraction_method")


# --- source records and projections ----------------------------------------------------


def _sourced(passages: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("string")
    record = hit_sources.source_record(F.col("title"), F.lit("PDF"), F.lit("de"), F.col("media_type"), nothing, nothing)
    return passages.withColumn("source", record)


SOURCE_SQL = """'{"title":"' || title || '","published_at":"' || substring(title, 1, 10) || '","download_url":null'
    || CASE WHEN media_type IS NULL THEN '' ELSE ',"media_type":"' || media_type || '"' END || '}'"""


@query("p7_project_source", sql(f"SELECT query_id, rank, {SOURCE_SQL} AS source_json FROM passages"))
def project_source(d: Inputs) -> DataFrame:
    return ranking.with_source_json(_sourced(d.passages)).select(*KEY, "source_json")


@query("p7b_project_source_all", sql("""
    SELECT query_id, rank, '{"title":"' || title || '","published_at":"' || substring(title, 1, 10) || '","download_url":null,"file_type":"PDF","language":"de","media_type":'
        || CASE WHEN media_type IS NULL THEN 'null' ELSE '"' || media_type || '"' END || ',"created_at":null,"last_updated_at":null}' AS source_json
    FROM passages"""))
def project_source_all(d: Inputs) -> DataFrame:
    return ranking.with_source_json(_sourced(d.passages), source_fields="all").select(*KEY, "source_json")


@query("p8_project_passages", sql("SELECT query_id, rank, score, title, media_type, queried_year FROM passages"))
def project_passages(d: Inputs) -> DataFrame:
    return annotate.project_passages(d.passages, "index")


@query("p9_mention_count", sql(r"""
    SELECT doc_id, label, cast(len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: w = label)) AS bigint) AS mentions
    FROM documents, (SELECT unnest(['the', 'de', 'la', 'und', 'non']) AS label) l"""))
def mention_count(d: Inputs) -> DataFrame:
    labels = F.array(*(F.lit(x) for x in ("the", "de", "la", "und", "non")))
    counted = annotate.with_mention_counts(d.documents.withColumn("labels", labels))
    return counted.select("doc_id", F.explode("mention_counts").alias("label", "mentions"))


@query("p18_chunk_documents", sql(r"""
    SELECT doc_id, chunk_no, len(piece) AS chars, md5(piece) AS digest FROM pieces WHERE piece <> ''""", recursive=True, pieces=r"""
        SELECT doc_id, -1 AS chunk_no, '' AS piece, text AS rest FROM documents
        UNION ALL
        SELECT doc_id, chunk_no + 1, substring(rest, 1, size), substring(rest, size + 1)
        FROM (SELECT doc_id, chunk_no, rest,
                     CASE WHEN len(rest) <= 5000 THEN len(rest)
                          WHEN regexp_matches(substring(rest, 1, 5000), '(?s)[.!?]\s') THEN len(regexp_extract(substring(rest, 1, 5000), '(?s)^.*[.!?]\s'))
                          ELSE 5000 END AS size
              FROM pieces WHERE rest <> '') cut"""))
def chunked(d: Inputs) -> DataFrame:
    return chunk_documents(d.documents).select(
        "doc_id", "chunk_no", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest")
    )


# --- ranking ----------------------------------------------------------------------------


@query("r2_rank_hits", sql("""
    SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, coalesce(title, ''), rank) AS pos FROM passages"""))
def rank_hits(d: Inputs) -> DataFrame:
    return ranking.rank_hits(d.passages).select(*KEY, F.col("pos").cast("bigint").alias("pos"))


DEDUPE_SQL = """
    SELECT query_id, min(rank) AS pos, arg_max(score, (score, -rank)) AS score, arg_max(title, (score, -rank)) AS title,
           array_to_string(list_sort(list(DISTINCT queried_year)), ';') AS queried_years
    FROM passages GROUP BY query_id, trim(regexp_replace(text, '\\s+', ' ', 'g'))"""


@query("r3_dedupe", sql(DEDUPE_SQL))
def dedupe(d: Inputs) -> DataFrame:
    kept = ranking.dedupe(d.passages, pos="rank", queried_year="queried_year")
    return kept.select("query_id", F.col("rank").alias("pos"), "score", "title", listed(F.col("queried_years")).alias("queried_years"))


@query("r10_intern_sources", sql(f"""
    SELECT query_id, rank, 's' || dense_rank() OVER (PARTITION BY query_id ORDER BY first_rank) AS source_id FROM (
        SELECT query_id, rank, min(rank) OVER (PARTITION BY query_id, source_json) AS first_rank
        FROM (SELECT query_id, rank, {SOURCE_SQL} AS source_json FROM passages) s) t"""))
def intern_sources(d: Inputs) -> DataFrame:
    return ranking.intern_sources(ranking.with_source_json(_sourced(d.passages)), pos="rank").select(*KEY, "source_id")


@query("r7_resolve_hit_sources", sql(f"SELECT query_id, rank, {SOURCE_SQL} AS source_json FROM passages"))
def resolve_hit_sources(d: Inputs) -> DataFrame:
    items = ranking.intern_sources(ranking.with_source_json(_sourced(d.passages)), pos="rank")
    return ranking.resolve_hit_sources(items, ranking.sources_of(items)).select(*KEY, "source_json")


# --- retrieval ----------------------------------------------------------------------------


@query("r1_retrieve_bm25", sql(f"SELECT query_id, passage_id, rank, round(score, 6) AS score FROM ({bm25('questions', 'doc_passages')}) b"))
def retrieve(d: Inputs) -> DataFrame:
    return retrieval.retrieve(d.questions, d.doc_passages).select(
        "query_id", "passage_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score")
    )


_INDEXES: dict[tuple[str, str, str], postings.Postings] = {}


def indexed(d: Inputs, passages: str) -> postings.Postings:
    """The index of a passage table, written once per session and data folder as an index is written once per corpus."""
    key = (d.spark.sparkContext.applicationId, d.folder, passages)
    if key not in _INDEXES:
        _INDEXES[key] = postings.write_postings(getattr(d, passages), shared_dir(d.spark, f"index-{passages}"))
    return _INDEXES[key]


@query("r1c_retrieve_indexed", sql(f"SELECT query_id, passage_id, rank, round(score, 6) AS score FROM ({bm25('questions', 'doc_passages')}) b"))
def retrieve_indexed(d: Inputs) -> DataFrame:
    found = postings.retrieve_indexed(d.questions, indexed(d, "doc_passages"))
    return found.select("query_id", "passage_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


@query("r1d_write_index", sql(r"""
    SELECT token, count(*) AS df, cast(sum(tf) AS bigint) AS occurrences FROM (
        SELECT passage_id, unnest(w) AS token, count(*) AS tf FROM (SELECT passage_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM doc_passages) x GROUP BY 1, 2) t
    GROUP BY token"""))
def write_index(d: Inputs) -> DataFrame:
    """Writes an index anew and reads its words back: documents and occurrences of each."""
    index = postings.write_postings(d.doc_passages, shared_dir(d.spark, "index"))
    uses = index.postings.select("token", F.explode("tfs").alias("tf")).groupBy("token").agg(F.sum("tf").alias("occurrences"))
    return index.words.join(uses, "token").select("token", "df", "occurrences")


@query("r1b_vector_top_k", """
    WITH dims AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
    centres AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(cast(x AS double)) AS m FROM dims GROUP BY label, i) t GROUP BY label)
    SELECT query_id, vec_id, rank, score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
            SELECT label AS query_id, vec_id, round(list_cosine_similarity(c, cast(embedding AS double[])), 6) AS score
            FROM (SELECT vec_id, embedding FROM embeddings) e, centres) s) r
    WHERE rank <= 50""")
def vector_top_k(d: Inputs) -> DataFrame:
    dims = d.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda v: v["m"]).alias("embedding")
    )
    found = retrieval.vector_top_k(centres, d.embeddings)
    return found.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), "score")


RANKED_SQL = """
    SELECT b.query_id, b.passage_id, b.score, p.text, p.title, p.media_type,
           row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, coalesce(p.title, ''), b.rank) AS pos
    FROM ({hits}) b JOIN {passages} p USING (passage_id)"""

UNIQUE_SQL = """
    SELECT query_id, min(pos) AS first_pos, arg_max(passage_id, (score, -pos)) AS passage_id, max(score) AS score,
           arg_max(title, (score, -pos)) AS title, arg_max_null(media_type, (score, -pos)) AS media_type, arg_max(text, (score, -pos)) AS text
    FROM {ranked} GROUP BY query_id, trim(regexp_replace(text, '\\s+', ' ', 'g'))"""

LIMIT_SQL = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_pos) AS pos FROM {unique_rows}) t WHERE pos <= {n}"""


def core_ctes(questions: str, passages: str, limit: int) -> dict[str, str]:
    return {
        "ranked_hits": RANKED_SQL.format(hits=bm25(questions, passages), passages=passages),
        "unique_hits": UNIQUE_SQL.format(ranked="ranked_hits"),
        "best_hits": LIMIT_SQL.format(unique_rows="unique_hits", n=limit),
    }


INTERNED_SQL = """SELECT *, 's' || dense_rank() OVER (PARTITION BY {scope} ORDER BY first_seen) AS source_id FROM (
    SELECT *, min(pos) OVER (PARTITION BY {scope}, title, media_type) AS first_seen FROM {rows}) i"""


@query("r4_search", sql(f"SELECT query_id, pos, passage_id, round(score, 6) AS score, source_id, len({YEARS_SQL}) AS n_years FROM ({INTERNED_SQL.format(scope='query_id', rows='best_hits')}) x",
                        **core_ctes("questions", "doc_passages", 10)))
def search(d: Inputs) -> DataFrame:
    found = plans.search(d.questions, d.doc_passages, index=indexed(d, "doc_passages")).items
    years = F.coalesce(F.size("years_covered.years"), F.lit(0))
    return found.select("query_id", F.col("pos").cast("bigint").alias("pos"), "passage_id", F.round("score", 6).alias("score"), "source_id",
                        F.when(F.col("years_covered").isNull(), 0).otherwise(years).cast("bigint").alias("n_years"))


@query("r4b_search_summary", sql("""
    SELECT q.query_id, cast(coalesce(n, 0) AS bigint) AS result_count
    FROM (SELECT query_id FROM questions UNION ALL SELECT 'none|' || query_id FROM questions) q
    LEFT JOIN (SELECT cast(query_id AS varchar) AS query_id, count(*) AS n FROM best_hits GROUP BY 1) b ON cast(q.query_id AS varchar) = b.query_id""", **core_ctes("questions", "doc_passages", 10)))
def search_summary(d: Inputs) -> DataFrame:
    """Questions without a hit are answered with 0."""
    nobody = d.questions.select(F.concat(F.lit("none|"), "query_id").alias("query_id"), F.lit("zzqqxx").alias("question"))
    asked = d.questions.select(F.col("query_id").cast("string").alias("query_id"), "question").unionByName(nobody)
    return plans.search(asked, d.doc_passages).summary


REQUESTS = """SELECT r_regionkey AS request_id, CASE r_regionkey % 3 WHEN 0 THEN 'Zubau' WHEN 1 THEN 'Verkauf' ELSE 'Total Leistung' END AS metric,
    1994 + r_regionkey AS start_year, 1998 AS end_year FROM {region} """
TIMELINE_QUERIES = """SELECT request_id || '|' || year AS query_id, request_id, year, start_year, metric || ' ' || year AS question
    FROM (SELECT *, unnest(generate_series(start_year, end_year)) AS year FROM requests) y"""


@query("r5_timeline", sql(f"SELECT request_id, pos, text_digest, score, queried_years, source_id FROM ({INTERNED_SQL.format(scope='request_id', rows='merged_years')}) x",
                          requests=REQUESTS.replace("{region}", "region"), year_questions=TIMELINE_QUERIES,
                          **core_ctes("year_questions", "line_passages", 3),
                          merged_years="""
    SELECT request_id, min(p) AS pos, md5(arg_max(text, (score, -p))) AS text_digest, max(score) AS score, arg_max(title, (score, -p)) AS title,
           arg_max_null(media_type, (score, -p)) AS media_type, array_to_string(list_sort(list(DISTINCT year)), ';') AS queried_years
    FROM (SELECT b.*, request_id, year, (year - start_year) * 3 + pos AS p FROM best_hits b JOIN year_questions USING (query_id)) t
    GROUP BY request_id, trim(regexp_replace(text, '\\s+', ' ', 'g'))"""))
def timeline(d: Inputs) -> DataFrame:
    requests = d.spark.sql(REQUESTS, region=d.region)
    found = plans.timeline(requests, d.line_passages, detail="full", index=indexed(d, "line_passages")).items
    return found.select("request_id", F.col("pos").cast("bigint").alias("pos"), F.md5("text").alias("text_digest"), "score",
                        listed(F.col("queried_years")).alias("queried_years"), "source_id")


@query("r5b_timeline_summary", sql("""
    SELECT request_id, count(DISTINCT trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS result_count,
           count(*) - count(DISTINCT trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS duplicates_collapsed
    FROM best_hits JOIN year_questions USING (query_id) GROUP BY request_id""",
    requests=REQUESTS.replace("{region}", "region"), year_questions=TIMELINE_QUERIES, **core_ctes("year_questions", "line_passages", 3)))
def timeline_summary(d: Inputs) -> DataFrame:
    """The passages are numbered and written once, as a corpus is stored before it is searched: a search reads them three times."""
    return plans.timeline(d.spark.sql(REQUESTS, region=d.region), stored(d, "line_passages", lambda: d.line_passages)).summary


@query("r6_rerank", sql(r"""
    SELECT query_id, passage_id, rerank_score, rerank_pos FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rerank_pos FROM (
            SELECT b.query_id, b.passage_id, b.rank, round(len(list_intersect(q.w, list_distinct(regexp_extract_all(lower(p.text), '[\p{L}\p{N}]+')))) / len(q.w), 6) AS rerank_score
            FROM top_hits b JOIN doc_passages p USING (passage_id)
            JOIN (SELECT query_id, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}]+')) AS w FROM questions) q USING (query_id)
            WHERE p.text <> '') s) r WHERE rerank_pos <= 2""", top_hits=bm25("questions", "doc_passages")))
def rerank(d: Inputs) -> DataFrame:
    hits = retrieval.retrieve(d.questions, d.doc_passages).join(d.doc_passages, "passage_id").join(d.questions, "query_id")
    best = ranking.rerank(hits, 2, pos="rank")
    return best.select("query_id", "passage_id", "rerank_score", F.col("rerank_pos").cast("bigint").alias("rerank_pos"))


TOPICS = "SELECT k AS topic_id, 'Stromproduktion Series ' || k AS topic FROM chart_blocks"
PROBES = """SELECT topic_id || '|' || probe AS query_id, topic_id, probe, replace(template, '{{topic}}', topic) AS question
    FROM topics, (SELECT unnest(generate_series(0, 4)) AS probe, unnest([{templates}]) AS template) t""".format(
    templates=", ".join(f"'{t}'" for t in M.PROBE_TEMPLATES))
POOLED = """
    SELECT topic_id, min(p) AS pos, arg_max(passage_id, (score, -p)) AS passage_id, max(score) AS score, arg_max(title, (score, -p)) AS title,
           arg_max(text, (score, -p)) AS text
    FROM (SELECT b.*, topic_id, probe * 25 + pos AS p FROM best_hits b JOIN probes USING (query_id)) t
    GROUP BY topic_id, trim(regexp_replace(text, '\\s+', ' ', 'g'))"""


def _topics(d: Inputs) -> DataFrame:
    return d.chart_blocks.select(F.col("k").alias("topic_id"), F.concat(F.lit("Stromproduktion Series "), F.col("k").cast("string")).alias("topic"))


@query("r8_probe_pool", sql("SELECT topic_id, pos, passage_id, score, title FROM pooled", topics=TOPICS, probes=PROBES, pooled=POOLED,
                            **core_ctes("probes", "chart_passages", 25)))
def probe_pool(d: Inputs) -> DataFrame:
    pool = plans.probe_pool(_topics(d), d.chart_passages)
    return pool.select("topic_id", F.col("pos").cast("bigint").alias("pos"), "passage_id", "score", "title")


@query("c9_get_charts", sql(f"""
    SELECT topic_id, pos, passage_id, score, source_id, n_rows FROM (
        SELECT *, 's' || dense_rank() OVER (PARTITION BY topic_id ORDER BY first_seen) AS source_id FROM (
            SELECT c.*, min(pos) OVER (PARTITION BY topic_id, title) AS first_seen FROM (
                SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, pool_pos) AS pos FROM (
                    SELECT topic_id, pos AS pool_pos, passage_id, score, title, n_rows FROM pooled
                    JOIN (SELECT k, count(*) AS n_rows FROM yearly GROUP BY k) y ON y.k = passage_id % 1000) a) c
            WHERE pos <= 5) e) f""", topics=TOPICS, probes=PROBES, pooled=POOLED, **core_ctes("probes", "chart_passages", 25)))
def get_charts(d: Inputs) -> DataFrame:
    found = plans.get_charts(_topics(d), d.chart_passages).items
    return found.select("topic_id", F.col("pos").cast("bigint").alias("pos"), "passage_id", "score", "source_id",
                        F.col("row_count").cast("bigint").alias("n_rows"))


# --- raw hits ---------------------------------------------------------------------------------


@query("s13_flatten_hits", sql("""
    SELECT query_id, rank, score, text, title, substring(title, 1, 10) AS published_at, media_type, 'PDF' AS file_type FROM passages"""))
def flatten_hits(d: Inputs) -> DataFrame:
    raw = d.passages.select("query_id", "rank", F.to_json(F.struct(
        "score", F.struct("text").alias("content"),
        F.struct(F.col("title").alias("_document_title"), F.lit("PDF").alias("_file_type"), F.col("media_type").alias("_media_type")).alias("metadata"),
    )).alias("json"))
    flat = hit_sources.flatten_hits(raw, "json")
    return flat.select("query_id", "rank", "score", "text", *(F.col(f"source.{c}").alias(c) for c in ("title", "published_at", "media_type", "file_type")))
