"""CTEs shared by several oracles, in DuckDB's dialect, written independently of the operators."""

from __future__ import annotations

from beleg.checks.fixtures import BASE, CONTENT_HASH, GLOSSARY, MODEL, TERMS, VOCAB, with_fixtures

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"


def _rows(source: str, *triples: str) -> str:
    return "\nUNION ALL\n".join(f"SELECT {t} FROM {source}" for t in triples)


def _iri(s: str, p: str, o: str) -> str:
    return f"{s} AS s, '{p}' AS p, {o} AS o, 'iri' AS o_kind, NULL::varchar AS o_type"


def _lit(s: str, p: str, o: str, kind: str = "string") -> str:
    return f"{s} AS s, '{p}' AS p, cast({o} AS varchar) AS o, 'literal' AS o_kind, '{XSD}{kind}' AS o_type"


B = BASE
PARTS: dict[str, str] = {
    "ent": """SELECT doc_id, substring(sha256(doc_id || '|' || lower(trim(label))), 1, 16) AS eid, min(label) AS label, arg_min(n, label) AS n
        FROM named GROUP BY 1, 2""",
    "lab": "SELECT substring(sha256(lower(trim(label))), 1, 16) AS lid, min(label) AS label_text FROM named GROUP BY 1",
    "rel": """SELECT DISTINCT f.doc_id,
            substring(sha256(f.doc_id || '|' || lower(trim(s)) || '|' || lower(trim(p)) || '|' || lower(trim(o))), 1, 16) AS aid,
            substring(sha256(f.doc_id || '|' || lower(trim(s))), 1, 16) AS sid, substring(sha256(f.doc_id || '|' || lower(trim(o))), 1, 16) AS oid,
            regexp_replace(trim(p), '[^A-Za-z0-9]', '_', 'g') AS slug,
            strftime(make_timestamp((1704067200 + o_orderkey) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS extracted
        FROM facts f JOIN graph_docs g ON f.doc_id = g.doc_id""",
    "triples": _rows("graph_docs",
            _iri(f"'{B}doc/' || doc_id", RDF + "type", f"'{B}Document'"),
            _lit(f"'{B}doc/' || doc_id", B + "sourceUri", "source_uri"),
            _lit(f"'{B}doc/' || doc_id", B + "contentType", "content_type"),
            _lit(f"'{B}doc/' || doc_id", B + "sizeBytes", "size_bytes", "integer"),
            _lit(f"'{B}doc/' || doc_id", B + "hasText", "trim(text) <> ''", "boolean"),
            _lit(f"'{B}doc/' || doc_id", B + "textTruncated", "text_truncated", "boolean"),
            _lit(f"'{B}doc/' || doc_id", B + "prop/Priority_Class", "o_orderpriority"),
            _lit(f"'{B}doc/' || doc_id", B + "prop/status", "o_orderstatus"),
            _lit(f"'{B}doc/' || doc_id", B + "prop/cust_key", "o_custkey"))
        + "\nUNION ALL\n" + _rows("lab",
            _iri(f"'{B}label/' || lid", RDF + "type", f"'{B}Label'"),
            _lit(f"'{B}label/' || lid", B + "labelText", "label_text"))
        + "\nUNION ALL\n" + _rows("ent",
            _iri(f"'{B}entity/' || eid", RDF + "type", f"'{B}Entity'"),
            _lit(f"'{B}entity/' || eid", B + "label", "label"),
            _iri(f"'{B}entity/' || eid", B + "hasLabelForm", f"'{B}label/' || substring(sha256(lower(trim(label))), 1, 16)"),
            _iri(f"'{B}doc/' || doc_id", B + "mentions", f"'{B}entity/' || eid"),
            _lit(f"'{B}entity/' || eid", B + "mentionCount", "n", "integer"))
        + f"\nUNION ALL\nSELECT DISTINCT '{B}entity/' || sid, '{B}relprop/' || slug, '{B}entity/' || oid, 'iri', NULL::varchar FROM rel"
        + "\nUNION ALL\n" + _rows("rel",
            _iri(f"'{B}assertion/' || aid", RDF + "type", f"'{B}Assertion'"),
            _iri(f"'{B}assertion/' || aid", RDF + "subject", f"'{B}entity/' || sid"),
            _iri(f"'{B}assertion/' || aid", RDF + "predicate", f"'{B}relprop/' || slug"),
            _iri(f"'{B}assertion/' || aid", RDF + "object", f"'{B}entity/' || oid"),
            _iri(f"'{B}assertion/' || aid", B + "derivedFrom", f"'{B}doc/' || doc_id"),
            _lit(f"'{B}assertion/' || aid", B + "extractionModel", f"'{MODEL}'"),
            _lit(f"'{B}assertion/' || aid", B + "extractedAt", "extracted", "dateTime")),
    # Labels against the vocabulary.
    "resolved": """SELECT lid, label_text,
            CASE WHEN v.key IS NULL THEN 'unresolved' WHEN v.senses IS NOT NULL THEN 'contested' WHEN v.generic THEN 'generic' ELSE 'best' END AS outcome,
            v.slug, v.type, v.senses
        FROM lab LEFT JOIN vocab_alias v ON v.key = lower(trim(label_text))""",
    "preds": """SELECT DISTINCT slug, CASE WHEN lower(slug) IN ('resides_in', 'belongs_to', 'wohnhaft_in') THEN 'located-in' END AS canonical FROM rel""",
    "overlay_label": _rows("resolved",
            _iri(f"'{B}label/' || lid", B + "canonicalTerm", f"'{TERMS}' || slug") ) + " WHERE outcome = 'best'"
        + f"\nUNION ALL\nSELECT '{B}label/' || lid, '{B}matchRule', 'exact', 'literal', '{XSD}string' FROM resolved WHERE outcome = 'best'"
        + f"\nUNION ALL\nSELECT '{B}label/' || lid, '{B}termType', '{VOCAB}' || type, 'iri', NULL FROM resolved WHERE outcome = 'best'"
        + f"\nUNION ALL\nSELECT '{B}label/' || lid, '{B}accordingTo', '{GLOSSARY}', 'iri', NULL FROM resolved WHERE outcome IN ('best', 'contested')"
        + f"\nUNION ALL\nSELECT '{B}label/' || lid, '{B}contestedTerm', '{TERMS}' || unnest(string_split(senses, ',')), 'iri', NULL FROM resolved WHERE outcome = 'contested'",
    "overlay_entity": f"""SELECT '{B}entity/' || eid AS s, '{B}canonicalTerm' AS p, '{TERMS}' || slug AS o, 'iri' AS o_kind, NULL::varchar AS o_type
            FROM ent JOIN resolved r ON r.lid = substring(sha256(lower(trim(label))), 1, 16) WHERE outcome = 'best'
        UNION ALL SELECT '{B}entity/' || eid, '{B}termType', '{VOCAB}' || type, 'iri', NULL
            FROM ent JOIN resolved r ON r.lid = substring(sha256(lower(trim(label))), 1, 16) WHERE outcome = 'best'""",
    "overlay_doc": f"""SELECT '{B}doc/' || doc_id AS s, '{B}publicationDate' AS p, regexp_extract(source_uri, '(\\d{{4}}-\\d\\d-\\d\\d)', 1) AS o, 'literal' AS o_kind, '{XSD}date' AS o_type FROM graph_docs
        UNION ALL SELECT '{B}doc/' || doc_id, '{B}title', 'order no ' || o_orderkey, 'literal', '{XSD}string' FROM graph_docs""",
    "overlay_pred": f"""SELECT '{B}relprop/' || slug AS s, '{B}canonicalPredicate' AS p, '{B}rel/' || canonical AS o, 'iri' AS o_kind, NULL::varchar AS o_type FROM preds WHERE canonical IS NOT NULL
        UNION ALL SELECT '{B}relprop/' || slug, '{B}accordingTo', '{GLOSSARY}', 'iri', NULL FROM preds WHERE canonical IS NOT NULL
        UNION ALL SELECT DISTINCT '{B}rel/' || canonical, '{RDF}type', '{B}ControlledPredicate', 'iri', NULL FROM preds WHERE canonical IS NOT NULL
        UNION ALL SELECT DISTINCT '{B}rel/' || canonical, '{B}definition', 'Where a party is found.', 'literal', '{XSD}string' FROM preds WHERE canonical IS NOT NULL
        UNION ALL SELECT DISTINCT '{B}rel/' || canonical, '{B}inversePredicate', '{B}rel/houses', 'iri', NULL FROM preds WHERE canonical IS NOT NULL
        UNION ALL SELECT DISTINCT '{B}rel/' || canonical, '{B}symmetric', 'false', 'literal', '{XSD}boolean' FROM preds WHERE canonical IS NOT NULL""",
    "overlay_node": f"""SELECT DISTINCT '{GLOSSARY}' AS s, '{RDF}type' AS p, '{B}GlossaryVersion' AS o, 'iri' AS o_kind, NULL::varchar AS o_type FROM vocab_alias
        UNION ALL SELECT DISTINCT '{GLOSSARY}', '{B}contentHash', '{CONTENT_HASH}', 'literal', '{XSD}string' FROM vocab_alias
        UNION ALL SELECT DISTINCT '{GLOSSARY}', '{B}schemaVersion', '1.0', 'literal', '{XSD}string' FROM vocab_alias
        UNION ALL SELECT DISTINCT '{GLOSSARY}', '{B}termIriBase', '{TERMS}', 'literal', '{XSD}string' FROM vocab_alias""",
    "overlay": "SELECT * FROM overlay_node UNION ALL SELECT * FROM overlay_label UNION ALL SELECT * FROM overlay_entity UNION ALL SELECT * FROM overlay_doc UNION ALL SELECT * FROM overlay_pred",
    # Clean, step by step.
    "fold_map": f"SELECT '{B}relprop/' || slug AS old, '{B}rel/' || canonical AS new FROM preds WHERE canonical IS NOT NULL",
    "folded": f"""SELECT DISTINCT t.s, coalesce(a.new, t.p) AS p, CASE WHEN t.p = '{RDF}predicate' THEN coalesce(b.new, t.o) ELSE t.o END AS o, o_kind, o_type
        FROM triples t LEFT JOIN fold_map a ON a.old = t.p LEFT JOIN fold_map b ON b.old = t.o""",
    "grouped": f"""SELECT '{B}entity/' || eid AS entity, n, lid, coalesce('term:' || CASE WHEN outcome = 'best' THEN slug END, 'label:' || lid) AS g
        FROM ent JOIN resolved r ON r.lid = substring(sha256(lower(trim(label))), 1, 16)""",
    "merges": "SELECT g, min(entity) AS canonical, count(*) AS size, cast(sum(n) AS bigint) AS mentions, count(DISTINCT lid) AS labels FROM grouped GROUP BY g HAVING count(*) > 1",
    "moved": "SELECT entity AS old, canonical AS new FROM grouped JOIN merges USING (g) WHERE entity <> canonical",
    "merged": f"""SELECT DISTINCT coalesce(a.new, t.s) AS s, t.p, coalesce(b.new, t.o) AS o, t.o_kind, t.o_type
        FROM folded t LEFT JOIN moved a ON a.old = t.s LEFT JOIN moved b ON b.old = t.o AND t.o_kind = 'iri'
        WHERE NOT (a.old IS NOT NULL AND t.p IN ('{RDF}type', '{B}hasLabelForm', '{B}mentionCount', '{B}label'))
          AND NOT (t.p = '{B}mentionCount' AND t.s IN (SELECT canonical FROM merges))
        UNION ALL SELECT canonical, '{B}mentionCount', cast(mentions AS varchar), 'literal', '{XSD}integer' FROM merges""",
    "zero": f"SELECT s AS entity FROM merged WHERE p = '{B}mentionCount' AND o = '0'",
    "ends": f"SELECT DISTINCT o AS entity FROM merged WHERE p IN ('{RDF}subject', '{RDF}object')",
    "orphans": "SELECT entity FROM zero WHERE entity NOT IN (SELECT entity FROM ends)",
    "cleaned": "SELECT * FROM merged WHERE s NOT IN (SELECT entity FROM orphans) AND o NOT IN (SELECT entity FROM orphans)",
}


def sql(text: str, recursive: bool = False, **ctes: str) -> str:
    return with_fixtures(text, {**PARTS, **ctes}, recursive)


def bm25(questions: str, passages: str, breadth: int = 50) -> str:
    """Top passages of (query_id, question) over (passage_id, text), as one SELECT."""
    return f"""
    SELECT query_id, passage_id, score, rank FROM (
      SELECT query_id, passage_id, units / 1000000 AS score,
             row_number() OVER (PARTITION BY query_id ORDER BY units DESC, passage_id) AS rank
      FROM (
        SELECT query_id, passage_id,
               sum(cast(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) * 1000000) AS bigint)) AS units
        FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+')) AS token FROM {questions}) q
        JOIN (SELECT passage_id, len, token, count(*) AS tf FROM (
                SELECT passage_id, len(w) AS len, unnest(w) AS token
                FROM (SELECT passage_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {passages}) w0) w1
              GROUP BY passage_id, len, token) t USING (token)
        JOIN (SELECT token, count(DISTINCT passage_id) AS df FROM (
                SELECT passage_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM {passages}) d0
              GROUP BY token) d USING (token),
             (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS mean FROM {passages}) c
        GROUP BY query_id, passage_id) s) r
    WHERE rank <= {breadth}"""
