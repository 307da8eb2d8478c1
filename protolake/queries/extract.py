"""Queries of the extraction operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolake.operators import extract as E
from protolake.operators import preprocess as R
from protolake.operators import sectioning as G
from protolake.functions.text import CLEAN_RULES, sql_replaced
from protolake.plans.overlay import TEXTS_SQL
from protolake.queries.text import docs, texts
from protolake.refdata import ABBREVIATIONS


def _classified(s, d):
    t = texts(s, d)
    held = E.sections_with_text(t).select("doc_id", "no", "title", F.inline(F.array(E.classify_section(F.col("title"), F.col("content")))))
    return held.withColumnRenamed("kind", "section_type")


def _findings(s, d):
    return R.key_findings(G.cut(texts(s, d)))


_CONTENT = "substring(text, start + 1 + length(title), stop - start)"

QUERIES = {
    "numeric_values": lambda s, d: E.numeric_values(docs(s, d)),
    "numeric_values_overlay": lambda s, d: E.numeric_values(texts(s, d)),
    "numeric_value_spans": lambda s, d: E.regex_spans(texts(s, d), {"number": r"(\d+(?:\.\d+)?)\s*([a-zA-Z]+(?:/[a-zA-Z]+)?)?"}),
    "time_expressions": lambda s, d: E.time_expressions(texts(s, d)),
    "eligibility_criteria": lambda s, d: E.items(texts(s, d), E.CRITERIA),
    "endpoints": lambda s, d: E.items(texts(s, d), E.ENDPOINTS),
    "references": lambda s, d: E.references(texts(s, d)),
    "section_spans": lambda s, d: E.sections(texts(s, d)),
    "section_classify": _classified,
    "section_boundaries": lambda s, d: G.cut(texts(s, d)).drop("content"),
    "section_boundaries_documents": lambda s, d: G.cut(docs(s, d)).select("doc_id", "no", "title", "start", "stop", F.md5("content").alias("digest")),
    "sections_by_spacing": lambda s, d: G.cut(texts(s, d), G.by_spacing).drop("content"),
    "sections_by_paragraphs": lambda s, d: G.cut(docs(s, d), G.by_paragraphs).select("doc_id", "no", "title", "start", "stop", F.md5("content").alias("digest")),
    "section_headers": lambda s, d: G.section_headers(texts(s, d)).drop("content"),
    "sections_by_capital_lines": lambda s, d: G.cut(texts(s, d), G.by_capital_lines),
    "extract_sections": lambda s, d: G.extract_sections(texts(s, d)).drop("text"),
    "sections_confident": lambda s, d: G.filter_sections(G.extract_sections(texts(s, d))).select("doc_id", "id"),
    "sections_of_type": lambda s, d: G.sections_of_type(G.extract_sections(texts(s, d)), "ELIGIBILITY_SECTION").select("doc_id", "id", "title"),
    "font_segments": lambda s, d: G.segment_by_font(docs(s, d)).select("doc_id", "no", F.md5("text").alias("digest"), "font", "is_bold", "is_italic"),
    "key_findings": _findings,
    "section_spans_whole": lambda s, d: E.sections_or_whole(docs(s, d)),
    "references_any": lambda s, d: E.references(texts(s, d), E.ANY_REFERENCE),
    "rule_entities": lambda s, d: E.rule_entities(texts(s, d)),
    "rule_entities_cued": lambda s, d: E.rule_entities(texts(s, d), E.CUED_ENTITY_RULES),
    "sentences": lambda s, d: E.sentences(docs(s, d)),
}

_BOUNDARIES = G.boundaries_sql(TEXTS_SQL)
_SLICED = f"SELECT * FROM (SELECT b.*, trim(substring(text, start + 1, stop - start), ' ' || chr(10)) AS content FROM ({_BOUNDARIES}) b JOIN ({TEXTS_SQL}) USING (doc_id)) WHERE content <> ''"
_EXTRACTED = f"SELECT doc_id, 'sec' || (no + 1) AS id, title, start, stop, {E.classify_sql('title', 'content')} FROM ({_SLICED})"

_NUMBER_RUNS = r"([\s\S]*?)(([0-9]+(?:\.[0-9]+)?)\s*(?:[a-zA-Z]+(?:/[a-zA-Z]+)?)?)"

ORACLES = {
    "numeric_value_spans": f"""SELECT doc_id, 'number' AS kind, CAST(z - length(m) AS INTEGER) AS start, CAST(z AS INTEGER) AS stop, m AS match FROM (SELECT doc_id, i, ms[i] AS m, sum(length(gs[i]) + length(ms[i])) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM (
        SELECT doc_id, gs, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_NUMBER_RUNS}', 1) AS gs, regexp_extract_all(text, '{_NUMBER_RUNS}', 2) AS ms FROM ({TEXTS_SQL}))))""",
    "section_boundaries": _BOUNDARIES,
    "sections_by_spacing": G.spacing_sql(TEXTS_SQL),
    "section_headers": G.headers_sql(f"SELECT doc_id, {sql_replaced('trim(' + sql_replaced('text', CLEAN_RULES, 'g') + ')', ABBREVIATIONS)} AS text FROM ({TEXTS_SQL})"),
    "extract_sections": f"SELECT * EXCLUDE (section_type), section_type AS type FROM ({_EXTRACTED})",
    "sections_confident": f"SELECT doc_id, id FROM ({_EXTRACTED}) WHERE confidence >= 0.5",
    "sections_of_type": f"SELECT doc_id, id, title FROM ({_EXTRACTED}) WHERE section_type = 'ELIGIBILITY_SECTION'",
    "font_segments": "SELECT doc_id, CAST(0 AS INTEGER) AS no, md5(coalesce(text, '')) AS digest, 'default' AS font, false AS is_bold, false AS is_italic FROM documents",
    "key_findings": f"SELECT doc_id, string_agg(title || ': ' || CASE WHEN contains(content, '.') THEN split_part(content, '.', 1) || '.' ELSE substring(content, 1, 100) || '...' END, chr(10) ORDER BY no) AS findings FROM ({_SLICED}) WHERE no < 3 AND length(content) > 30 GROUP BY doc_id",
    "numeric_values": E.numeric_sql("SELECT doc_id, text FROM documents"),
    "numeric_values_overlay": E.numeric_sql(TEXTS_SQL),
    "time_expressions": E.times_sql(TEXTS_SQL),
    "eligibility_criteria": E.items_sql(TEXTS_SQL, E.CRITERIA),
    "endpoints": E.items_sql(TEXTS_SQL, E.ENDPOINTS),
    "references": E.references_sql(TEXTS_SQL),
    "section_spans": E.sections_sql(TEXTS_SQL),
    "section_classify": f"SELECT doc_id, no, title, {E.classify_sql('title', _CONTENT)} FROM ({E.sections_sql(TEXTS_SQL)}) JOIN ({TEXTS_SQL}) USING (doc_id)",
    "section_spans_whole": E.sections_or_whole_sql("SELECT doc_id, text FROM documents"),
    "references_any": E.any_references_sql(TEXTS_SQL),
    "rule_entities": E.rule_entities_sql(TEXTS_SQL),
    "rule_entities_cued": E.rule_entities_sql(TEXTS_SQL, E.CUED_ENTITY_RULES),
    "sentences": E.SENTENCES_SQL,
}
