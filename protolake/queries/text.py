"""Queries over raw documents and over the overlay's texts: normalization and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolake.functions import text as T
from protolake.operators import preprocess as R
from protolake.operators import profile as P
from protolake.plans.overlay import ELEMENTS_SQL, TEXTS_SQL, elements, protocol_texts
from protolake.refdata import PARSER_ABBREVIATIONS, UNIT_NAMES, UNITS


def docs(spark, d, *columns):
    return spark.read.parquet(f"{d}/documents.parquet").select(*(columns or ("doc_id", "text")))


def texts(spark, d):
    return protocol_texts(docs(spark, d, "doc_id"))


def unit_concept(units):
    """Concept id of a unit, whatever its case; other names included, 0 if unknown."""
    key = F.lower(F.trim(units))
    out = F.lit(0)
    for name, unit in [(k.lower(), v) for k, v in UNITS.items()] + [(k, UNITS.get(v, 0)) for k, v in UNIT_NAMES.items()]:
        out = F.when(key == name, unit).otherwise(out)
    return out


def unit_sql(units: str) -> str:
    return f"CASE lower(trim({units})) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in [(k.lower(), v) for k, v in UNITS.items()] + [(k, UNITS.get(v, 0)) for k, v in UNIT_NAMES.items()]) + " ELSE 0 END"


def _clean(spark, d):
    out = T.replaced(F.coalesce("text", F.lit("")), T.CLEAN_RULES, "")
    return docs(spark, d).select("doc_id", F.length(F.trim(out)).alias("length"), F.md5(F.trim(out)).alias("digest"))


def _clean_whole(spark, d):
    out = T.clean_text(F.col("text"))
    return docs(spark, d).select("doc_id", out.alias("text")).select("doc_id", F.length("text").alias("length"), F.md5("text").alias("digest"))


def _whitespace(spark, d):
    out = T.normalize_whitespace(F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", F.md5(out).alias("digest"))


_DATES = "format_string('%04d-%02d-%02d', 1890 + doc_id % 230, doc_id % 14, doc_id % 33)"

QUERIES = {
    "clean_text_stats": _clean,
    "clean_text_documents": _clean_whole,
    "normalize_whitespace": _whitespace,
    "normalize_abbreviations": lambda s, d: texts(s, d).select("doc_id", T.normalize_abbreviations(F.col("text")).alias("text")),
    "dosage_standardize": lambda s, d: elements(docs(s, d, "doc_id")).filter("dosage is not null").select("doc_id", T.standardize_dosage(F.col("dosage")).alias("dosage")),
    "normalize_dates": lambda s, d: texts(s, d).select("doc_id", T.normalize_dates(F.col("text")).alias("text")),
    "valid_date_check": lambda s, d: docs(s, d, "doc_id").withColumn("date", F.expr(_DATES)).select("doc_id", "date", T.is_valid_date(F.col("date")).alias("valid")),
    "sanitize_name": lambda s, d: docs(s, d, "doc_id", "source").withColumn("name", F.concat(F.lit("My File "), F.coalesce("source", F.lit("?")), F.lit(" #"), "doc_id", F.lit("!@$%.txt"))).select("doc_id", T.sanitize_filename(F.col("name")).alias("name")),
    "unit_map": lambda s, d: elements(docs(s, d, "doc_id")).filter("units is not null").select("doc_id", "units", unit_concept(F.col("units")).alias("concept_id")),
    "preprocess_medical_text": lambda s, d: texts(s, d).select("doc_id", R.preprocess_medical_text(F.col("text")).alias("text")),
    "preprocess_medical_text_documents": lambda s, d: docs(s, d).select("doc_id", F.md5(R.preprocess_medical_text(F.coalesce("text", F.lit("")))).alias("digest")),
    "preprocess_for_model": lambda s, d: R.preprocess_for_model(docs(s, d)).select("doc_id", "no", "start", "text", F.size("tables").alias("n_tables"), "statistics.word_count"),
    "preprocess_document": lambda s, d: R.preprocess_document(docs(s, d)).select("doc_id", F.md5("text").alias("digest"), "document_type", "language", "sentence_count", "section_count", F.array_join("key_phrases", "|").alias("key_phrases"), "n_chunks", "word_count"),
    "normalize_parsed_whitespace": lambda s, d: docs(s, d).select("doc_id", F.md5(T.normalize_parsed_whitespace(F.coalesce("text", F.lit("")))).alias("digest")),
    "text_statistics": lambda s, d: P.text_statistics(docs(s, d)),
    "dedupe_consecutive_lines": lambda s, d: P.dedupe_consecutive_lines(docs(s, d)),
    "remove_headers_footers": lambda s, d: P.remove_headers_footers(docs(s, d)),
    "detect_language": lambda s, d: P.detect_language(docs(s, d)),
    "top_trigrams": lambda s, d: P.top_trigrams(docs(s, d)),
    "detect_document_type": lambda s, d: P.detect_document_type(texts(s, d)),
    "key_phrase_scores": lambda s, d: P.key_phrase_scores(texts(s, d)),
    "key_phrases": lambda s, d: P.key_phrases(texts(s, d)),
    # the general ones again, over whole raw texts
    "normalize_abbreviations_documents": lambda s, d: docs(s, d).select("doc_id", T.normalize_abbreviations(F.col("text")).alias("text")),
    "normalize_dates_documents": lambda s, d: docs(s, d).select("doc_id", T.normalize_dates(F.col("text")).alias("text")),
    "detect_document_type_documents": lambda s, d: P.detect_document_type(docs(s, d)),
    "key_phrase_scores_documents": lambda s, d: P.key_phrase_scores(docs(s, d)),
    "key_phrases_documents": lambda s, d: P.key_phrases(docs(s, d)),
    "replace_tables": lambda s, d: P.replace_tables(docs(s, d)).select("doc_id", "text", F.size("tables").alias("n"), F.md5(F.array_join("tables", "\n")).alias("digest")),
    "table_runs": lambda s, d: P.table_runs(docs(s, d)),
    "chunk_offsets": lambda s, d: P.chunk_offsets(docs(s, d)),
    "chunk_offsets_any": lambda s, d: P.chunk_offsets(docs(s, d), marks=".!?", at_lines=True),
}

ORACLES = {
    "clean_text_stats": f"SELECT doc_id, CAST(length(t) AS INTEGER) AS length, md5(t) AS digest FROM (SELECT doc_id, trim({T.sql_replaced('coalesce(text, ' + chr(39) * 2 + ')', T.CLEAN_RULES, 'g')}) AS t FROM documents)",
    "normalize_whitespace": f"SELECT doc_id, md5(trim({T.sql_replaced('coalesce(text, ' + chr(39) * 2 + ')', T.WHITESPACE_RULES, 'g')})) AS digest FROM documents",
    "normalize_abbreviations": f"SELECT doc_id, {T.sql_replaced('text', T.ABBREVIATIONS)} AS text FROM ({TEXTS_SQL})",
    "dosage_standardize": f"SELECT doc_id, {T.sql_replaced('dosage', T.DOSAGE_RULES)} AS dosage FROM ({ELEMENTS_SQL}) WHERE dosage IS NOT NULL",
    "normalize_dates": f"SELECT doc_id, {T.sql_replaced('text', T.date_rules(), 'g')} AS text FROM ({TEXTS_SQL})",
    "valid_date_check": "SELECT doc_id, date, CAST(substring(date, 1, 4) AS INTEGER) BETWEEN 1900 AND 2100 AND CAST(substring(date, 6, 2) AS INTEGER) BETWEEN 1 AND 12 AND CAST(substring(date, 9, 2) AS INTEGER) BETWEEN 1 AND 31 AS valid FROM (SELECT doc_id, printf('%04d-%02d-%02d', 1890 + doc_id % 230, doc_id % 14, doc_id % 33) AS date FROM documents)",
    "sanitize_name": r"SELECT doc_id, rtrim(substring(regexp_replace(replace('My File ' || coalesce(source, '?') || ' #' || doc_id || '!@$%', ' ', '_'), '[^\p{L}\p{N}_-]', '', 'g'), 1, 50), '_') || '_txt' AS name FROM documents",
    "unit_map": f"SELECT doc_id, units, {unit_sql('units')} AS concept_id FROM ({ELEMENTS_SQL}) WHERE units IS NOT NULL",
    "preprocess_medical_text": f"SELECT doc_id, {T.sql_replaced(T.sql_replaced('text', PARSER_ABBREVIATIONS), R.PARSER_RULES, 'g')} AS text FROM ({TEXTS_SQL})",
    "normalize_parsed_whitespace": f"SELECT doc_id, md5(trim({T.sql_replaced('coalesce(text, ' + chr(39) * 2 + ')', T.PARSED_WHITESPACE_RULES, 'g')})) AS digest FROM documents",
    "text_statistics": P.TEXT_STATISTICS_SQL,
    "dedupe_consecutive_lines": P.DEDUPE_SQL,
    "remove_headers_footers": P.HEADERS_SQL,
    "detect_language": P.LANGUAGE_SQL,
    "top_trigrams": P.TOP_TRIGRAMS_SQL,
    "detect_document_type": P.document_type_sql(TEXTS_SQL),
    "key_phrase_scores": P.KEY_PHRASES_SQL.replace("{source}", f"({TEXTS_SQL})"),
    "key_phrases": P.GREEDY_SQL.replace("{source}", f"({TEXTS_SQL})"),
    "key_phrases_documents": P.GREEDY_SQL.replace("{source}", "documents"),
    "normalize_dates_documents": f"SELECT doc_id, {T.sql_replaced('text', T.date_rules(), 'g')} AS text FROM documents",
    "detect_document_type_documents": P.document_type_sql("SELECT doc_id, text FROM documents"),
    "key_phrase_scores_documents": P.KEY_PHRASES_SQL.replace("{source}", "documents"),
    "replace_tables": P.REPLACE_TABLES_SQL,
    "table_runs": P.TABLE_RUNS_SQL,
    "chunk_offsets": P.CHUNKS_SQL,
    "chunk_offsets_any": P.ANY_CHUNKS_SQL,
}
