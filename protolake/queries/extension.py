"""Queries beyond the documents: windows over events (an extension), HTML rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolake.functions import display as V
from protolake.functions.text import file_size_text, month_number
from protolake.operators import extraction as X
from protolake.operators import sectioning as G
from protolake.operators.convert import fhir_resources, omop_tables
from protolake.plans.overlay import ELEMENTS_SQL, TEXTS_SQL
from protolake.queries.entities import CLEANED_SQL, EXTRACTED_SQL, cleaned, elems, ids
from protolake.queries.extract import ORACLES as SECTIONS
from protolake.queries.standards import ORACLES as STANDARDS
from protolake.queries.text import texts, unit_concept
from protolake.refdata import COLORS, JOB_PROGRESS, MONTHS, OTHER_COLOR, SAMPLE_DESCRIPTIONS
from protolake.sources.files import empty_concepts, expired, html_table, html_tables, pretty_json, sniffed_encoding
from protolake.streaming.ingest import event_windows, latest_states


def _windows(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return event_windows(events).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _highlighted(s, d):
    found = X.extract_entities(texts(s, d)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "label", "confidence")).alias("spans"))
    return cleaned(s, d).join(found, "doc_id").select("doc_id", V.highlight_entities(F.col("text"), F.col("spans")).alias("html"))


def _marked_sections(s, d):
    found = G.extract_sections(texts(s, d)).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "type")).alias("spans"))
    return texts(s, d).join(found, "doc_id").select("doc_id", F.md5(V.highlight_sections(F.col("text"), F.col("spans"))).alias("digest"))


def _compared(s, d):
    both = _highlighted(s, d).join(texts(s, d).withColumnRenamed("text", "raw"), "doc_id")
    return both.select("doc_id", F.md5(V.side_by_side(F.concat(F.lit("Text "), F.col("doc_id").cast("string")), V.escape_html(F.col("raw")), F.col("html"))).alias("digest"))


def _names(s, d):
    name = F.get(F.array(*[F.lit(x) for x in [*SAMPLE_DESCRIPTIONS, "other.doc"]]), (F.col("doc_id") % 6).cast("int"))
    landed = V.landing_name(F.col("name"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8))
    held = ids(s, d).withColumn("name", F.replace(name, F.lit("_"), F.lit("-"))).withColumn("sample", name)
    return held.select("doc_id", landed.alias("landed"), V.original_filename(landed).alias("original"), V.sample_description(F.col("sample")).alias("description"), V.supported(F.col("name")).alias("supported"))


def _encodings(s, d):
    text = F.concat(F.lit("caf\u00e9 \u2019s "), F.col("doc_id").cast("string"), F.lit(" plain words follow here"))
    latin = F.concat(F.lit("caf\u00e9 "), F.col("doc_id").cast("string"))
    content = F.when(F.col("doc_id") % 5 == 0, F.encode(text, "UTF-8")).when(F.col("doc_id") % 5 == 1, F.encode(text, "UTF-16LE")).when(F.col("doc_id") % 5 == 2, F.encode(text, "UTF-16BE")).when(F.col("doc_id") % 5 == 3, F.concat(F.unhex(F.lit("636166E920927320")), F.encode(F.col("doc_id").cast("string"), "ISO-8859-1"))).otherwise(F.encode(latin, "ISO-8859-1"))
    return ids(s, d).select("doc_id", sniffed_encoding(content).alias("encoding"))


def _states(s, d):
    """Updates made from the id: three for each job, the last by time wins."""
    names = F.array(*[F.lit(x) for x in JOB_PROGRESS])
    rows = ids(s, d).select((F.col("doc_id") % 40).alias("job_id"), F.col("doc_id").alias("ts"), F.get(names, (F.col("doc_id") % len(JOB_PROGRESS)).cast("int")).alias("state"))
    return latest_states(rows)


def _visible(s, d):
    e = X.extract_entities(texts(s, d))
    return e.groupBy("doc_id").agg(F.count_if(F.col("label") == "MEDICATION").alias("visible"), F.count("*").alias("n"))


def _pages(s, d):
    t = F.coalesce("text", F.lit(""))
    page = F.when(F.col("doc_id") % 3 == 0, F.substring(t, 1, 9)).when(F.col("doc_id") % 3 == 1, F.lit("   ")).otherwise(t)
    return s.read.parquet(f"{d}/documents.parquet").filter("doc_id is not null").select("doc_id", V.needs_ocr(page).alias("ocr"), V.expected_entities(F.col("text")).alias("expected"))


def _aged(s, d):
    """Files changed one hour after another, seen at the hundredth hour."""
    files = ids(s, d).select("doc_id", F.timestamp_seconds(F.col("doc_id") * 3600).alias("modificationTime"))
    return expired(files, F.timestamp_seconds(F.lit(100 * 3600))).select("doc_id")


def _sizes(s, d):
    """Bytes made from the id, exact up to 38 digits and then as a double: 64 cubes pass a long from the id 2^19 on."""
    i, x = F.col("doc_id").cast("decimal(38,0)"), F.col("doc_id").cast("double")
    exact = F.try_multiply(F.try_multiply(F.try_multiply(i, i), i), F.lit(64).cast("decimal(38,0)"))
    return ids(s, d).select("doc_id", F.coalesce(file_size_text(exact), file_size_text(x * x * x * 64)).alias("size"), month_number(F.get(F.array(*[F.lit(m) for m in [*MONTHS, "No month"]]), (F.col("doc_id") % 13).cast("int"))).alias("month"))


QUERIES = {
    "expired_files": _aged,
    "file_sizes": _sizes,
    "highlight_entities": _highlighted,
    "highlight_sections": _marked_sections,
    "side_by_side": _compared,
    "file_names": _names,
    "detect_encoding": _encodings,
    "latest_job_states": _states,
    "visible_entities": _visible,
    "page_predicates": _pages,
    "entity_context": lambda s, d: G.with_context(X.extract_entities(texts(s, d)), cleaned(s, d)).select("doc_id", "e", "context"),
    "pretty_resources": lambda s, d: fhir_resources(elems(s, d)).filter("resource_type = 'Library'").select("protocol_id", pretty_json(F.from_json("resource", "resourceType string, id string, status string, title string")).alias("json")),
    "omop_html_tables": lambda s, d: html_tables(omop_tables(elems(s, d), unit_concept)["condition_occurrence"], "protocol_id", ["condition_occurrence_id", "condition_source_value"], "condition_occurrence_id"),
    "empty_concepts": lambda s, d: empty_concepts(s, "loinc"),
    "event_windows": _windows,
    "html_rows": lambda s, d: html_table(elems(s, d).select("doc_id", "kind", "text"), ["kind", "text"]).select("doc_id", "html"),
}

def _escaped(column: str) -> str:
    out = f"coalesce({column}, '')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


_PART = lambda t, a, b: _escaped(f"substring({t}, CAST({a} AS BIGINT) + 1, CAST(greatest(0, {b} - ({a})) AS BIGINT))")
_COLOR = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COLORS.items()) + f" ELSE '{OTHER_COLOR}' END"
_SPAN = f"""'<span class="entity" style="background-color: ' || {_COLOR} || ';" data-type="' || label || '" title="' || label || ' ' || CAST(floor(confidence * 100 + 0.5) AS INTEGER) || '%">' || {_PART('text', 'start', 'stop')} || '</span>'"""
_HIGHLIGHT = f"""SELECT doc_id, replace(string_agg({_PART('text', 'coalesce(prior, 0)', 'start')} || {_SPAN}, '' ORDER BY e) || any_value({_PART('text', 'final', 'length(text)')}), chr(10), '<br>') AS html FROM (
    SELECT x.*, t.text, lag(stop) OVER (PARTITION BY x.doc_id ORDER BY e) AS prior, max(stop) OVER (PARTITION BY x.doc_id) AS final FROM (SELECT doc_id, e, label, start, stop, confidence FROM ({EXTRACTED_SQL})) x JOIN ({CLEANED_SQL}) t USING (doc_id)) GROUP BY doc_id"""
_DIV = f"""'<div class="section-header" data-section-type="' || type || '">' || type || '</div><div class="section" data-section-type="' || type || '">' || {_PART('text', 'start', 'stop')} || '</div>'"""
_SAMPLES = [*SAMPLE_DESCRIPTIONS, "other.doc"]
_PRETTY = "'{' || chr(10) || '  \"resourceType\" : \"Library\",' || chr(10) || '  \"id\" : \"library-' || protocol_id || '\",' || chr(10) || '  \"status\" : \"draft\",' || chr(10) || '  \"title\" : \"Logic for Protocol ' || protocol_id || '\"' || chr(10) || '}'"

_BYTES = "doc_id * doc_id * doc_id * 64"
ORACLES = {
    "expired_files": "SELECT doc_id FROM documents WHERE doc_id < 76",
    "file_sizes": f"""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024, 1)) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', round(n / 1048576, 1)) || ' MB' ELSE printf('%.1f', round(n / 1073741824, 1)) || ' GB' END AS size,
        CAST(CASE WHEN doc_id % 13 = 12 THEN 1 ELSE doc_id % 13 + 1 END AS INTEGER) AS month FROM (SELECT doc_id, {_BYTES} AS n FROM documents WHERE doc_id IS NOT NULL)""",
    "highlight_entities": _HIGHLIGHT,
    "highlight_sections": f"""SELECT doc_id, md5(replace(string_agg({_PART('text', 'coalesce(prior, 0)', 'start')} || {_DIV}, '' ORDER BY start) || any_value({_PART('text', 'final', 'length(text)')}), chr(10), '<br>')) AS digest FROM (
        SELECT x.*, t.text, lag(stop) OVER (PARTITION BY x.doc_id ORDER BY start) AS prior, max(stop) OVER (PARTITION BY x.doc_id) AS final FROM (SELECT doc_id, start, stop, type FROM ({SECTIONS['extract_sections']})) x JOIN ({TEXTS_SQL}) t USING (doc_id)) GROUP BY doc_id""",
    "side_by_side": f"""SELECT doc_id, md5('<div class="comparison"><h2>Text ' || doc_id || '</h2><div class="left">' || {_escaped('text')} || '</div><div class="right">' || html || '</div></div>') AS digest FROM ({_HIGHLIGHT}) JOIN ({TEXTS_SQL}) USING (doc_id)""",
    "file_names": f"""SELECT doc_id, stem || '_' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 8) || ext AS landed, stem || ext AS original, coalesce(MAP {{{', '.join(f"'{k}': '{v}'" for k, v in SAMPLE_DESCRIPTIONS.items())}}}[name], 'Sample document') AS description, ext IN ('.pdf', '.docx', '.txt') AS supported
        FROM (SELECT doc_id, name, replace(split_part(name, '.', 1), '_', '-') AS stem, '.' || split_part(name, '.', 2) AS ext FROM (SELECT doc_id, {_SAMPLES}[doc_id % 6 + 1] AS name FROM documents WHERE doc_id IS NOT NULL))""",
    "detect_encoding": "SELECT doc_id, ['utf-8', 'utf-16-le', 'utf-16-be', 'windows-1252', 'iso-8859-1'][doc_id % 5 + 1] AS encoding FROM documents WHERE doc_id IS NOT NULL",
    "latest_job_states": "SELECT job_id, ts, {0}[i] AS state, {1}[i] AS progress FROM (SELECT doc_id % 40 AS job_id, max(doc_id) AS ts, max(doc_id) % 6 + 1 AS i FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)".format(list(JOB_PROGRESS), list(JOB_PROGRESS.values())),
    "visible_entities": f"SELECT doc_id, count(*) FILTER (label = 'MEDICATION') AS visible, count(*) AS n FROM ({EXTRACTED_SQL}) GROUP BY doc_id",
    "page_predicates": "SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN length(trim(coalesce(text, ''))) < 10 ELSE true END AS ocr, CAST(greatest(1, length(coalesce(text, '')) // 200) AS INTEGER) AS expected FROM documents WHERE doc_id IS NOT NULL",
    "pretty_resources": f"SELECT DISTINCT protocol_id, {_PRETTY} AS json FROM ({ELEMENTS_SQL})",
    "omop_html_tables": f"SELECT protocol_id, '<table><tr><th>condition_occurrence_id</th><th>condition_source_value</th></tr>' || string_agg('<tr><td>' || condition_occurrence_id || '</td><td>' || {_escaped('condition_source_value')} || '</td></tr>', '' ORDER BY condition_occurrence_id) || '</table>' AS html FROM ({STANDARDS['omop_condition_occurrence']}) GROUP BY protocol_id",
    "empty_concepts": "SELECT '' AS system, '' AS code, '' AS term, '' AS display, '' AS component, '' AS property, '' AS time, '' AS scale, '' AS method WHERE false",
    "html_rows": f"SELECT doc_id, '<tr><td>' || {_escaped('kind')} || '</td><td>' || {_escaped('text')} || '</td></tr>' AS html FROM ({ELEMENTS_SQL})",
    "event_windows": "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
