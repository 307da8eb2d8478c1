"""Queries of OMOP tables, FHIR resources, validation and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolake.operators import entities as N
from protolake.operators import convert as C
from protolake.operators import extraction as X
from protolake.operators import monitor as Q
from protolake.operators import sectioning as G
from protolake.operators import standards as O
from protolake.operators import training as W
from protolake.plans.overlay import ELEMENTS_SQL
from protolake.queries.entities import CLEANED_SQL, EXTRACTED_SQL, MAPPED_SQL, cleaned, elems, ids
from protolake.queries.extract import ORACLES as SECTION_ORACLES
from protolake.queries.text import texts, unit_concept, unit_sql
from protolake.refdata import BODY_SITES, COLORS, CONDITION_WORDS, DEVICE_WORDS, EXCLUSION, INCLUSION, JOB_PROGRESS, LAB_WORDS, OBSERVATION_WORDS, OTHER_COLOR, PROTOCOL, SPECIMEN_TYPES, SPECIMEN_WORDS


def _condition_counts(s, d):
    rows = O.condition_occurrence(elems(s, d))
    return rows.groupBy("condition_type_concept_id", F.col("condition_source_code").isNotNull().alias("mapped")).agg(F.count("*").alias("n"), F.count_distinct("condition_source_code").alias("codes"))


def _resources(s, d):
    """Resources some of which are broken by their id."""
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in O.FHIR_REQUIRED])
    return ids(s, d).select(i.alias("rid"), F.get(kinds, (i % 4).cast("int")).alias("resource_type"), F.when(i % 7 == 0, None).when(i % 11 == 0, "broken").otherwise("draft").alias("status"),
        F.when(i % 5 == 0, None).when(i % 13 == 0, "Nothing").otherwise("Task").alias("kind"), F.when(i % 3 == 0, "").otherwise("logic-library").alias("type"))


_RES = "SELECT doc_id AS rid, ['PlanDefinition', 'ActivityDefinition', 'Library', 'Questionnaire'][doc_id % 4 + 1] AS resource_type, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'broken' ELSE 'draft' END AS status, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'Nothing' ELSE 'Task' END AS kind, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'logic-library' END AS type FROM documents WHERE doc_id IS NOT NULL"
_FHIR_ISSUES = " UNION ALL ".join([f"SELECT rid, '{r} missing required element: {e}' AS issue FROM r WHERE resource_type = '{r}' AND coalesce({e}, '') = ''" for r, es in O.FHIR_REQUIRED.items() for e in es] + ["SELECT rid, resource_type || ' has invalid status: ' || status FROM r WHERE status NOT IN ('draft', 'active', 'retired', 'unknown')", "SELECT rid, 'ActivityDefinition has invalid kind: ' || kind FROM r WHERE resource_type = 'ActivityDefinition' AND kind NOT IN ('ServiceRequest', 'MedicationRequest', 'Task', 'Appointment')"])


def _loose(s, d):
    """Procedure rows as strings, some of which are broken by their id."""
    i = F.col("doc_id")
    return ids(s, d).select(i, i.cast("string").alias("procedure_occurrence_id"), F.when(i % 5 == 0, None).when(i % 3 == 0, "0").otherwise("4000").alias("procedure_concept_id"), F.when(i % 7 == 0, None).otherwise(str(PROTOCOL)).alias("procedure_type_concept_id"),
        F.when(i % 11 == 0, "2023-13-01").otherwise("2023-02-31").alias("procedure_date"), F.when(i % 4 == 0, "not-a-number").otherwise("2").alias("quantity"))


_LOOSE = f"SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN '0' ELSE '4000' END AS concept, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '{PROTOCOL}' END AS kind, doc_id % 11 = 0 AS bad_date, doc_id % 4 = 0 AS bad_quantity FROM documents WHERE doc_id IS NOT NULL"
_OMOP_ISSUES = " UNION ALL ".join(f"SELECT doc_id, 'procedure_occurrence' AS table_name, '{x}' AS issue FROM ({_LOOSE}) WHERE {w}" for x, w in [("Missing required field: procedure_concept_id", "concept IS NULL"), ("Unmapped concept: procedure_concept_id", "concept = '0'"), ("Missing required field: procedure_type_concept_id", "kind IS NULL"), ("procedure_date should be date", "bad_date"), ("quantity should be integer", "bad_quantity")])


def _issues(s, d):
    return O.omop_issues("procedure_occurrence", _loose(s, d), "doc_id")


def _rollup(s, d):
    return N.stub_entities(ids(s, d)).rollup("label").agg(F.round(F.avg("confidence"), 6).alias("mean"), F.count("*").alias("n")).select(F.coalesce("label", F.lit("ALL")).alias("label"), "mean", "n")


def _summary(s, d):
    e = elems(s, d)
    return e.groupBy("protocol_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("eligibility_criteria", "procedures", "medications", "endpoints")], F.count("*").alias("total"))


def _monitor(s, d):
    """Ten of a hundred runs also failed once."""
    n = N.stub_entities(ids(s, d)).select(F.col("doc_id").alias("run"), "confidence")
    runs = ids(s, d).select(F.col("doc_id").alias("run"), ((F.col("doc_id") % 9 + 1) / 10).alias("seconds"))
    log = Q.record_extractions(Q.new_log(s), runs, n)
    return Q.metrics(Q.record_errors(log, runs.filter("run % 10 = 0").select("run")))


def _progress(s, d):
    states = list(JOB_PROGRESS)
    state = F.get(F.array(*[F.lit(x) for x in states]), (F.col("doc_id") % len(states)).cast("int"))
    value = F.lit(0)
    for k, v in JOB_PROGRESS.items():
        value = F.when(F.col("state") == k, v).otherwise(value)
    return ids(s, d).withColumn("state", state).select("doc_id", "state", value.alias("progress"))


def _colors(s, d):
    base = F.regexp_replace("label", "^[BI]-", "")
    color = F.lit(OTHER_COLOR)
    for k, v in COLORS.items():
        color = F.when(base == k, v).otherwise(color)
    return N.stub_tags(ids(s, d)).withColumnRenamed("tag", "label").groupBy("label").agg(F.count("*").alias("n")).select("label", color.alias("color"), "n")


def _both_rows(s, d):
    """All issues of resources and rows that are broken by their id."""
    fhir = O.fhir_issues(_resources(s, d)).select(F.lit("FHIR").alias("standard"), "issue")
    return fhir.unionByName(_issues(s, d).select(F.lit("OMOP CDM").alias("standard"), "issue"))


def _both(s, d):
    fhir = O.fhir_issues(_resources(s, d)).withColumn("resource_type", F.substring_index("issue", " ", 1))
    return C.all_issues(fhir, _issues(s, d))


def _report(s, d):
    e = X.extract_entities(texts(s, d))
    return C.protocol_report(e, X.extract_relations(e, cleaned(s, d)), G.extract_sections(texts(s, d)))


def _judged_tags(s, d):
    """The stub's tags as gold; predicted: some tags lost or of another kind, by token."""
    n = (F.col("doc_id") + F.col("idx") * 5) % 7
    return N.stub_tags(ids(s, d)).select("doc_id", "idx", F.col("tag").alias("gold"), F.when(n == 0, "O").when(n == 3, F.regexp_replace("tag", "CONDITION", "MEDICATION")).otherwise(F.col("tag")).alias("predicted"))


_JUDGED = f"SELECT doc_id, idx, tag AS gold, CASE (doc_id + idx * 5) % 7 WHEN 0 THEN 'O' WHEN 3 THEN regexp_replace(tag, 'CONDITION', 'MEDICATION') ELSE tag END AS predicted FROM ({N.TAGS_SQL})"


def _aligned(s, d):
    """Word pieces of a sentence made from the id: a mark, one to three pieces of each of five words, a mark."""
    words = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda w: F.array_repeat(w, (1 + (F.col("doc_id") + w) % 3).cast("int"))))
    labels = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda w: ((F.col("doc_id") * 3 + w) % 11).cast("int"))
    none = F.array(F.lit(None).cast("int"))
    return ids(s, d).select("doc_id", W.align_labels(F.concat(none, words, none), labels).alias("l")).select("doc_id", F.array_join(F.transform("l", lambda x: x.cast("string")), " ").alias("labels"))


_IN = ["condition_occurrence_id", "condition_concept_id", "condition_type_concept_id", "condition_source_value"]

QUERIES = {
    "omop_condition_counts": _condition_counts,
    "omop_condition_occurrence": lambda s, d: O.condition_occurrence(elems(s, d)),
    "omop_drug_exposure": lambda s, d: O.drug_exposure(elems(s, d)),
    "omop_procedure_occurrence": lambda s, d: O.procedure_occurrence(elems(s, d)),
    "omop_observation": lambda s, d: O.observation(elems(s, d)),
    "omop_measurement": lambda s, d: O.measurement(elems(s, d), unit_concept),
    "omop_device_exposure": lambda s, d: O.device_exposure(elems(s, d)),
    "omop_specimen": lambda s, d: O.specimen(elems(s, d)),
    "omop_sql_insert": lambda s, d: O.insert_sql("condition_occurrence", O.condition_occurrence(elems(s, d)), _IN),
    "fhir_plan_actions": lambda s, d: O.plan_actions(elems(s, d)),
    "fhir_plan_definition_json": lambda s, d: O.plan_definition_json(elems(s, d)),
    "fhir_activities": lambda s, d: O.activities(elems(s, d)),
    "fhir_questionnaire_items": lambda s, d: O.questionnaire_items(elems(s, d)),
    "fhir_library": lambda s, d: O.library(elems(s, d).select("protocol_id").distinct().withColumn("title", F.concat(F.lit("Protocol "), F.col("protocol_id").cast("string")))),
    "fhir_issues": lambda s, d: O.fhir_issues(_resources(s, d)),
    "fhir_dangling_refs": lambda s, d: O.plan_actions(elems(s, d)).filter("definition is not null").select("protocol_id", "definition").join(O.activities(elems(s, d)).filter("lower(title) not like '%biopsy%'").select(F.concat(F.lit("ActivityDefinition/"), "id").alias("definition")).distinct(), "definition", "left_anti"),
    "omop_issues": _issues,
    "omop_required_issues": lambda s, d: _issues(s, d).filter("issue like 'Missing%'"),
    "omop_unmapped_tables": lambda s, d: _issues(s, d).groupBy("table_name").agg(F.count_if(F.col("issue").startswith("Unmapped")).alias("unmapped")).filter("unmapped > 0"),
    "issue_severity": lambda s, d: _issues(s, d).groupBy(O.severity(F.col("issue")).alias("severity")).agg(F.count("*").alias("n")),
    "validation_report": lambda s, d: O.report(_issues(s, d)),
    "consistency_counts": lambda s, d: C.consistency(elems(s, d), unit_concept),
    "omop_convert_issues": lambda s, d: C.omop_convert(elems(s, d), unit_concept)["issues"],
    "omop_convert_summary": lambda s, d: C.omop_convert(elems(s, d), unit_concept)["summary"],
    "omop_convert_sql": lambda s, d: C.omop_convert(elems(s, d), unit_concept, "sqlite")["sql"],
    "fhir_convert": lambda s, d: C.fhir_resources(elems(s, d)),
    "fhir_convert_issues": lambda s, d: C.fhir_convert(elems(s, d))["issues"],
    "issues_of_both_standards": _both,
    "recommendations": lambda s, d: C.recommendations(_both_rows(s, d)),
    "protocol_report": _report,
    "entity_scores": lambda s, d: W.entity_scores(_judged_tags(s, d)),
    "aligned_labels": _aligned,
    "named_tags": lambda s, d: W.named_tags(ids(s, d).select("doc_id", F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train").alias("split"), (F.col("doc_id") % 12).cast("string").alias("tag"))),
    "confidence_rollup": _rollup,
    "protocol_summary": _summary,
    "monitor_metrics": _monitor,
    "job_progress": _progress,
    "entity_colors": _colors,
}

_ANY = lambda words: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
_ROWS = f"SELECT protocol_id, doc_id, kind, ctype, text, code, dosage, quantity, units, low FROM ({MAPPED_SQL})"


def _numbered(rows: str, name: str) -> str:
    return f"SELECT * EXCLUDE (source, doc_id), CAST(row_number() OVER (PARTITION BY protocol_id ORDER BY source, doc_id) AS INTEGER) AS {name} FROM ({rows})"


_CONDITION = _numbered(f"SELECT protocol_id, doc_id, 0 AS source, 0 AS condition_concept_id, code AS condition_source_code, CASE WHEN ctype = 'inclusion' THEN {INCLUSION} ELSE {EXCLUSION} END AS condition_type_concept_id, text AS condition_source_value FROM ({_ROWS}) WHERE kind = 'eligibility_criteria'", "condition_occurrence_id")
_HASHED = "'activity-' || coalesce(code, substring(md5(text), 1, 8))"
_ACTIONS = _numbered(f"SELECT protocol_id, doc_id, 0 AS source, CASE WHEN ctype = 'inclusion' THEN 'Inclusion Criterion' ELSE 'Exclusion Criterion' END AS title, text AS description, 'applicability' AS condition_kind, CAST(NULL AS VARCHAR) AS definition FROM ({_ROWS}) WHERE kind = 'eligibility_criteria' UNION ALL SELECT protocol_id, doc_id, 1, text, NULL, NULL, 'ActivityDefinition/' || {_HASHED} FROM ({_ROWS}) WHERE kind = 'procedures'", "action_no")
_ACTIVITIES = f"SELECT protocol_id, doc_id, {_HASHED} AS id, 'draft' AS status, CASE WHEN kind = 'procedures' THEN 'ServiceRequest' ELSE 'MedicationRequest' END AS kind, text AS title FROM ({_ROWS}) WHERE kind IN ('procedures', 'medications')"

ORACLES = {
    "omop_condition_counts": f"SELECT condition_type_concept_id, condition_source_code IS NOT NULL AS mapped, count(*) AS n, count(DISTINCT condition_source_code) AS codes FROM ({_CONDITION}) GROUP BY 1, 2",
    "omop_condition_occurrence": _CONDITION,
    "omop_drug_exposure": _numbered(f"SELECT protocol_id, doc_id, 0 AS source, 0 AS drug_concept_id, code AS drug_source_code, {PROTOCOL} AS drug_type_concept_id, dosage AS sig, text AS drug_source_value FROM ({_ROWS}) WHERE kind = 'medications'", "drug_exposure_id"),
    "omop_procedure_occurrence": _numbered(f"SELECT protocol_id, doc_id, 0 AS source, 0 AS procedure_concept_id, code AS procedure_source_code, {PROTOCOL} AS procedure_type_concept_id, TRY_CAST(quantity AS INTEGER) AS quantity, text AS procedure_source_value FROM ({_ROWS}) WHERE kind = 'procedures'", "procedure_occurrence_id"),
    "omop_observation": _numbered(f"SELECT protocol_id, doc_id, 0 AS source, 0 AS observation_concept_id, code AS observation_source_code, {PROTOCOL} AS observation_type_concept_id, 'Protocol Endpoint' AS value_as_string, text AS observation_source_value FROM ({_ROWS}) WHERE kind = 'endpoints' UNION ALL SELECT protocol_id, doc_id, 2, 0, code, {PROTOCOL}, ctype || ' criterion', text FROM ({_ROWS}) WHERE kind = 'eligibility_criteria' AND NOT {_ANY(CONDITION_WORDS)} AND {_ANY(OBSERVATION_WORDS)}", "observation_id"),
    "omop_measurement": _numbered(f"SELECT protocol_id, doc_id, 0 AS source, 0 AS measurement_concept_id, code AS measurement_source_code, {PROTOCOL} AS measurement_type_concept_id, {unit_sql('units')} AS unit_concept_id, low AS range_low, low + 10 AS range_high, text AS measurement_source_value, units AS unit_source_value, CAST(NULL AS VARCHAR) AS value_source_value FROM ({_ROWS}) WHERE kind = 'measurements' UNION ALL SELECT protocol_id, doc_id, 1, 0, code, {PROTOCOL}, NULL, NULL, NULL, text, NULL, 'Protocol Endpoint' FROM ({_ROWS}) WHERE kind = 'endpoints' AND {_ANY(LAB_WORDS)}", "measurement_id"),
    "omop_device_exposure": _numbered(f"SELECT protocol_id, doc_id, 0 AS source, 0 AS device_concept_id, code AS device_source_code, {PROTOCOL} AS device_type_concept_id, text AS device_source_value, TRY_CAST(quantity AS INTEGER) AS quantity FROM ({_ROWS}) WHERE kind = 'devices' UNION ALL SELECT protocol_id, doc_id, 1, 0, code, {PROTOCOL}, lower(text), TRY_CAST(quantity AS INTEGER) FROM ({_ROWS}) WHERE kind = 'procedures' AND {_ANY(DEVICE_WORDS)}", "device_exposure_id"),
    "omop_specimen": _numbered(f"SELECT protocol_id, doc_id, 0 AS source, 0 AS specimen_concept_id, code AS specimen_source_code, {PROTOCOL} AS specimen_type_concept_id, TRY_CAST(quantity AS INTEGER) AS quantity, CASE {' '.join(f'WHEN contains(lower(text), {chr(39)}{w}{chr(39)}) THEN {chr(39)}{n}{chr(39)}' for w, n in SPECIMEN_TYPES)} ELSE 'Unknown' END AS specimen_source_value, CASE {' '.join(f'WHEN contains(lower(text), {chr(39)}{w}{chr(39)}) THEN {chr(39)}{w}{chr(39)}' for w in BODY_SITES)} END AS anatomic_site_source_value FROM ({_ROWS}) WHERE kind = 'procedures' AND {_ANY(SPECIMEN_WORDS)}", "specimen_id"),
    "omop_sql_insert": f"SELECT protocol_id, 'INSERT INTO condition_occurrence ({', '.join(_IN)}) VALUES (' || condition_occurrence_id || ', ' || condition_concept_id || ', ' || condition_type_concept_id || ', ''' || replace(condition_source_value, '''', '''''') || ''');' AS statement FROM ({_CONDITION})",
    "fhir_plan_actions": _ACTIONS,
    "fhir_activities": _ACTIVITIES,
    "fhir_questionnaire_items": f"SELECT protocol_id, p || '-' || n AS link_id, text, type, unit FROM ({_numbered(f'SELECT protocol_id, doc_id, 0 AS source, {chr(39)}endpoint{chr(39)} AS p, text, {chr(39)}string{chr(39)} AS type, CAST(NULL AS VARCHAR) AS unit FROM ({ELEMENTS_SQL}) WHERE kind = {chr(39)}endpoints{chr(39)} UNION ALL SELECT protocol_id, doc_id, 1, {chr(39)}measurement{chr(39)}, text, {chr(39)}decimal{chr(39)}, units FROM ({ELEMENTS_SQL}) WHERE kind = {chr(39)}measurements{chr(39)}', 'n')})",
    "fhir_library": f"SELECT DISTINCT protocol_id, 'Logic for Protocol ' || protocol_id AS title, 'draft' AS status, 'logic-library' AS type_code FROM ({ELEMENTS_SQL})",
    "fhir_issues": f"WITH r AS ({_RES}) {_FHIR_ISSUES}",
    "fhir_dangling_refs": f"SELECT protocol_id, definition FROM ({_ACTIONS}) WHERE definition IS NOT NULL AND definition NOT IN (SELECT 'ActivityDefinition/' || id FROM ({_ACTIVITIES}) WHERE lower(title) NOT LIKE '%biopsy%')",
    "omop_issues": _OMOP_ISSUES,
    "omop_required_issues": f"SELECT * FROM ({_OMOP_ISSUES}) WHERE issue LIKE 'Missing%'",
    "omop_unmapped_tables": f"SELECT table_name, count(*) AS unmapped FROM ({_OMOP_ISSUES}) WHERE issue LIKE 'Unmapped%' GROUP BY 1",
    "issue_severity": f"SELECT CASE WHEN lower(issue) LIKE '%missing required%' THEN 'Error' ELSE 'Warning' END AS severity, count(*) AS n FROM ({_OMOP_ISSUES}) GROUP BY 1",
    "validation_report": f"SELECT count(*) AS total, count(*) FILTER (issue LIKE 'Missing required%') AS errors, count(*) FILTER (issue NOT LIKE 'Missing required%') AS warnings, count(*) FILTER (issue LIKE 'Missing required%') AS missing, count(*) FILTER (issue LIKE '%should be%') AS invalid, count(*) FILTER (issue LIKE 'Unmapped%') AS unmapped, 'Add the missing required fields.' AS recommendation FROM ({_OMOP_ISSUES})",
    "consistency_counts": f"""SELECT category, f AS fhir, o AS omop, f = o AS consistent FROM (SELECT CASE kind WHEN 'eligibility_criteria' THEN 'conditions' ELSE kind END AS category, count(*) AS f, count(*) AS o FROM ({ELEMENTS_SQL}) WHERE kind IN ('eligibility_criteria', 'procedures', 'medications') GROUP BY 1
        UNION ALL SELECT 'observations', (SELECT count(*) FROM ({ELEMENTS_SQL}) WHERE kind IN ('endpoints', 'measurements')), (SELECT count(*) FROM ({ELEMENTS_SQL}) WHERE kind = 'endpoints' OR (kind = 'eligibility_criteria' AND NOT {_ANY(CONDITION_WORDS)} AND {_ANY(OBSERVATION_WORDS)})))""",
    "confidence_rollup": f"SELECT coalesce(label, 'ALL') AS label, round(avg(confidence), 6) AS mean, count(*) AS n FROM ({N.ENTITIES_SQL}) GROUP BY ROLLUP (label)",
    "protocol_summary": "SELECT protocol_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("eligibility_criteria", "procedures", "medications", "endpoints")) + f", count(*) AS total FROM ({ELEMENTS_SQL}) GROUP BY 1",
    "monitor_metrics": f"SELECT round(avg((doc_id % 9 + 1) / 10), 6) AS mean_seconds, round(avg(c), 6) AS mean_confidence, round(avg(n), 6) AS mean_entities, round(count(*) FILTER (doc_id % 10 = 0) / (greatest(1, count(*)) + count(*) FILTER (doc_id % 10 = 0)), 6) AS error_rate FROM (SELECT doc_id, count(*) AS n, avg(confidence) AS c FROM ({N.ENTITIES_SQL}) GROUP BY 1)",
    "job_progress": "SELECT doc_id, {0}[doc_id % 6 + 1] AS state, {1}[doc_id % 6 + 1] AS progress FROM documents WHERE doc_id IS NOT NULL".format(list(JOB_PROGRESS), list(JOB_PROGRESS.values())),
    "entity_colors": f"SELECT tag AS label, CASE regexp_replace(tag, '^[BI]-', '') {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in COLORS.items())} ELSE '{OTHER_COLOR}' END AS color, count(*) AS n FROM ({N.TAGS_SQL}) GROUP BY 1",
}

# what builds on the SQL of the seven tables
_TABLES = {x: ORACLES[f"omop_{x}"] for x in O.OMOP_SCHEMAS}
_CONCEPT = {x: next(n for n, _, need in O.OMOP_SCHEMAS[x] if need and n.endswith("_concept_id") and "type" not in n) for x in _TABLES}
_CONVERTED = " UNION ALL ".join(f"SELECT '{x}' AS table_name, protocol_id, {x}_id AS record, 'Warning' AS severity, 'Unmapped concept: {_CONCEPT[x]}' AS issue FROM ({q})" for x, q in _TABLES.items())
_MADE = {
    "condition_occurrence": "condition_occurrence_id condition_concept_id condition_type_concept_id condition_source_value", "drug_exposure": "drug_exposure_id drug_concept_id drug_type_concept_id sig drug_source_value",
    "procedure_occurrence": "procedure_occurrence_id procedure_concept_id procedure_type_concept_id quantity procedure_source_value", "observation": "observation_id observation_concept_id observation_type_concept_id value_as_string observation_source_value",
    "measurement": "measurement_id measurement_concept_id measurement_type_concept_id unit_concept_id range_low range_high measurement_source_value unit_source_value value_source_value",
    "device_exposure": "device_exposure_id device_concept_id device_type_concept_id quantity device_source_value", "specimen": "specimen_id specimen_concept_id specimen_type_concept_id quantity specimen_source_value anatomic_site_source_value",
}


def _literal(column: str) -> str:
    quoted = f"'''' || replace({column}, '''', '''''') || ''''"
    text = column in ("sig", "value_as_string") or column.endswith("_source_value")
    return f"CASE WHEN {column} IS NULL THEN 'NULL' ELSE {quoted if text else f'CAST({column} AS VARCHAR)'} END"


def _insert(table: str) -> str:
    names = _MADE[table].split()
    values = " || ', ' || ".join(map(_literal, names))
    return f"SELECT '{table}' AS table_name, 'insert' AS kind, protocol_id, {table}_id AS record, 'INSERT INTO {table} ({', '.join(names)}) VALUES (' || {values} || ');' AS statement FROM ({_TABLES[table]})"


_FIXED = [("_preamble", "setup", "PRAGMA foreign_keys = ON;")] + [(x, "create", O.create_table_sql(x, "sqlite")) for x in _TABLES] + [(x, "index", f"-- CREATE INDEX idx_{x}_{f} ON {x}({f});") for x, fs in C.INDEXED.items() for f in fs]
_FIXED_SQL = " UNION ALL ".join(f"SELECT '{x}' AS table_name, '{k}' AS kind, CAST(NULL AS BIGINT) AS protocol_id, CAST(NULL AS INTEGER) AS record, '{t}' AS statement" for x, k, t in _FIXED)


def _json(column: str) -> str:
    return f"CAST(to_json({column}) AS VARCHAR)"


def _field(name: str, column: str) -> str:
    """A field that is left out if the column is null."""
    return f"""coalesce(',"{name}":' || {_json(column)}, '')"""


def _coded(system: str, code: str) -> str:
    return '{"coding":[{"system":"http://terminology.hl7.org/CodeSystem/' + system + '","code":"' + code + '"}]}'


def _head(kind: str, id_: str) -> str:
    return f"""'{{"resourceType":"{kind}","id":' || {_json(id_)} || ',"status":"draft"'"""


_CONDITION_JSON = f"""CASE WHEN condition_kind IS NULL THEN '' ELSE ',"condition":[{{"kind":' || {_json('condition_kind')} || ',"expression":{{"language":"text/plain","expression":' || {_json('description')} || '}}}}]' END"""
_ACTION = f"""'{{"title":' || {_json('title')} || {_field('description', 'description')} || {_CONDITION_JSON} || {_field('definitionCanonical', 'definition')} || '}}'"""
_SHORT = f"""'{{"title":' || {_json('title')} || {_field('description', 'description')} || {_field('definitionCanonical', 'definition')} || '}}'"""
_ITEM = f"""'{{"linkId":' || {_json('link_id')} || ',"text":' || {_json('text')} || ',"type":' || {_json('type')} || '}}'"""
_IDS = f"SELECT DISTINCT protocol_id FROM ({ELEMENTS_SQL})"
_PLAN_ID, _FORM_ID, _LIBRARY_ID = ("'" + x + "-' || p.protocol_id" for x in ("plan", "questionnaire", "library"))
_RESOURCES_SQL = f"""SELECT p.protocol_id, 'PlanDefinition' AS resource_type, {_PLAN_ID} AS id, CAST(0 AS INTEGER) AS no, {_head('PlanDefinition', _PLAN_ID)} || ',"type":{_coded('plan-definition-type', 'protocol')}' || coalesce(',"action":[' || a || ']', '') || '}}' AS resource
    FROM ({_IDS}) p LEFT JOIN (SELECT protocol_id, string_agg({_ACTION}, ',' ORDER BY action_no) AS a FROM ({_ACTIONS}) GROUP BY 1) x ON p.protocol_id = x.protocol_id
UNION ALL SELECT protocol_id, 'ActivityDefinition', id, CAST(row_number() OVER (PARTITION BY protocol_id ORDER BY doc_id) - 1 AS INTEGER), {_head('ActivityDefinition', 'id')} || ',"kind":' || {_json('kind')} || ',"title":' || {_json('title')} || '}}' FROM ({_ACTIVITIES})
UNION ALL SELECT p.protocol_id, 'Library', {_LIBRARY_ID}, 0, {_head('Library', _LIBRARY_ID)} || ',"type":{_coded('library-type', 'logic-library')},"title":"Logic for Protocol ' || p.protocol_id || '"}}' FROM ({_IDS}) p
UNION ALL SELECT p.protocol_id, 'Questionnaire', {_FORM_ID}, 0, {_head('Questionnaire', _FORM_ID)} || coalesce(',"item":[' || i || ']', '') || '}}'
    FROM ({_IDS}) p LEFT JOIN (SELECT protocol_id, string_agg({_ITEM}, ',' ORDER BY link_id, text, type) AS i FROM ({ORACLES['fhir_questionnaire_items']}) GROUP BY 1) x ON p.protocol_id = x.protocol_id"""
_BOTH_ROWS = f"SELECT 'FHIR' AS standard, issue FROM (WITH r AS ({_RES}) {_FHIR_ISSUES}) UNION ALL SELECT 'OMOP CDM', issue FROM ({_OMOP_ISSUES})"
_FOUND_RELATIONS = N.relations_sql(N.pairs_sql(f"SELECT doc_id, e, label, start, stop FROM ({EXTRACTED_SQL})"), CLEANED_SQL)
ORACLES |= {
    "omop_convert_issues": _CONVERTED,
    "omop_convert_summary": "SELECT table_name, records, CAST(0 AS BIGINT) AS errors, CAST(CASE WHEN records > 0 THEN 1 ELSE 0 END AS BIGINT) AS warnings, records > 0 AS with_data FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS table_name, count(*) AS records FROM ({q})" for x, q in _TABLES.items()) + ")",
    "omop_convert_sql": " UNION ALL ".join([_FIXED_SQL, *map(_insert, _TABLES)]),
    "fhir_convert": _RESOURCES_SQL,
    "fhir_convert_issues": "SELECT CAST(0 AS BIGINT) AS protocol_id, '' AS resource_type, CAST(0 AS INTEGER) AS no, '' AS issue WHERE false",
    "fhir_plan_definition_json": f"""SELECT protocol_id, '{{"resourceType":"PlanDefinition","id":"plan-' || protocol_id || '","status":"draft","action":[' || string_agg({_SHORT}, ',' ORDER BY action_no) || ']}}' AS resource FROM ({_ACTIONS}) GROUP BY protocol_id""",
    "issues_of_both_standards": f"SELECT DISTINCT standard, CASE standard WHEN 'FHIR' THEN split_part(issue, ' ', 1) ELSE 'procedure_occurrence' END AS place, issue FROM ({_BOTH_ROWS})",
    "recommendations": f"""WITH n AS (SELECT standard, count(*) FILTER (lower(issue) LIKE '%missing required%') AS m, count(*) FILTER (lower(issue) LIKE '%should be%') AS t, count(*) FILTER (lower(issue) LIKE '%unmapped%') AS u FROM ({_BOTH_ROWS}) GROUP BY 1)
        SELECT standard, CAST(0 AS INTEGER) AS no, 'Required ' || CASE standard WHEN 'FHIR' THEN 'elements' ELSE 'fields' END || ' are missing ' || m || ' times: add them.' AS recommendation FROM n
        UNION ALL SELECT standard, 1, 'Correct the types of ' || t || ' fields.' FROM n WHERE standard <> 'FHIR' UNION ALL SELECT standard, 2, 'Map more terms to concepts.' FROM n WHERE standard <> 'FHIR'""",
    "protocol_report": f"""WITH r AS (SELECT 'entities' AS part, label, confidence FROM ({EXTRACTED_SQL}) UNION ALL SELECT 'relations', relation, confidence FROM ({_FOUND_RELATIONS}) UNION ALL SELECT 'sections', type, confidence FROM ({SECTION_ORACLES['extract_sections']}))
        SELECT part, coalesce(label, 'ALL') AS label, count(*) AS n, round(avg(confidence), 6) AS confidence FROM r GROUP BY GROUPING SETS ((part, label), (part))""",
    "entity_scores": W.scores_sql(_JUDGED),
    "aligned_labels": "SELECT doc_id, '-100 ' || string_agg((doc_id * 3 + w) % 11 || repeat(' -100', CAST((doc_id + w) % 3 AS INTEGER)), ' ' ORDER BY w) || ' -100' AS labels FROM (SELECT doc_id, unnest(range(0, 5)) AS w FROM documents WHERE doc_id IS NOT NULL) GROUP BY doc_id",
    "named_tags": f"WITH n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split, {W.TAG_NAMES}[doc_id % 12 + 1] AS tag FROM documents WHERE doc_id IS NOT NULL) SELECT * FROM n UNION ALL SELECT doc_id, 'test', tag FROM n WHERE split = 'validation'",
}
