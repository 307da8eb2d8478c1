"""OMOP CDM 5.4 tables and FHIR R4 resources from protocol elements, and their validation.

Vocabulary codes are kept as source codes: concept ids stay 0 unless a concept
map gives one. Record ids count within a protocol, so nothing needs a global order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protolake.operators.terms import map_exact
from protolake.refdata import (
    BODY_SITES, CONDITION_WORDS, DEVICE_WORDS, EXCLUSION, INCLUSION, LAB_WORDS, OBSERVATION_WORDS, PROTOCOL, SPECIMEN_TYPES, SPECIMEN_WORDS,
)

# fixed values: fields of the CDM tables (name, type, required)
_OCCURRENCE = [("person_id", "integer", False)]
OMOP_SCHEMAS = {
    "condition_occurrence": [("condition_occurrence_id", "integer", True), *_OCCURRENCE, ("condition_concept_id", "integer", True), ("condition_start_date", "date", False), ("condition_start_datetime", "datetime", False), ("condition_end_date", "date", False), ("condition_end_datetime", "datetime", False), ("condition_type_concept_id", "integer", True), ("condition_status_concept_id", "integer", False), ("stop_reason", "string", False), ("provider_id", "integer", False), ("visit_occurrence_id", "integer", False), ("visit_detail_id", "integer", False), ("condition_source_value", "string", False), ("condition_source_concept_id", "integer", False), ("condition_status_source_value", "string", False)],
    "drug_exposure": [("drug_exposure_id", "integer", True), *_OCCURRENCE, ("drug_concept_id", "integer", True), ("drug_exposure_start_date", "date", False), ("drug_type_concept_id", "integer", True), ("quantity", "float", False), ("days_supply", "integer", False), ("sig", "string", False), ("route_source_value", "string", False), ("drug_source_value", "string", False)],
    "procedure_occurrence": [("procedure_occurrence_id", "integer", True), *_OCCURRENCE, ("procedure_concept_id", "integer", True), ("procedure_date", "date", False), ("procedure_type_concept_id", "integer", True), ("quantity", "integer", False), ("procedure_source_value", "string", False)],
    "observation": [("observation_id", "integer", True), *_OCCURRENCE, ("observation_concept_id", "integer", True), ("observation_date", "date", False), ("observation_type_concept_id", "integer", True), ("value_as_string", "string", False), ("observation_source_value", "string", False), ("observation_source_concept_id", "integer", False)],
    "measurement": [("measurement_id", "integer", True), *_OCCURRENCE, ("measurement_concept_id", "integer", True), ("measurement_date", "date", False), ("measurement_type_concept_id", "integer", True), ("value_as_number", "float", False), ("unit_concept_id", "integer", False), ("range_low", "float", False), ("range_high", "float", False), ("measurement_source_value", "string", False), ("unit_source_value", "string", False), ("value_source_value", "string", False)],
    "device_exposure": [("device_exposure_id", "integer", True), *_OCCURRENCE, ("device_concept_id", "integer", True), ("device_exposure_start_date", "date", False), ("device_type_concept_id", "integer", True), ("quantity", "integer", False), ("device_source_value", "string", False)],
    "specimen": [("specimen_id", "integer", True), *_OCCURRENCE, ("specimen_concept_id", "integer", True), ("specimen_type_concept_id", "integer", True), ("specimen_date", "date", False), ("quantity", "float", False), ("specimen_source_value", "string", False), ("anatomic_site_source_value", "string", False), ("disease_status_source_value", "string", False)],
}


def holds(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """A dense id within each protocol: producers in turn, elements in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("protocol_id").orderBy("source", "doc_id"))).drop("source", "doc_id")


def _of(df: DataFrame, kind: str, source: int = 0) -> DataFrame:
    return df.filter(F.col("kind") == kind).withColumn("source", F.lit(source))


def condition_occurrence(elements: DataFrame) -> DataFrame:
    rows = _of(map_exact(elements), "eligibility_criteria").filter("text is not null")
    kind = F.when(F.lower("ctype") == "inclusion", INCLUSION).otherwise(EXCLUSION)
    return numbered(rows.select("protocol_id", "doc_id", "source", F.lit(0).alias("condition_concept_id"), F.col("code").alias("condition_source_code"), kind.alias("condition_type_concept_id"), F.col("text").alias("condition_source_value")), "condition_occurrence_id")


def drug_exposure(elements: DataFrame) -> DataFrame:
    rows = _of(map_exact(elements), "medications")
    return numbered(rows.select("protocol_id", "doc_id", "source", F.lit(0).alias("drug_concept_id"), F.col("code").alias("drug_source_code"), F.lit(PROTOCOL).alias("drug_type_concept_id"), F.col("dosage").alias("sig"), F.col("text").alias("drug_source_value")), "drug_exposure_id")


def procedure_occurrence(elements: DataFrame) -> DataFrame:
    rows = _of(map_exact(elements), "procedures")
    return numbered(rows.select("protocol_id", "doc_id", "source", F.lit(0).alias("procedure_concept_id"), F.col("code").alias("procedure_source_code"), F.lit(PROTOCOL).alias("procedure_type_concept_id"), F.col("quantity").try_cast("int").alias("quantity"), F.col("text").alias("procedure_source_value")), "procedure_occurrence_id")


def observation(elements: DataFrame) -> DataFrame:
    rows = map_exact(elements)
    cols = lambda value: ["protocol_id", "doc_id", "source", F.lit(0).alias("observation_concept_id"), F.col("code").alias("observation_source_code"), F.lit(PROTOCOL).alias("observation_type_concept_id"), value.alias("value_as_string"), F.col("text").alias("observation_source_value")]
    endpoints = _of(rows, "endpoints").select(*cols(F.lit("Protocol Endpoint")))
    criteria = _of(rows, "eligibility_criteria", 2).filter(~holds(F.col("text"), CONDITION_WORDS) & holds(F.col("text"), OBSERVATION_WORDS)).select(*cols(F.concat("ctype", F.lit(" criterion"))))
    return numbered(endpoints.unionByName(criteria), "observation_id")


def measurement(elements: DataFrame, unit_concept) -> DataFrame:
    rows = map_exact(elements)
    cols = lambda unit, low, units, value: ["protocol_id", "doc_id", "source", F.lit(0).alias("measurement_concept_id"), F.col("code").alias("measurement_source_code"), F.lit(PROTOCOL).alias("measurement_type_concept_id"), unit.alias("unit_concept_id"), low.alias("range_low"), (low + 10).alias("range_high"), F.col("text").alias("measurement_source_value"), units.alias("unit_source_value"), value.alias("value_source_value")]
    null = lambda kind: F.lit(None).cast(kind)
    measured = _of(rows, "measurements").select(*cols(unit_concept(F.col("units")), F.col("low"), F.col("units"), null("string")))
    labs = _of(rows, "endpoints", 1).filter(holds(F.col("text"), LAB_WORDS)).select(*cols(null("int"), null("double"), null("string"), F.lit("Protocol Endpoint")))
    return numbered(measured.unionByName(labs), "measurement_id")


def device_exposure(elements: DataFrame) -> DataFrame:
    rows = map_exact(elements)
    cols = lambda text: ["protocol_id", "doc_id", "source", F.lit(0).alias("device_concept_id"), F.col("code").alias("device_source_code"), F.lit(PROTOCOL).alias("device_type_concept_id"), text.alias("device_source_value"), F.col("quantity").try_cast("int").alias("quantity")]
    devices = _of(rows, "devices").select(*cols(F.col("text")))
    procedures = _of(rows, "procedures", 1).filter(holds(F.col("text"), DEVICE_WORDS)).select(*cols(F.lower("text")))
    return numbered(devices.unionByName(procedures), "device_exposure_id")


def specimen(elements: DataFrame) -> DataFrame:
    rows = _of(map_exact(elements), "procedures").filter(holds(F.col("text"), SPECIMEN_WORDS))
    t, kind, site = F.lower("text"), F.lit("Unknown"), F.lit(None).cast("string")
    for word, name in reversed(SPECIMEN_TYPES):
        kind = F.when(F.contains(t, F.lit(word)), name).otherwise(kind)
    for s in reversed(BODY_SITES):
        site = F.when(F.contains(t, F.lit(s)), s).otherwise(site)
    return numbered(rows.select("protocol_id", "doc_id", "source", F.lit(0).alias("specimen_concept_id"), F.col("code").alias("specimen_source_code"), F.lit(PROTOCOL).alias("specimen_type_concept_id"), F.col("quantity").try_cast("int").alias("quantity"), kind.alias("specimen_source_value"), site.alias("anatomic_site_source_value")), "specimen_id")


_SQL_TYPES = {
    "sqlite": {"integer": "INTEGER", "float": "REAL", "string": "TEXT", "date": "TEXT", "datetime": "TEXT"},
    "postgresql": {"integer": "INTEGER", "float": "FLOAT", "string": "VARCHAR(255)", "date": "DATE", "datetime": "TIMESTAMP WITH TIME ZONE"},
    "mysql": {"integer": "INT", "float": "FLOAT", "string": "VARCHAR(255)", "date": "DATE", "datetime": "DATETIME"},
    "mssql": {"integer": "INT", "float": "FLOAT", "string": "NVARCHAR(255)", "date": "DATE", "datetime": "DATETIME2"},
}


def create_table_sql(table: str, dialect: str = "postgresql") -> str:
    """CREATE TABLE of a CDM table in one of four dialects; the first field is the key."""
    kinds = _SQL_TYPES[dialect]
    fields = [f"    {n} {kinds[k]}{' NOT NULL' if need else ''}{' PRIMARY KEY' if i == 0 else ''}" for i, (n, k, need) in enumerate(OMOP_SCHEMAS[table])]
    return f"CREATE TABLE {table} (\n" + ",\n".join(fields) + "\n);"


def insert_sql(table: str, df: DataFrame, columns: list[str], keep: list[Column] | None = None) -> DataFrame:
    """One INSERT statement for each row; quotes doubled, nulls as NULL."""
    quoted = lambda c: F.when(F.col(c).isNull(), F.lit("NULL")).otherwise(F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("''")), F.lit("'")) if dict(df.dtypes)[c] == "string" else F.col(c).cast("string"))
    return df.select("protocol_id", *(keep or []), F.concat(F.lit(f"INSERT INTO {table} ({', '.join(columns)}) VALUES ("), F.concat_ws(", ", *[quoted(c) for c in columns]), F.lit(");")).alias("statement"))


def activity_id(code: Column, title: Column) -> Column:
    """From the code, else from a hash of the title: the same on every run, so references to it hold."""
    return F.concat(F.lit("activity-"), F.coalesce(code, F.substring(F.md5(title), 1, 8)))


def plan_actions(elements: DataFrame) -> DataFrame:
    """Actions of each protocol's PlanDefinition: criteria, then procedures with a reference to their ActivityDefinition."""
    rows = map_exact(elements)
    criteria = _of(rows, "eligibility_criteria").select("protocol_id", "doc_id", "source", F.when(F.col("ctype") == "inclusion", "Inclusion Criterion").otherwise("Exclusion Criterion").alias("title"), F.col("text").alias("description"), F.lit("applicability").alias("condition_kind"), F.lit(None).cast("string").alias("definition"))
    steps = _of(rows, "procedures", 1).select("protocol_id", "doc_id", "source", F.col("text").alias("title"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("condition_kind"), F.concat(F.lit("ActivityDefinition/"), activity_id(F.col("code"), F.col("text"))).alias("definition"))
    return numbered(criteria.unionByName(steps), "action_no")


def activities(elements: DataFrame) -> DataFrame:
    """ActivityDefinitions: a ServiceRequest for each procedure, a MedicationRequest for each medication."""
    rows = map_exact(elements).filter(F.col("kind").isin("procedures", "medications"))
    return rows.select("protocol_id", "doc_id", activity_id(F.col("code"), F.col("text")).alias("id"), F.lit("draft").alias("status"), F.when(F.col("kind") == "procedures", "ServiceRequest").otherwise("MedicationRequest").alias("kind"), F.col("text").alias("title"))


def questionnaire_items(elements: DataFrame) -> DataFrame:
    """Items: endpoints as strings, then measurements as decimals with their unit; one counter for both."""
    ends = _of(elements, "endpoints").select("protocol_id", "doc_id", "source", F.lit("endpoint").alias("p"), "text", F.lit("string").alias("type"), F.lit(None).cast("string").alias("unit"))
    measured = _of(elements, "measurements", 1).select("protocol_id", "doc_id", "source", F.lit("measurement").alias("p"), "text", F.lit("decimal").alias("type"), F.col("units").alias("unit"))
    return numbered(ends.unionByName(measured), "n").select("protocol_id", F.concat("p", F.lit("-"), F.col("n").cast("string")).alias("link_id"), "text", "type", "unit")


def library(protocols: DataFrame) -> DataFrame:
    """protocol_id, title: a Library of each."""
    return protocols.select("protocol_id", F.concat(F.lit("Logic for "), "title").alias("title"), F.lit("draft").alias("status"), F.lit("logic-library").alias("type_code"))


def plan_definition_json(elements: DataFrame) -> DataFrame:
    """Each protocol's PlanDefinition as JSON, actions in order."""
    action = F.struct("action_no", "title", "description", F.col("definition").alias("definitionCanonical"))
    rows = plan_actions(elements).groupBy("protocol_id").agg(F.array_sort(F.collect_list(action)).alias("action"))
    resource = F.struct(F.lit("PlanDefinition").alias("resourceType"), F.concat(F.lit("plan-"), F.col("protocol_id").cast("string")).alias("id"), F.lit("draft").alias("status"), F.transform("action", lambda a: a.dropFields("action_no")).alias("action"))
    return rows.select("protocol_id", F.to_json(resource).alias("resource"))


FHIR_REQUIRED = {"PlanDefinition": ["status"], "ActivityDefinition": ["status", "kind"], "Library": ["status", "type"], "Questionnaire": ["status"]}
FHIR_STATUS = ["draft", "active", "retired", "unknown"]
FHIR_KINDS = ["ServiceRequest", "MedicationRequest", "Task", "Appointment"]


def fhir_issues(resources: DataFrame) -> DataFrame:
    """resources: rid, resource_type, status, kind, type; one row for each missing element or value that is not allowed."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = [F.when((F.col("resource_type") == r) & empty(e), F.lit(f"{r} missing required element: {e}")) for r, es in FHIR_REQUIRED.items() for e in es]
    checks += [F.when(~empty("status") & ~F.col("status").isin(FHIR_STATUS), F.concat("resource_type", F.lit(" has invalid status: "), "status")), F.when((F.col("resource_type") == "ActivityDefinition") & ~empty("kind") & ~F.col("kind").isin(FHIR_KINDS), F.concat(F.lit("ActivityDefinition has invalid kind: "), "kind"))]
    return resources.select("rid", F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def omop_issues(table: str, rows: DataFrame, key: str) -> DataFrame:
    """rows with string columns: required fields that are missing, values that do not cast, concept ids of 0."""
    checks = []
    for name, kind, required in OMOP_SCHEMAS[table]:
        if required and name not in rows.columns:
            checks.append(F.lit(f"Missing required field: {name}"))
        if name in rows.columns:
            c = F.col(name).cast("string")
            if required:
                checks.append(F.when(c.isNull(), F.lit(f"Missing required field: {name}")))
            if kind in ("integer", "float"):
                checks.append(F.when(c.isNotNull() & c.try_cast("int" if kind == "integer" else "double").isNull(), F.lit(f"{name} should be {kind}")))
            if kind in ("date", "datetime"):
                from protolake.functions.text import is_valid_date

                checks.append(F.when(c.isNotNull() & ~is_valid_date(c), F.lit(f"{name} should be {kind}")))
            if name.endswith("_concept_id") and required and "type" not in name:
                checks.append(F.when(c == "0", F.lit(f"Unmapped concept: {name}")))
    return rows.select(key, F.lit(table).alias("table_name"), F.explode(F.array_compact(F.array(*checks))).alias("issue"))


def severity(issue: Column) -> Column:
    return F.when(F.contains(F.lower(issue), F.lit("missing required")), "Error").otherwise("Warning")


def report(issues: DataFrame) -> DataFrame:
    """Issues, errors, warnings and one recommendation by what was found first."""
    n = lambda word: F.count_if(F.contains(F.lower("issue"), F.lit(word)))
    sums = issues.agg(F.count("*").alias("total"), F.count_if(severity(F.col("issue")) == "Error").alias("errors"), F.count_if(severity(F.col("issue")) == "Warning").alias("warnings"), n("missing required").alias("missing"), n("should be").alias("invalid"), n("unmapped").alias("unmapped"))
    advice = F.when(F.col("missing") > 0, "Add the missing required fields.").when(F.col("invalid") > 0, "Correct the types.").when(F.col("unmapped") > 0, "Map more terms to concepts.").when(F.col("total") > 0, "Look at each issue by itself.").otherwise("No issues found.")
    return sums.select("*", advice.alias("recommendation"))
