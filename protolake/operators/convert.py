"""Protocol elements to OMOP tables and FHIR resources in one go, with validation, SQL, summaries and sinks.

A conversion is a set of DataFrames over all protocols at once: nothing is
collected, and each table stays a plan of its own until it is written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protolake.operators import standards as O
from protolake.operators.terms import dictionary, mapper_statistics

CDM_VERSION, FHIR_VERSION = "5.4", "4.0.1"
# fixed values: item types of questionnaires
ITEM_TYPES = "group display boolean decimal integer date dateTime time string text url choice open-choice attachment reference quantity".split()
# fixed values: fields of commented index statements
INDEXED = {
    "condition_occurrence": ["person_id", "condition_concept_id", "condition_type_concept_id"],
    "drug_exposure": ["person_id", "drug_concept_id", "drug_type_concept_id"],
    "procedure_occurrence": ["person_id", "procedure_concept_id", "procedure_type_concept_id"],
    "observation": ["person_id", "observation_concept_id", "observation_type_concept_id"],
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def omop_tables(elements: DataFrame, unit_concept: Callable[[Column], Column]) -> dict[str, DataFrame]:
    """All seven tables."""
    makers = {x: getattr(O, x) for x in O.OMOP_SCHEMAS if x != "measurement"}
    tables = {x: f(elements) for x, f in makers.items()} | {"measurement": O.measurement(elements, unit_concept)}
    return {x: tables[x] for x in O.OMOP_SCHEMAS}


def record_key(table: str) -> str:
    return f"{table}_id"


def filled(table: str, rows: DataFrame, date: str, schema=None) -> tuple[DataFrame, DataFrame]:
    """rows with required person_id and dates that are missing filled (0, ``date``), and a warning (protocol_id, record, issue) for each."""
    warnings, out = [], rows
    for name, _, required in schema or O.OMOP_SCHEMAS[table]:
        if required and (name == "person_id" or name.endswith("_date")):
            value = F.lit(0) if name == "person_id" else F.lit(date)
            there = F.col(name).isNotNull() if name in rows.columns else F.lit(False)
            note = F.concat(F.lit(f"{table} missing {name} (using {'placeholder' if name == 'person_id' else 'protocol date'})"))
            warnings.append(rows.filter(~there).select("protocol_id", F.col(record_key(table)).alias("record"), note.alias("issue")))
            out = out.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    empty = rows.filter(F.lit(False)).select("protocol_id", F.col(record_key(table)).alias("record"), F.lit("").alias("issue"))
    return out, _union([empty, *warnings])


def omop_validation(tables: dict[str, DataFrame], date: str = "1970-01-01") -> DataFrame:
    """table_name, protocol_id, record, severity, issue of the records of all tables: missing required fields, wrong types, unmapped concepts, and warnings of what filled() fills.

    Tables that the model does not have get one error.
    """
    parts = []
    for table, rows in tables.items():
        if table not in O.OMOP_SCHEMAS:
            parts.append(rows.limit(1).select(F.lit(table).alias("table_name"), F.lit(None).cast("long").alias("protocol_id"), F.lit(None).cast("int").alias("record"), F.lit("Error").alias("severity"), F.lit(f"No schema found for table {table}").alias("issue")))
            continue
        whole, warnings = filled(table, rows, date)
        key = record_key(table)
        found = O.omop_issues(table, whole.withColumn("record", F.struct("protocol_id", key)), "record")
        parts.append(found.select("table_name", "record.protocol_id", F.col(f"record.{key}").cast("int").alias("record"), O.severity(F.col("issue")).alias("severity"), "issue"))
        parts.append(warnings.select(F.lit(table).alias("table_name"), "protocol_id", F.col("record").cast("int").alias("record"), F.lit("Warning").alias("severity"), "issue"))
    return _union(parts)


def omop_summary(tables: dict[str, DataFrame], issues: DataFrame) -> DataFrame:
    """For each table: records, distinct errors and warnings, and whether it holds data."""
    counts = _union([rows.agg(F.lit(x).alias("table_name"), F.count("*").alias("records")) for x, rows in tables.items()])
    kinds = issues.select("table_name", "severity", "issue").distinct().groupBy("table_name").agg(F.count_if(F.col("severity") == "Error").alias("errors"), F.count_if(F.col("severity") == "Warning").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return counts.join(kinds, "table_name", "left").select("table_name", "records", zero("errors"), zero("warnings"), (F.col("records") > 0).alias("with_data"))


def _columns(table: str, rows: DataFrame) -> list[str]:
    """Fields of the model that the rows have, in the model's order."""
    return [n for n, _, _ in O.OMOP_SCHEMAS[table] if n in rows.columns]


def generate_sql(tables: dict[str, DataFrame], dialect: str = "sqlite") -> DataFrame:
    """table_name, kind (setup, create, index, insert), protocol_id, record, statement for all tables; index statements are comments. Fields that the model does not have are left out."""
    spark = next(iter(tables.values())).sparkSession
    fixed = [("_preamble", "setup", "PRAGMA foreign_keys = ON;")] if dialect == "sqlite" else []
    for x in tables:
        fixed.append((x, "create", O.create_table_sql(x, dialect)))
        fixed += [(x, "index", f"-- CREATE INDEX idx_{x}_{f} ON {x}({f});") for f in INDEXED.get(x, [])]
    head = spark.createDataFrame(fixed, "table_name string, kind string, statement string").select("table_name", "kind", F.lit(None).cast("long").alias("protocol_id"), F.lit(None).cast("int").alias("record"), "statement")
    rows = []
    for x, t in tables.items():
        made = O.insert_sql(x, t, _columns(x, t), keep=[F.col(record_key(x)).cast("int").alias("record")])
        rows.append(made.select(F.lit(x).alias("table_name"), F.lit("insert").alias("kind"), "protocol_id", "record", "statement"))
    return _union([head, *rows])


def omop_convert(elements: DataFrame, unit_concept: Callable[[Column], Column], dialect: str | None = None, date: str = "1970-01-01") -> dict:
    """tables, validation (issues and summary), version, terminology statistics, and sql with a dialect."""
    tables = {x: filled(x, t, date)[0] for x, t in omop_tables(elements, unit_concept).items()}
    issues = omop_validation(tables, date)
    out = {"tables": tables, "issues": issues, "summary": omop_summary(tables, issues), "version": CDM_VERSION, "statistics": mapper_statistics(dictionary(elements.sparkSession))}
    return out | ({"sql": generate_sql(tables, dialect)} if dialect else {})


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "csv") -> list[str]:
    """One folder for each table that has rows, as csv with a header, json or parquet; the names of those written."""
    done = []
    for x, t in tables.items():
        if not t.isEmpty():
            writer = t.write.mode("overwrite")
            (writer.option("header", "true") if kind == "csv" else writer).format(kind).save(f"{path}/{x}")
            done.append(x)
    return done


def fhir_resources(elements: DataFrame) -> DataFrame:
    """protocol_id, resource_type, id, no, resource (JSON) of all protocols: a PlanDefinition, a Library and a Questionnaire each, and their ActivityDefinitions."""
    name = lambda p: F.concat(F.lit(p), F.col("protocol_id").cast("string"))
    code = lambda system, value: F.struct(F.array(F.struct(F.lit(f"http://terminology.hl7.org/CodeSystem/{system}").alias("system"), F.lit(value).alias("code"))).alias("coding"))
    protocols = elements.select("protocol_id").distinct()
    expression = F.struct(F.lit("text/plain").alias("language"), F.col("description").alias("expression"))
    condition = F.when(F.col("condition_kind").isNotNull(), F.array(F.struct(F.col("condition_kind").alias("kind"), expression.alias("expression"))))
    actions = O.plan_actions(elements).groupBy("protocol_id").agg(F.array_sort(F.collect_list(F.struct("action_no", "title", "description", condition.alias("condition"), F.col("definition").alias("definitionCanonical")))).alias("action"))
    items = O.questionnaire_items(elements).groupBy("protocol_id").agg(F.array_sort(F.collect_list(F.struct(F.col("link_id").alias("linkId"), "text", "type"))).alias("item"))

    def one(df: DataFrame, kind: str, id_: Column, rest: list[Column], no: Column = F.lit(0)) -> DataFrame:
        body = F.struct(F.lit(kind).alias("resourceType"), id_.alias("id"), F.lit("draft").alias("status"), *rest)
        return df.select("protocol_id", F.lit(kind).alias("resource_type"), id_.alias("id"), no.cast("int").alias("no"), F.to_json(body).alias("resource"))

    plans = one(protocols.join(actions, "protocol_id", "left"), "PlanDefinition", name("plan-"), [code("plan-definition-type", "protocol").alias("type"), F.transform("action", lambda a: a.dropFields("action_no")).alias("action")])
    order = F.row_number().over(Window.partitionBy("protocol_id").orderBy("doc_id")) - 1
    steps = O.activities(elements)
    acts = one(steps.withColumn("no", order), "ActivityDefinition", F.col("id"), [F.col("kind"), F.col("title")], F.col("no"))
    libraries = one(protocols, "Library", name("library-"), [code("library-type", "logic-library").alias("type"), F.concat(F.lit("Logic for Protocol "), F.col("protocol_id").cast("string")).alias("title")])
    forms = one(protocols.join(items, "protocol_id", "left"), "Questionnaire", name("questionnaire-"), [F.col("item")])
    return _union([plans, acts, libraries, forms])


_PARSED = """resourceType string, status string, kind string, action array<struct<title: string, description: string, condition: array<struct<kind: string, expression: struct<expression: string>>>>>,
    item array<struct<linkId: string, type: string>>, participant array<struct<type: string>>"""


def fhir_validation(resources: DataFrame) -> DataFrame:
    """resource rows of fhir_resources(): protocol_id, resource_type, no, issue: type, required elements, allowed values, structure of actions, conditions, participants, codings and items, and references to activities that are not there.

    The issues' texts are fixed values.
    """
    raw = lambda path: F.get_json_object("resource", f"$.{path}")
    of = lambda kind: F.col("resource_type") == kind
    held = resources.withColumn("x", F.from_json("resource", _PARSED))
    many = F.col("resource_type") == "ActivityDefinition"
    who = F.when(many, F.concat("resource_type", F.lit("["), F.col("no").cast("string"), F.lit("]"))).otherwise(F.col("resource_type"))
    say = lambda *parts: F.concat(who, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    checks = [F.when(~F.coalesce(F.col("x.resourceType"), F.lit("")).eqNullSafe(F.col("resource_type")), F.when(many, say(" has invalid resourceType")).otherwise(F.concat(F.lit("Invalid resourceType for "), "resource_type")))]
    for kind, names in O.FHIR_REQUIRED.items():
        checks += [F.when(of(kind) & (F.coalesce(raw(n), F.lit("")) == ""), say(f" missing required element: {n}")) for n in names]
    checks.append(F.when(F.col("x.status").isNotNull() & ~F.col("x.status").isin(O.FHIR_STATUS), say(" has invalid status: ", F.col("x.status"))))
    checks.append(F.when(many & F.col("x.kind").isNotNull() & ~F.col("x.kind").isin(O.FHIR_KINDS), say(" has invalid kind: ", F.col("x.kind"))))
    no_list = lambda path: raw(path).isNotNull() & ~F.startswith(raw(path), F.lit("["))
    checks += [F.when(of(kind) & no_list(path), say(f" {path} must be an array")) for kind, path in (("PlanDefinition", "action"), ("ActivityDefinition", "participant"), ("Questionnaire", "item"))]
    checks.append(F.when(of("Library") & raw("type").isNotNull() & ~F.startswith(raw("type"), F.lit("{")), say(" type must be a CodeableConcept")).when(of("Library") & raw("type").isNotNull() & ~F.coalesce(F.startswith(raw("type.coding"), F.lit("[")), F.lit(False)), say(" type.coding must be an array")))
    none = F.array().cast("array<string>")
    at = lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))
    each = lambda c, f: F.coalesce(F.flatten(F.transform(c, lambda e, i: F.array_compact(f(e, i)))), none)
    bare = lambda c: F.coalesce(c, F.lit("")) == ""
    actions = each(F.col("x.action"), lambda a, i: F.concat(F.array(F.when(bare(a["title"]) & bare(a["description"]), say(" action", at(i), " missing both title and description"))),
        F.coalesce(F.flatten(F.transform(a["condition"], lambda c, j: F.array(F.when(c["kind"].isNull(), say(" action", at(i), " condition", at(j), " missing kind")), F.when(c["expression"].isNull(), say(" action", at(i), " condition", at(j), " missing expression"))))), none)))
    items = each(F.col("x.item"), lambda q, i: F.array(F.when(q["linkId"].isNull(), say(" item", at(i), " missing linkId")), F.when(q["type"].isNull(), say(" item", at(i), " missing type")), F.when(q["type"].isNotNull() & ~q["type"].isin(ITEM_TYPES), say(" item", at(i), " has invalid type: ", q["type"]))))
    people = each(F.col("x.participant"), lambda p, i: F.array(F.when(p["type"].isNull(), say(" participant", at(i), " missing type"))))
    found = held.select("protocol_id", "resource_type", "no", F.explode(F.concat(F.array_compact(F.array(*checks)), actions, items, people)).alias("issue"))
    return found.unionByName(dangling(resources))


def dangling(resources: DataFrame) -> DataFrame:
    """Issues of plans whose actions name an ActivityDefinition that their protocol does not have."""
    named = resources.filter("resource_type = 'PlanDefinition'").withColumn("r", F.explode(F.from_json(F.get_json_object("resource", "$.action"), "array<struct<definitionCanonical: string>>"))).select("protocol_id", "no", F.col("r.definitionCanonical").alias("ref")).filter("ref is not null")
    there = resources.filter("resource_type = 'ActivityDefinition'").select("protocol_id", F.concat(F.lit("ActivityDefinition/"), "id").alias("ref")).distinct()
    return named.join(there, ["protocol_id", "ref"], "left_anti").select("protocol_id", F.lit("PlanDefinition").alias("resource_type"), "no", F.concat(F.lit("PlanDefinition has an invalid reference: "), "ref").alias("issue"))


def fhir_convert(elements: DataFrame) -> dict:
    """resources, issues, version and terminology statistics."""
    resources = fhir_resources(elements)
    return {"resources": resources, "issues": fhir_validation(resources), "version": FHIR_VERSION, "statistics": mapper_statistics(dictionary(elements.sparkSession))}


def all_issues(fhir: DataFrame, omop: DataFrame) -> DataFrame:
    """standard, place, issue of both standards' issues, each once."""
    left = fhir.select(F.lit("FHIR").alias("standard"), F.col("resource_type").alias("place"), "issue")
    right = omop.select(F.lit("OMOP CDM").alias("standard"), F.col("table_name").alias("place"), "issue")
    return left.unionByName(right).distinct()


def recommendations(issues: DataFrame) -> DataFrame:
    """issues: standard, issue (rows): standard, no, recommendation, in order, at least one for each standard.

    FHIR: missing elements, plans without actions, references; OMOP CDM: missing fields, types, unmapped concepts;
    else a general one. Standards without an issue are not in the rows.
    """
    has = lambda word: F.count_if(F.contains(F.lower("issue"), F.lit(word)))
    n = issues.groupBy("standard").agg(has("missing required").alias("missing"), has("should be").alias("types"), has("unmapped").alias("unmapped"), has("at least one action").alias("actions"), has("reference").alias("references"))
    fhir, omop = F.col("standard") == "FHIR", F.col("standard") == "OMOP CDM"
    count = lambda c: F.col(c).cast("string")
    lines = F.array_compact(F.array(
        F.when(fhir & (F.col("missing") > 0), F.concat(F.lit("Required elements are missing "), count("missing"), F.lit(" times: add them."))), F.when(fhir & (F.col("actions") > 0), F.lit("Give the PlanDefinition actions.")),
        F.when(fhir & (F.col("references") > 0), F.lit("Correct references between resources.")), F.when(omop & (F.col("missing") > 0), F.concat(F.lit("Required fields are missing "), count("missing"), F.lit(" times: add them."))),
        F.when(omop & (F.col("types") > 0), F.concat(F.lit("Correct the types of "), count("types"), F.lit(" fields."))), F.when(omop & (F.col("unmapped") > 0), F.lit("Map more terms to concepts."))))
    some = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("Look at each issue by itself.")))
    return n.select("standard", F.posexplode(some).alias("no", "recommendation"))


def consistency(elements: DataFrame, unit_concept: Callable[[Column], Column]) -> DataFrame:
    """category, fhir, omop, consistent for conditions, procedures, medications and observations (questionnaire items against observations)."""
    parts = {
        "conditions": (O.plan_actions(elements).filter("condition_kind is not null"), O.condition_occurrence(elements)), "procedures": (O.activities(elements).filter("kind = 'ServiceRequest'"), O.procedure_occurrence(elements)),
        "medications": (O.activities(elements).filter("kind = 'MedicationRequest'"), O.drug_exposure(elements)), "observations": (O.questionnaire_items(elements), O.observation(elements)),
    }
    count = lambda df, x, name: df.agg(F.lit(x).alias("category"), F.count("*").alias(name))
    left, right = _union([count(a, x, "fhir") for x, (a, _) in parts.items()]), _union([count(b, x, "omop") for x, (_, b) in parts.items()])
    return left.join(right, "category").select("category", "fhir", "omop", (F.col("fhir") == F.col("omop")).alias("consistent"))


def protocol_report(entities: DataFrame, relations: DataFrame, sections: DataFrame) -> DataFrame:
    """part (entities, relations, sections), label, n and mean confidence of each label, and ALL of each part; labels without B- and I-."""
    rows = [entities.select(F.lit("entities").alias("part"), F.regexp_replace("label", "^[BI]-", "").alias("label"), "confidence"), relations.select(F.lit("relations").alias("part"), F.col("relation").alias("label"), "confidence"), sections.select(F.lit("sections").alias("part"), F.col("type").alias("label"), "confidence")]
    out = _union(rows).groupBy("part", "label").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"))
    whole = out.groupBy("part").agg(F.lit("ALL").alias("label"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    return out.unionByName(whole).select("part", "label", "n", F.round(F.col("s") / F.col("n"), 6).alias("confidence"))
