"""A synthetic clinical overlay of the documents table, the same in Spark and SQL.

The driver's tables hold no clinical text, so each document id stands for one
element of a protocol (twelve ids a protocol) and for one short protocol text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["eligibility_criteria", "procedures", "medications", "endpoints", "measurements", "devices"]
SYSTEMS = ["snomed", "snomed", "rxnorm", "loinc", "loinc", "snomed"]
#: Odd lengths, so that type and term do not go together.
VOCABULARY = {
    "eligibility_criteria": ["hypertension", "asthma", "Age >= 18 years", "type 2 diabetes mellitus", "Able to give informed consent", "bipolar disorder", "chronic kidney disease", "htn", "hypertention"],
    "procedures": ["blood sample collection", "MRI scan", "urine specimen", "pacemaker implant check", "liver biopsy", "physical examination", "chest x-ray"],
    "medications": ["metformin", "aspirin", "lisinopril", "metphormin", "atorvastatyn", "amoxicilin", "study drug"],
    "endpoints": ["change in hemoglobin a1c level", "overall survival", "blood pressure", "lab value of creatinine", "quality of life"],
    "measurements": ["hemoglobin a1c", "glucose", "cholesterol", "potasium", "hematocrit", "body weight", "creatinine"],
    "devices": ["insulin pump", "cardiac monitor", "glucose meter"],
}
UNIT_WORDS = ["mmHg", "kg", "mmol/L", "percent", "furlongs", "U/L", "%"]
DOSAGES = ["500 mg bid", "10mg daily", "q8h p.o.", "2 ml iv", "5 mcg q.d."]
QUANTITIES = ["2", "one", "7"]


def _list(values) -> Column:
    return F.array(*[F.lit(x) for x in values])


def elements(docs: DataFrame) -> DataFrame:
    """doc_id, protocol_id, kind, system, ctype, text, base, units, dosage, quantity, low: one element for each doc_id."""
    i = F.col("doc_id")
    six, k = F.floor(i / 6).cast("long"), (i % 6).cast("int")
    base = F.element_at(F.array(*[F.get(_list(VOCABULARY[x]), (six % len(VOCABULARY[x])).cast("int")) for x in KINDS]), k + 1)
    variant = F.floor(i / 36).cast("long") % 4
    rows = docs.filter(i.isNotNull() & (i >= 0)).select(i.alias("doc_id"), F.floor(i / 12).cast("long").alias("protocol_id"), F.element_at(_list(KINDS), k + 1).alias("kind"), F.element_at(_list(SYSTEMS), k + 1).alias("system"),
        F.when(k == 0, F.when(six % 2 == 0, "inclusion").otherwise("exclusion")).alias("ctype"), base.alias("base"), variant.alias("variant"),
        F.when(k == 4, F.get(_list(UNIT_WORDS), (six % len(UNIT_WORDS)).cast("int"))).alias("units"), F.when(k == 2, F.get(_list(DOSAGES), (six % len(DOSAGES)).cast("int"))).alias("dosage"),
        F.when(k == 1, F.get(_list(QUANTITIES), (six % len(QUANTITIES)).cast("int"))).alias("quantity"), F.when(k == 4, (i % 50).cast("double")).alias("low"))
    text = F.when(F.col("variant") == 1, F.concat(F.lit("History of "), "base")).when(F.col("variant") == 2, F.upper("base")).when(F.col("variant") == 3, F.concat("base", F.lit(","))).otherwise(F.col("base"))
    return rows.withColumn("text", text).drop("variant")


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


_PICK = " ".join(f"WHEN {k} THEN {sql_list(VOCABULARY[x])}[(doc_id // 6) % {len(VOCABULARY[x])} + 1]" for k, x in enumerate(KINDS))
#: The same as elements(), as a SQL query without parentheses around it.
ELEMENTS_SQL = f"""SELECT * EXCLUDE (variant), CASE variant WHEN 1 THEN 'History of ' || base WHEN 2 THEN upper(base) WHEN 3 THEN base || ',' ELSE base END AS text FROM (
    SELECT doc_id, doc_id // 12 AS protocol_id, {sql_list(KINDS)}[doc_id % 6 + 1] AS kind, {sql_list(SYSTEMS)}[doc_id % 6 + 1] AS system,
    CASE WHEN doc_id % 6 = 0 THEN CASE WHEN (doc_id // 6) % 2 = 0 THEN 'inclusion' ELSE 'exclusion' END END AS ctype, CASE doc_id % 6 {_PICK} END AS base, (doc_id // 36) % 4 AS variant,
    CASE WHEN doc_id % 6 = 4 THEN {sql_list(UNIT_WORDS)}[(doc_id // 6) % {len(UNIT_WORDS)} + 1] END AS units, CASE WHEN doc_id % 6 = 2 THEN {sql_list(DOSAGES)}[(doc_id // 6) % {len(DOSAGES)} + 1] END AS dosage,
    CASE WHEN doc_id % 6 = 1 THEN {sql_list(QUANTITIES)}[(doc_id // 6) % {len(QUANTITIES)} + 1] END AS quantity, CASE WHEN doc_id % 6 = 4 THEN CAST(doc_id % 50 AS DOUBLE) END AS low
    FROM documents WHERE doc_id >= 0)"""

#: {n}: numbers from doc_id; {c} and {p}: terms; {m}: a medication.
_TEXT = (
    "1. INTRODUCTION\nPt with Hx of {c} on {m} b.i.d. since {mo}/{d}/2023, seen w/o pain on March {d}, 2024.\n"
    "INCLUSION CRITERIA:\n- Age >= {a} years, including {c}\n- Able to give consent\n\n"
    "EXCLUSION CRITERIA:\n- {p} within {w} weeks\n- Use of {m} {a} mg twice daily\n\n"
    "PRIMARY ENDPOINTS:\n- Change in {c} at week {w}\n\nSECONDARY ENDPOINTS:\n- {p} before day {d}\n\n"
    "STATISTICAL ANALYSIS\nThe sample size is {a} and the p value 0.05.\n\nREFERENCES\n[1] Smith J, {c} review.\n[2] Doe A, {m} trial.\n"
)


def protocol_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text: one short protocol for each doc_id."""
    i = F.col("doc_id")
    pick = lambda kind: F.get(_list(VOCABULARY[kind]), (i % len(VOCABULARY[kind])).cast("int"))
    parts = {"{c}": pick("eligibility_criteria"), "{p}": pick("procedures"), "{m}": pick("medications"), "{mo}": (i % 12 + 1).cast("string"), "{d}": (i % 28 + 1).cast("string"), "{a}": (i % 60 + 18).cast("string"), "{w}": (i % 12 + 2).cast("string")}
    text = F.lit(_TEXT)
    for k, v in parts.items():
        text = F.replace(text, F.lit(k), v)
    return docs.filter(i.isNotNull() & (i >= 0)).select(i.alias("doc_id"), text.alias("text"))


def _texts_sql() -> str:
    pick = lambda kind: f"{sql_list(VOCABULARY[kind])}[doc_id % {len(VOCABULARY[kind])} + 1]"
    text = "'" + _TEXT.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for k, v in {"{c}": pick("eligibility_criteria"), "{p}": pick("procedures"), "{m}": pick("medications"), "{mo}": "doc_id % 12 + 1", "{d}": "doc_id % 28 + 1", "{a}": "doc_id % 60 + 18", "{w}": "doc_id % 12 + 2"}.items():
        text = f"replace({text}, '{k}', CAST({v} AS VARCHAR))"
    return f"SELECT doc_id, {text} AS text FROM documents WHERE doc_id >= 0"


TEXTS_SQL = _texts_sql()
