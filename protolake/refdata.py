"""Fixed values of the document operators: word lists, patterns, code tables, schemas.

Patterns are written in the common part of Java's and RE2's syntax, since the
same rules are run by Spark and by the SQL that checks them.
"""

from __future__ import annotations

# fixed values: abbreviations and what they stand for, applied in this order, any case
ABBREVIATIONS = [
    (r"\bpt\b", "patient"), (r"\bpts\b", "patients"), (r"\bDx\b", "diagnosis"), (r"\bRx\b", "treatment"), (r"\bHx\b", "history"),
    (r"\bw/o\b", "without"), (r"\bw/", "with"), (r"\bs/p\b", "status post"), (r"\bp\.o\.", "by mouth"),
    (r"\bb\.i\.d\.", "twice daily"), (r"\bt\.i\.d\.", "three times daily"), (r"\bq\.i\.d\.", "four times daily"), (r"\bq\.d\.", "once daily"), (r"\bp\.r\.n\.", "as needed"),
    (r"\bIV\b", "intravenous"), (r"\bIM\b", "intramuscular"), (r"\bSC\b", "subcutaneous"), (r"\bq\b", "every"), (r"\bh\b", "hour"),
    (r"\bAM\b", "morning"), (r"\bPM\b", "evening"), (r"\byo\b", "year old"), (r"\by\.o\.", "year old"),
]

# fixed values: abbreviations of notes that the parser spells out, applied in this order, any case
PARSER_ABBREVIATIONS = [
    (r"\bpt\b", "patient"), (r"\bpts\b", "patients"), (r"\bDx\b", "diagnosis"), (r"\bRx\b", "prescription"), (r"\bTx\b", "treatment"), (r"\bHx\b", "history"), (r"\bFHx\b", "family history"),
    (r"\bPMH\b", "past medical history"), (r"\bHTN\b", "hypertension"), (r"\bDM\b", "diabetes mellitus"), (r"\bBID\b", "twice daily"), (r"\bTID\b", "three times daily"), (r"\bQID\b", "four times daily"),
    (r"\bPRN\b", "as needed"), (r"\bq([0-9]+)h\b", "every $1 hours"), (r"\byo\b", "year old"), (r"\by/o\b", "year old"), (r"\bw/\b", "with"), (r"\bs/p\b", "status post"), (r"\bc/o\b", "complains of"),
    (r"\ba/w\b", "associated with"),
]

# fixed values: dosage units, frequencies and routes, applied in this order, any case; $1 is the first group
DOSAGE_RULES = [
    (r"\bkg\b", "kg"), (r"\bkilograms?\b", "kg"), (r"\bg\b", "g"), (r"\bgrams?\b", "g"), (r"\bmg\b", "mg"), (r"\bmilligrams?\b", "mg"), (r"\bµg\b", "mcg"), (r"\bmcg\b", "mcg"), (r"\bmicrograms?\b", "mcg"),
    (r"\bml\b", "mL"), (r"\bmilliliters?\b", "mL"), (r"\bl\b", "L"), (r"\bliters?\b", "L"),
    (r"\bhr\b", "hour"), (r"\bhrs\b", "hours"), (r"\bmin\b", "minute"), (r"\bmins\b", "minutes"), (r"\bsec\b", "second"), (r"\bsecs\b", "seconds"),
    (r"\bq\.?d\.?\b", "once daily"), (r"\bb\.?i\.?d\.?\b", "twice daily"), (r"\bt\.?i\.?d\.?\b", "three times daily"), (r"\bq\.?i\.?d\.?\b", "four times daily"),
    (r"\bq\.?([0-9]+)h\.?\b", "every $1 hours"), (r"\bq\.?([0-9]+)min\.?\b", "every $1 minutes"),
    (r"\bp\.?o\.?\b", "by mouth"), (r"\bper\.? os\b", "by mouth"), (r"\bi\.?v\.?\b", "intravenous"), (r"\bi\.?m\.?\b", "intramuscular"), (r"\bs\.?c\.?\b", "subcutaneous"),
    (r"\bsubcut\.?\b", "subcutaneous"), (r"\bs\.?l\.?\b", "sublingual"), (r"\bsubling\.?\b", "sublingual"),
    (r"([0-9]+)\s*mg/kg", "$1 mg/kg"), (r"([0-9]+)\s*g/day", "$1 g/day"), (r"([0-9]+)\s*mg\s+daily", "$1 mg once daily"), (r"([0-9]+)\s*mg\s+bid", "$1 mg twice daily"),
]

# fixed values: characters that normalization replaces
CHARACTERS = {"\u2028": "\n", "\u2029": "\n", "\u00a0": " ", "\u2013": "-", "\u2014": "--", "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2026": "..."}

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

# fixed values: section headings of protocols
SECTION_HEADERS = [
    "inclusion criteria", "exclusion criteria", "eligibility criteria", "study population", "patient selection", "study procedures", "intervention", "study design", "objectives", "endpoints", "primary endpoint",
    "secondary endpoints", "methodology", "statistical analysis", "adverse events", "dosage and administration", "background", "introduction", "study rationale", "conclusion", "references",
]

# fixed values: most frequent trigrams of four languages, in rank order; _ is a space at the ends
LANGUAGE_PROFILES = {
    "en": ["the", "and", "ing", "ion", "to_", "ed_", "is_", "at_", "on_", "as_"],
    "fr": ["les", "de_", "ent", "et_", "des", "que", "ons", "ur_", "est", "ait"],
    "de": ["der", "die", "ein", "und", "den", "sch", "ich", "cht", "mit", "gen"],
    "es": ["de_", "la_", "que", "el_", "en_", "con", "os_", "ent", "ado", "as_"],
}

# fixed values: phrases that speak for a kind of document
DOCUMENT_TYPES = {
    "clinical_trial": ["clinical trial", "study protocol", "inclusion criteria", "exclusion criteria", "randomization", "placebo", "double-blind", "endpoints", "efficacy", "participants", "enrollment"],
    "practice_guideline": ["practice guideline", "clinical practice", "recommendation", "guideline", "standard of care", "best practice", "evidence-based", "grade of evidence", "consensus", "panel recommends"],
    "radiology_report": ["radiograph", "radiology", "imaging", "mri", "ct scan", "x-ray", "ultrasound", "impression", "findings", "technique", "contrast"],
}

# fixed values: cues of section types in titles and content; s? and the like are optional letters
SECTION_CUES = {
    "INTRODUCTION": ["introduction", "background", "rationale", "overview", "summary"],
    "OBJECTIVES": ["objectives?", "aims?", "goals?", "purpose", "hypothesis"],
    "ELIGIBILITY_SECTION": ["eligibility", "inclusion criteria", "exclusion criteria", "patient selection", "study population"],
    "PROCEDURES_SECTION": ["procedures?", "interventions?", "methods?", "study design", "protocol", "treatment"],
    "STATISTICAL_ANALYSIS": ["statistical analysis", "statistics", "data analysis", "analysis plan", "sample size"],
    "ADVERSE_EVENTS_SECTION": ["adverse events?", "safety", "side effects", "toxicity", "complications"],
    "RESULTS": ["results", "findings", "outcomes?", "endpoints?"],
    "DISCUSSION": ["discussion", "conclusions?", "summary", "interpretation"],
    "RECOMMENDATIONS": ["recommendations?", "guidelines?", "guidance", "advisories?", "best practices?"],
}

# fixed values: patterns in section content; each hit adds 0.2
CONTENT_PATTERNS = {
    "INTRODUCTION": [r"\bbackground\b.{1,50}\bdisease\b", r"\bcurrent.{1,30}\btreatment\b", r"\bproblem.{1,30}\baddressed\b"],
    "OBJECTIVES": [r"\bprimary.{1,20}\bendpoint\b", r"\bsecondary.{1,20}\bendpoint\b", r"\baim\b.{1,20}\bstudy\b", r"\bgoal\b.{1,20}\bstudy\b"],
    "ELIGIBILITY_SECTION": [r"\binclusion\b.{1,50}\bcriteria\b", r"\bexclusion\b.{1,50}\bcriteria\b", r"\bage\b.{1,20}\b(years|>=|over)\b", r"\b(male|female)\b.{1,30}\bpatients\b"],
    "PROCEDURES_SECTION": [r"\bdosage\b.{1,50}\badministration\b", r"\bfrequency\b.{1,30}\btreatment\b", r"\bprocedure\b.{1,50}\bperformed\b", r"\bmeasurement\b.{1,50}\btime\b"],
    "STATISTICAL_ANALYSIS": [r"\bsample\b.{1,20}\bsize\b", r"\bp.{1,5}value\b", r"\bstatistical.{1,30}\banalysis\b", r"\bt.{1,5}test\b|\banova\b|\bregression\b"],
    "ADVERSE_EVENTS_SECTION": [r"\badverse\b.{1,20}\bevent\b", r"\bside\b.{1,20}\beffect\b", r"\btoxicity\b", r"\bsafety\b.{1,30}\bmonitoring\b"],
}

# fixed values: relation cues in order of precedence
RELATION_CUES = {
    "INCLUDES": ["including", "contains", "consists of", "comprises", "with", "having"],
    "EXCLUDES": ["excluding", "without", "except for", "other than", "not including"],
    "TREATS": ["treats", "for treatment of", "indicated for", "used for", "administered for"],
    "CAUSES": ["causes", "results in", "leads to", "produces", "associated with"],
    "PRECEDES": ["before", "prior to", "precedes", "followed by", "preceding"],
    "FOLLOWS": ["after", "following", "subsequent to", "succeeded by"],
    "MEASURES": ["measures", "assesses", "evaluates", "quantifies", "determines"],
    "RECOMMENDS": ["recommended", "advised", "suggested", "proposed", "indicated"],
}

# fixed values: relations that two labels suggest, in either direction
TYPE_RELATIONS = [
    ("ELIGIBILITY", "ELIGIBILITY", "INCLUDES", 0.5), ("ELIGIBILITY", "CONDITION", "INCLUDES", 0.6), ("PROCEDURE", "TIMEPOINT", "PRECEDES", 0.5), ("MEDICATION", "CONDITION", "TREATS", 0.6),
    ("MEDICATION", "ADVERSE_EVENT", "CAUSES", 0.6), ("ENDPOINT", "PROCEDURE", "MEASURES", 0.6), ("RECOMMENDATION", "PROCEDURE", "RECOMMENDS", 0.7), ("RECOMMENDATION", "MEDICATION", "RECOMMENDS", 0.7),
]

# fixed values: cued rules of the fallback extractor
CUED_ENTITY_RULES = [
    ("ELIGIBILITY", r"(?i)(?:inclusion|exclusion)[ \t\n\r\f\x0B\-:]+([^\n.]+)"),
    ("ELIGIBILITY", r"(?i)(?:include|exclude)[ \t\n\r\f\x0B\-:]+([^\n.]+)"),
    ("ELIGIBILITY", r"(?i)(?:eligible|ineligible)[ \t\n\r\f\x0B\-:]+([^\n.]+)"),
    ("ELIGIBILITY", r"(?i)(?:criteria|criterion)[ \t\n\r\f\x0B\-:]+([^\n.]+)"),
    ("PROCEDURE", r"(?i)(?:procedure|protocol|intervention)[ \t\n\r\f\x0B\-:]+([^\n.]+)"),
    ("PROCEDURE", r"(?i)(?:administer|perform|conduct)[ \t\n\r\f\x0B\-:]+([^\n.]+)"),
]

# fixed values: colours of entity types
COLORS = {
    "ELIGIBILITY": "#ffcccb", "PROCEDURE": "#c2f0c2", "MEDICATION": "#c2e0ff", "ENDPOINT": "#ffffcc", "TIMING": "#e6ccff", "DOSAGE": "#ffd8b1", "ADVERSE_EVENT": "#ffc0cb",
    "CONDITION": "#d3d3d3", "INCLUSION": "#ffe4b5", "EXCLUSION": "#ffa07a",
}
OTHER_COLOR = "#e0e0e0"

# fixed values: descriptions of sample documents
SAMPLE_DESCRIPTIONS = {
    "clinical_trial.pdf": "Example clinical trial protocol with inclusion/exclusion criteria", "discharge_summary.pdf": "Hospital discharge summary with medication and procedure details",
    "practice_guideline.pdf": "Medical practice guideline with recommended procedures", "radiology_report.txt": "Radiology report with findings and recommendations", "medication_list.pdf": "Patient medication list with dosages and instructions",
}

# fixed values: states of a job and their progress
JOB_PROGRESS = {"parsing": 15, "extracting_entities": 40, "extracting_relations": 65, "standardizing": 85, "completed": 100, "error": 0}

# fixed values: prefixes that term normalization strips, once each, in this order
TERM_PREFIXES = ["history of ", "chronic ", "acute ", "suspected "]

# fixed values: abbreviations of terms
TERM_ABBREVIATIONS = {
    "htn": "hypertension", "dm": "diabetes mellitus", "cad": "coronary artery disease", "chf": "congestive heart failure", "copd": "chronic obstructive pulmonary disease",
    "uti": "urinary tract infection", "ckd": "chronic kidney disease", "gerd": "gastroesophageal reflux disease", "afib": "atrial fibrillation", "hb a1c": "hemoglobin a1c",
}

# fixed values: synonym sets that the terms of the tests need; more sets are read from a file
SYNONYMS = {
    "diabetes": ["diabetes mellitus", "dm", "diabetes", "diabetes type 2", "type 2 diabetes", "t2dm", "adult onset diabetes", "non-insulin dependent diabetes mellitus", "niddm"],
    "diabetes_type_1": ["type 1 diabetes mellitus", "t1dm", "insulin dependent diabetes mellitus", "iddm", "juvenile onset diabetes", "juvenile diabetes"],
    "hypertension": ["hypertension", "htn", "high blood pressure", "elevated blood pressure", "arterial hypertension"],
    "myocardial_infarction": ["myocardial infarction", "mi", "heart attack", "cardiac infarction", "acute myocardial infarction", "ami", "stemi", "nstemi"],
    "cerebrovascular_accident": ["cerebrovascular accident", "cva", "stroke", "brain attack", "cerebral infarction", "cerebral ischemia", "cerebrovascular insult"],
    "chronic_kidney_disease": ["chronic kidney disease", "ckd", "renal insufficiency", "kidney failure", "chronic renal failure", "chronic renal insufficiency", "end stage renal disease", "esrd"],
    "asthma": ["asthma", "bronchial asthma", "reactive airway disease", "bronchospasm", "wheezing"],
}

SYSTEM_URIS = {"snomed": "http://snomed.info/sct", "loinc": "http://loinc.org", "rxnorm": "http://www.nlm.nih.gov/research/umls/rxnorm"}

# fixed values: sample concepts (code, display; the term is the display in lower case unless given)
SNOMED = [
    ("38341003", "Hypertension"), ("73211009", "Diabetes mellitus"), ("44054006", "Type 2 diabetes mellitus"), ("46635009", "Type 1 diabetes mellitus"), ("195967001", "Asthma"),
    ("13645005", "Chronic obstructive pulmonary disease"), ("22298006", "Myocardial infarction"), ("230690007", "Cerebrovascular accident"), ("84114007", "Heart failure"), ("233604007", "Pneumonia"),
    ("429040005", "Allergy to penicillin"), ("64859006", "Osteoporosis"), ("396275006", "Osteoarthritis"), ("90688005", "Chronic kidney disease"), ("49436004", "Atrial fibrillation"),
    ("73430006", "Depression"), ("35489007", "Depressive disorder"), ("197480006", "Anxiety disorder"), ("4556007", "Transient ischemic attack"), ("66071002", "Viral hepatitis B", "type b viral hepatitis"),
    ("40468003", "Viral hepatitis C"), ("155501007", "Thromboembolic disorder"), ("363346000", "Malignant neoplastic disease"), ("68496003", "Polyp"), ("271737000", "Anemia"),
    ("13200003", "Anemia due to blood loss"), ("87628006", "Bacterial infectious disease"), ("59621000", "Essential hypertension"), ("10725009", "Benign prostatic hyperplasia"), ("62315008", "Diarrhea"),
    ("43116000", "Eczema"), ("24700007", "Multiple sclerosis"), ("13920009", "Pulmonary embolism"), ("266998003", "Urinary tract infection"), ("44186003", "Hyperthyroidism"),
    ("40930008", "Hypothyroidism"), ("75934005", "Metabolic syndrome X"), ("55822004", "Hyperlipidemia"), ("235856003", "Hepatitis"), ("88805009", "Chronic hepatitis"),
]
LOINC = [
    ("4548-4", "Hemoglobin A1c/Hemoglobin.total in Blood", "hemoglobin a1c"), ("85354-9", "Blood pressure panel with all children optional", "blood pressure"), ("2093-3", "Cholesterol [Mass/volume] in Serum or Plasma", "cholesterol"),
    ("2160-0", "Creatinine [Mass/volume] in Serum or Plasma", "creatinine"), ("2339-0", "Glucose [Mass/volume] in Blood", "glucose"), ("2571-8", "Triglyceride [Mass/volume] in Serum or Plasma", "triglycerides"),
    ("3094-0", "Urea nitrogen [Mass/volume] in Serum or Plasma", "urea nitrogen"), ("2823-3", "Potassium [Moles/volume] in Serum or Plasma", "potassium"), ("2951-2", "Sodium [Moles/volume] in Serum or Plasma", "sodium"),
    ("2075-0", "Chloride [Moles/volume] in Serum or Plasma", "chloride"), ("2345-7", "Glucose [Mass/volume] in Serum or Plasma", "glucose"), ("26515-7", "Platelets [#/volume] in Blood", "platelet count"),
    ("26464-8", "Leukocytes [#/volume] in Blood", "leukocyte count"), ("718-7", "Hemoglobin [Mass/volume] in Blood", "hemoglobin"), ("4544-3", "Hematocrit [Volume Fraction] of Blood", "hematocrit"),
    ("788-0", "Erythrocytes [#/volume] in Blood", "erythrocyte count"), ("17861-6", "Calcium [Mass/volume] in Serum or Plasma", "calcium"), ("1975-2", "Bilirubin.total [Mass/volume] in Serum or Plasma", "bilirubin total"),
    ("1920-8", "Aspartate aminotransferase [Enzymatic activity/volume] in Serum or Plasma", "aspartate aminotransferase"), ("1742-6", "Alanine aminotransferase [Enzymatic activity/volume] in Serum or Plasma", "alanine aminotransferase"),
    ("2458-8", "IgG [Mass/volume] in Serum", "igg"), ("6690-2", "Cells.CD45 [#/volume] in Blood", "leukocyte common antigen"),
]
RXNORM = [
    ("6809", "metformin"), ("29046", "lisinopril"), ("1191", "aspirin"), ("83367", "atorvastatin"), ("10582", "levothyroxine"), ("4053", "amlodipine"), ("11170", "losartan"), ("4337", "atenolol"), ("3356", "acetaminophen"),
    ("6960", "morphine"), ("161", "acetylsalicylic acid"), ("56360", "rosuvastatin"), ("42316", "simvastatin"), ("35296", "sertraline"), ("8299", "paroxetine"), ("58927", "venlafaxine"), ("58147", "pantoprazole"),
    ("36567", "omeprazole"), ("73494", "dexlansoprazole"), ("153165", "esomeprazole"), ("2244", "amoxicillin"), ("10312", "levofloxacin"), ("89522", "cephalexin"), ("1739", "azithromycin"), ("6135", "metoprolol"),
    ("321988", "eszopiclone"), ("2551", "alprazolam"), ("9997", "lorazepam"), ("32968", "prednisone"), ("7052", "methylprednisolone"), ("6373", "montelukast"), ("69749", "fluticasone"), ("3264", "albuterol"),
]
# fixed values: custom mappings, which come before the concept tables
CUSTOM = [
    ("snomed", "diabetes", "73211009", "Diabetes mellitus"), ("snomed", "diabetus", "73211009", "Diabetes mellitus"), ("loinc", "hba1c", "4548-4", "Hemoglobin A1c/Hemoglobin.total in Blood"),
]

# fixed values: context words that raise the score of a match whose display has the keyword
CONTEXT_HINTS = [
    ("snomed", "diabetes", ["glucose", "sugar", "a1c", "metformin", "insulin", "glycemic"]), ("snomed", "hypertension", ["blood pressure", "bp", "systolic", "diastolic", "mmhg"]),
    ("snomed", "asthma", ["respiratory", "breathing", "wheeze", "inhaler", "bronchial"]), ("snomed", "pneumonia", ["lung", "respiratory", "cough", "infection", "fever"]),
    ("snomed", "heart", ["cardiac", "chest pain", "cardiovascular", "ecg", "ekg"]),
    ("loinc", "hemoglobin", ["blood", "cbc", "anemia", "diabetes"]), ("loinc", "glucose", ["diabetes", "blood sugar", "fasting", "a1c"]), ("loinc", "cholesterol", ["lipid", "hdl", "ldl", "cardiovascular"]),
    ("loinc", "creatinine", ["kidney", "renal", "gfr", "bun"]),
    ("rxnorm", "metformin", ["diabetes", "hypoglycemic", "glucose", "a1c"]), ("rxnorm", "lisinopril", ["hypertension", "blood pressure", "ace inhibitor", "bp"]),
    ("rxnorm", "aspirin", ["antiplatelet", "pain", "blood thinner", "heart", "stroke"]), ("rxnorm", "atorvastatin", ["cholesterol", "statin", "lipid", "cardiovascular"]),
]

# fixed values: concept ids of units, and other names of them
UNITS = {
    "mg": 8576, "ml": 8587, "mmHg": 8876, "kg": 9529, "cm": 8582, "g": 8505, "mmol/L": 8840, "U/L": 8645, "cells/μL": 8848, "%": 8554,
    "years": 8532, "months": 8531, "days": 8507, "hours": 8520, "minutes": 8517, "seconds": 8555,
}
UNIT_NAMES = {"milligrams": "mg", "milliliters": "ml", "kilograms": "kg", "grams": "g", "centimeters": "cm", "millimeters": "mm", "percent": "%"}

# fixed values: type concepts of records that come from a protocol
PROTOCOL, INCLUSION, EXCLUSION = 32879, 32880, 32881

# fixed values: words that decide which table a criterion, an endpoint or a procedure belongs to
CONDITION_WORDS = ["disease", "disorder", "syndrome", "condition"]
OBSERVATION_WORDS = ["age", "gender", "sex", "consent", "language", "able to"]
LAB_WORDS = ["lab", "test", "level", "count", "concentration", "value"]
DEVICE_WORDS = ["device", "implant", "catheter", "pacemaker", "stent", "monitor", "machine", "ventilator", "pump"]
SPECIMEN_WORDS = ["sample", "specimen", "collection", "biopsy", "aspirate", "blood draw", "venipuncture", "tissue"]
SPECIMEN_TYPES = [("blood", "Blood"), ("urine", "Urine"), ("tissue", "Tissue"), ("biopsy", "Tissue"), ("fluid", "Fluid"), ("swab", "Swab")]
BODY_SITES = ["arm", "leg", "chest", "abdomen", "head", "neck", "back", "liver", "kidney", "heart", "lung"]

# own list: English words without content
STOPWORDS = (
    "the and for are but not you all any can had her was one our out his has him its who did yes she may too use that with have this will your from they know want been good "
    "much some time very when come here just like long make many more only over such take than them well were what then there their these those which while would about into other"
).split()


def concepts() -> list[tuple[str, str, str, str, int, int]]:
    """All terms: system, term, code, display, priority (custom first), order."""
    rows = [(s, t, c, d, 0, k) for k, (s, t, c, d) in enumerate(CUSTOM)]
    for system, table in (("snomed", SNOMED), ("loinc", LOINC), ("rxnorm", RXNORM)):
        rows += [(system, (x[2] if len(x) > 2 else x[1]).lower(), x[0], x[1], 1, k) for k, x in enumerate(table)]
    return rows
