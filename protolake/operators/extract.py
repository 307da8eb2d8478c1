"""Extraction from text: values with offsets, criteria, endpoints, references, sections, rule entities, sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protolake.functions.text import let
from protolake.refdata import CONTENT_PATTERNS, CUED_ENTITY_RULES, SECTION_CUES, SECTION_HEADERS

# fixed values: numbers with units, and time expressions
NUMBER = r"([0-9]+(?:\.[0-9]+)?)[ \t\n]*([a-zA-Z]+(?:/[a-zA-Z]+)?)?"
TIMES = {
    "duration": r"([0-9]+(?:\.[0-9]+)?\s*(?:days?|weeks?|months?|years?|hours?|minutes?|seconds?))",
    "frequency": r"((?:once|twice|three times|four times)\s+(?:daily|weekly|monthly|yearly|a day|a week|a month|a year))",
    "timepoint": r"((?:day|week|month|year)\s+[0-9]+)",
}


def regex_spans(df: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """doc_id, kind, start, stop, match of every match of Python patterns, in batches."""
    compiled = {k: re.compile(p, re.IGNORECASE) for k, p in patterns.items()}

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, k, m.start(), m.end(), m.group()) for d, t in zip(b["doc_id"], b[text]) if t for k, p in compiled.items() for m in p.finditer(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start", "stop", "match"])

    return df.select("doc_id", text).mapInPandas(find, "doc_id long, kind string, start int, stop int, match string")


def numeric_values(docs: DataFrame) -> DataFrame:
    """Numbers with the word after them as unit, in order."""
    t = F.coalesce("text", F.lit(""))
    found = F.arrays_zip(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(1)).alias("v"), F.regexp_extract_all(t, F.lit(NUMBER), F.lit(2)).alias("u"))
    return docs.select("doc_id", F.posexplode(found).alias("no", "x")).select("doc_id", "no", F.col("x.v").cast("double").alias("value"), F.nullif(F.col("x.u"), F.lit("")).alias("unit"))


def numeric_sql(source: str) -> str:
    return rf"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS no, CAST(v[i] AS DOUBLE) AS value, nullif(coalesce(u[i], ''), '') AS unit FROM (SELECT doc_id, v, u, unnest(range(1, len(v) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{NUMBER}', 1) AS v, regexp_extract_all(coalesce(text, ''), '{NUMBER}', 2) AS u FROM ({source})))"""


def time_expressions(docs: DataFrame) -> DataFrame:
    """Durations, then frequencies, then timepoints."""
    t = F.coalesce("text", F.lit(""))
    all_ = F.concat(*[_kind(F.regexp_extract_all(t, F.lit("(?i)" + p), F.lit(1)), k) for k, p in TIMES.items()])
    return docs.select("doc_id", F.posexplode(all_).alias("no", "x")).select("doc_id", "no", "x.kind", "x.text")


def _kind(values: Column, kind: str) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))


def times_sql(source: str) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, {n} AS o, i, '{k}' AS kind, x[i] AS text FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?i){p}', 1) AS x FROM ({source})))" for n, (k, p) in enumerate(TIMES.items()))
    return f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, i) - 1 AS INTEGER) AS no, kind, text FROM ({parts})"


# fixed values: marks of list items, titles of lists, marks of references
BULLET = r"(?:^|\n)[•\-*●○0-9.]+[ \t]*([^\n]+)"


def block(text: Column, title: str) -> Column:
    """The lines below a title, to the next empty line or the end."""
    return F.regexp_extract(text, rf"(?i){title}[:.\- \t]*\n((?:[^\n]+\n?)+)", 1)


def block_sql(title: str) -> str:
    return rf"regexp_extract(text, '(?i){title}[:.\- \t]*\n((?:[^\n]+\n?)+)', 1)"


def items(docs: DataFrame, titles: dict[str, str]) -> DataFrame:
    """doc_id, kind, no, text: the bullets below each title; its lines if it has none."""
    out = []
    for kind, title in titles.items():
        b = block(F.coalesce("text", F.lit("")), title)
        bullets = F.transform(F.regexp_extract_all(b, F.lit(BULLET), F.lit(1)), lambda x: F.trim(x))
        plain = F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != "")
        rows = let(bullets, lambda x: F.when(F.size(x) > 0, x).otherwise(plain))
        out.append(docs.select("doc_id", F.lit(kind).alias("kind"), F.posexplode(rows).alias("no", "text")))
    first, *rest = out
    for x in rest:
        first = first.unionByName(x)
    return first


CRITERIA = {"inclusion": "inclusion criteria", "exclusion": "exclusion criteria"}
ENDPOINTS = {"primary": r"primary\s+endpoints?", "secondary": r"secondary\s+endpoints?"}


def items_sql(source: str, titles: dict[str, str]) -> str:
    one = lambda kind, title: rf"""SELECT doc_id, '{kind}' AS kind, CAST(i - 1 AS INTEGER) AS no, x[i] AS text FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id,
        CASE WHEN len(regexp_extract_all(b, '{BULLET}', 1)) > 0 THEN list_transform(regexp_extract_all(b, '{BULLET}', 1), lambda v: trim(v)) ELSE list_filter(list_transform(string_split(b, chr(10)), lambda v: trim(v)), lambda v: v <> '') END AS x
        FROM (SELECT doc_id, {block_sql(title)} AS b FROM ({source}))))"""  # noqa: E731
    return " UNION ALL ".join(one(k, t) for k, t in titles.items())


# fixed values: marks of references
REFERENCE = r"(?:^|\n)\[([0-9]+)\] ([^\n]+)"

#: Also "(n) text", "n. text" and "n) text"; the number is what is left without the marks.
ANY_REFERENCE = r"(?:^|\n)(\[[0-9]+\]|\(?[0-9]+[.)]) ([^\n]+)"


def references(docs: DataFrame, mark: str = REFERENCE) -> DataFrame:
    """Numbered references below a references heading; without any, its lines of ten characters or more, numbered by place."""
    b = F.regexp_extract(F.coalesce("text", F.lit("")), r"(?i)(?:references|bibliography)[ \t]*:?[ \t]*\n((?:[^\n]*\n?)*)", 1)
    numbered = F.zip_with(F.regexp_extract_all(b, F.lit(mark), F.lit(1)), F.regexp_extract_all(b, F.lit(mark), F.lit(2)), lambda n, t: F.struct(F.regexp_replace(n, "[^0-9]", "").alias("number"), F.trim(t).alias("text")))
    plain = F.filter(F.transform(F.filter(F.transform(F.split(b, "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x, i: F.struct((i + 1).cast("string").alias("number"), x.alias("text"))), lambda x: F.length(x["text"]) >= 10)
    return docs.select("doc_id", F.explode(let(numbered, lambda n: F.when(F.size(n) > 0, n).otherwise(plain))).alias("r")).select("doc_id", "r.number", "r.text")


def references_sql(source: str) -> str:
    return rf"""SELECT doc_id, n[i] AS number, trim(t[i]) AS text FROM (SELECT doc_id, n, t, unnest(range(1, len(n) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(b, '{REFERENCE}', 1) AS n, regexp_extract_all(b, '{REFERENCE}', 2) AS t
    FROM (SELECT doc_id, regexp_extract(text, '(?i)(?:references|bibliography)[ \t]*:?[ \t]*\n((?:[^\n]*\n?)*)', 1) AS b FROM ({source}))))"""


def any_references_sql(source: str) -> str:
    return rf"""SELECT doc_id, regexp_replace(n[i], '[^0-9]', '', 'g') AS number, trim(t[i]) AS text FROM (SELECT doc_id, n, t, unnest(range(1, len(n) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(b, '{ANY_REFERENCE}', 1) AS n, regexp_extract_all(b, '{ANY_REFERENCE}', 2) AS t
    FROM (SELECT doc_id, regexp_extract(text, '(?i)(?:references|bibliography)[ \t]*:?[ \t]*\n((?:[^\n]*\n?)*)', 1) AS b FROM ({source}))))"""


def is_heading(line: Column) -> Column:
    """Known headings by name, lines in capitals, numbered lines, and short lines that end with a colon."""
    bare = F.trim(line)
    known = F.exists(F.array(*[F.lit(h) for h in SECTION_HEADERS]), lambda h: F.contains(F.lower(bare), h)) & (F.length(bare) < 50) & ~F.rlike(bare, F.lit(r"^[-•*\[]"))
    return (bare != "") & (known | F.rlike(bare, F.lit(r"^[A-Z][A-Z \-]{3,48}:?\z")) | F.rlike(bare, F.lit(r"^(?:[0-9]+\.)+\s+[A-Z][A-Za-z0-9_ \-]+\z")))


def heads_at(lines: Column) -> Column:
    """lines: array of (n, title), title null but for heads: (title, start) of the heads. A fold of running offsets that keeps the heads only, which are few beside the lines."""
    kind = "struct<at: int, heads: array<struct<title: string, start: int>>>"
    step = lambda acc, x: F.struct((acc["at"] + x["n"] + 1).alias("at"), F.when(x["title"].isNull(), acc["heads"]).otherwise(F.concat(acc["heads"], F.array(F.struct(x["title"].alias("title"), acc["at"].alias("start"))))).alias("heads"))
    return F.aggregate(lines, F.struct(F.lit(0).alias("at"), F.array().alias("heads")).cast(kind), step, lambda acc: acc["heads"])


def sections_with_text(docs: DataFrame) -> DataFrame:
    """doc_id, no, title, start, stop, content: a section begins at its heading and ends at the next one's or with the text; content is what stands behind the title. Offsets are of the text as it is.

    A text's lines stay in its row; rows that share a doc_id are cut each.
    """
    t = F.coalesce("text", F.lit(""))
    lines = F.transform(F.split(t, "\n"), lambda x: F.struct(F.length(x).alias("n"), F.when(is_heading(x), F.regexp_replace(F.trim(x), r":\z", "")).alias("title")))
    held = docs.select("doc_id", t.alias("text"), heads_at(lines).alias("heads"))
    each = held.select("doc_id", "text", "heads", F.posexplode("heads").alias("no", "x"))
    stop = F.coalesce(F.get("heads", F.col("no") + 1)["start"], F.length("text"))
    placed = each.select("doc_id", "no", "x.title", "x.start", stop.alias("stop"), "text")
    content = F.substr(F.col("text"), F.col("start") + 1 + F.length("title"), F.col("stop") - F.col("start"))
    return placed.select("doc_id", "no", "title", "start", "stop", content.alias("content"))


def sections(docs: DataFrame) -> DataFrame:
    """sections_with_text() without the content."""
    return sections_with_text(docs).drop("content")


def sections_or_whole(docs: DataFrame) -> DataFrame:
    """sections(); a text without a heading is cut at its paragraphs' short first lines, and a text without those is one section, Document. Blank texts give none. A text's lines stay in its row."""
    t = F.coalesce("text", F.lit(""))
    judged = lambda x: F.struct(F.length(x).alias("n"), F.trim(x).alias("bare"), is_heading(x).alias("head"), F.rlike(x, F.lit(r"^[ \t\r\f\x0B]*\z")).alias("blank"))
    lines = F.transform(F.split(t, "\n"), judged)
    blank_at = lambda ls, i: F.coalesce(F.get(ls, i)["blank"], F.lit(True))
    capitals = lambda b: (F.upper(b) == b) & (F.lower(b) != b)
    first = lambda ls, x, i: ~x["blank"] & blank_at(ls, i - 1) & (F.length(x["bare"]) < 50) & (F.endswith(x["bare"], F.lit(":")) | capitals(x["bare"]) | ~blank_at(ls, i + 1))
    marked = let(lines, lambda ls: F.transform(ls, lambda x, i: F.struct(x["n"].alias("n"), x["bare"].alias("bare"), x["head"].alias("head"), x["blank"].alias("blank"), first(ls, x, i).alias("first"))))

    def titled(ls: Column) -> Column:
        heads, firsts, filled = F.exists(ls, lambda x: x["head"]), F.exists(ls, lambda x: x["first"]), F.exists(ls, lambda x: ~x["blank"])
        name = lambda x, i: F.when(F.when(heads, x["head"]).when(firsts, x["first"]).otherwise((i == 0) & filled), F.when(heads | firsts, F.regexp_replace(x["bare"], r":\z", "")).otherwise(F.lit("Document")))
        return F.transform(ls, lambda x, i: F.struct(x["n"].alias("n"), name(x, i).alias("title")))

    held = docs.select("doc_id", F.length(t).alias("n"), heads_at(let(marked, titled)).alias("heads"))
    each = held.select("doc_id", "n", "heads", F.posexplode("heads").alias("no", "x"))
    return each.select("doc_id", "no", "x.title", "x.start", F.coalesce(F.get("heads", F.col("no") + 1)["start"], F.col("n")).alias("stop"))


def sections_or_whole_sql(source: str) -> str:
    known = " OR ".join(f"contains(lower(b), '{h}')" for h in SECTION_HEADERS)
    return rf"""SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS no, CASE WHEN heads OR firsts THEN regexp_replace(b, ':\z', '') ELSE 'Document' END AS title, CAST(start AS INTEGER) AS start, CAST(coalesce(lead(start) OVER w, n) AS INTEGER) AS stop FROM (
    SELECT *, bool_or(first) OVER (PARTITION BY doc_id) AS firsts FROM (
    SELECT *, bool_or(head) OVER (PARTITION BY doc_id) AS heads, bool_or(NOT blank) OVER (PARTITION BY doc_id) AS filled,
        NOT blank AND coalesce(lag(blank) OVER v, true) AND length(b) < 50 AND (ends_with(b, ':') OR (upper(b) = b AND lower(b) <> b) OR NOT coalesce(lead(blank) OVER v, true)) AS first FROM (
    SELECT *, regexp_matches(line, '^[ \t\r\f\x0B]*\z') AS blank, b <> '' AND ((({known}) AND length(b) < 50 AND NOT regexp_matches(b, '^[-•*\[]')) OR regexp_matches(b, '^[A-Z][A-Z \-]{{3,48}}:?\z') OR regexp_matches(b, '^(?:[0-9]+\.)+\s+[A-Z][A-Za-z0-9_ \-]+\z')) AS head FROM (
    SELECT doc_id, n, i, ls[i] AS line, trim(ls[i]) AS b, coalesce(sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT doc_id, n, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, length(coalesce(text, '')) AS n, string_split(coalesce(text, ''), chr(10)) AS ls FROM ({source})))))
    WINDOW v AS (PARTITION BY doc_id ORDER BY i)))
    WHERE CASE WHEN heads THEN head WHEN firsts THEN first ELSE i = 1 AND filled END WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


def sections_sql(source: str) -> str:
    known = " OR ".join(f"contains(lower(b), '{h}')" for h in SECTION_HEADERS)
    return rf"""SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS no, regexp_replace(b, ':\z', '') AS title, CAST(start AS INTEGER) AS start, CAST(coalesce(lead(start) OVER w, n) AS INTEGER) AS stop FROM (
    SELECT doc_id, n, i, ls[i] AS line, trim(ls[i]) AS b, coalesce(sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM (SELECT doc_id, n, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, length(coalesce(text, '')) AS n, string_split(coalesce(text, ''), chr(10)) AS ls FROM ({source}))))
    WHERE b <> '' AND ((({known}) AND length(b) < 50 AND NOT regexp_matches(b, '^[-•*\[]')) OR regexp_matches(b, '^[A-Z][A-Z \-]{{3,48}}:?\z') OR regexp_matches(b, '^(?:[0-9]+\.)+\s+[A-Z][A-Za-z0-9_ \-]+\z')) WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


def classify_section(title: Column, content: Column, strict: bool = False) -> Column:
    """Struct of kind and confidence: a cue in the title 0.9, in the first 500 characters 0.7, else content patterns at 0.2 each, 0.7 at most, else UNKNOWN 0.3.

    strict: cues with an optional letter match only if spelled with a question mark.
    """
    spelled = lambda c: c.replace("?", r"\?") if strict else c
    t, c = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.substring(F.coalesce(content, F.lit("")), 1, 500))
    whole = F.lower(F.coalesce(content, F.lit("")))
    first = lambda text: F.get(F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(r"\b(?:" + "|".join(map(spelled, cs)) + r")\b")), F.lit(x)) for x, cs in SECTION_CUES.items()])), F.lit(0))
    scored = F.array(*[F.struct(F.least(F.lit(0.7), sum((F.rlike(whole, F.lit(p)).cast("int") for p in ps), start=F.lit(0)) * F.lit(0.2)).alias("s"), F.lit(-k).alias("k"), F.lit(x).alias("x")) for k, (x, ps) in enumerate(CONTENT_PATTERNS.items())])
    parts = F.struct(first(t).alias("title"), first(c).alias("content"), F.array_max(scored).alias("best"))
    return let(parts, lambda p: F.when(p["title"].isNotNull(), F.struct(p["title"].alias("kind"), F.lit(0.9).alias("confidence"))).when(p["content"].isNotNull(), F.struct(p["content"].alias("kind"), F.lit(0.7).alias("confidence")))
        .when(p["best"]["s"] > 0, F.struct(p["best"]["x"].alias("kind"), F.round(p["best"]["s"], 6).alias("confidence"))).otherwise(F.struct(F.lit("UNKNOWN").alias("kind"), F.lit(0.3).alias("confidence"))))


def classify_sql(title: str, content: str) -> str:
    whens = [(f"regexp_matches(lower({title}), '\\b(?:{'|'.join(cs)})\\b')", x, "0.9") for x, cs in SECTION_CUES.items()] + [(f"regexp_matches(lower(substring({content}, 1, 500)), '\\b(?:{'|'.join(cs)})\\b')", x, "0.7") for x, cs in SECTION_CUES.items()]
    scores = {x: "least(0.7::DOUBLE, (" + " + ".join(f"CAST(regexp_matches(lower({content}), '{p}') AS INTEGER)" for p in ps) + ") * 0.2::DOUBLE)" for x, ps in CONTENT_PATTERNS.items()}
    best = f"greatest({', '.join(scores.values())})"
    kind = "CASE " + " ".join(f"WHEN {w} THEN '{x}'" for w, x, _ in whens) + " " + " ".join(f"WHEN {best} > 0 AND {s} = {best} THEN '{x}'" for x, s in scores.items()) + " ELSE 'UNKNOWN' END"
    sure = "CASE " + " ".join(f"WHEN {w} THEN {c}::DOUBLE" for w, _, c in whens) + f" WHEN {best} > 0 THEN round({best}, 6) ELSE 0.3::DOUBLE END"
    return f"{kind} AS section_type, {sure} AS confidence"


# fixed values: rules of the fallback extractor
ENTITY_RULES = [
    ("ELIGIBILITY", r"(?i)(?:inclusion|exclusion)(?: criteria)?:\s*([^\n.]+)"),
    ("ELIGIBILITY", r"(?i)(?:able to|must have|must be)\s+([^\n.]+)"),
    ("PROCEDURE", r"(?i)procedures?:\s*([^\n.]+)"),
    ("PROCEDURE", r"(?i)((?:blood|urine|liver|mri|chest) [a-z]+)"),
]

def rule_entities(docs: DataFrame, rules=ENTITY_RULES) -> DataFrame:
    """Entities that fixed rules find, at confidence 0.5."""
    t = F.coalesce("text", F.lit(""))
    all_ = F.concat(*[_kind(F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda x: F.trim(x)), k) for k, p in rules])
    return docs.select("doc_id", F.posexplode(all_).alias("no", "x")).select("doc_id", "no", F.col("x.kind").alias("label"), "x.text", F.lit(0.5).alias("confidence"))


def rule_entities_sql(source: str, rules=ENTITY_RULES) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, {n} AS o, i, '{k}' AS label, trim(x[i]) AS text FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 1) AS x FROM ({source})))" for n, (k, p) in enumerate(rules))
    return f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY o, i) - 1 AS INTEGER) AS no, label, text, 0.5::DOUBLE AS confidence FROM ({parts})"


def sentences(docs: DataFrame) -> DataFrame:
    """Sentences end behind . ! or ? before white space; the white space goes. Abbreviations are not known, unlike trained splitters."""
    marked = F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"([.!?])[ \t\r\n]+", "$1\u0001")
    return docs.select("doc_id", F.posexplode(F.filter(F.split(marked, "\u0001"), lambda x: x != "")).alias("no", "text"))


SENTENCES_SQL = r"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS no, x[i] AS text FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id,
    list_filter(string_split(regexp_replace(trim(coalesce(text, '')), '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda v: v <> '') AS x FROM documents))"""
