"""Sections by other cues than known headings: line shapes, spacing, paragraphs, capitals, headers of cleaned text.

Each rule is a function of one text that gives (title, start, stop) in order;
an Arrow function applies it to each row, with the section's text sliced there,
so nothing is shuffled and no text is joined back. Offsets are of the text that
is sliced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protolake.functions.text import clean_text
from protolake.operators.extract import classify_section
from protolake.refdata import SECTION_HEADERS

Section = tuple[str, int, int]
Rule = Callable[[str], list[Section]]

# fixed values: shapes of heading lines
NUMBERED = r"^\s*(\d+\.)+\s+([A-Z][\w\s\-]+)$"
CAPITALS = r"^\s*([A-Z][A-Z\s\-]+)(?:\:|\.)?\s*$"
WITH_COLON = r"^\s*([A-Z][\w\s\-]+)\:\s*$"
CAPITAL_LINE = r"(?:^|\n)([A-Z][A-Z\s]{3,}[A-Z0-9]:?)(?:\n|\s*$)"
CONTEXT_HEADERS = [r"\n\s*([A-Z][A-Za-z\s]+:)\s*\n", r"\n\s*(\d+\.\d*\s+[A-Z][A-Za-z\s]+)\s*\n", r"\n\s*([A-Z][A-Z\s]+)\s*\n"]
_SHAPES = [(re.compile(NUMBERED), 2), (re.compile(CAPITALS), 1), (re.compile(WITH_COLON), 1)]
_CAPITAL_LINE = re.compile(CAPITAL_LINE, re.M)
_CONTEXT = [re.compile(p) for p in CONTEXT_HEADERS]
_PARAGRAPH = re.compile(r"\n\s*\n")


def with_lines(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def to_next(heads: list[tuple[str, int]], n: int) -> list[Section]:
    """Sections that reach from each head to the next one's, the last to the end."""
    return [(title, at, stop) for (title, at), stop in zip(heads, [*(at for _, at in heads[1:]), n])]


def boundaries(text: str) -> list[Section]:
    """By heading shapes, capitals, and short lines between an empty and an indented one; else by spacing, else the whole text."""
    lines = list(with_lines(text))
    heads = []
    for k, (at, line) in enumerate(lines):
        bare = line.strip()
        if not bare:
            continue
        title = next((m.group(g).strip() for shape, g in _SHAPES if (m := shape.match(line))), None)
        if title is None and bare.isupper() and 3 < len(bare) < 50 and not bare.endswith(":"):
            title = bare
        if title is None and 0 < k < len(lines) - 1 and len(bare) < 50 and not lines[k - 1][1].strip() and lines[k + 1][1].strip() and lines[k + 1][1].startswith(" "):
            title = bare
        if title is not None:
            heads.append((title, at))
    return to_next(heads, len(text)) or by_spacing(text) or [("Document", 0, len(text))]


def paragraphs(text: str) -> list[tuple[int, str]]:
    """(start, paragraph) of the parts between empty lines that hold more than white space."""
    out, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        out.append((at, text[at : m.start()]))
        at = m.end()
    return [(a, p) for a, p in [*out, (at, text[at:])] if p.strip()]


def by_spacing(text: str) -> list[Section]:
    """Paragraphs whose first line is short and ends with a colon, is in capitals, or stands above a line that is not indented: the section begins below that line."""
    heads = []
    for at, p in paragraphs(text):
        first, *rest = p.split("\n")
        title = first.strip()
        if len(title) < 50 and (title.endswith(":") or title.isupper() or rest and not rest[0].startswith(" ")):
            heads.append((title, at, min(at + len(first) + 1, at + len(p))))
    ends = [*(at for _, at, _ in heads[1:]), len(text)]
    return [(title, begin, stop) for (title, _, begin), stop in zip(heads, ends)]


def by_paragraphs(text: str, most: int = 1000) -> list[Section]:
    """Paragraphs gathered until a heading-like one (short, in capitals or with a colon) or until over ``most`` characters; the title is a short first line."""
    groups: list[list[tuple[int, int]]] = []
    for at, p in paragraphs(text):
        bare = p.strip()
        letters = [c for c in bare if c.isalpha()]
        heading = len(bare) < 50 and (bare.endswith(":") or all(c.isupper() for c in letters))
        if not groups or heading or groups[-1][-1][1] - groups[-1][0][0] > most:
            groups.append([])
        groups[-1].append((at, at + len(p)))
    out = []
    for g in groups:
        first = text[g[0][0] : g[-1][1]].split("\n", 1)[0]
        out.append((first.strip() if len(first) < 50 else "Untitled Section", g[0][0], g[-1][1]))
    return out


def by_headers(text: str) -> list[Section]:
    """Typed sections of a cleaned text: lines that hold a known heading give its name, lines of under six words in capitals, numbered lines and short lines with a colon an unknown one."""
    heads = []
    for at, line in with_lines(text):
        low = line.lower()
        known = next((h for h in SECTION_HEADERS if h in low), None)
        if not line.strip():
            continue
        if known:
            heads.append((known.upper().replace(" ", "_"), at))
        elif (line.isupper() and len(line.split()) < 6) or re.match(r"^[0-9]+\.[0-9]*\s+\w+", line) or (line.strip().endswith(":") and len(line) < 50):
            heads.append(("UNKNOWN_SECTION", at))
    return to_next(heads, len(text))


def by_capital_lines(text: str) -> list[Section]:
    """Plain texts: lines in capitals; a section is what stands behind its line."""
    found = list(_CAPITAL_LINE.finditer(text))
    stops = [*(m.start() for m in found[1:]), len(text)]
    return [(m.group(1).strip(), m.end(), max(stop, m.end())) for m, stop in zip(found, stops)]


def cut(docs: DataFrame, rule: Rule = boundaries, text: Column | None = None) -> DataFrame:
    """doc_id, no, title, start, stop, content (trimmed) of every row's sections; null and empty texts have none."""
    kind = pa.list_(pa.struct([("title", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("content", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"title": x, "start": a, "stop": z, "content": t[a:z].strip()} for x, a, z in rule(t)] if t else [] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("text") if text is None else text).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, found array<struct<title: string, start: int, stop: int, content: string>>")
    return out.select("doc_id", F.posexplode("found").alias("no", "x")).select("doc_id", "no", "x.*")


def extract_sections(docs: DataFrame, model=None) -> DataFrame:
    """doc_id, id (sec1, ...), title, type, start, stop, text, confidence: boundaries(), without empty sections, classified.

    model: a function (title column, content column) -> struct of kind and confidence, null where the rules decide; ids keep the
    boundary's number. A text whose sections are all empty is cut by paragraphs.
    """
    rule = lambda t: [x for x in boundaries(t) if t[x[1] : x[2]].strip()] and boundaries(t) or by_paragraphs(t)
    found = cut(docs, rule).filter("content <> ''")
    rules = classify_section(F.col("title"), F.col("content"))
    judged = rules if model is None else F.coalesce(model(F.col("title"), F.col("content")), rules)
    rows = found.select("doc_id", "no", "title", "start", "stop", "content", F.inline(F.array(judged)))
    return rows.select("doc_id", F.concat(F.lit("sec"), (F.col("no") + 1).cast("string")).alias("id"), "title", F.col("kind").alias("type"), "start", "stop", F.col("content").alias("text"), "confidence")


def filter_sections(sections: DataFrame, least: float = 0.5) -> DataFrame:
    """Sections of at least this confidence; a missing one is 0."""
    return sections.filter(F.coalesce("confidence", F.lit(0.0)) >= least)


def sections_of_type(sections: DataFrame, kind: str) -> DataFrame:
    return sections.filter(F.col("type") == kind)


def section_headers(docs: DataFrame) -> DataFrame:
    """Typed sections of the cleaned texts; see by_headers()."""
    return cut(docs, by_headers, clean_text(F.col("text"))).withColumnRenamed("title", "type")


def context_of(text: str, start: int, stop: int, window: int = 200) -> str:
    """The text around a span, from the last header before it to the next one behind it inside the window, if any."""
    low, high = max(0, start - window), min(len(text), stop + window)
    before, after = text[low:start], text[stop:high]
    for p in _CONTEXT:
        if found := list(p.finditer(before)):
            low += found[-1].start()
            break
    for p in _CONTEXT:
        if m := p.search(after):
            high = stop + m.start()
            break
    return text[low:high].strip()


def with_context(entities: DataFrame, texts: DataFrame, window: int = 200) -> DataFrame:
    """entities (doc_id, start, stop, ...) with context, out of their document's text."""

    @F.pandas_udf("string")
    def look(t, a, b):
        import pandas as pd

        return pd.Series([context_of(x, int(i), int(j), window) if x is not None else None for x, i, j in zip(t, a, b)])

    return entities.join(texts.select("doc_id", F.col("text").alias("whole_text")), "doc_id").withColumn("context", look("whole_text", "start", "stop")).drop("whole_text")


# fixed values: marks of fonts, what each turns into, and what that changes
FONT_MARKS = [(r'(?i)<font[\s="\w]+bold[\s="\w]+>', "<bold>"), (r'(?i)<font[\s="\w]+italic[\s="\w]+>', "<italic>"), (r'<font[\s="\w]+>', "<font>")]
FONT_CHANGES = {
    "<bold>": {"bold": True}, "</bold>": {"bold": False}, "<italic>": {"italic": True}, "</italic>": {"italic": False}, "<font>": {"font": "unknown"},
    "</font>": {"font": "default", "bold": False, "italic": False},
}
_FONT_TOKEN = re.compile("|".join(FONT_CHANGES))
PLAIN = {"font": "default", "bold": False, "italic": False}


def font_segments(text: str) -> list[tuple[str, str, bool, bool]]:
    """(text, font, bold, italic) of the runs between font marks; a text without font marks is one run, whatever else it holds."""
    if not re.search(FONT_MARKS[-1][0], text) and "</font>" not in text:
        return [(text, *PLAIN.values())]
    for mark, token in FONT_MARKS:
        text = re.sub(mark, token, text)
    out, state, at = [], dict(PLAIN), 0
    for m in [*_FONT_TOKEN.finditer(text), None]:
        run = text[at : m.start() if m else len(text)]
        if run:
            out.append((run, *state.values()))
        if m:
            state |= FONT_CHANGES[m.group()]
            at = m.end()
    return out


def segment_by_font(docs: DataFrame) -> DataFrame:
    """doc_id, no, text, font, is_bold, is_italic of every text's runs."""
    kind = "array<struct<text: string, font: string, is_bold: boolean, is_italic: boolean>>"

    @F.pandas_udf(kind)
    def split(texts):
        return texts.map(lambda t: [dict(zip(("text", "font", "is_bold", "is_italic"), x)) for x in font_segments(t or "")])

    return docs.select("doc_id", F.posexplode(split(F.col("text"))).alias("no", "x")).select("doc_id", "no", "x.*")


_LINES = "SELECT doc_id, n, i, ls[i] AS line, trim(ls[i]) AS b, CAST(coalesce(sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM (SELECT doc_id, CAST(length(text) AS INTEGER) AS n, ls, text, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM ({0}) WHERE text <> ''))"


def boundaries_sql(source: str) -> str:
    """boundaries() of texts with a heading, in SQL (those without one are left out)."""
    caps, numbered, colon = (p.replace(r"\:", ":") for p in (CAPITALS, NUMBERED, WITH_COLON))
    return rf"""WITH l AS ({_LINES.format(source)}), j AS (SELECT *, lag(b) OVER w AS p, lead(line) OVER w AS nx FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    h AS (SELECT *, CASE WHEN b = '' THEN NULL WHEN regexp_matches(line, '{numbered}') THEN trim(regexp_extract(line, '{numbered}', 2)) WHEN regexp_matches(line, '{caps}') THEN trim(regexp_extract(line, '{caps}', 1)) WHEN regexp_matches(line, '{colon}') THEN trim(regexp_extract(line, '{colon}', 1))
        WHEN upper(b) = b AND lower(b) <> b AND length(b) BETWEEN 4 AND 49 AND NOT ends_with(b, ':') THEN b WHEN p = '' AND length(b) < 50 AND trim(nx) <> '' AND starts_with(nx, ' ') THEN b END AS title FROM j)
    SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS no, title, start, coalesce(lead(start) OVER w, n) AS stop FROM h WHERE title IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


def headers_sql(source: str) -> str:
    """by_headers() of cleaned texts, in SQL."""
    known = "CASE " + " ".join(f"WHEN contains(lower(line), '{h}') THEN '{h.upper().replace(' ', '_')}'" for h in SECTION_HEADERS)
    return rf"""WITH l AS ({_LINES.format(source)}), h AS (SELECT *, CASE WHEN b = '' THEN NULL ELSE {known} WHEN (upper(line) = line AND lower(line) <> line AND len(string_split_regex(b, '\s+')) < 6) OR regexp_matches(line, '^[0-9]+\.[0-9]*\s+\w+') OR (ends_with(b, ':') AND length(line) < 50) THEN 'UNKNOWN_SECTION' END END AS type FROM l)
    SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS no, type, start, coalesce(lead(start) OVER w, n) AS stop FROM h WHERE type IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


def spacing_sql(source: str) -> str:
    """by_spacing() of texts whose empty lines hold nothing, in SQL."""
    return rf"""WITH l AS ({_LINES.format(source)}), j AS (SELECT *, coalesce(lag(b) OVER w, '') AS p, lead(line) OVER w AS nx FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    h AS (SELECT * FROM j WHERE b <> '' AND p = '' AND length(b) < 50 AND (ends_with(b, ':') OR (upper(b) = b AND lower(b) <> b) OR (nx <> '' AND NOT starts_with(nx, ' '))))
    SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS no, b AS title, CAST(least(start + length(line) + CASE WHEN coalesce(nx, '') = '' THEN 0 ELSE 1 END, n) AS INTEGER) AS start, coalesce(lead(start) OVER w, n) AS stop FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""
