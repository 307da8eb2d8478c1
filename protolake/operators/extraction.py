"""Entities and relations of whole texts: chunks, a tagger, decoding, offsets, overlaps, fallbacks, ids.

The tagger is a function of the caller: texts in, for each the tokens' (start,
stop, tag, confidence). It runs in Arrow batches, so a model is loaded once for
each worker. The one here needs no model: it knows a few words. Everything of a
text happens in its row; pairs of entities are made in a row of their document and never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolake.functions.text import clean_text
from protolake.operators.entities import Cues, Judge, Model, relations_of, sliced
from protolake.operators.profile import chunks_of
from protolake.refdata import CUED_ENTITY_RULES

Token = tuple[int, int, str, float]
Tagger = Callable[[list[str]], list[list[Token]]]

#: Own list: words that the built-in tagger knows.
LEXICON = {
    "MEDICATION": ["metformin", "aspirin", "lisinopril", "atorvastatin", "amoxicillin", "drug"],
    "CONDITION": ["hypertension", "asthma", "diabetes", "mellitus", "disorder", "disease", "kidney", "bipolar"],
    "PROCEDURE": ["biopsy", "scan", "mri", "specimen", "pacemaker", "implant", "examination", "collection", "urine", "liver", "blood"],
    "ELIGIBILITY": ["consent", "age", "inclusion", "exclusion"],
    "TIMEPOINT": ["week", "weeks", "day"],
}
_TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 20_000
SCHEMA = "e int, text string, label string, start int, stop int, confidence double"


def tagger_of(lexicon: dict[str, list[str]]) -> Tagger:
    """A tagger that knows words: those of the lexicon are B-, or I- behind a word of the same label; surer with the word's length."""
    labels = {w: label for label, words in lexicon.items() for w in words}

    def tag(texts: list[str]) -> list[list[Token]]:
        out = []
        for text in texts:
            tokens, last = [], None
            for m in _TOKEN.finditer(text):
                label = labels.get(m.group().lower())
                name = "O" if label is None else f"{'I' if label == last else 'B'}-{label}"
                tokens.append((m.start(), m.end(), name, 0.9 if label is None else (52 + 5 * min(9, len(m.group()))) / 100))
                last = label
            out.append(tokens)
        return out

    return tag


lexicon_tagger = tagger_of(LEXICON)


def decoded(text: str, tokens: list[Token], threshold: float) -> list[tuple[str, str, int, int, float]]:
    """(text, label, start, stop, confidence) of the entities of a chunk.

    A token that is O, below the threshold, tagged B- or of another label ends an entity, which reaches to that token's
    start, the last one to the chunk's end. text: its tokens without gaps.
    """
    out, parts, sure, label, begin = [], [], [], None, 0

    def close(stop: int) -> None:
        if label is not None:
            out.append(("".join(parts), label, begin, stop, sum(sure) / len(sure)))

    for start, stop, tag, confidence in tokens:
        if start == stop:
            continue
        mine = None if tag == "O" or confidence < threshold else tag[2:] if tag[1:2] == "-" else tag
        if mine is None or tag.startswith("B-") or mine != label:
            close(start)
            parts, sure, label, begin = [], [], mine, start
        if mine is not None:
            parts.append(text[start:stop])
            sure.append(confidence)
    close(len(text))
    return out


def without_overlaps(entities: list) -> list:
    """The surest, then longest, then first entities that do not overlap one taken before; by start."""
    taken: list = []
    for x in sorted(entities, key=lambda x: (-x[4], x[2] - x[3])):
        if all(x[3] <= y[2] or x[2] >= y[3] for y in taken):
            taken.append(x)
    return sorted(taken, key=lambda x: x[2])


def entities_of(text: str, tagger: Tagger, threshold: float = 0.7, longest: int = 512, size: int = 400, overlap: int = 50) -> list:
    """Entities of a cleaned text; longer texts in chunks, offsets of the text."""
    if len(text) <= longest:
        return decoded(text, tagger([text])[0], threshold)
    spans = chunks_of(text, size, overlap, 100, ".", False)
    parts = [text[a:b] for a, b in spans]
    found = []
    for (a, _), part, tokens in zip(spans, parts, tagger(parts)):
        found += [(t, label, start + a, stop + a, c) for t, label, start, stop, c in decoded(part, tokens, threshold)]
    return without_overlaps(found)


def rule_spans(text: str) -> list:
    """Entities that the cued rules find, rule by rule, with offsets of the text; their text is trimmed, the offsets are not."""
    return [(m.group(1).strip(), label, m.start(1), m.end(1), 0.5) for label, rule in _RULES for m in rule.finditer(text)]


_RULES = [(label, re.compile(pattern)) for label, pattern in CUED_ENTITY_RULES]


def expected_entities(length: int) -> int:
    """Fewest entities that a text of this length is expected to have."""
    return max(1, length // 200)


def extract_entities(docs: DataFrame, tagger: Tagger = lexicon_tagger, threshold: float = 0.7, fallback: bool = False, clean: bool = True) -> DataFrame:
    """doc_id, e, text, label, start, stop, confidence of the entities of every text, of the cleaned text's offsets (clean=False: the text as it is).

    fallback: a text with fewer entities than expected is tried again at 0.8 of the threshold, and one without any gets
    what the cued rules find. Null and empty texts have none; rows that share a doc_id are worked on each.
    """
    kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("confidence", pa.float64())]))
    names = [f.name for f in kind.value_type]

    def find(text: str, raw: int) -> list:
        found = entities_of(text, tagger, threshold)
        if fallback and len(found) < expected_entities(raw):
            found = entities_of(text, tagger, 0.8 * threshold) or rule_spans(text)
        return [dict(zip(names, x)) for x in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])

    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (clean_text(t) if clean else t).alias("text"), F.length(t).alias("n"))
    out = rows.mapInArrow(run, "doc_id long, found array<struct<text: string, label: string, start: int, stop: int, confidence: double>>")
    return out.select("doc_id", F.posexplode("found").alias("e", "x")).select("doc_id", "e", "x.text", "x.label", "x.start", "x.stop", F.round("x.confidence", 6).alias("confidence"))


def extract_relations(entities: DataFrame, texts: DataFrame, threshold: float = 0.5, fallback: bool = False, model: Model | None = None) -> DataFrame:
    """doc_id, id (rel1, rel2, ... in order of the pairs), s_e, t_e, relation, confidence of entities of their texts (doc_id, text).

    fallback: a document without a relation is tried again at 0.8 of the threshold. model: see classify_relations(); it is asked once for a pair and its reverse.
    A document's entities meet its texts in one row. Pairs are made and judged there, a few documents at a time, and never shuffled.
    """
    least = 0.8 * threshold if fallback else threshold
    names = ("e", "label", "start", "stop")

    def found(mine: list[dict], judges: list[Judge]) -> Iterator[tuple[int, int, str, float]]:
        related = lambda lowest: (x for x in relations_of([tuple(y[c] for c in names) for y in mine], judges) if x[3] >= lowest)
        return related(threshold if least < threshold and any(True for _ in related(threshold)) else least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = Cues()
        ids, rows = [], []
        for b in sliced(batches):
            for doc_id, mine, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "entities", "texts"))):
                for n, x in enumerate(found(mine, [Judge(cues, t, model) for t in own]), 1):
                    ids.append((doc_id, n))
                    rows.append(x)
                    if len(rows) == OUT_ROWS:
                        yield packed(ids, rows)
                        ids, rows = [], []
        if rows:
            yield packed(ids, rows)

    def packed(ids: list[tuple], rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((*zip(*ids), *zip(*rows)), schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("s_e", pa.int32()), ("t_e", pa.int32()), ("relation", pa.string()), ("confidence", pa.float64())])
    whole = entities.dropna(subset=["e", "start", "stop"])
    mine = whole.groupBy("doc_id").agg(F.collect_list(F.struct(*names)).alias("entities"))
    own = texts.groupBy("doc_id").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    both = mine.join(own, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "entities", "texts")
    out = both.mapInArrow(run, "doc_id long, n int, s_e int, t_e int, relation string, confidence double")
    return out.select("doc_id", F.concat(F.lit("rel"), F.col("n").cast("string")).alias("id"), "s_e", "t_e", "relation", "confidence")


def filter_relations(relations: DataFrame, least: float = 0.5) -> DataFrame:
    return relations.filter(F.coalesce("confidence", F.lit(0.0)) >= least)


def relation_texts(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the texts of both entities: doc_id, id, line ('source --[RELATION]--> target')."""
    of = lambda p: entities.select("doc_id", F.col("e").alias(f"{p}_e"), F.col("text").alias(f"{p}_text"))
    both = relations.join(of("s"), ["doc_id", "s_e"]).join(of("t"), ["doc_id", "t_e"])
    return both.select("doc_id", "id", F.concat("s_text", F.lit(" --["), "relation", F.lit("]--> "), "t_text").alias("line"))


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def entities_sql(texts: str, threshold: float = 0.7, lexicon: dict[str, list[str]] = LEXICON) -> str:
    """extract_entities() of texts (doc_id, text) as they are, in SQL: chunks by recursion, tokens by their gaps, and the greedy choice by recursion."""
    cut = "substring(t, {0} - 99, 100)"
    stop = f"CASE WHEN {{0}} >= n THEN n WHEN contains({cut}, '.') THEN {{0}} - instr(reverse({cut}), '.') + 1 ELSE {{0}} END"
    label = "CASE " + " ".join(f"WHEN lower(w) IN ({_quoted(ws)[1:-1]}) THEN '{x}'" for x, ws in lexicon.items()) + " END"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, CAST(length(text) AS BIGINT) AS n FROM ({texts}) WHERE text <> ''),
    c AS (SELECT doc_id, t, n, CAST(0 AS BIGINT) AS a, CASE WHEN n <= 512 THEN n ELSE {stop.format('400')} END AS b FROM d
        UNION ALL SELECT doc_id, t, n, b - 50, {stop.format('(b + 350)')} FROM c WHERE b < n),
    g AS (SELECT doc_id, n, a, b, regexp_extract_all(substring(t, a + 1, b - a), '([^A-Za-z0-9]*)([A-Za-z0-9]+)', 1) AS gs, regexp_extract_all(substring(t, a + 1, b - a), '([^A-Za-z0-9]*)([A-Za-z0-9]+)', 2) AS ws FROM c),
    u AS (SELECT doc_id, n, a, b, i, gs[i] AS gap, ws[i] AS w FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM g)),
    k AS (SELECT *, a + sum(length(gap) + length(w)) OVER (PARTITION BY doc_id, a ORDER BY i) - length(w) AS start, {label} AS label, (52 + 5 * least(9, length(w))) / 100 AS sure FROM u),
    p AS (SELECT *, lag(label) OVER v AS before, lead(start) OVER v AS next FROM k WINDOW v AS (PARTITION BY doc_id, a ORDER BY i)),
    s AS (SELECT *, label IS NOT NULL AND sure >= {threshold} AS hit FROM p),
    f AS (SELECT *, hit AND NOT (coalesce(before = label, false) AND coalesce(lag(hit) OVER v, false)) AS new FROM s WINDOW v AS (PARTITION BY doc_id, a ORDER BY i)),
    o AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id, a ORDER BY i) AS no FROM f),
    e AS (SELECT doc_id, any_value(n) AS n, a, string_agg(w, '' ORDER BY i) AS text, any_value(label) AS label, min(start) AS start, arg_max(coalesce(next, b), i) AS stop, avg(sure) AS confidence FROM o WHERE hit GROUP BY doc_id, a, no),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(confidence, 12) DESC, stop - start DESC, a, start) AS rank FROM e),
    z AS (SELECT doc_id, rank, [{{'a': start, 'b': stop}}] AS taken, true AS kept FROM r WHERE rank = 1
        UNION ALL SELECT r.doc_id, r.rank, CASE WHEN r.n > 512 AND len(list_filter(taken, lambda y: r.start < y.b AND y.a < r.stop)) > 0 THEN taken ELSE list_append(taken, {{'a': r.start, 'b': r.stop}}) END,
            r.n <= 512 OR len(list_filter(taken, lambda y: r.start < y.b AND y.a < r.stop)) = 0 FROM z JOIN r ON r.doc_id = z.doc_id AND r.rank = z.rank + 1)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS e, text, label, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, round(confidence, 6) AS confidence FROM r JOIN z USING (doc_id, rank) WHERE kept"""


def relations_numbered_sql(relations: str) -> str:
    return f"SELECT doc_id, 'rel' || row_number() OVER (PARTITION BY doc_id ORDER BY s_e, t_e) AS id, s_e, t_e, relation, confidence FROM ({relations})"
