"""Line and text profiles of raw documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from protolake.functions.text import let
from protolake.refdata import DOCUMENT_TYPES, LANGUAGE_PROFILES, STOPWORDS


def statistics_of(text: Column) -> Column:
    """Struct of the counts of words, sentences and other characters than white space, and averages guarded against none."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_count(t, F.lit(r"[^ \t\r\n]+"))
    sentences = F.regexp_count(t, F.lit(r"[.!?]+(?:[ \t\r\n]+|\z)"))
    chars = F.length(F.regexp_replace(t, r"[ \t\r\n]+", ""))
    return F.struct(words.cast("int").alias("word_count"), sentences.cast("int").alias("sentence_count"), chars.cast("int").alias("character_count"),
        F.round(words / F.greatest(F.lit(1), sentences), 6).alias("words_per_sentence"), F.round(chars / F.greatest(F.lit(1), words), 6).alias("characters_per_word"))


def text_statistics(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.inline(F.array(statistics_of(F.col("text")))))


TEXT_STATISTICS_SQL = r"""SELECT doc_id, CAST(w AS INTEGER) AS word_count, CAST(s AS INTEGER) AS sentence_count, CAST(c AS INTEGER) AS character_count,
    round(w / greatest(1, s), 6) AS words_per_sentence, round(c / greatest(1, w), 6) AS characters_per_word
FROM (SELECT doc_id, len(regexp_extract_all(t, '[^ \t\r\n]+')) AS w, len(regexp_extract_all(t, '[.!?]+(?:[ \t\r\n]+|\z)')) AS s, length(regexp_replace(t, '[ \t\r\n]+', '', 'g')) AS c
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, no (from 0), line."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line"))


LINES_SQL = "SELECT doc_id, i - 1 AS no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"


def without_repeats(lines: Column) -> Column:
    """Lines but those that equal, stripped, the line before them."""
    return let(lines, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.trim(x) != F.trim(F.get(s, i - 1)))))


def without_headers(lines: Column, repeats: int = 2, width: int = 80) -> Column:
    """Lines but those that stand more than ``repeats`` times and are short; empty lines stay."""
    # sorted runs give each line's count without a quadratic search
    often = lambda o: F.array_distinct(F.filter(o, lambda x, i: (x != "") & (F.length(x) < width) & F.coalesce(F.get(o, i + repeats) == x, F.lit(False))))
    return let(lines, lambda s: let(let(F.array_sort(F.transform(s, lambda x: F.trim(x))), often), lambda bad: F.filter(s, lambda x: ~F.array_contains(bad, F.trim(x)))))


def _kept_lines(docs: DataFrame, rule) -> DataFrame:
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    held = docs.select("doc_id", F.size(split).alias("n"), rule(split).alias("kept"))
    return held.select("doc_id", (F.col("n") - F.size("kept")).cast("int").alias("dropped"), F.md5(F.array_join("kept", "\n")).alias("digest"))


def dedupe_consecutive_lines(docs: DataFrame) -> DataFrame:
    """without_repeats() of every text: how many lines go, and a digest of the rest. Within the row, so nothing is shuffled."""
    return _kept_lines(docs, without_repeats)


DEDUPE_SQL = f"""SELECT doc_id, CAST(count(*) FILTER (same) AS INTEGER) AS dropped, md5(string_agg(line, chr(10) ORDER BY no) FILTER (NOT same)) AS digest
FROM (SELECT doc_id, no, line, coalesce(trim(line) = trim(lag(line) OVER (PARTITION BY doc_id ORDER BY no)), false) AS same FROM ({LINES_SQL})) GROUP BY doc_id"""


def remove_headers_footers(docs: DataFrame) -> DataFrame:
    """without_headers() of every text: how many lines go, and a digest of the rest."""
    return _kept_lines(docs, without_headers)


HEADERS_SQL = f"""SELECT doc_id, CAST(count(*) FILTER (bad) AS INTEGER) AS dropped, md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT bad), '')) AS digest
FROM (SELECT *, trim(line) <> '' AND length(trim(line)) < 80 AND count(*) OVER (PARTITION BY doc_id, trim(line)) > 2 AS bad FROM ({LINES_SQL})) GROUP BY doc_id"""


def frequent_trigrams(text: str | None, most: int) -> list[tuple[str, int]]:
    """The most frequent trigrams of the lower-cased text between two underscores, and their counts; first seen wins ties."""
    padded = f"_{(text or '').lower()}_"
    if len(padded) < 3:
        return [(padded, 1)]
    points = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.uint64)
    codes = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
    _, first, n = np.unique(codes, return_index=True, return_counts=True)
    if len(n) > most:
        some = np.flatnonzero(n >= np.partition(n, -most)[-most])
        first, n = first[some], n[some]
    order = np.lexsort((first, -n))[:most]
    return [(padded[i : i + 3], int(k)) for i, k in zip(first[order].tolist(), n[order].tolist())]


def with_trigrams(docs: DataFrame, most: int = 10) -> DataFrame:
    """doc_id and grams, the ``most`` most frequent trigrams in rank order: a row for each row of docs, counted inside it, so nothing is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"gram": g, "n": n} for g, n in frequent_trigrams(t, most)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.struct([("gram", pa.string()), ("n", pa.int64())])))], ["doc_id", "grams"])

    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, grams array<struct<gram: string, n: bigint>>")


def language_scores(grams: Column) -> dict[str, Column]:
    """For each language 3 - rank of every trigram that its profile lists, added up."""
    score = lambda gs: F.aggregate(F.transform(grams, lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, g in enumerate(gs) for v in (g, 3 - k)]), x), F.lit(0))), F.lit(0), lambda a, x: a + x)
    return {x: score(gs) for x, gs in LANGUAGE_PROFILES.items()}


def language_of(grams: Column) -> Column:
    """The language of the highest score above 0 (declared order wins ties), else unknown."""
    best = lambda s: F.greatest(*[s[x] for x in LANGUAGE_PROFILES])
    held = F.struct(*[c.alias(x) for x, c in language_scores(grams).items()])

    def name(s: Column) -> Column:
        out = F.lit("unknown")
        for x in reversed(LANGUAGE_PROFILES):
            out = F.when((s[x] == best(s)) & (best(s) > 0), x).otherwise(out)
        return out

    return let(held, name)


def detect_language(docs: DataFrame, ranked: int = 10) -> DataFrame:
    """Trigram profile: the ``ranked`` most frequent trigrams (first seen wins ties) score 3 - rank in each language that lists them; the best above 0, else unknown. A row for each row of docs."""
    grams = F.col("grams.gram")
    return with_trigrams(docs, ranked).select("doc_id", language_of(grams).alias("language"), *[c.cast("int").alias(f"score_{x}") for x, c in language_scores(grams).items()])


def top_trigrams(docs: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent trigrams of each text, in rank order; rows that share a doc_id are counted each."""
    return with_trigrams(docs, k).select("doc_id", F.posexplode("grams").alias("rank", "x")).select("doc_id", (F.col("rank") + 1).alias("rank"), "x.gram", "x.n")


_GRAMS_SQL = """SELECT doc_id, gram, count(*) AS n, min(i) AS first FROM (SELECT doc_id, i, substring(p, i, 3) AS gram FROM (SELECT doc_id, p, unnest(range(1, greatest(length(p) - 2, 1) + 1)) AS i
    FROM (SELECT doc_id, '_' || lower(coalesce(text, '')) || '_' AS p FROM documents))) GROUP BY doc_id, gram"""
TOP_TRIGRAMS_SQL = f"SELECT doc_id, CAST(rank AS INTEGER) AS rank, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM ({_GRAMS_SQL})) WHERE rank <= 5"
_CASES = {x: "CASE gram " + " ".join(f"WHEN '{g}' THEN {3 - k}" for k, g in enumerate(gs)) + " ELSE 0 END" for x, gs in LANGUAGE_PROFILES.items()}
LANGUAGE_SQL = f"""SELECT doc_id, CASE WHEN greatest(en, fr, de, es) <= 0 THEN 'unknown' WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr' WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS language,
    CAST(en AS INTEGER) AS score_en, CAST(fr AS INTEGER) AS score_fr, CAST(de AS INTEGER) AS score_de, CAST(es AS INTEGER) AS score_es
FROM (SELECT doc_id, {', '.join(f'sum({c}) AS {x}' for x, c in _CASES.items())} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM ({_GRAMS_SQL})) WHERE rank <= 10 GROUP BY doc_id)"""


def type_counts(text: Column) -> dict[str, Column]:
    t = F.lower(F.coalesce(text, F.lit("")))
    count = lambda ps: sum(((F.length(t) - F.length(F.replace(t, F.lit(p), F.lit("")))) / len(p) for p in ps), start=F.lit(0)).cast("int")
    return {x: count(ps) for x, ps in DOCUMENT_TYPES.items()}


def type_in(text: str) -> str:
    """The kind whose phrases stand most often in a text (declared order wins ties), else unknown."""
    low = text.lower()
    counts = {x: sum(low.count(p) for p in ps) for x, ps in DOCUMENT_TYPES.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "unknown"


def detect_document_type(texts: DataFrame) -> DataFrame:
    """document_type as type_in() has it, from counts by kind."""
    n = texts.select("doc_id", *[c.alias(x) for x, c in type_counts(F.col("text")).items()])
    best, out = F.greatest(*[F.col(x) for x in DOCUMENT_TYPES]), F.lit("unknown")
    for x in reversed(DOCUMENT_TYPES):
        out = F.when((F.col(x) == best) & (best > 0), x).otherwise(out)
    return n.select("*", out.alias("document_type"))


def document_type_sql(source: str) -> str:
    count = lambda ps: "CAST(" + " + ".join(f"(length(t) - length(replace(t, '{p}', ''))) / {len(p)}" for p in ps) + " AS INTEGER)"
    best = f"greatest({', '.join(DOCUMENT_TYPES)})"
    return f"SELECT *, CASE WHEN {best} = 0 THEN 'unknown' {' '.join(f'WHEN {x} = {best} THEN {chr(39)}{x}{chr(39)}' for x in DOCUMENT_TYPES)} END AS document_type FROM (SELECT doc_id, {', '.join(f'{count(ps)} AS {x}' for x, ps in DOCUMENT_TYPES.items())} FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM ({source})))"


_WORDS = re.compile(r"\w+")
_EMPTY_WORDS = frozenset(STOPWORDS)


def phrases_of(text: str | None) -> dict[str, tuple[float, int]]:
    """Score and count of each phrase of one to three words without words of under three characters; score: mean frequency in the text of their words that carry content."""
    words = _WORDS.findall((text or "").lower())
    often = Counter(w for w in words if len(w) > 2 and w not in _EMPTY_WORDS)
    value = [often.get(w, 0) for w in words]
    out: dict[str, tuple[float, int]] = {}
    for n in (1, 2, 3):
        for k in range(len(words) - n + 1):
            if all(len(w) > 2 for w in words[k : k + n]):
                phrase = " ".join(words[k : k + n])
                out[phrase] = (sum(value[k : k + n]) / n, out.get(phrase, (0, 0))[1] + 1)
    return out


def _phrase_rows(texts: DataFrame, found) -> DataFrame:
    """doc_id and phrases, found(text): a row for each row of texts, counted inside it."""
    kind = pa.list_(pa.struct([("phrase", pa.string()), ("score", pa.float64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 200):  # a text has more phrases than words
                part = batch.slice(a, 200)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([found(t) for t in part.column("text").to_pylist()], kind)], ["doc_id", "phrases"])

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, phrases array<struct<phrase: string, score: double, n: bigint>>")


def key_phrase_scores(texts: DataFrame) -> DataFrame:
    """doc_id, phrase, score and count of the phrases of every text; see phrases_of()."""
    every = lambda t: [{"phrase": p, "score": s, "n": n} for p, (s, n) in phrases_of(t).items()]
    return _phrase_rows(texts, every).select("doc_id", F.explode("phrases").alias("x")).select("doc_id", "x.phrase", F.round("x.score", 6).alias("score"), "x.n")


def greedy_phrases(text: str | None, k: int = 10) -> list[str]:
    """Up to k phrases by score that are not part of one taken before."""
    taken: list[str] = []
    for phrase, _ in sorted(phrases_of(text).items(), key=lambda x: (-round(x[1][0], 6), x[0])):
        if not any(phrase in y for y in taken):
            taken.append(phrase)
            if len(taken) == k:
                break
    return taken


def key_phrases(texts: DataFrame, k: int = 10) -> DataFrame:
    """doc_id, rank, phrase of greedy_phrases() of every text."""
    found = lambda t: [{"phrase": p, "score": 0.0, "n": 0} for p in greedy_phrases(t, k)]
    return _phrase_rows(texts, found).select("doc_id", F.posexplode("phrases.phrase").alias("rank", "phrase"))


KEY_PHRASES_SQL = r"""WITH toks AS (SELECT doc_id, i AS pos, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM {source}))),
f AS (SELECT doc_id, pos, w, CASE WHEN c THEN sum(CAST(c AS INTEGER)) OVER (PARTITION BY doc_id, w) ELSE 0 END AS f FROM (SELECT *, length(w) > 2 AND NOT list_contains(@stop, w) AS c FROM toks)),
g AS (SELECT doc_id, w, f, lead(w, 1) OVER o AS w1, lead(f, 1) OVER o AS f1, lead(w, 2) OVER o AS w2, lead(f, 2) OVER o AS f2 FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT doc_id, w AS phrase, round(CAST(f AS DOUBLE), 6) AS score FROM g WHERE length(w) > 2 UNION ALL SELECT doc_id, w || ' ' || w1, round((f + f1) / 2, 6) FROM g WHERE length(w) > 2 AND length(w1) > 2
    UNION ALL SELECT doc_id, w || ' ' || w1 || ' ' || w2, round((f + f1 + f2) / 3, 6) FROM g WHERE length(w) > 2 AND length(w1) > 2 AND length(w2) > 2)
SELECT doc_id, phrase, max(score) AS score, count(*) AS n FROM p GROUP BY doc_id, phrase""".replace("@stop", str(STOPWORDS))
#: The greedy choice as a recursion over the phrases in order; binary collation, as Python and Spark order by code point.
GREEDY_SQL = f"""WITH RECURSIVE o AS (SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase) AS k FROM ({KEY_PHRASES_SQL})),
r AS (SELECT doc_id, k, [phrase] AS taken, true AS hit FROM o WHERE k = 1
    UNION ALL SELECT o.doc_id, o.k, CASE WHEN len(list_filter(taken, lambda y: contains(y, o.phrase))) = 0 THEN list_append(taken, o.phrase) ELSE taken END, len(list_filter(taken, lambda y: contains(y, o.phrase))) = 0
    FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1 WHERE len(taken) < 10)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS rank, phrase FROM r JOIN o USING (doc_id, k) WHERE hit"""


def _runs(split: Column) -> Column:
    """(first_line, n_lines) of the runs of two or more lines that look like rows of a table (a pipe, a tab or two spaces)."""
    like = lambda x: F.contains(x, F.lit("|")) | F.contains(x, F.lit("\t")) | F.contains(x, F.lit("  "))
    rows = let(split, lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(like(x), i)), lambda i: i.isNotNull()))
    # a run begins where the row before is not one, and ends where the row behind is not one
    first = lambda r: F.filter(r, lambda x, k: F.coalesce(F.get(r, k - 1) != x - 1, F.lit(True)))
    last = lambda r: F.filter(r, lambda x, k: F.coalesce(F.get(r, k + 1) != x + 1, F.lit(True)))
    both = let(rows, lambda r: F.zip_with(first(r), last(r), lambda a, b: F.struct(a.alias("first_line"), (b - a + 1).cast("long").alias("n_lines"))))
    return F.filter(both, lambda x: x["n_lines"] >= 2)


def table_runs(docs: DataFrame) -> DataFrame:
    """table_no, first line and number of lines of each table of a text; a text's lines stay in its row."""
    runs = _runs(F.split(F.coalesce("text", F.lit("")), "\n"))
    return docs.select("doc_id", F.posexplode(runs).alias("k", "x")).select("doc_id", (F.col("k") + 1).alias("table_no"), "x.first_line", "x.n_lines")


def replace_tables(docs: DataFrame) -> DataFrame:
    """doc_id, text with each table in one line, [TABLE_n], and tables, their lines joined again."""
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    held = docs.select("doc_id", let(split, lambda ls: F.struct(ls.alias("lines"), _runs(ls).alias("runs"))).alias("x"))

    def kept(lines: Column, runs: Column) -> Column:
        number = lambda i: F.array_max(F.transform(runs, lambda r, k: F.when((i >= r["first_line"]) & (i < r["first_line"] + r["n_lines"]), k + 1)))
        head = lambda i: F.exists(runs, lambda r: r["first_line"] == i)
        marked = F.transform(lines, lambda x, i: let(number(i), lambda n: F.when(n.isNull(), x).when(head(i), F.concat(F.lit("[TABLE_"), n.cast("string"), F.lit("]")))))
        return F.array_join(F.filter(marked, lambda x: x.isNotNull()), "\n")

    tables = F.transform("x.runs", lambda r: F.array_join(F.slice("x.lines", r["first_line"] + 1, r["n_lines"].cast("int")), "\n"))
    return held.select("doc_id", kept(F.col("x.lines"), F.col("x.runs")).alias("text"), tables.alias("tables"))


REPLACE_TABLES_SQL = f"""WITH l AS (SELECT *, contains(line, '|') OR contains(line, chr(9)) OR contains(line, '  ') AS row FROM ({LINES_SQL})),
m AS (SELECT *, CASE WHEN row THEN no - row_number() OVER (PARTITION BY doc_id, row ORDER BY no) END AS run FROM l),
r AS (SELECT doc_id, run, min(no) AS first, string_agg(line, chr(10) ORDER BY no) AS body, row_number() OVER (PARTITION BY doc_id ORDER BY min(no)) AS k FROM m WHERE row GROUP BY doc_id, run HAVING count(*) >= 2),
t AS (SELECT m.doc_id, string_agg(CASE WHEN r.k IS NULL THEN line ELSE '[TABLE_' || k || ']' END, chr(10) ORDER BY no) AS text FROM m LEFT JOIN r USING (doc_id, run) WHERE r.k IS NULL OR no = first GROUP BY m.doc_id)
SELECT doc_id, text, CAST(len(coalesce(b, [])) AS INTEGER) AS n, md5(coalesce(array_to_string(b, chr(10)), '')) AS digest FROM t LEFT JOIN (SELECT doc_id, list(body ORDER BY k) AS b FROM r GROUP BY doc_id) USING (doc_id)"""


TABLE_RUNS_SQL = f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS INTEGER) AS table_no, CAST(first_line AS INTEGER) AS first_line, n_lines FROM (
    SELECT doc_id, min(no) AS first_line, count(*) AS n_lines FROM (SELECT doc_id, no, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run
    FROM ({LINES_SQL}) WHERE contains(line, '|') OR contains(line, chr(9)) OR contains(line, '  ')) GROUP BY doc_id, run HAVING count(*) >= 2)"""


def chunks_of(text: str, size: int, overlap: int, reach: int, marks: str, at_lines: bool) -> list[tuple[int, int]]:
    """(start, stop) of each chunk of a text: one pass, as each cut looks back over ``reach`` characters only."""
    out, start, n = [], 0, len(text)
    while n:
        limit = start + size
        if limit >= n:
            return [*out, (start, n)]
        low = limit - reach
        at = max(text.rfind(m, low, limit) for m in marks)
        if at < 0 and at_lines:
            at = text.rfind("\n", low, limit)
        stop = at + 1 if at >= 0 else limit
        out.append((start, stop))
        start = stop - overlap
    return out


def with_chunks(docs: DataFrame, size: int = 500, overlap: int = 50, reach: int = 100, marks: str = ".", at_lines: bool = False) -> DataFrame:
    """docs with chunks, an array of (start, stop): up to ``size`` characters that end behind the last of ``marks`` (``at_lines``: else the last line end) among their last ``reach`` characters, if any, and begin ``overlap`` before the last one's end.

    The cut depends on the one before, so an Arrow function walks over each text; the last chunk ends with the text.
    """
    if not 0 < overlap + reach < size:
        raise ValueError("overlap and reach must leave a chunk some way ahead")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "stop": b} for a, b in chunks_of(t or "", size, overlap, reach, marks, at_lines)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "chunks"])

    return docs.mapInArrow(cut, StructType([*docs.schema.fields, StructField("chunks", ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])))]))


def chunk_offsets(docs: DataFrame, size: int = 500, overlap: int = 50, reach: int = 100, marks: str = ".", at_lines: bool = False) -> DataFrame:
    """doc_id, no, start, stop of the chunks that with_chunks() cuts; empty texts have none."""
    return with_chunks(docs.select("doc_id", "text"), size, overlap, reach, marks, at_lines).select("doc_id", F.posexplode("chunks").alias("no", "c")).select("doc_id", "no", "c.start", "c.stop")


_TAIL = "substring(t, {0} - 99, 100)"
_BACK = "CASE WHEN regexp_matches(" + _TAIL + ", '[.!?]') THEN instr(reverse(translate(" + _TAIL + ", '!?', '..')), '.') ELSE instr(reverse(" + _TAIL + "), chr(10)) END"
_STOP = "CASE WHEN {0} >= n THEN n WHEN " + _BACK + " > 0 THEN {0} - (" + _BACK + ") + 1 ELSE {0} END"
ANY_CHUNKS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, t, n, 0 AS no, CAST(0 AS BIGINT) AS start, {_STOP.format('500')} AS stop FROM d
    UNION ALL SELECT doc_id, t, n, no + 1, stop - 50, {_STOP.format('(stop + 450)')} FROM c WHERE stop < n)
SELECT doc_id, CAST(no AS INTEGER) AS no, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM c"""
CHUNKS_SQL = """WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, t, n, 0 AS no, CAST(0 AS BIGINT) AS start, CASE WHEN 500 >= n THEN n WHEN contains(substring(t, 401, 100), '.') THEN 500 - instr(reverse(substring(t, 401, 100)), '.') + 1 ELSE 500 END AS stop FROM d
    UNION ALL SELECT doc_id, t, n, no + 1, stop - 50, CASE WHEN stop + 450 >= n THEN n WHEN contains(substring(t, stop + 351, 100), '.') THEN stop + 450 - instr(reverse(substring(t, stop + 351, 100)), '.') + 1 ELSE stop + 450 END FROM c WHERE stop < n)
SELECT doc_id, CAST(no AS INTEGER) AS no, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM c"""
