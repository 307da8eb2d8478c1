"""License scans: an exact set-similarity join of text blocks with license templates, in native expressions.

Blocks are lines and, for notices that wrap, the runs of words of a paragraph
(adjacent lines, up to a line without a word) that are half as long again as the
template; templates are a parameter of any length and number. A block matches a
template when it holds at least ``percent`` of the template's distinct words, a run
of words in the template's order (else a word of the line above would count).
Words are ordered by their number of blocks in the whole corpus, rarest first
(counted by a first pass, for the templates' words only, since no other word can be
shared), and stand for their rank from then on:

* prefix: a match must hold one of the template's |T| - need + 1 rarest words; these
  are in an index from word to templates, so a block meets only the templates whose
  rare words it holds, however many there are;
* length: a block with fewer distinct words than needed cannot match;
* position: a block must have enough words that are not rarer than the shared one.

What passes is counted exactly. The index and the templates are one literal of the
plan, as large as the templates; the expressions do not grow with them, and no
row is shuffled for the join.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protolake.llm.columns import LOWER, UPPER, let, words_of
from protolake.llm.rows import unused

#: Between words, in any text.
RAW_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: License notices and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by nd 4 0": "cc-by-nd",
    "this work is dedicated to the public domain under cc0 1 0": "cc0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "subject to the terms of the mozilla public license version 2 0": "mpl-2.0",
}
PERCENT = 90


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(text, UPPER, LOWER)


def lines_of(text: Column) -> Column:
    """The words of each line, as they are written."""
    return F.transform(F.split(text, "\n"), lambda x: words_of(x, RAW_GAP))


def word_order(df: DataFrame, text: str, templates: list[str]) -> list[str]:
    """The templates' words, rarest first by their number of blocks (lines) in the corpus; ties by the word."""
    every = sorted({w for t in templates for w in t.split()})
    if not every:
        return []
    some = F.transform(lines_of(F.col(text).cast("string")), lambda x: F.array_distinct(F.filter(F.transform(x, lowered_if(every)), lambda w: w.isNotNull())))
    counted = dict(df.select(F.explode(F.flatten(some)).alias("w")).groupBy("w").count().collect())
    return sorted(every, key=lambda w: (counted.get(w, 0), w))


def looks_like(words: list[str]):
    """A test of words as written: true for all that are one of the words in lower case (and rarely for others, by letters beyond ASCII)."""
    return lambda w: F.lower(w).isin(sorted({x.lower() for x in words})) if words else F.lit(False)


def lowered_if(words: list[str]):
    """A word in lower case if it is one of the words, else null; folds A-Z only where it may be."""
    like = looks_like(words)
    return lambda w: F.when(like(w), let(lowered(w), lambda x: F.when(x.isin(words), x)))


class Index:
    """Templates as ranks of their words, and from each word of a prefix to its templates; columns are literals of the plan."""

    def __init__(self, order: list[str], templates: list[tuple[str, str]], percent: int):
        rank = {w: k for k, w in enumerate(order)}
        held: list[list[int]] = [[] for _ in order]
        rows, firsts = [], set()
        for t, label in templates:
            phrase = list(dict.fromkeys(rank[w] for w in t.split()))
            need = -(-percent * len(phrase) // 100)
            if not need:
                continue
            ranks = sorted(phrase)
            prefix = ranks[: len(ranks) - need + 1]
            for r in prefix:
                held[r].append(len(rows))
                firsts.add(order[r])
            ints = lambda x: f"array({', '.join(map(str, x))})"
            rows.append(f"named_struct('label', {_quoted(label)}, 'need', {need}, 'ranks', {ints(ranks)}, 'prefix', {ints(prefix)}, 'phrase', {ints(phrase)}, 'length', {len(t.split()) * 3 // 2})")
        self.firsts = sorted(firsts)
        self.any = bool(rows)
        size = 1 << max(1, (2 * len(order)).bit_length())
        cells: list[list[str]] = [[] for _ in range(size)]
        for w, k in rank.items():
            cells[zlib.crc32(w.encode()) % size].append(f"named_struct('w', {_quoted(w)}, 'r', {k})")
        none = "cast(array() as array<struct<w: string, r: int>>)"
        self.cells = F.expr(f"array({', '.join(f'array({chr(44).join(x)})' if x else none for x in cells)})")
        self.size = size
        self.holders = F.expr(f"array({', '.join(ints(x) if x else 'cast(array() as array<int>)' for x in held)})") if rows else None
        self.templates = F.expr(f"array({', '.join(rows)})") if rows else None

    def rank(self, word: Column) -> Column:
        """Rank of a word in lower case; -1 if no template has it."""
        cell = F.get(self.cells, F.pmod(F.crc32(word.cast("binary")), F.lit(self.size)).cast("int"))
        return F.coalesce(F.get(F.filter(cell, lambda e: e["w"] == word), F.lit(0))["r"], F.lit(-1))

    def ranks(self, words: Column) -> Column:
        return F.transform(words, lambda w: self.rank(lowered(w)))

    def of(self, ranks: Column) -> Column:
        """Templates that have one of the ranks in their prefix, as structs with the rarest such rank."""
        pairs = F.flatten(F.transform(F.array_sort(F.array_distinct(F.filter(ranks, lambda r: r >= 0))), lambda r: F.transform(F.get(self.holders, r), lambda t: F.struct(t.alias("t"), r.alias("r")))))
        first = let(pairs, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, F.lit(1), i), lambda y: y["t"] == x["t"])))
        return F.transform(first, lambda x: F.struct(F.get(self.templates, x["t"]).alias("t"), x["r"].alias("r")))


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def line_matches(ranks: Column, index: Index) -> Column:
    """(label, part) of the templates that a line's words match."""

    def judge(mine: Column) -> Column:
        fits = F.filter(index.of(mine), lambda c: (F.size(mine) >= c["t"]["need"]) & (F.size(F.filter(mine, lambda r: r >= c["r"])) >= c["t"]["need"]))
        exact = F.transform(fits, lambda c: F.struct(c["t"]["label"].alias("label"), F.size(F.array_intersect(c["t"]["ranks"], mine)).alias("n"), c["t"]["need"].alias("need"), F.size(c["t"]["ranks"]).alias("all")))
        return F.transform(F.filter(exact, lambda e: e["n"] >= e["need"]), lambda e: F.struct(e["label"].alias("label"), (e["n"] / e["all"]).alias("part")))

    return let(F.array_distinct(F.filter(ranks, lambda r: r >= 0)), judge)


def in_order(run: Column, phrase: Column, length: Column) -> Column:
    """Most of the phrase's words that stand in a run in the phrase's order: for each number of them, the least place where they can end."""
    ends = lambda acc, w: F.transform(acc, lambda e, c: F.least(e, F.when(c > 0, let(F.get(acc, c - 1), lambda p: let(F.array_position(F.slice(run, p + 1, length), w), lambda x: F.when(x > 0, p + x.cast("int")))))))
    start = F.concat(F.array(F.lit(0)), F.transform(phrase, lambda _: F.lit(None).cast("int")))
    return F.size(F.array_compact(F.aggregate(phrase, start, ends))) - 1


def wrapped_matches(ranks: Column, index: Index) -> Column:
    """(label, part) of the templates that a run of a paragraph's words matches, in the template's order."""

    def best(t: Column) -> Column:
        rare = F.filter(F.transform(ranks, lambda r, i: F.when(F.array_contains(t["prefix"], r), i)), lambda i: i.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(rare, lambda i: F.sequence(F.greatest(i - t["length"] + 1, F.lit(0)), i))))
        runs = F.transform(F.filter(starts, lambda i: F.array_contains(t["ranks"], F.get(ranks, i))), lambda i: F.slice(ranks, i + 1, t["length"]))
        full = F.filter(runs, lambda z: F.size(F.array_intersect(t["ranks"], z)) >= t["need"])
        return F.array_max(F.transform(full, lambda z: in_order(z, t["phrase"], t["length"])))

    fits = F.filter(index.of(ranks), lambda c: F.size(F.array_intersect(c["t"]["ranks"], ranks)) >= c["t"]["need"])
    exact = F.transform(fits, lambda c: F.struct(c["t"]["label"].alias("label"), best(c["t"]).alias("n"), c["t"]["need"].alias("need"), F.size(c["t"]["ranks"]).alias("all")))
    return F.transform(F.filter(exact, lambda e: e["n"] >= e["need"]), lambda e: F.struct(e["label"].alias("label"), (e["n"] / e["all"]).alias("part")))


def block_matches(lines: Column, index: Index) -> Column:
    """(label, part) of all matches in a text's lines and paragraphs; only blocks with a word of some prefix are looked at."""
    like = looks_like(index.firsts)
    none = F.lit(None).cast("array<struct<label: string, part: double>>")

    def judge(flags: Column) -> Column:
        marked = F.filter(F.transform(lines, lambda x, i: F.when(F.get(flags, i), x)), lambda x: x.isNotNull())
        single = F.flatten(F.transform(marked, lambda x: line_matches(index.ranks(x), index)))
        gaps = F.filter(F.transform(lines, lambda x, i: F.when(F.size(x) == 0, i)), lambda i: i.isNotNull())
        bounds = F.concat(F.array(F.lit(-1)), gaps, F.array(F.size(lines)))
        spans = let(bounds, lambda g: F.filter(F.transform(g, lambda a, k: F.struct((a + 1).alias("a"), (F.get(g, k + 1) - a - 1).alias("n"))), lambda s: s["n"] > 1))
        several = F.filter(spans, lambda s: F.exists(F.slice(flags, s["a"] + 1, s["n"]), lambda f: f))
        wrapped = F.flatten(F.transform(several, lambda s: let(index.ranks(F.flatten(F.slice(lines, s["a"] + 1, s["n"]))), lambda r: wrapped_matches(r, index))))
        return F.when(F.exists(flags, lambda f: f), F.concat(single, wrapped)).otherwise(none)

    return let(F.transform(lines, lambda x: F.exists(x, like)), judge) if index.any else none


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """(i, label) of every place where a phrase's words stand consecutively."""
    starts = looks_like([p.split()[0] for p in phrases])
    listed = F.expr("array(" + ", ".join(f"named_struct('w', array({', '.join(map(_quoted, p.split()))}), 'label', {_quoted(x)})" for p, x in phrases.items()) + ")")
    at = F.filter(F.transform(words, lambda w, i: F.when(starts(w), i)), lambda i: i.isNotNull())
    hits = lambda i: F.transform(F.filter(listed, lambda p: p["w"] == F.transform(F.slice(words, i + 1, F.size(p["w"])), lowered)), lambda p: F.struct(i.alias("i"), p["label"].alias("label")))
    return F.flatten(F.transform(at, hits))


def scan_licenses(df: DataFrame, text: str = "text", templates: dict[str, str] | list[tuple[str, str]] | None = None, percent: int = PERCENT, phrases: dict[str, str] | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score; replaces columns of these names.

    templates: (text in lower case, label) pairs or a dictionary; several may share a label. score: 1 with a
    base phrase, else the best containment of a matching template, else 0. Null and empty texts have no
    words, empty labels and score 0. Repeated rows are scanned each; an empty table gives no row; other columns stay.
    """
    templates = TEMPLATES if templates is None else templates
    templates = list(templates.items()) if isinstance(templates, dict) else list(templates)
    phrases = {p: x for p, x in (PHRASES if phrases is None else phrases).items() if p.split()}
    index = Index(word_order(df, text, [t for t, _ in templates]), templates, percent)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    no_place = F.lit(None).cast("array<struct<i: int, label: string>>")
    places = lambda lines: let(F.flatten(lines), lambda w: F.struct(F.size(w).cast("long").alias("n"), (phrase_places(w, phrases) if phrases else no_place).alias("base")))
    scanned = let(lines_of(t), lambda lines: F.struct(places(lines).alias("words"), block_matches(lines, index).alias("found")))
    own = unused(df, "scanned")
    held = df.withColumn(own, scanned)
    base, found = (F.coalesce(F.col(f"{own}.{c}"), F.array()) for c in ("words.base", "found"))
    joined = lambda *a: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(x, lambda e: e["label"]) for x in a]))), ",")
    at = F.transform(base, lambda e: e["i"].cast("long"))
    best = F.coalesce(F.array_max(F.transform(found, lambda e: e["part"])), F.lit(0.0))
    return held.withColumns({
        "n_words": F.col(f"{own}.words.n"), "n_base": F.size(base).cast("long"), "first_word": F.array_min(at), "last_word": F.array_max(at),
        "base_labels": joined(base), "labels": joined(base, found), "score": F.when(F.size(base) > 0, F.lit(1.0)).otherwise(best),
    }).drop(own)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).drop("text")


_BASE = " UNION ALL ".join(
    "SELECT rid, i - 1 AS p, '{}' AS label FROM (SELECT rid, ws, unnest(range(1, len(ws) - {})) AS i FROM words) WHERE {}".format(x, len(p.split()) - 2, " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(p.split())))
    for p, x in PHRASES.items()
)
_TEMPLATES = ", ".join(f"('{x}', {sorted(set(t.split()))})" for t, x in TEMPLATES.items())
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
words AS (SELECT rid, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
base AS ({_BASE}),
templates(label, need) AS (VALUES {_TEMPLATES}),
blocks AS (SELECT rid, list_distinct(regexp_extract_all(l, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)),
hits AS (SELECT rid, label, len(list_intersect(b, need)) / len(need) AS part FROM blocks, templates WHERE 100 * len(list_intersect(b, need)) >= {PERCENT} * len(need)),
counted AS (SELECT rid, count(*) AS n, min(p) AS a, max(p) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
every AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM hits) GROUP BY rid),
best AS (SELECT rid, max(part) AS part FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
    coalesce(counted.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0)::DOUBLE END AS score
FROM d JOIN words USING (rid) LEFT JOIN counted USING (rid) LEFT JOIN every USING (rid) LEFT JOIN best USING (rid)
"""
