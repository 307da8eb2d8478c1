"""Line-first quality cleaning with native expressions only.

Each line is judged by itself: punctuation (more marks than letters' words can
carry), navigation (menu separators) and boilerplate (stock phrases). Failing
lines are removed; a document that loses too many of its words is rejected, as
is one that fails the base rules on its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protolake.llm.columns import let, texts, words_of
from protolake.llm.rows import unused

GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: Stock phrases of web pages, in lower case.
BOILERPLATE = [
    "accept all cookies", "all rights reserved", "back to top", "click here to", "cookie policy", "enable javascript", "forgot your password",
    "lorem ipsum", "privacy policy", "read more comments", "sign up for our newsletter", "skip to content", "subscribe to our newsletter", "terms of service", "terms of use",
]
MARK = r"[#*$%&|<>!?{}\[\]=~^\\]"
SEPARATOR = r"[|»•›]"


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that the array holds at least twice, the first of them included."""

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, k, x: F.get(s, k)["h"] == x["h"]
        at = let(ordered, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: F.coalesce(same(s, k - 1, x), F.lit(False)) | F.coalesce(same(s, k + 1, x), F.lit(False))), lambda x: x["i"])))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), covered(t)).otherwise(F.lit(0).cast("long")))


def line_fails(line: Column, mark_percent: int = 30, separators: int = 3) -> Column:
    """True for lines (with a word) that are mostly marks, menus, or stock phrases."""
    words = F.regexp_count(line, F.lit(WORD))
    return (100 * F.regexp_count(line, F.lit(MARK)) > mark_percent * words) | (F.regexp_count(line, F.lit(SEPARATOR)) >= separators) | F.exists(texts(BOILERPLATE), lambda p: F.contains(F.lower(line), p))


def quality(df: DataFrame, text: str = "text", min_words: int = 50, repeat_percent: int = 50, lost_percent: int = 50) -> DataFrame:
    """Adds the base counts, cleaned (the text of the lines that pass), base_failed and kept; replaces columns of these names.

    Null and empty texts have no word: zero counts, an empty cleaned text, base_failed.
    Repeated rows are judged each; an empty table gives no row; other columns stay.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    w, x = unused(df, "counted"), unused(df, "cleaned_lines")
    judged = df.withColumns({
        w: let(words_of(t, GAP), lambda z: F.struct(F.size(z).cast("long").alias("n"), repeated_words(z).alias("repeat"))),
        x: let(lines, lambda z: F.struct((F.size(z) - F.size(F.array_distinct(z))).cast("long").alias("dup"), F.array_join(F.filter(z, lambda y: ~line_fails(y)), "\n").alias("clean"))),
    })
    n, repeat = F.col(f"{w}.n"), F.col(f"{w}.repeat")
    failed = (n < min_words) | (100 * repeat > repeat_percent * n)
    left = F.regexp_count(F.col(f"{x}.clean"), F.lit(WORD))
    return judged.withColumns({
        "n_words": n, "word_chars": F.length(F.regexp_replace(t, GAP, "")).cast("long"), "n_symbols": F.regexp_count(t, F.lit(SYMBOL)).cast("long"), "n_dup_lines": F.col(f"{x}.dup"),
        "n_repeat_words": repeat, "base_failed": failed, "cleaned": F.col(f"{x}.clean"), "words_left": left.cast("long"), "kept": ~failed & (100 * (n - left) <= lost_percent * n),
    }).drop(w, x)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


_PHRASES = " OR ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE)
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
f AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM f) GROUP BY rid),
lines AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
judged AS (SELECT rid, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
    100 * len(regexp_extract_all(l, '[#*$%&|<>!?{{}}\[\]=~^\\]')) > 30 * len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) OR len(regexp_extract_all(l, '[|»•›]')) >= 3 OR {_PHRASES} AS bad FROM lines),
k AS (SELECT rid, count(*) - count(DISTINCT l) AS dup, coalesce(sum(n) FILTER (NOT bad), 0) AS words_left FROM judged GROUP BY rid),
a AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(words_left, 0) AS BIGINT) AS words_left
    FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN k USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - words_left) <= 50 * n_words AS kept, words_left FROM a
"""
