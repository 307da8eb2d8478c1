"""Text normalization as column expressions.

Rules are folded into chains of regexp_replace, so they stay in generated code.
Only NFKC has no built-in; it runs as an Arrow function on texts that are not
plain ASCII.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from protolake.refdata import ABBREVIATIONS, CHARACTERS, DOSAGE_RULES, MONTHS, TERM_PREFIXES


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def replaced(text: Column, rules, flags: str = "(?i)") -> Column:
    for pattern, by in rules:
        text = F.regexp_replace(text, flags + pattern, by)
    return text


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_unicode(text: Column) -> Column:
    """NFKC, then dashes, quotes and separators in plain characters."""
    out = F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), nfkc(text)).otherwise(text)
    for a, b in CHARACTERS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# fixed values: white space and cleaning rules, applied in this order
WHITESPACE_RULES = [(r"\t", "    "), (r" +", " "), (r"\n{3,}", "\n\n"), (r" *\n *", "\n"), (r" +([.,;:!?)])", "$1"), (r"\( +", "("), (r"([.,;:!?])([A-Za-z])", "$1 $2")]
PARSED_WHITESPACE_RULES = [(r"\t", " "), (r"\r\n", "\n"), (r" +", " "), (r"\n +", "\n"), (r"\n{3,}", "\n\n")]
CLEAN_RULES = [(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), (r"[ \t]+", " "), (r"\n+", "\n"), (r" *\n *", "\n"), (r"[–—]", "-"), (r"\.([A-Z])", ". $1")]


def normalize_whitespace(text: Column) -> Column:
    return F.trim(replaced(text, WHITESPACE_RULES, ""))


def normalize_parsed_whitespace(text: Column) -> Column:
    return F.trim(replaced(text, PARSED_WHITESPACE_RULES, ""))


def normalize_abbreviations(text: Column) -> Column:
    return replaced(text, ABBREVIATIONS)


def clean_text(text: Column) -> Column:
    """Control characters, spaces, lines and dashes in order; abbreviations spelled out. Null gives ''."""
    return normalize_abbreviations(F.trim(replaced(normalize_unicode(F.coalesce(text, F.lit(""))), CLEAN_RULES, "")))


def standardize_dosage(text: Column) -> Column:
    return replaced(text, DOSAGE_RULES)


def date_rules() -> list[tuple[str, str]]:
    """Slash dates month first, then those that only fit day first; then dates with month names. One- and two-digit parts apart, so that zeros can be padded without code."""
    rules = []
    for m, mm in ((r"(1[0-2]|0[1-9])", "$1"), (r"([1-9])", "0$1")):
        for d, dd in ((r"(3[01]|[12][0-9]|0[1-9])", "$2"), (r"([1-9])", "0$2")):
            rules.append((rf"\b{m}/{d}/([0-9]{{4}})\b", f"$3-{mm}-{dd}"))
    for d, dd in ((r"(3[01]|[12][0-9]|0[1-9])", "$1"), (r"([1-9])", "0$1")):
        for m, mm in ((r"(1[0-2]|0[1-9])", "$2"), (r"([1-9])", "0$2")):
            rules.append((rf"\b{d}/{m}/([0-9]{{4}})\b", f"$3-{mm}-{dd}"))
    for k, name in enumerate(MONTHS, 1):
        for d, dd in ((r"([0-9]{2})", "$1"), (r"([0-9])", "0$1")):
            rules.append((rf"\b{name}\s+{d}(?:st|nd|rd|th)?,\s+([0-9]{{4}})\b", f"$2-{k:02d}-{dd}"))
            rules.append((rf"\b{d}(?:st|nd|rd|th)?\s+{name},?\s+([0-9]{{4}})\b", f"$2-{k:02d}-{dd}"))
    return rules


def normalize_dates(text: Column) -> Column:
    return replaced(text, date_rules(), "")


def is_valid_date(text: Column) -> Column:
    """yyyy-mm-dd with year 1900 to 2100, month 1 to 12 and day 1 to 31, whatever the month's length."""
    shape = F.rlike(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"))
    part = lambda a, n: F.substring(text, a, n).try_cast("int")
    return F.coalesce(shape & part(1, 4).between(1900, 2100) & part(6, 2).between(1, 12) & part(9, 2).between(1, 31), F.lit(False))


def month_number(name: Column) -> Column:
    out = F.lit(1)
    for k, m in enumerate(MONTHS, 1):
        out = F.when(F.lower(name) == m.lower(), k).otherwise(out)
    return out


def normalize_term(term: Column) -> Column:
    out = F.lower(F.coalesce(term, F.lit("")))
    for p in TERM_PREFIXES:
        out = F.regexp_replace(out, f"^{p}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[,.;:!?()]", " "), r"\s+", " "))


def sanitize_filename(name: Column) -> Column:
    """Spaces to _, other characters than word characters and - dropped, 50 characters at most; the extension stays."""
    stem, ext = F.regexp_replace(name, r"\.[^.]*\z", ""), F.regexp_extract(name, r"\.([^.]*)\z", 1)
    clean = F.substring(F.regexp_replace(F.replace(stem, F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_-]", ""), 1, 50)
    return F.when(ext != "", F.concat_ws("_", F.regexp_replace(clean, r"_+\z", ""), ext)).otherwise(clean)


def file_size_text(n: Column) -> Column:
    """n: whole bytes, of any numeric type; null: null."""
    one = lambda unit: F.format_string("%.1f", n.cast("double") / unit)
    return (F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(one(1024), F.lit(" KB")))
        .when(n < 1024**3, F.concat(one(1024**2), F.lit(" MB"))).when(n.isNotNull(), F.concat(one(1024**3), F.lit(" GB"))))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sql_replaced(text: str, rules, flags: str = "gi") -> str:
    """The same chain in the SQL that checks it."""
    for pattern, by in rules:
        by = by.replace("\\", "\\\\")
        for k in "123":
            by = by.replace(f"${k}", f"\\{k}")
        pattern, by = (x.replace("'", "''") for x in (pattern, by))
        by = "' || chr(10) || '".join(by.split("\n")) if "\n" in by else by
        text = f"regexp_replace({text}, '{pattern}', ('{by}'), '{flags}')"
    return text


def sql_term(term: str) -> str:
    out = f"lower(coalesce({term}, ''))"
    for p in TERM_PREFIXES:
        out = f"regexp_replace({out}, '^{p}', '')"
    return f"trim(regexp_replace(regexp_replace({out}, '[,.;:!?()]', ' ', 'g'), '\\s+', ' ', 'g'))"
