"""What a reader sees: marked texts, comparisons, names and descriptions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from protolake.functions.text import escape_html
from protolake.refdata import COLORS, OTHER_COLOR, SAMPLE_DESCRIPTIONS


def entity_color(label: Column) -> Column:
    """The colour of a label, with or without B- and I-."""
    base, out = F.regexp_replace(label, "^[BI]-", ""), F.lit(OTHER_COLOR)
    for k, v in COLORS.items():
        out = F.when(base == k, v).otherwise(out)
    return out


def percent(confidence: Column) -> Column:
    return F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))


def _marked(text: Column, spans: Column, around) -> Column:
    """text with around(span, its part) for each span (start, stop, ...); every part is escaped by itself, so offsets hold. Spans that begin before the last one's end are left out."""
    part = lambda a, b: F.substr(text, a + 1, F.greatest(F.lit(0), b - a))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("html"))
    step = lambda acc, x: F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["stop"].alias("at"), F.concat(acc["html"], escape_html(part(acc["at"], x["start"])), around(x, escape_html(part(x["start"], x["stop"])))).alias("html")))
    whole = F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(acc["html"], escape_html(part(acc["at"], F.length(text)))))
    return F.replace(whole, F.lit("\n"), F.lit("<br>"))


def highlight_entities(text: Column, entities: Column) -> Column:
    """entities: array of (start, stop, label, confidence), start first."""
    head = lambda x: F.concat(F.lit('<span class="entity" style="background-color: '), entity_color(x["label"]), F.lit(';" data-type="'), x["label"], F.lit('" title="'), x["label"], F.lit(" "), percent(x["confidence"]), F.lit('">'))
    return _marked(text, entities, lambda x, part: F.concat(head(x), part, F.lit("</span>")))


def highlight_sections(text: Column, sections: Column) -> Column:
    """sections: array of (start, stop, type), start first."""
    name = lambda x: F.concat(F.lit(' data-section-type="'), x["type"], F.lit('">'))
    return _marked(text, sections, lambda x, part: F.concat(F.lit('<div class="section-header"'), name(x), x["type"], F.lit('</div><div class="section"'), name(x), part, F.lit("</div>")))


def side_by_side(title: Column, left: Column, right: Column) -> Column:
    """Two pieces of HTML beside each other under a title."""
    return F.concat(F.lit('<div class="comparison"><h2>'), escape_html(title), F.lit('</h2><div class="left">'), left, F.lit('</div><div class="right">'), right, F.lit("</div></div>"))


def sample_description(name: Column) -> Column:
    out = F.lit("Sample document")
    for k, v in SAMPLE_DESCRIPTIONS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def landing_name(name: Column, mark: Column) -> Column:
    """stem_mark.ext: where an upload is kept."""
    return F.concat(F.regexp_replace(name, r"\.[^.]*\z", ""), F.lit("_"), mark, F.regexp_extract(name, r"(\.[^.]*)\z", 1))


def original_filename(name: Column) -> Column:
    """What stands before the first _, with the extension."""
    return F.concat(F.substring_index(name, "_", 1), F.regexp_extract(name, r"(\.[^.]*)\z", 1))


def supported(name: Column) -> Column:
    """Whether a name's extension is one that can be read."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)).isin("pdf", "docx", "txt")


def needs_ocr(page: Column, least: int = 10) -> Column:
    """A page without text, or with fewer characters than ``least``."""
    return F.length(F.trim(F.coalesce(page, F.lit("")))) < least


def expected_entities(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 200)).cast("int")
