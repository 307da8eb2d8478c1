"""What a token classifier's training needs: tag names, labels of word pieces, and scores of whole entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: tag names by number
TAG_NAMES = ["O", "B-protein", "I-protein", "B-DNA", "I-DNA", "B-RNA", "I-RNA", "B-cell_line", "I-cell_line", "B-cell_type", "I-cell_type"]


def tag_names(tag: Column) -> Column:
    """The name of a tag's number; null for others."""
    return F.get(F.array(*[F.lit(x) for x in TAG_NAMES]), tag.try_cast("int"))


def named_tags(rows: DataFrame) -> DataFrame:
    """rows: split, ..., tag (a number): with the tags' names; the validation rows a second time as test."""
    named = rows.withColumn("tag", tag_names(F.col("tag")))
    return named.unionByName(named.filter("split = 'validation'").withColumn("split", F.lit("test")))


def align_labels(word_ids: Column, labels: Column) -> Column:
    """The label of each word piece: its word's on the word's first piece, -100 on others and on pieces of no word (null)."""
    first = lambda w, i: w.isNotNull() & ~w.eqNullSafe(F.get(word_ids, i - 1))
    return F.transform(word_ids, lambda w, i: F.when(first(w, i), F.get(labels, w)).otherwise(F.lit(-100)))


def entity_spans(tags: DataFrame, tag: str) -> DataFrame:
    """doc_id, label, start, stop of the entities of a tag column over (doc_id, idx): one begins at B-, and at I- behind another label or none."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    label = F.when(F.col(tag) != "O", F.regexp_replace(F.col(tag), "^[BI]-", ""))
    named = tags.select("doc_id", "idx", label.alias("label"), F.startswith(F.col(tag), F.lit("B-")).alias("begins"))
    new = F.col("label").isNotNull() & (F.col("begins") | ~F.coalesce(F.lag("label").over(w) == F.col("label"), F.lit(False)))
    numbered = named.withColumn("no", F.sum(new.cast("int")).over(w)).filter("label is not null")
    return numbered.groupBy("doc_id", "no").agg(F.first("label").alias("label"), F.min("idx").alias("start"), F.max("idx").alias("stop")).drop("no")


def entity_scores(tags: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """Precision, recall and F1 of whole entities, for each label and for ALL (micro); 0 where a quotient has no base."""
    key = ["doc_id", "label", "start", "stop"]
    mark = lambda c, name: entity_spans(tags, c).select(*key, F.lit(1).alias(name))
    both = mark(gold, "g").join(mark(predicted, "p"), key, "full")
    sums = both.rollup("label").agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("hit"), F.count("g").alias("gold"), F.count("p").alias("predicted"), F.grouping("label").alias("all"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = part(F.col("hit"), F.col("predicted")), part(F.col("hit"), F.col("gold"))
    return sums.select(F.when(F.col("all") == 1, F.lit("ALL")).otherwise(F.col("label")).alias("label"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(part(2 * p * r, p + r), 6).alias("f1"), "gold", "predicted")


def spans_sql(source: str, tag: str) -> str:
    return f"""SELECT doc_id, any_value(label) AS label, min(idx) AS start, max(idx) AS stop FROM (SELECT *, sum(CASE WHEN label IS NOT NULL AND (b OR p IS DISTINCT FROM label) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS no FROM (
        SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM (SELECT doc_id, idx, {tag} LIKE 'B-%' AS b, CASE WHEN {tag} <> 'O' THEN regexp_replace({tag}, '^[BI]-', '') END AS label FROM ({source})))) WHERE label IS NOT NULL GROUP BY doc_id, no"""


def scores_sql(source: str) -> str:
    return f"""WITH g AS ({spans_sql(source, 'gold')}), p AS ({spans_sql(source, 'predicted')}), j AS (SELECT coalesce(g.label, p.label) AS label, g.doc_id IS NOT NULL AS a, p.doc_id IS NOT NULL AS b FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.label = p.label AND g.start = p.start AND g.stop = p.stop),
    s AS (SELECT coalesce(label, 'ALL') AS label, count(*) FILTER (a AND b) AS hit, count(*) FILTER (a) AS gold, count(*) FILTER (b) AS predicted FROM j GROUP BY ROLLUP (label))
    SELECT label, round(CASE WHEN predicted > 0 THEN hit / predicted ELSE 0.0::DOUBLE END, 6) AS precision, round(CASE WHEN gold > 0 THEN hit / gold ELSE 0.0::DOUBLE END, 6) AS recall, round(CASE WHEN hit > 0 THEN 2 * (hit / predicted) * (hit / gold) / (hit / predicted + hit / gold) ELSE 0.0::DOUBLE END, 6) AS f1, gold, predicted FROM s"""
