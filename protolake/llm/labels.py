"""Bounded samples of labelled rows, and the fold that is never learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protolake.llm.storage import rest


def labelled_rows(docs: DataFrame, marks: DataFrame, per_label: int | dict, most_chars: int = 8_000_000):
    """A bounded sample of labelled rows off the held-out fold: (texts, labels, rows of each label), in the order of a hash.

    docs: doc_id, text; marks: doc_id, label (at most one row for each doc_id), or None if docs has a column label.
    At most ``per_label`` whole texts (a number, or one by label) of every label: those of the least
    hashes. Rows of one label are taken until their texts reach ``most_chars`` characters together; no text is cut.

    The first pass counts rows by label and by the size class of their hash (64 classes), without
    texts but for their being empty; the second fetches the classes that hold enough rows, about
    twice as many as wanted, which is what a label's one task sorts.
    """
    rows = docs.filter(F.col("text") != "").filter(~is_held_out(F.col("doc_id")))
    h = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    level = F.floor(F.log2(F.shiftrightunsigned(h, 1).cast("double") + 2)).cast("int")  # 1 to 63: a class has half of the rows of the next
    if marks is None:
        keyed, held = rows.filter("label is not null"), rows
    else:
        keyed = rows.select("doc_id").join(marks.filter("label is not null"), "doc_id")  # ids only are shuffled
    by_level: dict = {}
    for r in keyed.groupBy("label", level.alias("level")).count().collect():  # labels x 63 rows at most
        by_level.setdefault(r["label"], {})[r["level"]] = r["count"]
    wanted = {}
    for value, n in by_level.items():
        most, seen = per_label[value] if isinstance(per_label, dict) else per_label, 0
        for k in sorted(n):
            seen += n[k]
            if seen >= most:
                break
        wanted[value] = (k, most)
    if not wanted:
        return [], [], {}
    spark = docs.sparkSession
    bound = spark.createDataFrame([(v, *x) for v, x in wanted.items()], keyed.select("label").schema.add("top", "integer").add("most", "integer"))
    bound = F.broadcast(bound)  # a row for each label
    if marks is not None:
        # about twice the wanted rows: a bounded list of ids, so the texts stay where they are
        some = keyed.withColumn("level", level).join(bound, "label").filter("level <= top").select("doc_id", "label", "most").distinct().collect()
        ids = spark.createDataFrame(some, keyed.select("doc_id", "label").schema.add("most", "integer"))
        chosen = rows.join(F.broadcast(ids), "doc_id")
    else:
        chosen = held.filter("label is not null").withColumn("level", level).join(bound, "label").filter("level <= top")
    order = Window.partitionBy("label").orderBy("h", "text")
    chosen = chosen.select("label", "most", "text", h.alias("h")).withColumn("k", F.row_number().over(order)).filter("k <= most")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = [(r["h"], r["text"], r["label"]) for r in chosen.withColumn("before", before).filter(F.col("before") < most_chars).select("h", "text", "label").collect()]
    rest(spark)  # before the training
    parts.sort(key=lambda x: x[:2])
    return [x[1] for x in parts], [x[2] for x in parts], {v: sum(n.values()) for v, n in by_level.items()}


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; false for null ids."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
