"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put into a pseudo-random order and laid end to end
as a stream of words, which is cut into blocks of equal size (the last may be
shorter). Slots take the golden-ratio points 0, g, 2g, ... modulo 1 through the
cumulative weights (a source weighs its target in blocks), so every run of
slots is close to the targets; the n-th slot of a source takes its n-th block,
and starts again after the last one. What the slots take is the mix: nothing is
added to or cut from it afterwards, so a source is off its target by a few
blocks at most, and a block is a small part of every source.

No step is one task's work: prefix sums are taken in two levels, over hash
buckets inside a source, over range partitions across sources, and over runs of
slots; the numbers of blocks and slots grow with the words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolake.llm.rows import unused
from protolake.llm.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Words of a block at most; and the fewest blocks of a source and of the mix, which make blocks smaller.
BLOCK, LEAST_BLOCKS, LEAST_SLOTS = 2048, 64, 1 << 15
#: More slots than this make blocks larger, as points repeat after 2**32.
MOST_SLOTS = 1 << 30
BUCKETS = 2048
_GOLDEN = 2654435769  # 2**32 / golden ratio, odd: 2**32 distinct points


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """df with, for each name, the sum of the column over all rows before in the order (unique). In two levels: inside range partitions, and over their totals."""
    part = unused(df, "part")
    dealt = stored(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    before = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(*[F.sum(c).alias(f"all_{n}") for n, c in sums.items()])  # a row for each partition
    over = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(part, *[F.coalesce(F.sum(f"all_{n}").over(over), F.lit(0)).alias(f"base_{n}") for n in sums])
    inside = dealt.withColumns({f"in_{n}": F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    return inside.join(bases, part).withColumns({n: F.col(f"in_{n}") + F.col(f"base_{n}") for n in sums}).drop(part, *[f"{p}_{n}" for p in ("in", "base") for n in sums])


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: float = 2.0) -> DataFrame:
    """sizes: one row for each source (source, source_size). Adds no (order), weight and target.

    Sources by code point, null last, weigh as listed, repeating. Targets share
    ``share`` of all sizes by weight and stop at ``most`` times their source's size;
    the excess is reshared until none is above. That is min(most * size, level * weight)
    for one level: sources are taken by size per weight, and the capped ones are
    those whose cap is below the level that the rest would get.
    """
    listed = F.array(*[F.lit(w) for w in weights])
    numbered = running(sizes.select("source", "source_size"), [F.col("source").isNull(), F.col("source").cast("binary")], {"no": F.lit(1).cast("long")})
    ranked = numbered.withColumn("weight", F.get(listed, (F.col("no") % len(weights)).cast("int")).cast("long"))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    cap = F.col("source_size") * F.lit(most)
    summed = running(ranked, [F.col("source_size") / F.col("weight"), F.col("no")], {"lower": F.col("source_size"), "lighter": F.col("weight")})
    level = (F.lit(float((total or 0) * share)) - F.col("lower") * F.lit(most)) / (F.lit(weight or 0) - F.col("lighter"))
    # the first source in this order that its cap does not bind sets the level; with none, all are capped
    free = summed.withColumn("level", level).filter(cap >= F.col("level") * F.col("weight"))
    least = free.agg(F.min(F.struct(F.col("source_size") / F.col("weight"), "no", "level"))["level"]).first()[0]
    target = cap if least is None else F.least(cap, F.lit(least) * F.col("weight"))
    return summed.select("no", "source", "source_size", "weight", target.alias("target"))


def block_sizes(wanted: DataFrame, total: float, block: int = BLOCK) -> DataFrame:
    """Adds block (words) to sources: at most ``block``, less for small sources and small mixes, more for huge ones."""
    even = max(1, min(block, int(total // LEAST_SLOTS)), int(total // MOST_SLOTS))
    return wanted.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(even), F.floor(F.col("source_size") / LEAST_BLOCKS))).cast("long"))


def schedule(wanted: DataFrame, most: int = 2) -> DataFrame:
    """wanted: sources (no, source_size, target, block). One row for each slot that takes a block: no, slot, k (its source's block), turn.

    A source's slots that would read it more than ``most`` times take nothing.
    """
    live = wanted.filter("target > 0 and source_size > 0").select("no", "source_size", "block", (F.col("target") / F.col("block")).alias("blocks"))
    summed = stored(running(live, [F.col("no")], {"low": F.col("blocks")}), "mix-weights")
    total = summed.agg(F.sum("blocks")).first()[0] or 0.0
    slots = int(total)
    spark = wanted.sparkSession
    # sources and points meet in the cells of the line of weights, 16 points each
    cells = max(1, slots // 16)
    cell = lambda x: F.least(F.floor(x / F.lit(total or 1.0) * cells), F.lit(cells - 1)).cast("long")
    spans = summed.withColumn("high", F.col("low") + F.col("blocks")).withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    at = F.pmod(F.col("id") * F.lit(_GOLDEN), F.lit(1 << 32)) / F.lit(float(1 << 32)) * F.lit(float(total))
    points = spark.range(slots).select(F.col("id").alias("slot"), at.alias("at")).withColumn("cell", cell(F.col("at")))
    drawn = points.join(spans, "cell").filter("at >= low and at < high").select("no", "slot", "source_size", "block")
    # slots rank inside their source: in runs of slots, then over the runs' counts
    run = max(4096, int(slots**0.5))
    drawn = stored(drawn.withColumn("run", F.floor(F.col("slot") / run)), "mix-drawn")
    base = drawn.groupBy("no", "run").agg(F.count("*").alias("n")).select("no", "run", F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("no", "run").orderBy("slot")) - 1
    ranked = drawn.withColumn("rank", rank).join(base, ["no", "run"]).withColumn("n", F.col("base") + F.col("rank"))
    cut = ranked.withColumn("m", F.ceil(F.col("source_size") / F.col("block")))
    return cut.select("no", "slot", (F.col("n") % F.col("m")).alias("k"), F.floor(F.col("n") / F.col("m")).alias("turn")).filter(F.col("turn") < most)


def streams(rows: DataFrame, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """rows: no, doc_id, size, tie, .... Adds begin: the document's place in its source's shuffled stream."""
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "tie", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = hashed.groupBy("no", "bucket").agg(F.sum("size").alias("n"))
    base = sums.select("no", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("no", "bucket").orderBy("h", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(base, ["no", "bucket"]).withColumn("begin", F.col("base") + F.col("inside")).drop("h", "bucket", "inside", "base")


def sized(df: DataFrame, source: str = "source") -> DataFrame:
    """doc_id, source, size (words) and tie (a hash of the text) of all rows."""
    return df.select("doc_id", F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col("text").cast("string")).alias("tie"))


def mix(df: DataFrame, share: float = 1.5, weights: tuple[int, ...] = WEIGHTS, most: int = 2, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of doc_id, text and source: (documents, sources, slots).

    documents: doc_id, no, size, tie, source_size, target, block, begin; sources: as targets() and block_sizes()
    give them; slots: as schedule() gives them. Null and empty texts have size 0 and are in no block; null
    sources are one source; repeated rows are documents each; an empty table, or one without any
    word, gives no slot. Reruns give the same mix.
    """
    docs = stored(sized(df), "mix-sizes")
    wanted = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    wanted = stored(wanted, "mix-targets")
    sources = stored(block_sizes(wanted, wanted.agg(F.sum("target")).first()[0] or 0.0, block), "mix-sources")
    # the table of sources follows their number, so the joins pick their own way
    known = docs.join(sources.select("no", F.col("source").alias("s"), "source_size", "target", "block"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return stored(streams(known), "mix-streams"), sources, stored(schedule(sources, most), "mix-slots")


def taken(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """documents with taken (words), n_slots and first_slot (of the blocks that hold its words; null without any), one row for each document."""
    spread = F.sequence(F.floor(F.col("begin") / F.col("block")), F.floor((F.col("begin") + F.col("size") - 1) / F.col("block")))
    pieces = docs.filter("size > 0").withColumn("k", F.explode(spread))
    used = slots.groupBy("no", "k").agg(F.count("*").alias("times"), F.min("slot").alias("first"))
    held = F.least(F.col("begin") + F.col("size"), (F.col("k") + 1) * F.col("block")) - F.greatest(F.col("begin"), F.col("k") * F.col("block"))
    met = pieces.join(used, ["no", "k"], "left").withColumn("words", held * F.coalesce("times", F.lit(0)))
    # a document with words has its place in its source for itself; one without takes nothing
    key = ["no", "begin", "doc_id", "tie", "source", "size", "source_size", "target", "block"]
    some = met.groupBy(*key).agg(F.sum("words").alias("taken"), F.coalesce(F.sum("times"), F.lit(0)).alias("n_slots"), F.min("first").alias("first_slot"))
    none = docs.filter("size = 0").select(*key, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("n_slots"), F.lit(None).cast("long").alias("first_slot"))
    return some.unionByName(none)


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows of the mix: each row of df as often as slots take the block that holds its first word, in slot order inside every partition.

    So a block stands for the documents that begin in it, and rows stay whole; a row comes up to ``most``
    times. Partitions are dealt by a hash, so each holds an even part of the mix, which is near the targets from its
    beginning on; texts are shuffled once. Rows without a word are in no block. Null doc_ids, sources and repeated
    rows are rows as others. All columns stay, whatever their names; an empty table gives no row.
    """
    names = df.columns
    at = {c.lower(): k for k, c in reversed(list(enumerate(names)))}
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])
    keys = plain.withColumns({"doc_id": F.col(f"c{at['doc_id']}"), "text": F.col(f"c{at['text']}").cast("string"), "source": F.col(f"c{at['source']}").cast("string")})
    docs, _, slots = mix(keys.select("doc_id", "text", "source"), **options)
    started = docs.filter("size > 0").withColumn("k", F.floor(F.col("begin") / F.col("block")))
    copies = started.join(slots, ["no", "k"]).select("doc_id", "source", "tie", "begin", "slot", "turn")
    # rows that agree in doc_id, source and text are alike: which of them a copy comes from makes no difference but for other columns
    n = F.row_number().over(Window.partitionBy("doc_id", "source", "tie", "turn").orderBy("begin"))
    chosen = copies.withColumn("nth", n).select(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("tie").alias("t"), "slot", "begin", "nth")
    alike = Window.partitionBy("doc_id", "source", "tie").orderBy(F.lit(0))
    rows = keys.withColumn("tie", F.xxhash64("text"))
    # numbers rows only where some are alike; a plain join otherwise, so texts are shuffled once
    repeated = not docs.filter("size > 0").groupBy("doc_id", "source", "tie").count().filter("count > 1").isEmpty()
    rows = rows.withColumn("nth", F.row_number().over(alike) if repeated else F.lit(1))
    same = F.col("doc_id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("tie") == F.col("t")) & (rows["nth"] == chosen["nth"])
    out = rows.drop("text").join(chosen, same).select(*[f"c{k}" for k in range(len(names))], "slot", "begin")
    return out.sortWithinPartitions("slot", "begin").select(*[f"c{k}" for k in range(len(names))]).toDF(*names)


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; first_slot: where it first comes, n_slots: how many slots take a part of it."""
    docs, _, slots = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken(docs, slots).select("doc_id", "size", "source_size", "target", "taken", "n_slots", "first_slot")
