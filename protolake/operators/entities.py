"""Entity spans and relations: decoding tags, overlaps, merging, pairs, classification, sections, graph."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolake.refdata import RELATION_CUES, TYPE_RELATIONS

TAGS = ["O", "B-ELIGIBILITY", "I-ELIGIBILITY", "B-CONDITION", "I-CONDITION", "O", "I-CONDITION", "B-MEDICATION", "I-MEDICATION"]
LABELS = ["MEDICATION", "CONDITION", "ELIGIBILITY", "PROCEDURE", "TIMEPOINT", "RECOMMENDATION", "ENDPOINT"]


def stub_tags(docs: DataFrame, tokens: int = 12) -> DataFrame:
    """A tagger that needs no model: tags and confidences from doc_id. doc_id, idx, start, stop, token, tag, confidence."""
    i, d = F.col("idx"), F.col("doc_id")
    rows = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(tokens - 1))).alias("idx"))
    return rows.select("doc_id", "idx", (i * 6).alias("start"), (i * 6 + 5).alias("stop"), F.concat(F.lit("t"), i.cast("string")).alias("token"),
        F.get(F.array(*[F.lit(t) for t in TAGS]), ((d * 7 + i * i * 3 + i) % len(TAGS)).cast("int")).alias("tag"), (0.5 + ((d + i * 13) % 50) / 100).alias("confidence"))


TAGS_SQL = f"SELECT doc_id, idx, idx * 6 AS start, idx * 6 + 5 AS stop, 't' || idx AS token, {TAGS}[(doc_id * 7 + idx * idx * 3 + idx) % {len(TAGS)} + 1] AS tag, 0.5::DOUBLE + ((doc_id + idx * 13) % 50) / 100::DOUBLE AS confidence FROM (SELECT doc_id, unnest(range(0, 12)) AS idx FROM documents WHERE doc_id IS NOT NULL)"


def bio_decode(tags: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Entities of token tags: a new one begins at B-, at another type, and behind a token that is O or below the threshold.

    text: the tokens without gaps; stop: where the next token begins, else the last one's end.
    """
    w = Window.partitionBy("doc_id").orderBy("idx")
    sure = tags.withColumn("next", F.lead("start").over(w)).filter((F.col("tag") != "O") & (F.col("confidence") >= threshold)).withColumn("label", F.regexp_replace("tag", "^[BI]-", ""))
    same = (F.lag("idx").over(w) == F.col("idx") - 1) & (F.lag("label").over(w) == F.col("label")) & ~F.startswith("tag", F.lit("B-"))
    numbered = sure.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("no", F.sum("new").over(w))
    found = numbered.groupBy("doc_id", "no").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max(F.coalesce("next", "stop")).alias("stop"), F.round(F.avg("confidence"), 6).alias("confidence"), F.array_sort(F.collect_list(F.struct("idx", "token"))).alias("t"))
    return found.select("doc_id", F.col("no").cast("int").alias("no"), "label", "start", "stop", "confidence", F.array_join(F.col("t.token"), "").alias("text"))


BIO_SQL = f"""SELECT doc_id, CAST(no AS INTEGER) AS no, min(label) AS label, CAST(min(start) AS INTEGER) AS start, CAST(max(coalesce(next, stop)) AS INTEGER) AS stop, round(avg(confidence), 6) AS confidence, string_agg(token, '' ORDER BY idx) AS text FROM (
    SELECT *, sum(CASE WHEN p = idx - 1 AND pl = label AND tag NOT LIKE 'B-%' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx) AS no FROM (
    SELECT *, lag(idx) OVER w AS p, lag(label) OVER w AS pl FROM (SELECT *, regexp_replace(tag, '^[BI]-', '') AS label FROM (SELECT *, lead(start) OVER (PARTITION BY doc_id ORDER BY idx) AS next FROM ({TAGS_SQL})) WHERE tag <> 'O' AND confidence >= 0.7)
    WINDOW w AS (PARTITION BY doc_id ORDER BY idx))) GROUP BY doc_id, no"""


def stub_entities(docs: DataFrame, n: int = 6) -> DataFrame:
    """doc_id, e, label, start, stop, confidence: entities made from doc_id."""
    e, d = F.col("e"), F.col("doc_id")
    rows = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("e"))
    start = ((d * 13 + e * 137) % 560).cast("int")
    return rows.select("doc_id", "e", F.get(F.array(*[F.lit(x) for x in LABELS]), ((d + e * e) % len(LABELS)).cast("int")).alias("label"), start.alias("start"), (start + 5 + (d + e * 7) % 30).cast("int").alias("stop"), (0.5 + ((d * 3 + e * 11) % 50) / 100).alias("confidence"))


ENTITIES_SQL = f"SELECT doc_id, e, {LABELS}[(doc_id + e * e) % {len(LABELS)} + 1] AS label, CAST((doc_id * 13 + e * 137) % 560 AS INTEGER) AS start, CAST((doc_id * 13 + e * 137) % 560 + 5 + (doc_id + e * 7) % 30 AS INTEGER) AS stop, 0.5::DOUBLE + ((doc_id * 3 + e * 11) % 50) / 100::DOUBLE AS confidence FROM (SELECT doc_id, CAST(unnest(range(0, 6)) AS INTEGER) AS e FROM documents WHERE doc_id IS NOT NULL)"


def resolve_overlaps(entities: DataFrame) -> DataFrame:
    """Greedy choice by confidence, then length, then order; an entity that overlaps a chosen one goes."""
    item = F.struct((-F.col("confidence")).alias("c"), (F.col("start") - F.col("stop")).alias("l"), "e", "label", "start", "stop", "confidence")
    ranked = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))
    kept = F.aggregate("all", none, lambda acc, x: F.when(F.exists(acc, lambda y: (x["start"] < y["stop"]) & (y["start"] < x["stop"])), acc).otherwise(F.concat(acc, F.array(x))))
    return ranked.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.e", "x.label", "x.start", "x.stop", F.round("x.confidence", 6).alias("confidence"))


OVERLAPS_SQL = f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, stop - start DESC, e) AS k FROM ({ENTITIES_SQL})),
r AS (SELECT doc_id, k, [{{'s': start, 't': stop}}] AS kept, true AS taken FROM o WHERE k = 1
    UNION ALL SELECT o.doc_id, o.k, CASE WHEN len(list_filter(kept, lambda y: o.start < y.t AND y.s < o.stop)) > 0 THEN kept ELSE list_append(kept, {{'s': o.start, 't': o.stop}}) END, len(list_filter(kept, lambda y: o.start < y.t AND y.s < o.stop)) = 0
    FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1)
SELECT o.doc_id, e, label, start, stop, round(confidence, 6) AS confidence FROM r JOIN o USING (doc_id, k) WHERE taken"""


def merge_spans(entities: DataFrame, gap: int = 3) -> DataFrame:
    """Neighbours of one label at most ``gap`` apart become one; confidence: the running mean of the last two, in closed form."""
    w = Window.partitionBy("doc_id").orderBy("start", "e")
    same = (F.col("start") <= F.lag("stop").over(w) + gap) & (F.lag("label").over(w) == F.col("label"))
    run = entities.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("no", F.sum("new").over(w))
    inside = Window.partitionBy("doc_id", "no")
    ranked = run.withColumn("i", F.row_number().over(inside.orderBy("start", "e"))).withColumn("k", F.count("*").over(inside))
    weight = F.pow(F.lit(2.0), -(F.col("k") - F.col("i") + F.when(F.col("i") == 1, 0).otherwise(1)))
    return ranked.groupBy("doc_id", "no").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max(F.struct("i", "stop"))["stop"].alias("stop"), F.round(F.sum(F.col("confidence") * weight), 6).alias("confidence"), F.count("*").alias("n")).withColumn("no", F.col("no").cast("int"))


MERGE_SQL = f"""SELECT doc_id, CAST(no AS INTEGER) AS no, min(label) AS label, min(start) AS start, arg_max(stop, i) AS stop, round(sum(confidence * pow(2.0, -(k - i + CASE WHEN i = 1 THEN 0 ELSE 1 END))), 6) AS confidence, count(*) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, no ORDER BY start, e) AS i, count(*) OVER (PARTITION BY doc_id, no) AS k FROM (SELECT *, sum(CASE WHEN start <= ps + 3 AND pl = label THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, e) AS no
    FROM (SELECT *, lag(stop) OVER w AS ps, lag(label) OVER w AS pl FROM ({ENTITIES_SQL}) WINDOW w AS (PARTITION BY doc_id ORDER BY start, e)))) GROUP BY doc_id, no"""


def entity_pairs(entities: DataFrame, reach: int = 500) -> DataFrame:
    """Ordered pairs of entities of a document, but those with both distances over ``reach``.

    Entities meet by document and stretch of text, so a long text's pairs grow with its length, not with its square: first those
    whose target begins near the source's end, then these turned around, but for what that finds again.
    """
    s, t = (entities.select("doc_id", *[F.col(c).alias(f"{p}_{c}") for c in ("e", "label", "start", "stop")]) for p in ("s", "t"))
    width = reach + 1
    cell = F.floor(F.col("s_stop") / width)
    left, right = s.withColumn("cell", F.explode(F.sequence(cell - 1, cell + 1))), t.withColumn("cell", F.floor(F.col("t_start") / width))
    near = left.join(right, ["doc_id", "cell"]).filter((F.col("s_e") != F.col("t_e")) & (F.abs(F.col("s_stop") - F.col("t_start")) <= reach)).drop("cell")
    turned = near.select("doc_id", *[F.col(f"{q}_{c}").alias(f"{p}_{c}") for p, q in (("s", "t"), ("t", "s")) for c in ("e", "label", "start", "stop")])
    return near.unionByName(turned.filter(F.abs(F.col("s_stop") - F.col("t_start")) > reach))


def pairs_sql(entities: str) -> str:
    cols = lambda p: ", ".join(f"{p}.{c} AS {p}_{c}" for c in ("e", "label", "start", "stop"))
    return f"SELECT s.doc_id, {cols('s')}, {cols('t')} FROM ({entities}) s JOIN ({entities}) t ON s.doc_id = t.doc_id AND s.e <> t.e AND NOT (abs(s.stop - t.start) > 500 AND abs(t.stop - s.start) > 500)"


class Cues:
    """All places of all cues in a text, and the first type with a cue inside a part of it.

    A cue counts in a part as if the part stood alone: where it touches the part's edge, no word goes on there.
    """

    def __init__(self) -> None:
        self.types = list(RELATION_CUES)
        order: dict[str, int] = {}
        for k, x in enumerate(self.types):
            for c in RELATION_CUES[x]:
                order.setdefault(c, k)
        self.cues = sorted(order.items(), key=lambda x: x[1])

    def places(self, text: str) -> list[tuple[int, int, int, bool, bool]]:
        """(type, start, stop, a word ends before it, a word ends with it), types in order."""
        out, word = [], lambda c: c == "_" or c.isascii() and c.isalnum()
        for cue, kind in self.cues:
            at = text.find(cue)
            while at >= 0:
                stop = at + len(cue)
                out.append((kind, at, stop, at == 0 or not word(text[at - 1]), stop == len(text) or not word(text[stop])))
                at = text.find(cue, at + 1)
        return out

    def first(self, places: list[tuple[int, int, int, bool, bool]], low: int, high: int) -> str | None:
        for kind, a, b, free, ends in places:
            if a >= low and b <= high and (free or a == low) and (ends or b == high):
                return self.types[kind]
        return None


Model = Callable[[str, int, int], tuple[str | None, float]]


class Judge:
    """Decides pairs of entities of one text by its cues and, if given, a model that is asked first."""

    def __init__(self, cues: Cues, text: str | None, model: Model | None = None) -> None:
        self.text, self.cues, self.model = (text or "").lower(), cues, model
        self.places, self.length = cues.places(self.text), len(self.text)

    def relation(self, inner: int, outer: int, low: int, high: int, kind: str | None, sure: float) -> tuple[str | None, float]:
        """Of a pair: inner and outer bound what lies between, low and high what lies around; kind and sure: what the labels suggest."""
        found, score = self.model(self.text, inner, outer) if self.model else (None, 0.0)
        if found is None:
            found, score = self.cues.first(self.places, inner, min(outer, self.length)), 0.8
        if found is None and sure <= 0.6:
            found, score = self.cues.first(self.places, low, min(high, self.length)), 0.6
        return (kind, sure) if found is None else (found, score)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a few rows: as Python objects, a row's list takes many times its bytes."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def classify_relations(pairs: DataFrame, texts: DataFrame, margin: int = 50, least: float = 0.5, model: Model | None = None) -> DataFrame:
    """A cue between the two 0.8, else a cue within ``margin`` around 0.6, else or if surer what the labels suggest.

    pairs: of doc_id; texts: doc_id, text. A document's pairs meet its text once; the text's cues
    are found once and each pair is decided by their places. model: (text, start and stop of what lies
    between) to (relation or None, confidence), asked first; the rules decide where it gives None.
    """
    low, high = F.least("s_start", "t_start"), F.greatest("s_stop", "t_stop")
    kind, sure = F.lit(None).cast("string"), F.lit(0.0)
    for a, b, x, c in reversed(TYPE_RELATIONS):
        either = ((F.col("s_label") == a) & (F.col("t_label") == b)) | ((F.col("s_label") == b) & (F.col("t_label") == a))
        kind, sure = F.when(either, x).otherwise(kind), F.when(either, c).otherwise(sure)
    inner, outer = F.least("s_stop", "t_stop"), F.greatest("s_start", "t_start")
    one = F.struct("s_e", "t_e", inner.alias("inner"), F.greatest(inner, outer).alias("outer"), F.greatest(F.lit(0), low - margin).alias("low"), (high + margin).alias("high"), kind.alias("kind"), sure.alias("sure"))
    # a document's pairs come from its few entities and are bounded by them; rows of texts that share a doc_id meet the pairs each
    packed = pairs.groupBy("doc_id").agg(F.collect_list(one).alias("pairs"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = Cues()
        for batch in sliced(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "s_e", "t_e", "relation", "confidence")}
            for doc_id, text, mine in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "pairs"))):
                judge_of = Judge(cues, text, model)
                for x in mine:
                    found, score = judge_of.relation(x["inner"], x["outer"], x["low"], x["high"], x["kind"], x["sure"])
                    if found is not None and score >= least:
                        for k, v in zip(out, (doc_id, x["s_e"], x["t_e"], found, score)):
                            out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("s_e", pa.int32()), ("t_e", pa.int32()), ("relation", pa.string()), ("confidence", pa.float64())])
    rows = packed.join(texts.select("doc_id", "text"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "pairs")
    return rows.mapInArrow(judge, "doc_id long, s_e int, t_e int, relation string, confidence double")


def neighbours(spans: list[tuple[int, int]], reach: int) -> Iterator[tuple[int, list[int]]]:
    """Each span's place with the ascending places of the others that are not more than ``reach`` away both ways, as entity_pairs() has it."""
    starts, stops = (sorted((x[k], i) for i, x in enumerate(spans)) for k in (0, 1))
    for i, (start, stop) in enumerate(spans):
        near = {j for _, j in starts[bisect_left(starts, (stop - reach,)) : bisect_left(starts, (stop + reach + 1,))]}
        near.update(j for _, j in stops[bisect_left(stops, (start - reach,)) : bisect_left(stops, (start + reach + 1,))])
        near.discard(i)
        yield i, sorted(near)


def relations_of(entities: list[tuple], judges: list[Judge], margin: int = 50, reach: int = 500) -> Iterator[tuple[int, int, str, float]]:
    """(s_e, t_e, relation, confidence) of the pairs of a document's entities (e, label, start, stop) in each of its texts, ordered by s_e and t_e.

    What classify_relations() finds in entity_pairs(). A pair and its reverse are judged at once; its verdicts are kept until the reverse's turn.
    """
    entities = sorted(entities, key=lambda x: x[0])
    kept: dict[tuple[int, int], list] = {}
    for e, same in groupby(neighbours([x[2:] for x in entities], reach), key=lambda x: entities[x[0]][0]):
        for j, i in sorted((j, i) for i, near in same for j in near):
            other = entities[j][0]
            if e == other:
                continue
            found = kept.pop((j, i), None)
            if found is None:
                (_, label, start, stop), (_, its_label, its_start, its_stop) = entities[i], entities[j]
                kind, sure = _SUGGESTED.get((label, its_label), (None, 0.0))
                inner, outer = min(stop, its_stop), max(start, its_start)
                around = (inner, max(inner, outer), max(0, min(start, its_start) - margin), max(stop, its_stop) + margin, kind, sure)
                found = kept[i, j] = [x.relation(*around) for x in judges]
            for relation, score in found:
                if relation is not None:
                    yield e, other, relation, score


_SUGGESTED: dict[tuple[str, str], tuple[str, float]] = {}
for _a, _b, _x, _c in TYPE_RELATIONS:
    _SUGGESTED.setdefault((_a, _b), (_x, _c))
    _SUGGESTED.setdefault((_b, _a), (_x, _c))


def relations_sql(pairs: str, texts: str) -> str:
    cue = lambda t: "CASE " + " ".join(f"WHEN regexp_matches({t}, '\\b(?:{'|'.join(cs)})\\b') THEN '{x}'" for x, cs in RELATION_CUES.items()) + " END"
    of = lambda v: "CASE " + " ".join(f"WHEN (s_label = '{a}' AND t_label = '{b}') OR (s_label = '{b}' AND t_label = '{a}') THEN {v(x, c)}" for a, b, x, c in TYPE_RELATIONS)
    return f"""SELECT doc_id, s_e, t_e, CASE WHEN b IS NOT NULL THEN b WHEN a IS NOT NULL AND s <= 0.6 THEN a ELSE k END AS relation, CASE WHEN b IS NOT NULL THEN 0.8::DOUBLE WHEN a IS NOT NULL AND s <= 0.6 THEN 0.6::DOUBLE ELSE s END AS confidence FROM (
        SELECT doc_id, s_e, t_e, {cue('bt')} AS b, {cue('ar')} AS a, {of(lambda x, c: chr(39) + x + chr(39))} END AS k, {of(lambda x, c: f'{c}::DOUBLE')} ELSE 0::DOUBLE END AS s FROM (
        SELECT *, substring(t, least(s_stop, t_stop) + 1, greatest(0, greatest(s_start, t_start) - least(s_stop, t_stop))) AS bt,
            substring(t, greatest(0, least(s_start, t_start) - 50) + 1, greatest(s_stop, t_stop) + 50 - greatest(0, least(s_start, t_start) - 50)) AS ar
        FROM ({pairs}) JOIN (SELECT doc_id, lower(text) AS t FROM ({texts})) USING (doc_id)))
    WHERE CASE WHEN b IS NOT NULL THEN 0.8 WHEN a IS NOT NULL AND s <= 0.6 THEN 0.6 ELSE s END >= 0.5"""


def assign_sections(entities: DataFrame, sections: DataFrame) -> DataFrame:
    """Each entity with the first section whose range holds its start; null without one."""
    held = entities.join(sections.select("doc_id", F.col("no"), "title", F.col("start").alias("a"), F.col("stop").alias("b")), "doc_id").filter(F.col("start").between(F.col("a"), F.col("b")))
    first = held.groupBy("doc_id", "e").agg(F.min(F.struct("no", "title"))["title"].alias("title"))
    return entities.select("doc_id", "e", "start").join(first, ["doc_id", "e"], "left")


def relation_graph(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, title) and edges (source, target, label, title)."""
    percent = lambda c: F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%"))
    nodes = entities.select("doc_id", F.col("e").alias("id"), F.col("label"), F.concat("label", F.lit(" "), percent(F.col("confidence"))).alias("title"))
    edges = relations.select("doc_id", F.col("s_e").alias("source"), F.col("t_e").alias("target"), F.col("relation").alias("label"), F.concat("relation", F.lit(" "), percent(F.col("confidence"))).alias("title"))
    return nodes, edges
