"""Terminology mapping: normalization, exact, variations, fuzzy scorers, TF-IDF, context, cascade.

The dictionary is a table: the built-in samples, and whatever concepts and custom
mappings the caller reads. It may be as large as a whole terminology, so joins
carry no hint and fuzzy stages meet it through an index: segments of terms for
edit distance, shared pairs of letters for ratios, shared words for TF-IDF. Every
blocking is exact: it loses no term that could reach its cutoff. Fuzzy stages
work on distinct terms that earlier stages left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolake.functions.text import let, normalize_term
from protolake.refdata import CONTEXT_HINTS, SYNONYMS, SYSTEM_URIS, TERM_ABBREVIATIONS, TERM_PREFIXES, concepts

SCHEMA = "system string, term string, code string, display string, priority int, ord int"
#: Cutoffs of ratio, partial ratio and token-sort ratio.
CUTOFFS = (90, 95, 85)
SCORERS = ("ratio", "partial_ratio", "token_sort_ratio")


def dictionary(spark: SparkSession, imported: DataFrame | None = None, mappings: DataFrame | None = None, built_in: bool = True) -> DataFrame:
    """system, term, code, display, priority, ord: the first match of each term.

    mappings (system, term, code, display) are a caller's custom mappings and come first, then the
    built-in custom ones, then imported concepts (the same columns) by code, then the built-in samples in table order.
    """
    columns = lambda df, priority: df.select("system", F.lower("term").alias("term"), "code", F.coalesce("display", "term").alias("display"), F.lit(priority).alias("priority"), F.lit(0).alias("ord"))
    parts = [spark.createDataFrame(concepts(), SCHEMA).withColumn("priority", F.when(F.col("priority") > 0, 2).otherwise(0))] if built_in else []
    parts += [columns(x, k) for x, k in ((mappings, -1), (imported, 1)) if x is not None]
    every = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)
    first = F.row_number().over(Window.partitionBy("system", "term").orderBy("priority", "ord", "code"))
    return every.withColumn("k", first).filter("k = 1").drop("k")


def statistics(d: DataFrame) -> DataFrame:
    """Entries of each system, and how many of them are custom."""
    return d.groupBy("system").agg(F.count("*").alias("n"), F.count_if(F.col("priority") <= 0).alias("custom"))


def mapper_statistics(d: DataFrame) -> DataFrame:
    """statistics() with the cutoffs of fuzzy matching; no external service is configured."""
    return statistics(d).select("*", *[F.lit(float(c)).alias(f"{n}_cutoff") for n, c in zip(SCORERS, CUTOFFS)], F.lit(70.0).alias("cosine_cutoff"), F.lit(True).alias("fuzzy"), F.lit(False).alias("external"))


def system_uri(system: Column) -> Column:
    out = F.lit("unknown")
    for k, v in SYSTEM_URIS.items():
        out = F.when(F.lower(system) == k, v).otherwise(out)
    return out


def map_exact(terms: DataFrame, d: DataFrame | None = None) -> DataFrame:
    """terms: system, text, ...; adds term, code, display (null without a match). d: a dictionary(), else the built-in one."""
    d = dictionary(terms.sparkSession) if d is None else d
    return terms.withColumn("term", normalize_term(F.col("text"))).join(d.select("system", "term", "code", "display"), ["system", "term"], "left")


def variations(term: Column) -> Column:
    """The term, without a prefix, without punctuation, squeezed, abbreviated or spelled out, and its synonyms; the term first, then by code point."""
    out = [term] + [F.when(F.startswith(term, F.lit(p)), F.substr(term, F.lit(len(p) + 1))) for p in TERM_PREFIXES]
    bare = F.regexp_replace(term, r"[^\p{L}\p{N}_\s]", " ")
    out += [bare, F.trim(F.regexp_replace(bare, r"\s+", " "))]
    for a, b in TERM_ABBREVIATIONS.items():
        out += [F.when(term == a, b).when(term == b, a)]
    sets = [F.when(term.isin(s), F.array(*[F.lit(x) for x in s])) for s in SYNONYMS.values()]
    none = F.array().cast("array<string>")
    rest = F.array_sort(F.array_except(F.concat(F.array_compact(F.array(*out)), *[F.coalesce(s, none) for s in sets]), F.array(term)))
    return F.concat(F.array(term), rest)


def add_synonyms(sets: DataFrame, term: str, synonyms: list[str]) -> DataFrame:
    """sets (set_id, term): the term's set takes the synonyms; a term without a set makes a new one."""
    words = sorted({x.lower() for x in (term, *synonyms)})
    mine = sets.filter(F.col("term") == term.lower()).agg(F.min("set_id").alias("set_id"))
    name = mine.select(F.coalesce("set_id", F.lit(f"set of {term.lower()}")).alias("set_id"))
    return sets.select("set_id", "term").unionByName(name.select("set_id", F.explode(F.array(*[F.lit(w) for w in words])).alias("term"))).distinct()


def built_in_synonyms(spark: SparkSession) -> DataFrame:
    """The built-in sets as (set_id, term)."""
    return spark.createDataFrame([(k, t) for k, ts in SYNONYMS.items() for t in ts], "set_id string, term string")


def map_variations(terms: DataFrame, d: DataFrame | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """terms: distinct (system, term); the first variation that the dictionary has. synonyms: further sets (set_id, term)."""
    d = dictionary(terms.sparkSession) if d is None else d
    tried = terms.select("system", "term", F.posexplode(variations(F.col("term"))).alias("k", "variation"))
    if synonyms is not None:
        own = synonyms.select("set_id", "term").distinct()
        more = terms.join(own, "term").join(own.select("set_id", F.col("term").alias("variation")), "set_id").filter("variation <> term")
        tried = tried.unionByName(more.select("system", "term", F.lit(1 << 20).alias("k"), "variation"))  # behind the built-in ones, by code point
    found = d.select("system", F.col("term").alias("variation"), "code", "display")
    best = tried.join(found, ["system", "variation"]).groupBy("system", "term").agg(F.min(F.struct("k", "variation", "code", "display")).alias("m"))
    return best.select("system", "term", "m.variation", "m.code", "m.display")


def _segments(n: Column, parts: int) -> Column:
    """(no, at, size) of the parts that a string of n characters is cut into, the longer ones last; places from 0."""
    small, long = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    at = lambda k: k * small + F.greatest(F.lit(0), k - (parts - long))
    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.struct(k.alias("no"), at(k).alias("at"), (small + F.when(k >= parts - long, 1).otherwise(0)).alias("size")))


def levenshtein_top1(terms: DataFrame, most: int = 3, d: DataFrame | None = None) -> DataFrame:
    """terms: distinct (system, term); the nearest dictionary term within ``most`` edits, ties by table order.

    A dictionary term is cut into most + 1 segments: within ``most`` edits one of them stands in the
    other term unchanged, at most ``most`` places away. So terms meet by (length, segment, its letters).
    """
    d = (dictionary(terms.sparkSession) if d is None else d).withColumn("n", F.length("term"))
    held = d.withColumn("s", F.explode(_segments(F.col("n"), most + 1))).select("system", "n", F.col("s.no").alias("no"), F.substr(F.col("term"), F.col("s.at") + 1, F.col("s.size")).alias("letters"), F.col("term").alias("near"))
    m = F.length("term")
    asked = terms.select("system", "term", F.explode(F.sequence(F.greatest(F.lit(0), m - most), m + most)).alias("n")).withColumn("s", F.explode(_segments(F.col("n"), most + 1)))
    shifted = asked.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("s.at") - most), F.col("s.at") + most))).filter(F.col("at") + F.col("s.size") <= m)
    wanted = shifted.select("system", "term", "n", F.col("s.no").alias("no"), F.substr(F.col("term"), F.col("at") + 1, F.col("s.size")).alias("letters")).distinct()
    pairs = wanted.join(held, ["system", "n", "no", "letters"]).select("system", "term", "near").distinct()
    close = pairs.withColumn("distance", F.levenshtein("term", "near", most)).filter("distance >= 0")
    ranked = close.join(d.select("system", F.col("term").alias("near"), "code", "priority", "ord"), ["system", "near"])
    best = ranked.groupBy("system", "term").agg(F.min(F.struct("distance", "priority", "ord", "near", "code")).alias("x"))
    return best.select("system", "term", "x.near", "x.code", "x.distance")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * longest common subsequence / total length."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter one with windows of the longer one of its length, partial windows at both ends included."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    windows = {long[max(0, k) : k + n] for k in range(1 - n, len(long))}
    return max((indel_ratio(short, w) for w in windows if w), default=100.0 if not long else 0.0)


def _bigrams(text: Column) -> Column:
    """Pairs of letters of a string, each with how often it came before, so that equal ones are told apart."""
    pairs = let(F.filter(F.split(text, ""), lambda c: c != ""), lambda cs: F.transform(F.slice(cs, 1, F.greatest(F.size(cs) - 1, F.lit(0))), lambda c, i: F.concat(c, F.get(cs, i + 1))))
    return let(pairs, lambda ps: F.transform(ps, lambda p, i: F.concat(p, F.size(F.filter(F.slice(ps, F.lit(1), i), lambda q: q == p)).cast("string"))))


def ratio_candidates(terms: DataFrame, d: DataFrame) -> DataFrame:
    """Pairs (system, term, near) that share a third of the shorter one's pairs of letters, as they are or with words sorted.

    That is needed for each scorer at its cutoff: at most (100 - cutoff) % of the letters of both differ,
    so the common ones stand in few runs. Terms of one letter are found by exact match only.
    """

    def spread(df: DataFrame, name: str) -> DataFrame:
        ways = F.array(F.struct(F.lit(0).alias("way"), F.col(name).alias("t")), F.struct(F.lit(1).alias("way"), F.array_join(F.array_sort(F.filter(F.split(F.col(name), r"\s+"), lambda w: w != "")), " ").alias("t")))
        each = df.select("system", name, F.explode(ways).alias("w")).select("system", name, "w.way", _bigrams(F.col("w.t")).alias("gs"))
        return each.select("system", name, "way", F.size("gs").alias(f"n_{name}"), F.explode("gs").alias("g"))

    met = spread(terms.select("system", "term").distinct(), "term").join(spread(d.select("system", F.col("term").alias("near")).distinct(), "near"), ["system", "way", "g"])
    shared = met.groupBy("system", "term", "near", "way").agg(F.count("*").alias("n"), F.first("n_term").alias("x"), F.first("n_near").alias("y"))
    return shared.filter(3 * F.col("n") >= F.least("x", "y")).select("system", "term", "near").distinct()


def ratio_top1(terms: DataFrame, cutoffs: tuple[float, float, float] = CUTOFFS, d: DataFrame | None = None) -> DataFrame:
    """terms: distinct (system, term); the best of ratio, partial ratio and token-sort ratio above their cutoffs (85 at least); the earlier scorer and the earlier concept win ties."""
    if min(cutoffs) < 85:
        raise ValueError("candidates are complete for cutoffs of 85 and more")
    d = dictionary(terms.sparkSession) if d is None else d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, near in zip(b.column("term").to_pylist(), b.column("near").to_pylist()):
                scored = ((f(t, near), -k) for k, f in enumerate((indel_ratio, partial_ratio, token_sort_ratio)))
                out.append(max((x for x in scored if x[0] >= cutoffs[-x[1]]), default=(None, 0)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("system", "term", "near")), pa.array([x[0] for x in out], pa.float64()), pa.array([-x[1] for x in out], pa.int32())], ["system", "term", "near", "score", "scorer"])

    scored = ratio_candidates(terms, d).mapInArrow(run, "system string, term string, near string, score double, scorer int").filter("score is not null")
    ranked = scored.join(d.select("system", F.col("term").alias("near"), "code", "display", "priority", "ord"), ["system", "near"])
    best = ranked.groupBy("system", "term").agg(F.min(F.struct((-F.col("score")).alias("s"), "scorer", "priority", "ord", "near", "code", "display")).alias("x"))
    return best.select("system", "term", "x.near", "x.code", "x.display", (-F.col("x.s")).alias("score"), F.get(F.array(*[F.lit(n) for n in SCORERS]), F.col("x.scorer")).alias("scorer"))


def _grams(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """1- and 2-grams of words with their counts."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    held = df.select(*keys, words.alias("w"))
    pairs = F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))
    return held.select(*keys, F.explode(F.concat("w", pairs)).alias("g")).groupBy(*keys, "g").agg(F.count("*").alias("tf"))


def cosine_top1(terms: DataFrame, least: float = 0.7, d: DataFrame | None = None) -> DataFrame:
    """terms: distinct (system, term); the dictionary term with the highest TF-IDF cosine, 0.7 at least, ties by table order. One fit for each system."""
    d = dictionary(terms.sparkSession) if d is None else d
    n = d.groupBy("system").agg(F.count("*").alias("n"))
    mine = _grams(d, ["system", "term"], "term").withColumnRenamed("term", "near")
    idf = mine.groupBy("system", "g").agg(F.count("*").alias("df")).join(n, "system").select("system", "g", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def weighted(grams: DataFrame, key: str, out: str) -> DataFrame:
        w = grams.join(idf, ["system", "g"]).withColumn("w", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("system", key)))
        return w.withColumn("norm", norm).select("system", key, "g", (F.col("w") / F.col("norm")).alias(out))

    left, right = weighted(_grams(terms, ["system", "term"], "term"), "term", "a"), weighted(mine, "near", "b")
    scores = left.join(right, ["system", "g"]).groupBy("system", "term", "near").agg(F.round(F.sum(F.col("a") * F.col("b")), 6).alias("cosine")).filter(F.col("cosine") >= least)
    ranked = scores.join(d.select("system", F.col("term").alias("near"), "code", "display", "priority", "ord"), ["system", "near"])
    best = ranked.groupBy("system", "term").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "priority", "ord", "near", "code", "display")).alias("m"))
    return best.select("system", "term", "m.near", "m.code", F.round(-F.col("m.c") * 100, 4).alias("score"), "m.display")


def context_boost(matches: DataFrame, context: str = "context") -> DataFrame:
    """matches: system, display, score and a context; ten points more, 100 at most, if the display has a keyword one of whose hints stands in the context; context_term: the last keyword's first such hint."""
    hint = F.lit(None).cast("string")
    for system, keyword, hints in CONTEXT_HINTS:
        hit = F.get(F.filter(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(F.lower(F.col(context)), h)), F.lit(0))
        hint = F.when((F.col("system") == system) & F.contains(F.lower("display"), F.lit(keyword)) & hit.isNotNull(), hit).otherwise(hint)
    out = matches.withColumn("context_term", hint)
    return out.withColumn("score", F.when(F.col("context_term").isNotNull(), F.least(F.lit(100.0), F.col("score") + 10)).otherwise(F.col("score")))


def cascade(terms: DataFrame, d: DataFrame | None = None, synonyms: DataFrame | None = None, cutoffs: tuple[float, float, float] = CUTOFFS) -> DataFrame:
    """terms: distinct (system, term) normalized: code, display, match_type, score, attempted.

    Exact matches, then variations (both 100), then for what they left the better of ratios and TF-IDF
    cosine (ratios win ties). match_type none without a match, unsupported for a system that the dictionary lacks;
    attempted: the methods tried, joined by commas.
    """
    d = dictionary(terms.sparkSession) if d is None else d
    known = d.select("system", "term", F.col("code").alias("c0"), F.col("display").alias("d0"))
    exact = terms.select("system", "term").join(known, ["system", "term"], "left")
    left = exact.filter("c0 is null").select("system", "term")
    varied = map_variations(left, d, synonyms).select("system", "term", F.col("code").alias("c1"), F.col("display").alias("d1"))
    rest = left.join(varied.select("system", "term"), ["system", "term"], "left_anti")
    ratio = ratio_top1(rest, cutoffs, d).select("system", "term", F.struct("code", "display", F.col("scorer").alias("match_type"), "score").alias("r"))
    cosine = cosine_top1(rest, d=d).select("system", "term", F.struct("code", "display", F.lit("cosine").alias("match_type"), "score").alias("c"))
    systems = d.select("system").distinct().withColumn("supported", F.lit(True))
    both = exact.join(varied, ["system", "term"], "left").join(ratio, ["system", "term"], "left").join(cosine, ["system", "term"], "left").join(systems, "system", "left")
    fuzzy = F.when(F.col("c.score") > F.coalesce(F.col("r.score"), F.lit(0.0)), F.col("c")).otherwise(F.col("r"))
    match = F.when(F.col("c0").isNotNull(), F.lit("exact")).when(F.col("c1").isNotNull(), F.lit("variation")).when(fuzzy.isNotNull(), fuzzy["match_type"]).when(F.col("supported"), F.lit("none")).otherwise(F.lit("unsupported"))
    score = F.when(F.coalesce("c0", "c1").isNotNull(), F.lit(100.0)).otherwise(F.coalesce(fuzzy["score"], F.lit(0.0)))
    tried = F.when(F.col("c0").isNotNull(), "exact").when(F.col("c1").isNotNull(), "exact,variation").when(F.col("supported"), "exact,variation,string,cosine").otherwise("")
    return both.select("system", "term", F.coalesce("c0", "c1", fuzzy["code"]).alias("code"), F.coalesce("d0", "d1", fuzzy["display"]).alias("display"), match.alias("match_type"), score.alias("score"), tried.alias("attempted"))


def map_terms(terms: DataFrame, d: DataFrame | None = None, synonyms: DataFrame | None = None, context: str | None = None) -> DataFrame:
    """terms: system, text, ...: every row with term and what cascade() says of it, and uri. context: a column whose words raise the score of fuzzy matches (context_term)."""
    held = terms.withColumn("term", normalize_term(F.col("text")))
    mapped = held.join(cascade(held.select("system", "term").distinct(), d, synonyms), ["system", "term"], "left").withColumn("uri", system_uri(F.col("system")))
    if context is None:
        return mapped
    fuzzy = F.col("match_type").isin(*SCORERS, "cosine")
    boosted = context_boost(mapped.withColumn("before", F.col("score")), context)
    return boosted.withColumn("context_term", F.when(fuzzy, F.col("context_term"))).withColumn("score", F.when(fuzzy, F.col("score")).otherwise(F.col("before"))).drop("before")


#: Services in the order in which they are asked, and the systems that each knows (None: all).
SERVICES = {"rxnav": ["rxnorm"], "umls": None, "bioportal": None}


def external_matches(terms: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """terms: distinct (system, term): service, code, display of the first service whose table (system, term, code, display) has the term.

    Services are offline tables here: what a caller has fetched. They are asked in the order of SERVICES; those without a table are left out.
    """
    parts = []
    for k, (name, systems) in enumerate(SERVICES.items()):
        if name in tables:
            rows = tables[name].select("system", F.lower("term").alias("term"), F.struct(F.lit(k).alias("k"), F.lit(name).alias("service"), "code", "display").alias("x"))
            parts.append(rows if systems is None else rows.filter(F.col("system").isin(systems)))
    if not parts:
        return terms.filter(F.lit(False)).select("system", "term", *[F.lit("").alias(c) for c in ("service", "code", "display")])
    found = terms.select("system", "term").join(reduce(DataFrame.unionByName, parts), ["system", "term"]).groupBy("system", "term").agg(F.min("x").alias("x"))
    return found.select("system", "term", "x.service", "x.code", "x.display")


def cascade_with_services(terms: DataFrame, tables: dict[str, DataFrame], d: DataFrame | None = None, synonyms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """cascade(), with what the services know of terms that it leaves; and these as custom mappings (system, term, code, display) for the next dictionary()."""
    found = cascade(terms, d, synonyms)
    open_ = found.filter("match_type = 'none'").select("system", "term")
    more = external_matches(open_, tables)
    renamed = more.select("system", "term", "service", F.col("code").alias("c"), F.col("display").alias("s"))
    hit = F.col("service").isNotNull()
    both = found.join(renamed, ["system", "term"], "left")
    out = both.select("system", "term", F.coalesce("code", "c").alias("code"), F.coalesce("display", "s").alias("display"), F.when(hit, F.col("service")).otherwise(F.col("match_type")).alias("match_type"), F.when(hit, 100.0).otherwise(F.col("score")).alias("score"), F.when(F.col("match_type") == "none", F.concat("attempted", F.lit(",external"))).otherwise(F.col("attempted")).alias("attempted"))
    return out, more.drop("service")
