"""Queries of entities, relations and terminology."""

from __future__ import annotations

from pyspark.sql import functions as F

from protolake.functions.text import CLEAN_RULES, clean_text, normalize_term, sql_replaced, sql_term
from protolake.operators import entities as N
from protolake.operators import extract as E
from protolake.operators import extraction as X
from protolake.operators import terms as M
from protolake.plans.overlay import ELEMENTS_SQL, TEXTS_SQL, elements, sql_list
from protolake.queries.text import docs, texts
from protolake.refdata import ABBREVIATIONS, CONTEXT_HINTS, SYNONYMS, TERM_ABBREVIATIONS, TERM_PREFIXES, concepts


def ids(s, d):
    return docs(s, d, "doc_id").filter("doc_id is not null")


def elems(s, d):
    return elements(docs(s, d, "doc_id"))


def distinct_terms(s, d):
    return elems(s, d).select("system", normalize_term(F.col("text")).alias("term")).distinct()


def _relations(s, d):
    return N.classify_relations(N.entity_pairs(N.stub_entities(ids(s, d))), texts(s, d))


def _boost(s, d):
    matched = M.map_exact(elems(s, d)).filter("code is not null").select("doc_id", "system", "display", F.lit(85.0).alias("score")).join(texts(s, d), "doc_id")
    return M.context_boost(matched, "text").select("doc_id", "system", "display", "score", "context_term")


def cleaned(s, d):
    """Texts of the overlay as the extractor cleans them."""
    return texts(s, d).select("doc_id", clean_text(F.col("text")).alias("text"))


#: Words that the raw documents have: of licenses and of addresses.
RAW_LEXICON = {"LICENSE": ["license", "licensed", "version", "public", "rights", "reserved", "apache", "general"], "CONTACT": ["example", "token", "https", "email"]}


def _raw_entities(s, d):
    return X.extract_entities(docs(s, d).filter("doc_id is not null"), X.tagger_of(RAW_LEXICON), clean=False)


def _extracted_relations(s, d):
    return X.extract_relations(X.extract_entities(texts(s, d)), cleaned(s, d))


#: A made-up service's answers: (service, system, term, code, display).
ANSWERS = [("rxnav", "rxnorm", "study drug", "R1", "Study drug"), ("rxnav", "snomed", "liver biopsy", "no", "not asked"), ("umls", "snomed", "liver biopsy", "U1", "Biopsy of liver"), ("umls", "rxnorm", "study drug", "U2", "late"), ("bioportal", "loinc", "overall survival", "B1", "Survival")]


def _served(s, d):
    rows = s.createDataFrame(ANSWERS, "service string, system string, term string, code string, display string")
    tables = {x: rows.filter(F.col("service") == x) for x in M.SERVICES}
    return M.cascade_with_services(distinct_terms(s, d), tables)[0].select("system", "term", "code", "match_type")


QUERIES = {
    "term_services": _served,
    "extract_entities": lambda s, d: X.extract_entities(texts(s, d)),
    "extract_entities_documents": _raw_entities,
    "extract_relations": _extracted_relations,
    "extract_relations_documents": lambda s, d: X.extract_relations(_raw_entities(s, d), docs(s, d)),
    "relation_texts": lambda s, d: X.relation_texts(_extracted_relations(s, d), X.extract_entities(texts(s, d))),
    "entity_counts_by_label": lambda s, d: X.extract_entities(texts(s, d)).groupBy("label").agg(F.count("*").alias("n")),
    "bio_decode": lambda s, d: N.bio_decode(N.stub_tags(ids(s, d))),
    "confidence_filter": lambda s, d: N.stub_entities(ids(s, d)).filter("confidence >= 0.7").select("doc_id", "e", "label"),
    "resolve_overlaps": lambda s, d: N.resolve_overlaps(N.stub_entities(ids(s, d))),
    "merge_spans": lambda s, d: N.merge_spans(N.stub_entities(ids(s, d))),
    "entity_pairs_within_500": lambda s, d: N.entity_pairs(N.stub_entities(ids(s, d))),
    "relation_classify": _relations,
    "relation_classify_documents": lambda s, d: N.classify_relations(N.entity_pairs(N.stub_entities(ids(s, d))), docs(s, d)),
    "relation_graph_nodes": lambda s, d: N.relation_graph(N.stub_entities(ids(s, d)), _relations(s, d))[0],
    "relation_graph_edges": lambda s, d: N.relation_graph(N.stub_entities(ids(s, d)), _relations(s, d))[1],
    "entity_section_join": lambda s, d: N.assign_sections(N.stub_entities(ids(s, d)), E.sections(texts(s, d))),
    "term_normalize": lambda s, d: elems(s, d).select("doc_id", normalize_term(F.col("text")).alias("term")),
    "term_exact": lambda s, d: M.map_exact(elems(s, d)).select("doc_id", "system", "term", "code", "display", M.system_uri(F.col("system")).alias("uri")),
    "term_unmapped": lambda s, d: distinct_terms(s, d).join(M.dictionary(s), ["system", "term"], "left_anti"),
    "term_variations": lambda s, d: M.map_variations(distinct_terms(s, d)),
    "term_levenshtein_top1": lambda s, d: M.levenshtein_top1(distinct_terms(s, d)),
    "term_ratio_top1": lambda s, d: M.ratio_top1(distinct_terms(s, d)),
    "term_cosine_top1": lambda s, d: M.cosine_top1(distinct_terms(s, d)).drop("display"),
    "term_context_boost": _boost,
    "term_cascade": lambda s, d: M.cascade(distinct_terms(s, d)),
    "term_map": lambda s, d: M.map_terms(elems(s, d).select("doc_id", "system", "text").withColumn("context", F.concat(F.lit("Patient on metformin, glucose "), F.col("doc_id").cast("string"))), context="context").select("doc_id", "system", "term", "code", "match_type", F.round("score", 4).alias("score"), "context_term"),
    "term_statistics": lambda s, d: M.mapper_statistics(M.dictionary(s)),
}

_str = lambda x: "'" + x.replace("'", "''") + "'"
DICTIONARY_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({_str(s)}, {_str(t)}, {_str(c)}, {_str(v)}, {p}, {k})" for s, t, c, v, p, k in concepts()) + ") x(system, term, code, display, priority, ord) QUALIFY row_number() OVER (PARTITION BY system, term ORDER BY priority, ord) = 1"
TERMS_SQL = f"SELECT DISTINCT system, {sql_term('text')} AS term FROM ({ELEMENTS_SQL})"
MAPPED_SQL = f"SELECT e.*, t.term, code, display FROM (SELECT *, {sql_term('text')} AS term FROM ({ELEMENTS_SQL})) t JOIN ({ELEMENTS_SQL}) e USING (doc_id) LEFT JOIN ({DICTIONARY_SQL}) d ON d.system = t.system AND d.term = t.term"
_RELATIONS = N.relations_sql(N.pairs_sql(N.ENTITIES_SQL), TEXTS_SQL)
_PERCENT = lambda c: f"CAST(CAST(floor({c} * 100 + 0.5) AS INTEGER) AS VARCHAR) || '%'"
_BARE = r"regexp_replace(term, '[^\p{L}\p{N}_\s]', ' ', 'g')"
_VARIATIONS = "list_filter(list_distinct(list_concat(" + "[" + ", ".join(["term"] + [f"CASE WHEN starts_with(term, '{p}') THEN substring(term, {len(p) + 1}) END" for p in TERM_PREFIXES] + [_BARE, f"trim(regexp_replace({_BARE}, '\\s+', ' ', 'g'))"] + [f"CASE WHEN term = '{a}' THEN '{b}' WHEN term = '{b}' THEN '{a}' END" for a, b in TERM_ABBREVIATIONS.items()]) + "], " + ", ".join(f"CASE WHEN list_contains({sql_list(x)}, term) THEN {sql_list(x)} ELSE [] END" for x in SYNONYMS.values()) + ")), lambda v: v IS NOT NULL)"
_LEV = f"""SELECT t.system, t.term, d.term AS near, d.code, levenshtein(t.term, d.term) AS distance FROM ({TERMS_SQL}) t JOIN (SELECT *, row_number() OVER (PARTITION BY system ORDER BY priority, ord) AS k FROM ({DICTIONARY_SQL})) d ON t.system = d.system
    QUALIFY row_number() OVER (PARTITION BY t.system, t.term ORDER BY levenshtein(t.term, d.term), d.k) = 1"""


def _gram_sql(source: str, key: str) -> str:
    return rf"""SELECT system, {key}, g, count(*) AS tf FROM (SELECT system, {key}, unnest(list_concat(w, CASE WHEN len(w) < 2 THEN [] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g
        FROM (SELECT system, {key}, regexp_extract_all(lower(term), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM ({source}))) GROUP BY ALL"""


_COSINE = f"""WITH d AS (SELECT *, priority * 1000 + ord AS k FROM ({DICTIONARY_SQL})), mine AS ({_gram_sql('SELECT * FROM d', 'k')}), n AS (SELECT system, count(*) AS n FROM d GROUP BY system),
idf AS (SELECT system, g, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM mine JOIN n USING (system) GROUP BY system, g), theirs AS ({_gram_sql(TERMS_SQL, 'term')}),
a AS (SELECT system, term, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY system, term)) AS a FROM theirs JOIN idf USING (system, g)),
b AS (SELECT system, k, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY system, k)) AS b FROM mine JOIN idf USING (system, g)),
s AS (SELECT system, term, k, round(sum(a * b), 6) AS cosine FROM a JOIN b USING (system, g) GROUP BY system, term, k HAVING round(sum(a * b), 6) >= 0.7 QUALIFY row_number() OVER (PARTITION BY system, term ORDER BY round(sum(a * b), 6) DESC, k) = 1)
SELECT s.system, s.term, d.term AS near, d.code, round(cosine * 100, 4) AS score FROM s JOIN d ON s.system = d.system AND s.k = d.k"""
_HINT = "CASE " + " ".join(f"WHEN system = '{s}' AND contains(lower(display), '{k}') AND len(list_filter({sql_list(h)}, lambda x: contains(t, x))) > 0 THEN list_filter({sql_list(h)}, lambda x: contains(t, x))[1]" for s, k, h in reversed(CONTEXT_HINTS)) + " END"

CLEANED_SQL = f"SELECT doc_id, {sql_replaced('trim(' + sql_replaced('text', CLEAN_RULES, 'g') + ')', ABBREVIATIONS)} AS text FROM ({TEXTS_SQL})"
EXTRACTED_SQL = X.entities_sql(CLEANED_SQL)
_EXTRACTED_RELATIONS = X.relations_numbered_sql(N.relations_sql(N.pairs_sql(f"SELECT doc_id, e, label, start, stop FROM ({EXTRACTED_SQL})"), CLEANED_SQL))

_SORTED = lambda c: f"array_to_string(list_sort(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')), ' ')"
# the longest common subsequence of all pairs, a row of bits at a time: terms have fewer than 62 characters
_RATIO = f"""WITH t AS ({TERMS_SQL}), d AS ({DICTIONARY_SQL}), p AS (SELECT t.system, t.term, d.term AS near, d.code, d.display, d.priority, d.ord FROM t JOIN d USING (system) WHERE t.term <> ''),
o AS (SELECT *, CASE WHEN length(term) <= length(near) THEN term ELSE near END AS short, CASE WHEN length(term) <= length(near) THEN near ELSE term END AS long FROM p),
w AS (SELECT *, unnest(range(1 - length(short), length(long))) AS k FROM o),
s AS (SELECT system, term, near, code, display, priority, ord, 0 AS scorer, term AS a, near AS b FROM p UNION ALL SELECT system, term, near, code, display, priority, ord, 2, {_SORTED('term')}, {_SORTED('near')} FROM p
    UNION ALL SELECT DISTINCT system, term, near, code, display, priority, ord, 1, short, substring(long, greatest(0, k) + 1, k + length(short) - greatest(0, k)) FROM w),
m AS (SELECT *, (1::BIGINT << length(a)) - 1 AS whole, list_transform(string_split(b, ''), lambda c: CAST(list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = c THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END)) AS BIGINT)) AS masks FROM s WHERE a <> '' AND b <> ''),
x AS (SELECT *, 200.0::DOUBLE * (length(a) - bit_count(list_reduce(list_concat([whole], masks), lambda r, q: ((r + (r & q)) | (r - (r & q))) & whole))) / (length(a) + length(b)) AS score FROM m)
SELECT system, term, near, code, display, score, ['ratio', 'partial_ratio', 'token_sort_ratio'][scorer + 1] AS scorer FROM x WHERE score >= [90, 95, 85][scorer + 1] QUALIFY row_number() OVER (PARTITION BY system, term ORDER BY score DESC, scorer, priority, ord) = 1"""


def _cascade_sql(variations: str) -> str:
    return f"""SELECT t.system, t.term, coalesce(e.code, v.code, CASE WHEN c.score > coalesce(r.score, 0) THEN c.code ELSE r.code END) AS code, coalesce(e.display, v.display, CASE WHEN c.score > coalesce(r.score, 0) THEN c.display ELSE r.display END) AS display,
    CASE WHEN e.code IS NOT NULL THEN 'exact' WHEN v.code IS NOT NULL THEN 'variation' WHEN c.score > coalesce(r.score, 0) THEN 'cosine' ELSE coalesce(r.scorer, 'none') END AS match_type,
    CASE WHEN coalesce(e.code, v.code) IS NOT NULL THEN 100.0::DOUBLE ELSE greatest(coalesce(c.score, 0), coalesce(r.score, 0)) END AS score, CASE WHEN e.code IS NOT NULL THEN 'exact' WHEN v.code IS NOT NULL THEN 'exact,variation' ELSE 'exact,variation,string,cosine' END AS attempted
    FROM ({TERMS_SQL}) t LEFT JOIN ({DICTIONARY_SQL}) e ON e.system = t.system AND e.term = t.term LEFT JOIN ({variations}) v ON v.system = t.system AND v.term = t.term LEFT JOIN ({_RATIO}) r ON r.system = t.system AND r.term = t.term
    LEFT JOIN (SELECT k.*, d.display FROM ({_COSINE}) k JOIN ({DICTIONARY_SQL}) d ON d.system = k.system AND d.term = k.near) c ON c.system = t.system AND c.term = t.term"""


RAW_SQL = "SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL"
_RAW_ENTITIES = X.entities_sql(RAW_SQL, lexicon=RAW_LEXICON)

ORACLES = {
    "extract_entities_documents": _RAW_ENTITIES,
    "extract_relations_documents": X.relations_numbered_sql(N.relations_sql(N.pairs_sql(f"SELECT doc_id, e, label, start, stop FROM ({_RAW_ENTITIES})"), RAW_SQL)),
    "extract_entities": EXTRACTED_SQL,
    "extract_relations": _EXTRACTED_RELATIONS,
    "relation_texts": f"SELECT r.doc_id, r.id, s.text || ' --[' || relation || ']--> ' || t.text AS line FROM ({_EXTRACTED_RELATIONS}) r JOIN ({EXTRACTED_SQL}) s ON s.doc_id = r.doc_id AND s.e = s_e JOIN ({EXTRACTED_SQL}) t ON t.doc_id = r.doc_id AND t.e = t_e",
    "entity_counts_by_label": f"SELECT label, count(*) AS n FROM ({EXTRACTED_SQL}) GROUP BY label",
    "bio_decode": N.BIO_SQL,
    "confidence_filter": f"SELECT doc_id, e, label FROM ({N.ENTITIES_SQL}) WHERE confidence >= 0.7",
    "resolve_overlaps": N.OVERLAPS_SQL,
    "merge_spans": N.MERGE_SQL,
    "entity_pairs_within_500": N.pairs_sql(N.ENTITIES_SQL),
    "relation_classify": _RELATIONS,
    "relation_classify_documents": N.relations_sql(N.pairs_sql(N.ENTITIES_SQL), "SELECT doc_id, text FROM documents"),
    "relation_graph_nodes": f"SELECT doc_id, e AS id, label, label || ' ' || {_PERCENT('confidence')} AS title FROM ({N.ENTITIES_SQL})",
    "relation_graph_edges": f"SELECT doc_id, s_e AS source, t_e AS target, relation AS label, relation || ' ' || {_PERCENT('confidence')} AS title FROM ({_RELATIONS})",
    "entity_section_join": f"SELECT e.doc_id, e, any_value(e.start) AS start, arg_min(title, no) AS title FROM ({N.ENTITIES_SQL}) e LEFT JOIN ({E.sections_sql(TEXTS_SQL)}) s ON e.doc_id = s.doc_id AND e.start BETWEEN s.start AND s.stop GROUP BY e.doc_id, e",
    "term_normalize": f"SELECT doc_id, {sql_term('text')} AS term FROM ({ELEMENTS_SQL})",
    "term_exact": f"SELECT doc_id, system, term, code, display, CASE system WHEN 'snomed' THEN 'http://snomed.info/sct' WHEN 'loinc' THEN 'http://loinc.org' ELSE 'http://www.nlm.nih.gov/research/umls/rxnorm' END AS uri FROM ({MAPPED_SQL})",
    "term_unmapped": f"SELECT system, term FROM ({TERMS_SQL}) ANTI JOIN ({DICTIONARY_SQL}) USING (system, term)",
    "term_variations": f"SELECT v.system, v.term, v.variation, code, display FROM (SELECT system, term, unnest({_VARIATIONS}) AS variation FROM ({TERMS_SQL})) v JOIN ({DICTIONARY_SQL}) d ON d.system = v.system AND d.term = v.variation QUALIFY row_number() OVER (PARTITION BY v.system, v.term ORDER BY v.variation <> v.term, v.variation) = 1",
    "term_levenshtein_top1": f"SELECT system, term, near, code, CAST(distance AS INTEGER) AS distance FROM ({_LEV}) WHERE distance <= 3",
    "term_cosine_top1": _COSINE,
    "term_context_boost": f"SELECT doc_id, system, display, CASE WHEN hint IS NULL THEN 85.0::DOUBLE ELSE 95.0::DOUBLE END AS score, hint AS context_term FROM (SELECT doc_id, system, display, {_HINT} AS hint FROM (SELECT m.doc_id, system, display, lower(x.text) AS t FROM ({MAPPED_SQL}) m JOIN ({TEXTS_SQL}) x USING (doc_id) WHERE code IS NOT NULL))",
}
_CASCADE = _cascade_sql(ORACLES["term_variations"])
_FUZZY = "match_type IN ('ratio', 'partial_ratio', 'token_sort_ratio', 'cosine')"
ORACLES |= {
    "term_services": f"""SELECT c.system, c.term, coalesce(c.code, x.code) AS code, coalesce(x.service, match_type) AS match_type FROM ({_CASCADE}) c LEFT JOIN (SELECT * FROM (VALUES {', '.join(map(str, ANSWERS))}) v(service, system, term, code, display)
        WHERE service <> 'rxnav' OR system = 'rxnorm' QUALIFY row_number() OVER (PARTITION BY system, term ORDER BY service = 'bioportal', service = 'umls') = 1) x ON c.code IS NULL AND x.system = c.system AND x.term = c.term""",
    "term_ratio_top1": _RATIO,
    "term_cascade": _CASCADE,
    "term_map": f"""SELECT doc_id, system, term, code, match_type, round(CASE WHEN {_FUZZY} AND hint IS NOT NULL THEN least(100, score + 10) ELSE score END, 4) AS score, CASE WHEN {_FUZZY} THEN hint END AS context_term
        FROM (SELECT *, {_HINT} AS hint FROM (SELECT x.doc_id, m.*, 'patient on metformin, glucose ' || x.doc_id AS t FROM (SELECT doc_id, system, {sql_term('text')} AS term FROM ({ELEMENTS_SQL})) x JOIN ({_CASCADE}) m ON m.system = x.system AND m.term = x.term))""",
    "term_statistics": f"SELECT system, count(*) AS n, count(*) FILTER (priority = 0) AS custom, 90.0::DOUBLE AS ratio_cutoff, 95.0::DOUBLE AS partial_ratio_cutoff, 85.0::DOUBLE AS token_sort_ratio_cutoff, 70.0::DOUBLE AS cosine_cutoff, true AS fuzzy, false AS external FROM ({DICTIONARY_SQL}) GROUP BY system",
}
