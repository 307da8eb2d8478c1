"""The operators on small cases whose results are known."""

import zipfile

import pytest
from pyspark.sql import functions as F

from protolake.functions import display as V
from protolake.functions import text as T
from protolake.operators import entities as N
from protolake.operators import extract as E
from protolake.operators import profile as P
from protolake.operators import standards as O
from protolake.operators import terms as M
from protolake.sources import files as S


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("term", ["history of asthma", "ASTHMA", "asthma,"])
def test_normalized_terms_map_exactly(spark, term):
    got = M.map_exact(spark.createDataFrame([("snomed", term)], "system string, text string")).first()
    assert (got["term"], got["code"]) == ("asthma", "195967001")


def test_fuzzy_stages(spark):
    rows = [("snomed", "htn"), ("snomed", "hypertention"), ("snomed", "zzzz qqqq"), ("loinc", "glucose"), ("rxnorm", "metphormin")]
    got = {r["term"]: r for r in M.cascade(spark.createDataFrame(rows, "system string, term string")).collect()}
    assert got["htn"]["code"] == got["hypertention"]["code"] == "38341003"
    assert (got["htn"]["match_type"], got["hypertention"]["match_type"]) == ("variation", "ratio")
    assert got["zzzz qqqq"]["match_type"] == "none" and got["glucose"]["code"] == "2339-0"
    assert got["metphormin"]["match_type"] == "none"


def test_scorers():
    assert round(M.indel_ratio("hypertention", "hypertension"), 2) == 91.67
    assert round(M.indel_ratio("metphormin", "metformin"), 2) == 84.21
    assert M.token_sort_ratio("b a", "a b") == 100.0 and M.partial_ratio("asthma", "bronchial asthma") == 100.0


ENT = "doc_id long, e int, label string, start int, stop int, confidence double"


def test_overlaps_keep_the_surest(spark):
    rows = [(1, 0, "A", 0, 10, 0.9), (1, 1, "A", 5, 15, 0.7), (1, 2, "A", 20, 30, 0.8)]
    assert sorted(r["e"] for r in N.resolve_overlaps(spark.createDataFrame(rows, ENT)).collect()) == [0, 2]


def test_merge(spark):
    rows = [(1, 0, "A", 0, 6, 0.9), (1, 1, "A", 7, 8, 0.8), (1, 2, "B", 20, 27, 0.7)]
    got = sorted((r["start"], r["stop"], r["confidence"]) for r in N.merge_spans(spark.createDataFrame(rows, ENT)).collect())
    assert got == [(0, 8, 0.85), (20, 27, 0.7)]


def test_relations(spark):
    text = "Patients with asthma including severe eczema"
    rows = [(1, 0, "X", 14, 20, 0.9), (1, 1, "Y", 38, 44, 0.9)]
    pairs = N.entity_pairs(spark.createDataFrame(rows, ENT))
    got = N.classify_relations(pairs, spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {(r["s_e"], r["t_e"], r["relation"], r["confidence"]) for r in got} == {(0, 1, "INCLUDES", 0.8), (1, 0, "INCLUDES", 0.8)}


def test_section_types(spark):
    rows = [("Study Objectives", ""), ("Part", "inclusion criteria are"), ("Part", "nothing here"), (None, None)]
    df = spark.createDataFrame(rows, "t string, c string").select(E.classify_section(F.col("t"), F.col("c")).alias("x")).select("x.*")
    got = [tuple(r) for r in df.collect()]
    assert got == [("OBJECTIVES", 0.9), ("ELIGIBILITY_SECTION", 0.7), ("UNKNOWN", 0.3), ("UNKNOWN", 0.3)]
    strict = spark.createDataFrame(rows[:1], "t string, c string").select(E.classify_section(F.col("t"), F.col("c"), strict=True)["kind"]).first()[0]
    assert strict == "UNKNOWN"


def test_sections_of_numbered_headings(spark):
    text = "1. INTRODUCTION\nab\n2. ELIGIBILITY CRITERIA\ncd\n3. PROCEDURES\nef"
    got = E.sections(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("no").collect()
    assert [r["title"] for r in got] == ["1. INTRODUCTION", "2. ELIGIBILITY CRITERIA", "3. PROCEDURES"]
    assert [text[r["start"] : r["stop"]][:2] for r in got] == ["1.", "2.", "3."] and got[-1]["stop"] == len(text)


def test_texts(spark):
    assert one(spark, T.normalize_abbreviations, "Pt with Hx of HTN w/o pain") == "patient with history of HTN without pain"
    assert one(spark, T.standardize_dosage, "10 mg daily q8h") == "10 mg once daily every 8 hours"
    assert one(spark, T.normalize_dates, "3/4/2024, 25/12/2023, March 7, 2021") == "2024-03-04, 2023-12-25, 2021-03-07"
    assert one(spark, T.normalize_unicode, "ﬁve – “x” …") == 'five - "x" ...'
    assert one(spark, T.sanitize_filename, "Test File Name !@#$%.txt") == "Test_File_Name_txt"
    assert one(spark, T.is_valid_date, "2023-02-31") and not one(spark, T.is_valid_date, "2023-13-01") and not one(spark, T.is_valid_date, None)
    assert one(spark, lambda c: T.file_size_text(F.length(c)), "x" * 2048) == "2.0 KB"
    assert one(spark, T.clean_text, None) == ""


def test_profiles_of_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a. b.")], "doc_id long, text string")
    for f in (P.text_statistics, P.dedupe_consecutive_lines, P.remove_headers_footers, P.detect_language, P.detect_document_type):
        assert f(df).count() == 3
    assert P.chunk_offsets(df).count() == 1 and P.key_phrases(df).count() == 0


def test_ddl_and_issues(spark):
    for d in ("sqlite", "postgresql", "mysql", "mssql"):
        assert all(O.create_table_sql(t, d).startswith(f"CREATE TABLE {t} (") for t in O.OMOP_SCHEMAS)
    rows = spark.createDataFrame([("1", None, "2023-13-40")], "doc_id string, procedure_concept_id string, procedure_date string")
    got = {r["issue"] for r in O.omop_issues("procedure_occurrence", rows, "doc_id").collect()}
    assert got == {f"Missing required field: procedure_{x}_id" for x in ("concept", "type_concept", "occurrence")} | {"procedure_date should be date"}  # fields that the rows lack are missing too


def test_parse_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("One é.\r\nTwo.\nThree.".encode())
    (tmp_path / "b.txt").write_bytes("é à".encode("latin-1"))
    (tmp_path / "c.xyz").write_bytes(b"?")
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    got = {r["path"][-5:]: r for r in S.parse(spark, str(tmp_path)).collect()}
    assert got["a.txt"]["line_count"] == 3 and got["a.txt"]["text"].startswith("One é.\n") and got["b.txt"]["text"] == "é à"
    assert got["c.xyz"]["error"].startswith("unsupported") and got["d.docx"[-5:]]["text"] == "Title" and got["d.docx"[-5:]]["tables"][0]["col_count"] == 2


def test_iob2_annotations_and_html(spark, tmp_path):
    lines = spark.createDataFrame([("p", 0, "Aspirin\tB-MED"), ("p", 1, "helps\tO"), ("p", 2, ""), ("p", 3, "Yes\tO")], "path string, no int, value string")
    got = sorted((r["sentence"], r["tokens"], r["tags"]) for r in S.iob2_sentences(lines).collect())
    assert got == [(0, ["Aspirin", "helps"], ["B-MED", "O"]), (1, ["Yes"], ["O"])]
    (tmp_path / "x.json").write_text('{"document_info": {"name": "n"}, "entities": [{"id": "e1", "text": "t", "type": "A", "start_pos": 0, "end_pos": 1, "confidence": 0.9}]}')
    assert S.annotated_entities(S.read_annotations(spark, str(tmp_path))).first()["label"] == "A"
    marked = spark.sql("SELECT 'a<b & c\nd' AS t, array(named_struct('start', 0, 'stop', 1, 'label', 'X', 'confidence', 0.5D)) AS s").select(V.highlight_entities(F.col("t"), F.col("s"))).first()[0]
    assert marked == '<span class="entity" style="background-color: #e0e0e0;" data-type="X" title="X 50%">a</span>&lt;b &amp; c<br>d'


def test_upsert_latest_wins(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), spark.createDataFrame([("x", 9)], "k string, v int")
    assert sorted(tuple(r) for r in S.upsert(a, b, ["k"]).collect()) == [("x", 9), ("y", 2)]


def test_stream_of_files(spark, tmp_path):
    from protolake.streaming.ingest import ingest_sections, text_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("INTRODUCTION\nx\nMETHODS\ny")
    ingest_sections(text_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["title"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["INTRODUCTION", "METHODS"]


def test_cascade_agrees_with_its_stages(spark):
    rows = [("snomed", t) for t in ("asthma", "htn", "dm", "hypertenson", "essential hypertension disease", "nothing like it", "")] + [("loinc", "hba1c"), ("rxnorm", "atorvastatyn")]
    terms = spark.createDataFrame(rows, "system string, term string")
    got = {(r["system"], r["term"]): r for r in M.cascade(terms).collect()}
    assert len(got) == len(rows)
    ratios = {(r["system"], r["term"]): r["code"] for r in M.ratio_top1(terms).collect()}
    for k, r in got.items():
        if r["match_type"] in ("ratio", "partial_ratio", "token_sort_ratio"):
            assert ratios[k] == r["code"]
    assert got["rxnorm", "atorvastatyn"]["code"] == "83367" and got["snomed", "dm"]["code"] == "73211009"


def test_rules_and_marks_of_the_reference(spark):
    docs = lambda text: spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = E.rule_entities(docs("Eligible: adults. Exclude - smokers\nProtocol: give it. Administer: 5 mg"), E.CUED_ENTITY_RULES).orderBy("no").collect()
    assert [(r["label"], r["text"]) for r in got] == [("ELIGIBILITY", "smokers"), ("ELIGIBILITY", "adults"), ("PROCEDURE", "give it"), ("PROCEDURE", "5 mg")]
    got = E.references(docs("References\n[1] First one.\n(2) Second one.\n3. Third one.\n4) Fourth one."), E.ANY_REFERENCE).collect()
    assert [(r["number"], r["text"]) for r in got] == [("1", "First one."), ("2", "Second one."), ("3", "Third one."), ("4", "Fourth one.")]


def test_chunks_break_at_any_mark_or_line(spark):
    first = lambda text: P.chunk_offsets(spark.createDataFrame([(1, text)], "doc_id long, text string"), marks=".!?", at_lines=True).filter("no = 0").first()["stop"]
    assert [first("x" * 449 + mark + "y" * 400) for mark in (".", "!", "?", "\n", "-")] == [450, 450, 450, 450, 500]
    assert first("x" * 449 + "!" + "y" * 20 + "\n" + "y" * 400) == 450


def test_texts_without_a_heading_have_sections(spark):
    rows = [(1, "plain text of more than fifty characters on one line, and no heading"), (2, "Notes:\nsome words here\n\nlong " + "z" * 60 + "\n\nMore\nwords"), (3, " \n "), (4, None), (5, "INTRODUCTION\nx\n\nMore\nwords")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["no"], r["title"], r["start"], r["stop"]) for r in E.sections_or_whole(df).orderBy("doc_id", "no").collect()]
    n = [len(t or "") for _, t in rows]
    assert got == [(1, 0, "Document", 0, n[0]), (2, 0, "Notes", 0, rows[1][1].index("More")), (2, 1, "More", rows[1][1].index("More"), n[1]), (5, 0, "INTRODUCTION", 0, n[4])]


def test_blocked_stages_equal_all_pairs(spark):
    """Edit distance and ratios over their indexes find what a look at every pair finds."""
    import random

    from protolake.refdata import concepts

    rng = random.Random(4)
    table: dict = {}
    for system, term, code, _, priority, _ in sorted(concepts(), key=lambda x: x[4]):
        table.setdefault(system, {}).setdefault(term, code)
    rows = set()
    for system, terms in table.items():
        for t in terms:
            for _ in range(3):
                cs = list(t)
                for _ in range(rng.randint(0, 4)):
                    at = rng.randrange(len(cs) + 1)
                    cs[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x", " ", "er"])
                rows.add((system, "".join(cs).strip()))
            rows.add((system, " ".join(reversed(t.split()))))
    rows = sorted(r for r in rows if len(r[1]) > 1)
    df = spark.createDataFrame(rows, "system string, term string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
        return row[-1]

    got = {(r["system"], r["term"]): (r["distance"], r["near"]) for r in M.levenshtein_top1(df).collect()}
    for s, t in rows:
        near = min(((distance(t, c), k, c) for k, c in enumerate(table[s])))
        assert got.get((s, t)) == ((near[0], near[2]) if near[0] <= 3 else None)
    scorers = dict(zip(M.SCORERS, (M.indel_ratio, M.partial_ratio, M.token_sort_ratio)))
    got = {(r["system"], r["term"]): (r["near"], r["scorer"], r["score"]) for r in M.ratio_top1(df).collect()}
    for s, t in rows[::4]:
        found = [(-f(t, c), i, k, c, n) for i, (n, f) in enumerate(scorers.items()) for k, c in enumerate(table[s]) if f(t, c) >= M.CUTOFFS[i]]
        assert got.get((s, t)) == ((min(found)[3], min(found)[4], -min(found)[0]) if found else None)


def test_own_terminology_reaches_every_stage(spark, tmp_path):
    (tmp_path / "c.csv").write_text("code,term,display,is_active\n111,Zorbitis Magna,Zorbitis magna,1\n222,gone,,0\n333,asthma,Own asthma,1\n")
    (tmp_path / "m.json").write_text('{"mappings": [{"term": "zm", "system": "snomed", "code": "111", "display": "Zorbitis magna"}], "synonyms": [{"term": "zorbitis magna", "synonyms": ["zorb"]}]}')
    imported = S.read_concepts(spark, str(tmp_path / "c.csv")).withColumn("system", F.lit("snomed"))
    mappings, synonyms = S.read_mappings(spark, str(tmp_path / "m.json"))
    later = spark.createDataFrame([("zq", "snomed", "444", "Zq")], "term string, system string, code string, display string")
    d = M.dictionary(spark, imported, S.upsert(mappings, later, ["system", "term"]))
    sets = M.add_synonyms(synonyms.select(F.col("term").alias("set_id"), "term").unionByName(synonyms.select(F.col("term").alias("set_id"), F.col("synonym").alias("term"))), "zorb", ["zrb"])
    rows = [("snomed", t) for t in ("ZM", "zq", "zorb", "zrb", "zorbitis magno", "asthma", "gone")] + [("icd", "asthma")]
    got = {(r["system"], r["term"]): r for r in M.map_terms(spark.createDataFrame(rows, "system string, text string"), d, sets).collect()}
    assert [got["snomed", t]["code"] for t in ("zm", "zq", "zorb", "zrb", "zorbitis magno")] == ["111", "444", "111", "111", "111"]
    assert got["snomed", "zorb"]["match_type"] == "variation" and got["snomed", "zorbitis magno"]["match_type"] == "partial_ratio"
    assert got["snomed", "asthma"]["code"] == "333" and got["snomed", "gone"]["match_type"] == "none" and got["icd", "asthma"]["match_type"] == "unsupported"
    assert {r["system"]: r["custom"] for r in M.mapper_statistics(d).collect()}["snomed"] == 4
    assert M.levenshtein_top1(spark.createDataFrame([("snomed", "zorbitismagna")], "system string, term string"), d=d).first()["code"] == "111"


def test_context_raises_fuzzy_matches_only(spark):
    rows = [("snomed", "hypertention", "BP 140 mmHg"), ("snomed", "hypertension", "BP 140"), ("snomed", "hypertention", "none")]
    got = M.map_terms(spark.createDataFrame(rows, "system string, text string, context string"), context="context").collect()
    assert sorted((r["term"], r["context"], round(r["score"], 2), r["context_term"]) for r in got) == [("hypertension", "BP 140", 100.0, None), ("hypertention", "BP 140 mmHg", 100.0, "bp"), ("hypertention", "none", 91.67, None)]


def _docx(path, body):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_files_of_every_kind(spark, tmp_path):
    p = lambda text, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\'{style}\'/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    _docx(tmp_path / "a.docx", p("Aims", "Heading1") + p("First words.") + p("Methods", "Heading2") + f"<w:tbl>{row('Name', '')}{row('x', 'y')}</w:tbl>")
    (tmp_path / "b.pdf").write_bytes(b"%PDF one")
    (tmp_path / "c").write_bytes(b"%PDF two")
    (tmp_path / "d").write_text("plain text\r\nPt on 5mg\n")
    (tmp_path / "e.txt").write_text("SUMMARY OF RESULTS\nAll went well.\nNEXT STEPS\nNone.\n")
    (tmp_path / "f.bin").write_bytes(b"\x00\x01\x02")
    (tmp_path / "g.docx").write_bytes(b"PK\x03\x04broken")
    pages = lambda data: ["Page one has text.", " ", data.decode()]
    parsed = S.parse(spark, str(tmp_path), pages, lambda data, k: f"read {k} of {data[-3:].decode()}")
    got = {r["path"].rpartition("/")[2]: r for r in parsed.collect()}
    assert got["a.docx"]["text"] == "Aims\nFirst words.\nMethods\nx | y" and [tuple(h) for h in got["a.docx"]["headings"]] == [("Aims", 1, 0), ("Methods", 2, 18)]
    assert got["a.docx"]["tables"][0]["rows"] == [{"Name": "x", "col_2": "y"}] and (got["a.docx"]["tables"][0]["row_count"], got["a.docx"]["tables"][0]["col_count"]) == (2, 2)
    assert got["b.pdf"]["page_count"] == 3 and got["b.pdf"]["text"] == "Page one has text.\n\nread 1 of one\n\nread 2 of one"
    assert got["c"]["extension"] == ".pdf" and got["d"]["text"] == "plain text\npatient on 5 mg"
    assert got["f.bin"]["error"].startswith("unsupported") and got["g.docx"]["error"].startswith("BadZipFile")
    sections = {(r["path"].rpartition("/")[2], r["title"]): (r["level"], r["content"]) for r in S.parsed_sections(parsed).collect()}
    assert sections["a.docx", "Aims"] == (1, "First words.") and sections["a.docx", "Methods"] == (2, "x | y")
    assert sections["e.txt", "SUMMARY OF RESULTS"][1] == "All went well."
    assert [r["path"].rpartition("/")[2] for r in S.list_files(spark, str(tmp_path), [".DOCX"]).collect()] and S.list_files(spark, str(tmp_path), [".docx"]).count() == 2


def test_file_operations_and_sinks(spark, tmp_path):
    files = S.Files(spark, f"file://{tmp_path}/store")
    path = files.save("x.bin", b"abc")
    assert files.path("x.bin") == path and files.copy("x.bin", "y.bin") and files.remove("x.bin") and not files.remove("x.bin") and files.path("x.bin") is None
    assert (tmp_path / "store/y.bin").read_bytes() == b"abc" and files.path(files.temporary())
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, [])], "k int, t string, xs array<int>")
    S.save_result(df, f"{tmp_path}/r")
    assert sorted(map(tuple, S.load_result(spark, f"{tmp_path}/r", df.schema).collect())) == sorted(map(tuple, df.collect()))
    for kind in ("json", "xml", "csv"):
        S.export(df, f"{tmp_path}/{kind}", kind)
    assert spark.read.option("header", "true").csv(f"{tmp_path}/csv").orderBy("k").first()["xs"] == "[1,2]" and spark.read.option("rowTag", "row").format("xml").load(f"{tmp_path}/xml").count() == 2
    S.export(df.selectExpr("'SELECT 1;' AS statement"), f"{tmp_path}/sql", "sql")
    with pytest.raises(ValueError):
        S.export(df, f"{tmp_path}/z", "doc")
    (tmp_path / "s.csv").write_text("code,term\n9,Zorbitis\n")
    assert [tuple(r) for r in S.read_terminologies(spark, {"snomed": str(tmp_path / "s.csv"), "loinc": str(tmp_path / "none.csv")}).collect()] == [("snomed", "zorbitis", "9", "Zorbitis")]


def test_conversion_writes_tables_and_statements(spark, tmp_path):
    from protolake.operators import convert as C
    from protolake.queries.entities import elems
    from protolake.queries.text import unit_concept

    out = C.omop_convert(elems(spark, "/root/testdata/sf0.001"), unit_concept, "sqlite")
    done = C.write_tables(out["tables"], str(tmp_path))
    assert done == list(out["tables"]) and spark.read.option("header", "true").csv(f"{tmp_path}/specimen").count() == out["tables"]["specimen"].count()
    import sqlite3

    con = sqlite3.connect(":memory:")
    order = {"setup": 0, "create": 1, "index": 2, "insert": 3}
    for r in sorted(out["sql"].collect(), key=lambda r: order[r["kind"]]):
        con.execute(r["statement"].replace("_id INTEGER NOT NULL PRIMARY KEY", "_id INTEGER NOT NULL"))  # ids count within a protocol
    assert con.execute("SELECT count(*) FROM measurement").fetchone()[0] == out["tables"]["measurement"].count()
    assert {x for x in ("postgresql", "mysql", "mssql") if "CREATE TABLE" in C.generate_sql(out["tables"], x).filter("kind = 'create'").first()["statement"]} == {"postgresql", "mysql", "mssql"}
    need = [("person_id", "integer", True), ("x_date", "date", True)]
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 5)], "protocol_id long, specimen_id int, person_id int")
    whole, warnings = C.filled("specimen", rows, "2024-01-02", need)
    assert sorted((r["person_id"], r["x_date"]) for r in whole.collect()) == [(0, "2024-01-02"), (5, "2024-01-02")] and warnings.count() == 3


def test_broken_resources_are_found(spark):
    from protolake.operators import convert as C

    rows = [
        (1, "PlanDefinition", "p", 0, '{"resourceType":"PlanDefinition","status":"odd","action":[{"title":"","condition":[{"kind":"a"},{"expression":{"expression":"x"}}]},{"title":"t","definitionCanonical":"ActivityDefinition/none"}]}'),
        (2, "PlanDefinition", "p", 0, '{"resourceType":"Plan","action":"no"}'), (1, "ActivityDefinition", "a", 0, '{"resourceType":"ActivityDefinition","status":"draft","kind":"Odd","participant":[{}]}'),
        (1, "Library", "l", 0, '{"resourceType":"Library","status":"draft","type":{"text":"x"}}'), (1, "Questionnaire", "q", 0, '{"resourceType":"Questionnaire","status":"draft","item":[{"type":"odd"},{"linkId":"1"}]}'),
    ]
    got = {r["issue"] for r in C.fhir_validation(spark.createDataFrame(rows, "protocol_id long, resource_type string, id string, no int, resource string")).collect()}
    assert got == {
        "PlanDefinition has invalid status: odd", "PlanDefinition action[0] missing both title and description", "PlanDefinition action[0] condition[0] missing expression", "PlanDefinition action[0] condition[1] missing kind",
        "PlanDefinition has an invalid reference: ActivityDefinition/none", "Invalid resourceType for PlanDefinition", "PlanDefinition missing required element: status", "PlanDefinition action must be an array",
        "ActivityDefinition[0] has invalid kind: Odd", "ActivityDefinition[0] participant[0] missing type", "Library type.coding must be an array",
        "Questionnaire item[0] missing linkId", "Questionnaire item[0] has invalid type: odd", "Questionnaire item[1] missing type",
    }


def test_sections_by_other_cues():
    from protolake.operators import sectioning as G

    text = "Intro words\nmore\n\n  \nMETHODS\nWe did it.\n\n" + "long text " * 120 + "\n\nlast one"
    short = "A:\n\nbody\n\nB:\n\nrest"
    assert [(t, short[a:b]) for t, a, b in G.by_paragraphs(short)] == [("A:", "A:\n\nbody"), ("B:", "B:\n\nrest")]
    got = G.by_paragraphs(text)
    assert [t for t, _, _ in got] == ["Intro words", "last one"] and got[-1][2] == len(text) and text[got[1][1] :] == "last one"
    assert [t for t, _, _ in G.boundaries("1. Aims\nx\nWHAT WE DID\ny\nNotes:\n\nSmall head\n  indented")] == ["Aims", "WHAT WE DID", "Notes", "Small head"]
    assert G.boundaries("just one line of lower case words that is much longer than fifty characters") == [("Document", 0, 75)] and G.by_spacing("") == []
    assert [(t, x.strip()) for t, a, b in G.by_capital_lines("intro\nRESULTS ONE\nfine\nEND PART:\nbye") for x in ["intro\nRESULTS ONE\nfine\nEND PART:\nbye"[a:b]]] == [("RESULTS ONE", "fine"), ("END PART:", "bye")]
    whole = "x\nAims:\n" + "a" * 30 + " target " + "b" * 30 + "\nNext Part:\nmore"
    at = whole.index("target")
    assert G.context_of(whole, at, at + 6) == "Aims:\n" + "a" * 30 + " target " + "b" * 30
    assert G.font_segments('a<font size="bold 3">b</bold>c<font x>d</font>') == [("a", "default", False, False), ("b", "default", True, False), ("c", "default", False, False), ("d", "unknown", False, False)]


def test_extraction_falls_back_and_shifts_offsets(spark):
    from protolake.operators import extraction as X

    text = "filler words without any known term. " * 30 + "Patient on metformin and aspirin."
    docs = spark.createDataFrame([(1, text), (2, "Exclude: smokers and minors."), (3, None), (4, ""), (1, "asthma")], "doc_id long, text string")
    got = X.extract_entities(docs, clean=False, fallback=True).collect()
    first = [r for r in got if r["doc_id"] == 1 and r["label"] == "MEDICATION"]
    assert [text[r["start"] :].split()[0].strip(".") for r in first][:1] == ["metformin"] and any(r["text"] == "asthma" for r in got)
    assert [(r["label"], r["text"], r["confidence"]) for r in got if r["doc_id"] == 2] == [("ELIGIBILITY", "smokers and minors", 0.5)] and not [r for r in got if r["doc_id"] in (3, 4)]
    shout = lambda texts: [[(0, len(t), "B-ALL", 0.6)] for t in texts]
    assert X.extract_entities(docs, shout, clean=False).count() == 0 and {r["label"] for r in X.extract_entities(docs, shout, fallback=True).collect()} == {"ALL"}
    spans = [("a", "X", 0, 10, 0.9), ("b", "Y", 5, 20, 0.95), ("c", "Z", 20, 30, 0.5)]
    assert [x[0] for x in X.without_overlaps(spans)] == ["b", "c"]


def test_rows_that_share_an_id_are_kept_apart(spark):
    df = spark.createDataFrame([(1, "der die und der die und"), (1, "the and the and the and"), (None, "RESULTS\nx"), (None, "METHODS\ny")], "doc_id long, text string")
    assert sorted(r["language"] for r in P.detect_language(df).collect() if r["doc_id"] == 1) == ["de", "en"] and P.detect_language(df).count() == 4
    assert sorted(r["title"] for r in E.sections(df).collect()) == ["METHODS", "RESULTS"]
    from protolake.operators import preprocess as R

    got = R.preprocess_document(df).collect()
    assert len(got) == 4 and {r["section_count"] for r in got if r["doc_id"] is None} == {1}
    tables = spark.createDataFrame([(1, "x\na | b\nc | d\ny"), (1, "no table")], "doc_id long, text string")
    chunks = R.preprocess_for_model(tables).orderBy("text").collect()
    assert [r["text"] for r in chunks] == ["no table", "x\n[TABLE_1]\ny"] and chunks[1]["tables"] == ["a | b\nc | d"]


def test_terminologies_are_set_up_and_services_asked(spark, tmp_path):
    (tmp_path / "c.csv").write_text("code,term\n9,Zorbitis\n")
    got = {r["system"]: r["n"] for r in S.write_dictionary(spark, f"{tmp_path}/d", {"snomed": str(tmp_path / "c.csv")}).collect()}
    d = S.read_dictionary(spark, f"{tmp_path}/d")
    assert set(got) == {"snomed", "loinc", "rxnorm"} and sum(got.values()) == d.count()
    terms = spark.createDataFrame([("snomed", "zorbitis"), ("rxnorm", "unheard of"), ("snomed", "unheard of")], "system string, term string")
    rows = spark.createDataFrame([("rxnorm", "Unheard of", "1", "x")], "system string, term string, code string, display string")
    out, learned = M.cascade_with_services(terms, {"rxnav": rows, "umls": rows.withColumn("code", F.lit("2"))}, d)
    got = {(r["system"], r["term"]): (r["code"], r["match_type"]) for r in out.collect()}
    assert got == {("snomed", "zorbitis"): ("9", "exact"), ("rxnorm", "unheard of"): ("1", "rxnav"), ("snomed", "unheard of"): (None, "none")}
    assert M.map_exact(spark.createDataFrame([("rxnorm", "unheard of")], "system string, text string"), M.dictionary(spark, mappings=learned)).first()["code"] == "1"


def test_relation_model_is_asked_first(spark):
    from protolake.operators import extraction as X

    text = "metformin before asthma"
    e = spark.createDataFrame([(1, 0, "metformin", "MEDICATION", 0, 9, 0.9), (1, 1, "asthma", "CONDITION", 17, 23, 0.9)], "doc_id long, e int, text string, label string, start int, stop int, confidence double")
    t = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = lambda whole, a, b: ("OWN", 0.7) if "before" in whole[a:b] else (None, 0.0)
    assert {r["relation"] for r in X.extract_relations(e, t, model=model).collect()} == {"OWN"} and {r["relation"] for r in X.extract_relations(e, t).collect()} == {"PRECEDES"}


def test_log_of_runs(spark):
    from protolake.operators import monitor as Q

    runs, found = spark.createDataFrame([(1, 2.0), (2, 4.0)], "run long, seconds double"), spark.createDataFrame([(1, 0.5), (1, 0.7)], "run long, confidence double")
    log = Q.record_errors(Q.record_extractions(Q.new_log(spark), runs, found), runs.select("run"))
    assert tuple(Q.metrics(log).first()) == (3.0, 0.6, 1.0, 0.5) and Q.metrics(Q.new_log(spark)).first()["error_rate"] == 0.0


def test_sizes_go_on_beyond_a_long(spark, tmp_path):
    from protolake.queries.extension import QUERIES

    ids = [None, 2, 27, 600, 524_287, 524_288, 599_999, 10**13]
    spark.createDataFrame([(i, "") for i in ids], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["size"] for r in QUERIES["file_sizes"](spark, str(tmp_path)).collect()}
    assert float(got.pop(10**13).removesuffix(" GB")) == pytest.approx(64e39 / 2**30)
    assert got == {2: "512 B", 27: "1.2 MB", 600: "12.9 GB", 524_287: "8589885440.1 GB", 524_288: "8589934592.0 GB", 599_999: "12874538898.6 GB"}


def test_relations_are_made_in_their_documents_row(spark):
    """As pairs and their verdicts give them, without a shuffle of pairs: with ids used twice, far entities, texts that are null."""
    import random

    from pyspark.sql import Window

    from protolake.operators import extraction as X

    r = random.Random(5)
    words, labels = ["filler", "words", "before", "with", "causes", "İ", "prior to"], ["MEDICATION", "CONDITION", "ELIGIBILITY", "PROCEDURE", "TIMEPOINT", None]
    texts = [(d, " ".join(r.choices(words, k=r.choice([0, 30, 600])))) for d in range(12)] + [(3, "metformin before asthma"), (4, None), (None, "x"), (99, "no entities")]
    rows = [(d, e, r.choice(labels), a, a + r.randint(1, 40)) for d in range(14) for e in range(r.choice([1, 9, 40])) for a in [r.randint(0, 3000)]] + [(5, e, "CONDITION", 7 * e, 7 * e + 5) for e in range(4)] + [(None, 0, "CONDITION", 0, 5)]
    ents = spark.createDataFrame(rows, "doc_id long, e int, label string, start int, stop int")
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = X.extract_relations(ents, docs)
    cols = ["doc_id", "s_e", "t_e", "relation", "confidence"]
    slow = N.classify_relations(N.entity_pairs(ents), docs)
    got, want = ([tuple(x) for x in df.select(*cols).collect()] for df in (found, slow))
    assert len(got) > 500 and sorted(got) == sorted(want)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("s_e", "t_e"))
    ids = [sorted(tuple(x) for x in df.select("doc_id", "id", "s_e", "t_e").collect()) for df in (found, slow.withColumn("id", F.concat(F.lit("rel"), number)))]
    assert ids[0] == ids[1]
    low = [x for x in (tuple(x) for x in N.classify_relations(N.entity_pairs(ents), docs, least=0.8 * 0.7).select(*cols).collect())]
    sure = {x[0] for x in low if x[4] >= 0.7}
    again = [tuple(x) for x in X.extract_relations(ents, docs, 0.7, fallback=True).select(*cols).collect()]
    assert sorted(again) == sorted(x for x in low if x[0] not in sure or x[4] >= 0.7)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("Exchange hashpartitioning") == 2
