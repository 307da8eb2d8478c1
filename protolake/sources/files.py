"""Sources: text, binary documents, annotations, IOB2 corpora, terminology tables; and sinks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protolake.functions.text import normalize_parsed_whitespace, normalize_unicode
from protolake.operators.preprocess import preprocess_medical_text

#: What parse() reads.
FORMATS = [".pdf", ".docx", ".txt"]
ENTITY = "struct<id:string,text:string,type:string,start_pos:int,end_pos:int,confidence:double>"
SECTION = "struct<id:string,title:string,type:string,start_pos:int,end_pos:int>"
RELATION = "struct<id:string,source_id:string,target_id:string,type:string,confidence:double>"
ANNOTATED = f"document_info struct<name:string,type:string,annotation_date:string>, entities array<{ENTITY}>, sections array<{SECTION}>, relations array<{RELATION}>"
MAPPINGS = "mappings array<struct<term:string,system:string,code:string,display:string>>, synonyms array<struct<term:string,synonyms:array<string>>>"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def encoding(content: Column) -> Column:
    """By byte-order mark, else utf-8 if the bytes are valid, else latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    return (F.when(head == "EFBBBF", "utf-8-sig").when(F.startswith(head, F.lit("FFFE")), "utf-16-le").when(F.startswith(head, F.lit("FEFF")), "utf-16-be")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("iso-8859-1"))


def decoded(content: Column) -> Column:
    """Text of plain files, without the mark, with line feeds only."""
    rest = lambda n: F.substring(content, n + 1, 1 << 30)
    e = encoding(content)
    text = F.when(e == "utf-8-sig", F.decode(rest(3), "UTF-8")).when(e == "utf-16-le", F.decode(rest(2), "UTF-16LE")).when(e == "utf-16-be", F.decode(rest(2), "UTF-16BE")).when(e == "utf-8", F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"\r\n?", "\n")


def sniffed_encoding(content: Column, sample: int = 10_000) -> Column:
    """Without a byte-order mark, from the first bytes: utf-16 by the zero bytes of plain letters, utf-8 if valid (a character that the sample cuts is no fault), else windows-1252 if bytes stand where latin-1 has control characters, else latin-1."""
    head = F.substring(content, 1, sample)
    digits = F.hex(head)
    pairs = F.greatest(F.lit(1), F.floor(F.length(head) / 2))
    by_pair = F.regexp_replace(digits, "(.{4})", "$1 ")
    count = lambda pattern: F.regexp_count(by_pair, F.lit(pattern))
    marked = encoding(content)
    whole = F.is_valid_utf8(F.substring(content, 1, sample).cast("string"))
    cut = F.exists(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: F.is_valid_utf8(F.substr(head, F.lit(1), F.length(head) - k).cast("string"))) & (F.length(head) == sample)
    return (F.when(marked.isin("utf-8-sig", "utf-16-le", "utf-16-be"), marked).when(count(r"\b[2-7][0-9A-F]00 ") * 2 > pairs, "utf-16-le").when(count(r"\b00[2-7][0-9A-F] ") * 2 > pairs, "utf-16-be")
        .when(whole | cut, "utf-8").when(F.rlike(digits, F.lit("^(?:..)*(?:8[0-9A-F]|9[0-9A-F])")), "windows-1252").otherwise("iso-8859-1"))


def list_files(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """Metadata without content (the column is never read), newest first; extensions, if given, with their dots."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime", extension(F.col("path")).alias("extension"))
    return (files if extensions is None else files.filter(F.col("extension").isin([x.lower() for x in extensions]))).orderBy(F.desc("modificationTime"), "path")


def file_kind(path: Column, content: Column) -> Column:
    """The extension if it is a supported one, else what the first bytes say; null for others."""
    head, e = F.hex(F.substring(content, 1, 4)), extension(path)
    plain = F.is_valid_utf8(F.substring(content, 1, 1000).cast("string")) & ~F.rlike(F.hex(F.substring(content, 1, 1000)), F.lit("^(?:..)*00"))
    return F.when(e.isin(FORMATS), e).when(head == "25504446", ".pdf").when(head == "504B0304", ".docx").when((e == "") & plain, ".txt")


def docx_parts(data: bytes) -> tuple[str, list[tuple[str, int, int]], list[dict]]:
    """Text, headings (text, level, place) and tables of a document.

    Paragraphs by line; below them the tables: the first row names the columns, of the others each cell stands under its
    column's name (col_n without one), and a row is a line of cells joined by ' | '.
    """
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.parse(zipfile.ZipFile(io.BytesIO(data)).open("word/document.xml")).getroot().find(f"{w}body")
    text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t")).strip()
    out, at, headings, tables = [], 0, [], []

    def add(line: str) -> None:
        nonlocal at
        out.append(line)
        at += len(line) + 1

    nodes = list(body) if body is not None else []
    for node in nodes:
        if node.tag == f"{w}p" and (line := text_of(node)):
            style = node.find(f"{w}pPr/{w}pStyle")
            name = style.get(f"{w}val", "") if style is not None else ""
            if name.startswith("Heading"):
                digits = name.removeprefix("Heading").strip()
                headings.append((line, int(digits) if digits.isdigit() else 1, at))
            add(line)
    for node in nodes:
        if node.tag == f"{w}tbl":
            rows = [[text_of(c) for c in row.iter(f"{w}tc")] for row in node.iter(f"{w}tr")]
            names = rows[0] if rows else []
            held = []
            for cells in rows[1:]:
                held.append({(names[k] if k < len(names) and names[k] else f"col_{k + 1}"): c for k, c in enumerate(cells)})
                if line := " | ".join(cells):
                    add(line)
            tables.append({"id": f"table_{len(tables) + 1}", "row_count": len(rows), "col_count": len(names), "rows": held})
            add("")
    return "\n".join(out), headings, tables


def pages_text(pages: list[str], ocr: Callable[[int], str] | None = None, least: int = 10) -> str:
    """Pages with an empty line between them; those with fewer characters than ``least`` are read by ocr(number), if given."""
    return "\n\n".join(ocr(k) if ocr and len(p.strip()) < least else p for k, p in enumerate(pages))


PARSED = "path string, extension string, text string, error string, page_count int, headings array<struct<text: string, level: int, start: int>>, tables array<struct<id: string, row_count: int, col_count: int, rows: array<map<string, string>>>>"


def parse(spark: SparkSession, path: str, pdf_pages: Callable[[bytes], list[str]] | None = None, ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """path, extension, text, error, page_count, headings, tables, counts of every file; files of no supported kind and failures carry an error instead of text.

    The kind comes from the extension, else from the first bytes. Texts get plain characters and white space; plain files also
    what preprocess_medical_text() does. PDFs need a reader from the caller (bytes to pages); without one they carry an error. ocr reads a page that has hardly any text.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = raw.withColumn("kind", file_kind(F.col("path"), F.col("content")))
    no = lambda kind: F.lit(None).cast(kind)
    types = dict(x.strip().split(" ", 1) for x in re.split(r", (?=(?:headings|tables|error|text|extension|page_count) )", PARSED))
    plain = files.filter("kind = '.txt'").select("path", F.col("kind").alias("extension"), preprocess_medical_text(normalize_parsed_whitespace(normalize_unicode(decoded(F.col("content"))))).alias("text"), no("string").alias("error"), no("int").alias("page_count"), no(types["headings"]).alias("headings"), no(types["tables"]).alias("tables"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c, e in zip(b["path"], b["content"], b["kind"]):
                try:
                    if e == ".docx":
                        text, headings, tables = docx_parts(bytes(c))
                        rows.append((p, e, text, None, None, [dict(zip(("text", "level", "start"), h)) for h in headings], tables))
                    elif e == ".pdf" and pdf_pages:
                        pages = pdf_pages(bytes(c))
                        rows.append((p, e, pages_text(pages, (lambda k, data=bytes(c): ocr(data, k)) if ocr else None), None, len(pages), None, None))
                    else:
                        rows.append((p, e, None, f"unsupported format: {e or p.rpartition('/')[2]}", None, None, None))
                except Exception as x:  # a broken file must not end the job; its row says why
                    rows.append((p, e, None, f"{type(x).__name__}: {x}", None, None, None))
            yield pd.DataFrame(rows, columns=["path", "extension", "text", "error", "page_count", "headings", "tables"])

    packed = files.filter("kind is null or kind <> '.txt'").mapInPandas(read, PARSED)
    pdf = F.col("extension") == ".pdf"
    packed = packed.withColumn("text", F.when(pdf, normalize_parsed_whitespace(normalize_unicode(F.col("text")))).otherwise(F.col("text")))
    plain = plain.withColumn("text", F.regexp_replace("text", r"\A\s+", ""))
    every = plain.unionByName(packed).withColumn("text", F.regexp_replace("text", r"\s+\z", ""))
    t = F.col("text")
    return every.select("*", F.length(t).alias("char_count"), F.regexp_count(t, F.lit(r"\S+")).alias("word_count"), F.size(F.split(t, "\n")).alias("line_count"))


def parsed_sections(parsed: DataFrame) -> DataFrame:
    """path, no, title, level, start, stop, content of every parsed file: by its headings if it has some, else as sections() cuts texts, else by lines in capitals."""
    from protolake.operators.extract import sections_with_text
    from protolake.operators.sectioning import by_capital_lines, cut

    good = parsed.filter("text is not null").withColumn("doc_id", F.xxhash64("path"))
    with_heads = good.filter("size(headings) > 0").select("path", "text", "headings", F.posexplode("headings").alias("no", "h"))
    stop = F.coalesce(F.get("headings", F.col("no") + 1)["start"], F.length("text"))
    own = with_heads.select("path", "no", F.col("h.text").alias("title"), F.col("h.level").alias("level"), F.col("h.start").alias("start"), stop.alias("stop"), F.regexp_replace(F.substr(F.col("text"), F.col("h.start") + F.length("h.text") + 1, stop - F.col("h.start") - F.length("h.text")), r"^\s+|\s+\z", "").alias("content"))
    rest = good.filter("headings is null or size(headings) = 0").select("doc_id", "path", "text")
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    # content runs on by the title's length there, for the cues of short sections
    known = sections_with_text(rest).withColumn("content", bare(F.substr(F.col("content"), F.lit(1), F.col("stop") - F.col("start") - F.length("title"))))
    enough = known.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    none = F.lit(None).cast("int").alias("level")
    columns = ["doc_id", "no", "title", none, "start", "stop", "content"]
    few = rest.join(enough, "doc_id", "left_anti")
    capital = cut(few, by_capital_lines)
    others = known.join(capital.select("doc_id").distinct(), "doc_id", "left_anti").select(*columns).unionByName(capital.select(*columns))
    return own.unionByName(others.join(rest.select("doc_id", "path"), "doc_id").select("path", "no", "title", "level", "start", "stop", "content"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents; fields that a file lacks are null."""
    return spark.read.schema(ANNOTATED).option("multiLine", "true").json(path)


def annotated_entities(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("document_info.name").alias("name"), F.explode("entities").alias("e")).select("name", "e.id", "e.text", F.col("e.type").alias("label"), F.col("e.start_pos").alias("start"), F.col("e.end_pos").alias("stop"), "e.confidence")


def read_mappings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Bulk mappings and synonyms."""
    raw = spark.read.schema(MAPPINGS).option("multiLine", "true").json(path)
    return raw.select(F.inline("mappings")), raw.select(F.explode("synonyms").alias("s")).select("s.term", F.explode("s.synonyms").alias("synonym"))


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """A concept CSV with a header: terms in lower case, rows without code or term dropped, inactive ones too."""
    raw = spark.read.option("header", "true").csv(path)
    active = F.coalesce(F.col("is_active").try_cast("int"), F.lit(1)) if "is_active" in raw.columns else F.lit(1)
    shown = F.coalesce("display", "term") if "display" in raw.columns else F.col("term")
    return raw.filter(F.col("code").isNotNull() & F.col("term").isNotNull() & (active == 1)).withColumn("display", shown).withColumn("term", F.lower("term"))


CONCEPT_COLUMNS = {"snomed": [], "loinc": ["component", "property", "time", "scale", "method"], "rxnorm": ["tty"]}


def empty_concepts(spark: SparkSession, system: str) -> DataFrame:
    """The schema of a system's concepts, without rows."""
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in ("system", "code", "term", "display", *CONCEPT_COLUMNS[system])))


def read_terminologies(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """system, term, code, display of the concept files of several systems; a system whose file cannot be read has none here, so the built-in samples stand in for it."""
    from pyspark.errors import AnalysisException

    out = empty_concepts(spark, "snomed").select("system", "term", "code", "display")
    for system, path in paths.items():
        try:
            out = out.unionByName(read_concepts(spark, path).select(F.lit(system).alias("system"), "term", "code", "display"))
        except AnalysisException as x:
            if x.getCondition() != "PATH_NOT_FOUND":
                raise
    return out


def write_dictionary(spark: SparkSession, path: str, concepts: dict[str, str] | None = None, mappings: str | None = None) -> DataFrame:
    """Sets terminologies up: reads concept files by system and a file of custom mappings, writes the dictionary as a table by system, and gives its statistics."""
    from protolake.operators.terms import dictionary, mapper_statistics

    custom = read_mappings(spark, mappings)[0] if mappings else None
    dictionary(spark, read_terminologies(spark, concepts or {}), custom).write.mode("overwrite").partitionBy("system").parquet(path)
    return mapper_statistics(read_dictionary(spark, path))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary that write_dictionary() wrote; lookups of one system read its part only."""
    return spark.read.parquet(path)


def iob2_sentences(lines: DataFrame) -> DataFrame:
    """lines: path, no, value (token TAB tag, blank between sentences): path, sentence, tokens, tags. Each file's lines are one group."""
    w = Window.partitionBy("path").orderBy("no")
    blank = F.trim("value") == ""
    rows = lines.withColumn("sentence", F.sum(blank.cast("int")).over(w)).filter(~blank)
    parts = F.split("value", "\t")
    pairs = rows.groupBy("path", "sentence").agg(F.array_sort(F.collect_list(F.struct("no", F.get(parts, F.lit(0)).alias("token"), F.coalesce(F.get(parts, F.lit(1)), F.lit("O")).alias("tag")))).alias("x"))
    return pairs.select("path", "sentence", F.col("x.token").alias("tokens"), F.col("x.tag").alias("tags"))


def read_iob2(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("no", "value"))
    return iob2_sentences(whole)


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows replace current ones with equal keys."""
    both = current.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return both.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_v")))).filter("_k = 1").drop("_v", "_k")


def save_result(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_result(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def export(df: DataFrame, path: str, kind: str) -> None:
    """json, xml, csv (nested columns as JSON) or sql (a column statement); other kinds are refused."""
    if kind not in ("json", "xml", "csv", "sql"):
        raise ValueError(f"unknown format: {kind}")
    if kind == "csv":
        nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
        df = df.withColumns({c: F.to_json(c) for c in nested})
    out = (df.select("statement") if kind == "sql" else df).write.mode("overwrite")
    {"json": out.json, "xml": out.option("rowTag", "row").format("xml").save, "csv": out.option("header", "true").csv, "sql": out.text}[kind](path)


class Files:
    """File operations in any store that Spark reaches, through its Hadoop file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf, self.folder = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder.rstrip("/")

    def _at(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(name if "/" in name else f"{self.folder}/{name}")
        return path.getFileSystem(self.conf), path

    def save(self, name: str, data: bytes) -> str:
        fs, path = self._at(name)
        with_out = fs.create(path, True)
        try:
            with_out.write(bytearray(data))
        finally:
            with_out.close()
        return str(path)

    def path(self, name: str) -> str | None:
        """The file's path, or None if it is not there."""
        fs, path = self._at(name)
        return str(path) if fs.exists(path) else None

    def remove(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path) and fs.delete(path, True)

    def copy(self, name: str, to: str) -> bool:
        (a, source), (b, target) = self._at(name), self._at(to)
        return a.exists(source) and self.jvm.org.apache.hadoop.fs.FileUtil.copy(a, source, b, target, False, self.conf)

    def temporary(self) -> str:
        """A new folder for files that can go."""
        import uuid

        fs, path = self._at(f"{self.folder}/tmp-{uuid.uuid4().hex}")
        fs.mkdirs(path)
        return str(path)


def pretty_json(value: Column) -> Column:
    """A struct as indented JSON."""
    return F.to_json(value, {"pretty": "true"})


def html_tables(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """key and html: one table for each key, a row for each row in order, cells escaped. A key's rows make one value: for groups of moderate size."""
    head = F.lit("<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>")
    rows = html_table(df, columns).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "html"))).alias("x"))
    return rows.select(key, F.concat(head, F.array_join(F.transform("x", lambda r: r["html"]), ""), F.lit("</table>")).alias("html"))


def html_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """One HTML row for each row, cells escaped."""
    from protolake.functions.text import escape_html

    cells = [F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return df.select("*", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def expired(files: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Files older than the retention."""
    return files.filter(F.col("modificationTime") < now - F.make_interval(hours=F.lit(hours)))
