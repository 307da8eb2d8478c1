"""General operators over whole raw texts, against brute force where SQL cannot follow."""

import hashlib
import re
import unicodedata

import pytest

from protolake import queries as core
from protolake.functions.text import CLEAN_RULES
from protolake.refdata import ABBREVIATIONS, CHARACTERS
from tests.compare import SF

RAW = ["normalize_abbreviations_documents", "normalize_dates_documents", "detect_document_type_documents", "key_phrase_scores_documents", "key_phrases_documents", "relation_classify_documents"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A table with no text, an empty one, and one beyond 100,000 characters with cues at its end."""
    d = str(tmp_path_factory.mktemp("raw"))
    end = "Pt seen w/o pain on 3/5/2024 in a clinical trial with placebo. größenh über"
    spark.createDataFrame([(1, None), (2, ""), (3, "filler words here. " * 6000 + end)], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def abbreviations(text):
    for pattern, by in ABBREVIATIONS:
        text = re.sub(pattern, by, text, flags=re.I)
    return text


def test_whole_texts_reach_the_general_operators(spark, tables):
    got = {n: [r for r in core.QUERIES[n](spark, tables).collect() if r["doc_id"] == 3] for n in RAW}
    assert "patient seen without pain" in got["normalize_abbreviations_documents"][0]["text"] and "2024-03-05" in got["normalize_dates_documents"][0]["text"]
    assert got["detect_document_type_documents"][0]["document_type"] == "clinical_trial"
    assert {"placebo", "clinical trial"} <= {r["phrase"] for r in got["key_phrase_scores_documents"]} and got["key_phrases_documents"]


def test_abbreviations_of_raw_texts_equal_brute_force(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text"] for r in core.QUERIES["normalize_abbreviations_documents"](spark, SF).collect()}
    assert got == {k: t if t is None else abbreviations(t) for k, t in rows.items()}


def test_clean_text_of_raw_texts_equals_brute_force(spark, tmp_path):
    def clean(text):
        text = unicodedata.normalize("NFKC", text or "")
        for a, b in CHARACTERS.items():
            text = text.replace(a, b)
        for pattern, by in CLEAN_RULES:
            text = re.sub(pattern, by.replace("$", "\\"), text)
        return abbreviations(text.strip(" "))

    odd = [(-1, None), (-2, ""), (-3, "  Pt\u00a0seen w/o \ufb01ve \u201cx\u201d\u2026 \u2013 end.\n\n Next\t\x07\uff11 ")]
    raw = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    raw.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["length"], r["digest"]) for r in core.QUERIES["clean_text_documents"](spark, str(tmp_path)).collect()}
    wanted = {r["doc_id"]: clean(r["text"]) for r in raw.collect()}
    assert wanted[-3] == 'patient seen without five "x"... - end.\nNext 1'
    assert got == {k: (len(t), hashlib.md5(t.encode()).hexdigest()) for k, t in wanted.items()}
