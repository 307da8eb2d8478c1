"""The training-data operators: small cases, brute force, round trips, held-out accuracy."""

import gc
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from protolake.llm import columns, encode, langid, licenses, minhash, mixing, packing, quality, queries, separators, storage, token_files, topk, toxicity
from protolake.llm.components import components
from protolake.llm.labels import labelled_rows
from protolake.llm.words import read_words
from tests.compare import SF, assert_same

LONG = " ".join(f"w{k % 7919}" for k in range(30_000))
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " phi", "en", None), (4, None, None, "b"), (5, "", "en", "b"), (6, " \n\t ", "en", "b"), (7, "one two", "fr", "c"), (8, "One TWO", "fr", "c"),
    (9, LONG, "en", "a"), (10, "... 123 !!!", "de", "é"), (7, "one two", "fr", "c"), (None, "no id here", "en", "a"), (None, None, None, None),
]
CLASH = ["score", "predicted", "lang_pred", "accepted", "kept", "n_words", "labels", "cleaned", "base_failed", "size", "taken", "begin", "row", "bands", "_text", "_id", "_words", "_lines", "_base", "kept_id", "nth", "c0", "a1", "judged_text", "slot", "scanned", "counted"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names the operators use."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id = -1")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(encode.tokenizer_path())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_pieces_encode_as_whole_texts(library):
    rng = np.random.default_rng(3)
    parts = ["a", "b1", "'s", "'ll", "'", " ", "  ", "\n", "\t", ".", "é", "!?", "東", " ", "’", "x" * 40, "\r\n", "<|endoftext|>", "\x1c", "²"]
    texts = [None, "", " ", "it's 'll", *("".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(800))]
    flat, at = encode.PieceEncoder().encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert flat[at[k] : at[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def expected_ids(library, rows, end):
    return {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4") for d, t in rows}


def test_token_files_round_trip(spark, odd, none, docs, library):
    for df in (docs.limit(60), odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        manifest = token_files.write_token_files(df, storage.scratch(spark, "t"))
        got = token_files.read_token_files(manifest).collect()
        assert len(got) == len(rows)
        crc = sorted(zlib.crc32(x.tobytes()) for d, t in rows for x in expected_ids(library, [(d, t)], 0).values())
        assert sorted(r["ids_crc32"] for r in got) == crc
        ordered = sorted(got, key=lambda r: r["start"])
        assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
        assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in got), key=lambda x: (x is not None, x or 0))
    uri = manifest.filter("n_docs > 0").first()["path"]
    f = token_files.TokenFile(uri)
    whole = f.ids(0, f.n)
    assert all(np.array_equal(f.document(k), whole[f.starts[k] : f.starts[k + 1]]) for k in range(f.n_docs))
    assert token_files.read_token_files(token_files.write_token_files(none, storage.scratch(spark, "t"))).count() == 0


def test_smallest_id_is_no_null(spark):
    df = spark.createDataFrame([(-(2**63), "a b"), (None, "c"), (2**63 - 1, None)], "doc_id long, text string")
    got = token_files.read_token_files(token_files.write_token_files(df, storage.scratch(spark, "t"))).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -(2**63), 2**63 - 1]


def test_blocks_with_exceptions():
    rng = np.random.default_rng(0)
    for high in (1, 2, 50_000, 2**32 - 1):
        ids = rng.integers(0, 20, (50, 128)).astype(np.uint32)
        ids[rng.random(ids.shape) < 0.05] = high
        payload, low, widths, counts, over, places = token_files.pack_blocks(ids)
        assert np.array_equal(token_files.unpack_blocks(np.frombuffer(payload, np.uint8), low, widths, counts, over, places), ids)


def test_packing_places_every_piece(spark, odd, none, docs, library):
    for df in (docs, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = packing.pack_documents(df).collect()
        ids = [x for r in rows for x in expected_ids(library, [r], 2).values()]
        assert sum(r["length"] for r in got) == sum(map(len, ids))
        want = []
        for x in ids:
            head = (len(x) - 1) % 1024 + 1
            want += [zlib.crc32(x[max(0, head + (k - 1) * 1024) : head + k * 1024].tobytes()) for k in range(-(-len(x) // 1024))]
        assert sorted(r["ids_crc32"] for r in got) == sorted(want)
        held: dict = {}
        for r in got:
            held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for pieces in held.values():
            ends = np.cumsum([n for _, n in sorted(pieces)])
            assert ends[-1] <= 1024 and [a for a, _ in sorted(pieces)] == [0, *ends[:-1].tolist()]
        assert len(held) <= sum(map(len, ids)) / 1024 * 1.05 + 2
    assert packing.pack_documents(none).count() == 0


def test_sum_of_squares_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 17, 40)
        bins, _ = packing.sum_of_squares(lengths, 16)
        gaps: list[int] = []
        for s, b in zip(lengths.tolist(), bins.tolist()):
            def cost(k):
                after = [g - (s if j == k else 0) for j, g in enumerate(gaps)]
                return sum(after.count(g) ** 2 for g in set(after) if 0 < g < 16)
            fits = [k for k, g in enumerate(gaps) if g >= s]
            if fits:
                assert b < len(gaps) and cost(b) == min(map(cost, fits))
                gaps[b] -= s
            else:
                assert b == len(gaps)
                gaps.append(16 - s)


def test_separator_scan_over_small_blocks(spark, odd, none, library):
    written = separators.write_flat_files(odd, storage.scratch(spark, "f"))
    got = separators.scan_flat_files(written.filter("n_bytes is not null").select("path", "n_bytes", "id_bytes"), block_bytes=64)
    names = written.filter("ordinal is not null").select("path", "ordinal", "doc_id")
    found = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in names.join(got, ["path", "ordinal"]).collect())
    assert found == sorted((r[0] or 0, len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert separators.write_flat_files(none, storage.scratch(spark, "f")).count() == 0


def test_flat_files_of_large_vocabularies(spark, tmp_path):
    """Ids above 65535 are written whole."""
    import json

    vocabulary = {f"t{k}": k for k in range(70_000)}
    path = tmp_path / "large.json"
    path.write_text(json.dumps({"version": "1.0", "model": {"type": "WordLevel", "vocab": vocabulary, "unk_token": "t0"}}))
    assert separators.id_bytes(str(path), 69_999) == 4 and separators.id_bytes(encode.tokenizer_path(), separators.END_ID) == 2
    ids = np.array([69_999, 5, 69_999 - 65_536, 69_999, 69_999], "<u4")
    with storage.open_to_write(f"file://{tmp_path}/f.ids") as f:
        f.write(ids.tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/f.ids", 20, 4)], "path string, n_bytes long, id_bytes int")
    got = separators.scan_flat_files(files, 69_999, block_bytes=8).orderBy("start").collect()
    assert [r["n_tokens"] for r in got] == [0, 2, 0]


def python_mix(rows, share=1.5, weights=(5, 2, 1), most=2):
    """rows (doc_id, text, source) -> target of each source, by water filling round by round."""
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(mixing.WORD, t or ""))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, target, free = share * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= most * sizes[s]}
        for s in over or free:
            target[s] = most * sizes[s] if over else level * weight[s]
            left -= target[s]
        free -= over or free
    return sizes, target


def test_mix(spark, odd, none, docs):
    for df in (docs, odd):
        d, sources, slots = mixing.mix(df)
        got = mixing.taken(d, slots).collect()
        assert len(got) == df.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
        sizes, target = python_mix([tuple(r) for r in df.select("doc_id", "text", "source").collect()])
        by: dict = {}
        for r in got:
            by.setdefault(r["source"], []).append(r)
        for s, rows in by.items():
            assert rows[0]["source_size"] == sizes[s] == sum(r["size"] for r in rows) and abs(rows[0]["target"] - target[s]) < 1e-6
            assert abs(sum(r["taken"] for r in rows) - target[s]) <= 8 * rows[0]["block"]
        assert all((r["first_slot"] is None) == (r["n_slots"] == 0) == (r["taken"] == 0) for r in got)
    again = mixing.taken(*[mixing.mix(odd)[k] for k in (0, 2)]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    d, _, slots = mixing.mix(none)
    assert mixing.taken(d, slots).count() == 0
    skewed = [("s0", 300), ("s1", 200), ("s2", 10), ("s3", 5), ("s4", 100), (None, 1)]
    t = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(skewed, "source string, source_size long")).collect()}
    assert t["s3"] == 10 and t[None] == 2 and abs(sum(t.values()) - 1.5 * 616) < 1e-6


def test_every_run_of_slots_is_near_the_targets(spark, docs, monkeypatch):
    _, sources, slots = mixing.mix(docs)
    blocks = {r["no"]: r["target"] / r["block"] for r in sources.collect()}
    total, drawn = sum(blocks.values()), slots.orderBy("slot").select("no", "slot").toPandas()
    for a in range(0, len(drawn), 997):
        for n in (50, 500, 5000):
            run = drawn[(drawn.slot >= a) & (drawn.slot < a + n)].no.value_counts()
            if a + n <= total:
                assert all(abs(run.get(k, 0) - n * b / total) <= 8 for k, b in blocks.items())
    monkeypatch.setattr(mixing, "_GOLDEN", 1)  # points that are not spread: the mix must follow them
    d, sources, slots = mixing.mix(docs)
    rows = mixing.taken(d, slots).groupBy("no").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert sum(abs(r["n"] - r["t"]) > 0.5 * r["t"] for r in rows) > len(rows) / 2


def test_mixed_rows_follow_the_slots(spark, docs, odd):
    for df in (docs, odd):
        d, _, slots = mixing.mix(df)
        times: dict = {}
        for r in slots.collect():
            times.setdefault((r["no"], r["k"]), []).append(r["slot"])
        want, order = {}, {}
        for r in d.filter("size > 0").collect():
            mine = times.get((r["no"], r["begin"] // r["block"]), [])
            want[r["doc_id"], r["source"]] = want.get((r["doc_id"], r["source"]), 0) + len(mine)
            order.setdefault((r["doc_id"], r["source"]), set()).update(mine)
        assert mixing.mixed(df).columns == df.columns
        rows, got, last = mixing.mixed(df).withColumn("part", F.spark_partition_id()).collect(), {}, {}
        for r in rows:
            key = r["doc_id"], r["source"]
            got[key] = got.get(key, 0) + 1
            behind = [x for x in order[key] if x >= last.get(r["part"], 0)]  # the next slot of this document in slot order
            assert behind
            last[r["part"]] = min(behind)
        assert got == {k: n for k, n in want.items() if n}


def jaccard_components(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def near_copies():
    rng = np.random.default_rng(5)
    words = [f"t{k}" for k in range(60)]
    out = []
    for k in range(80):
        w = list(words)
        for at in rng.choice(60, rng.integers(0, 3), replace=False):
            w[at] = f"u{rng.integers(0, 50)}"
        out.append((100 + k, " ".join(w)))
    return out


def test_near_duplicates_by_brute_force(spark, odd, none, docs):
    plain = [r for r in docs.select("doc_id", "text").collect()]
    cases = [[tuple(r) for r in plain], near_copies()]
    for rows in cases:
        got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r["doc_id"]: tuple(r)[1:] for r in got} == jaccard_components(rows)
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    want = jaccard_components([(r[0], r[1]) for r in ROWS if r[0] is not None])
    assert all(tuple(r)[1:] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert all(r["component_id"] is None and not r["kept"] for r in got if r["doc_id"] is None)
    assert minhash.near_duplicates(none).count() == 0


def test_all_pairs_between_components(spark):
    """The last round alone, over chunks, connects what brute force connects."""
    rows = near_copies() * 5
    rows = [(k, t + f" v{k % 400} x{k % 7}") for k, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, text string")
    docs = df.withColumnRenamed("id", "doc_id")
    signed = minhash.sign(docs).select(F.col("doc_id").alias("id"), "sig", "n_shingles")
    members = signed.select(F.lit(1).cast("long").alias("bucket"), F.lit(len(rows)).cast("long").alias("n"), "id", F.col("id").alias("component"), "sig", "n_shingles")
    found = {r["id"]: r["component"] for r in components(minhash.across(members, docs)).collect()}
    want = jaccard_components(rows)
    assert {k: found.get(k, k) for k, _ in rows} == {k: v[1] for k, v in want.items()}


def test_posterior_bounds_are_sharp():
    least = minhash.least_matches()
    assert len(least) == 8 and list(least) == sorted(least) and 60 < least[-1] < 96


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (3, 9), (10, 11), (11, 12), (12, 10)] + [(k, k + 1) for k in range(100, 140)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10} | {k: 100 for k in range(100, 141)}


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.2, (400, 10)).astype(np.float32)
    x[50:90] = x[50]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1001, [float("nan")] * 10), (1002, [None] * 10), (1003, [])]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got: dict = {}
    for r in topk.top_k(df, df.filter("vec_id % 50 = 0"), 10, block_rows=64, query_rows=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    v = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    for q in range(0, 400, 50):
        s = v @ v[q]
        assert got[q] == [(k, s[k]) for k in sorted((k for k in range(400) if k != q), key=lambda k: (-s[k], k))[:10]]
    assert len(got) == 8 and topk.top_k(df.filter("vec_id < 0"), df.filter("vec_id < 0")).count() == 0


def test_bounds_prune_and_lengths_stay_apart(spark):
    """Most pairs get no exact product; vectors of other lengths are never compared."""
    v = topk.integer_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    asked = v.filter("vec_id % 100 = 0")
    for block_rows in (8000, 500):
        products = topk.searched(v, asked, block_rows=block_rows).agg(F.sum("exact")).first()[0]
        assert products < (0.25 if block_rows == 8000 else 0.5) * asked.count() * v.count()
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0, 0.2, 3 + k % 4).tolist()) for k in range(90)] + [(200, rng.normal(0, 1, 7).tolist())]
    df = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    held = {k: np.floor(1024 * np.array(x)).astype(np.int64) for k, x in rows}
    got: dict = {}
    for r in topk.top_k(df, df.filter("vec_id % 10 = 0"), 5, block_rows=20, query_rows=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in (k for k in held if k % 10 == 0):
        score = {k: int(x @ held[q]) for k, x in held.items() if k != q and len(x) == len(held[q])}
        assert got.get(q, []) == sorted(score.items(), key=lambda e: (-e[1], e[0]))[:5]


def test_quality_of_odd_rows(odd, none):
    got = quality.quality(odd).select("doc_id", "n_words", "n_repeat_words", "base_failed", "kept", "cleaned").collect()
    assert len(got) == len(ROWS) and all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 50)
    assert next(r for r in got if r["doc_id"] == 9)["n_repeat_words"] == 30_000 and quality.quality(none).count() == 0


def test_quality_lines(spark):
    good = "This line has many plain words and ends well. " * 8
    df = spark.createDataFrame([(1, good + "\nHome | About | News | Shop\nAll rights reserved."), (2, "\n".join(["a ### b *** c $$$ %%% &&& <<<"] * 3 + [f"x{k}" for k in range(9)]))], "doc_id long, text string")
    a, b = quality.quality(df).orderBy("doc_id").collect()
    assert a["cleaned"] == good and not b["kept"]


def test_top_k_of_repeated_rows_equals_sql(spark, tmp_path):
    import duckdb

    df = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id < 300")
    df.unionByName(df.filter("vec_id % 7 < 3")).unionByName(df.filter("vec_id % 100 = 50")).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(tuple(r) for r in topk.op7_top_k(spark, str(tmp_path)).collect())
    assert got and got == sorted(con.execute(topk.OP7_SQL).fetchall())


def test_licenses_of_odd_rows(spark, odd, none):
    assert licenses.scan_licenses(odd).select("labels").distinct().collect()[0][0] == "" and licenses.scan_licenses(none).count() == 0
    rows = [(1, "x\nReleased under the MIT License."), (2, "ALL-RIGHTS\nreserved cc by"), (3, "licence: Licensed under the Apache License, Version 2.0!"), (4, "released under the license")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["labels"], r["base_labels"], r["n_base"]) for r in got] == [("mit", "", 0), ("cc-by,reserved", "cc-by,reserved", 2), ("apache-2.0", "", 0), ("", "", 0)]


def test_licenses_that_wrap_over_lines(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    gpl = " * This work is licensed under the terms of\n * the GNU General Public License,\n * version 3."
    near = "A word nd above.\nLicensed under CC BY-NC 4.0"
    far = "released under the " + "x " * 40 + "\nmit license"
    rows = [(1, "Copyright (c) X. " + bsd), (2, gpl), (3, bsd.replace("\n", "\n \n")), (4, far), (5, "y\n" * 300 + bsd + "\ny" * 300), (6, "Released under\nthe MIT\nLicense"), (7, bsd.replace("\n", " ")), (8, near)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in range(1, 9)] == ["bsd", "gpl,gpl-3", "", "", "bsd", "mit", "bsd", "cc-by,cc-by-nc"]
    assert got[1]["score"] == got[5]["score"] == got[6]["score"] == got[7]["score"] == 1.0 and got[3]["score"] == 0.0


def test_wrapped_licenses_equal_brute_force(spark):
    rng = random.Random(5)
    notices, rows = [t.split() for t in licenses.TEMPLATES], []
    for k in range(120):
        words = [rng.choice(["the", "work", "under", "x", "y", "."]) for _ in range(rng.randint(0, 30))]
        for t in rng.sample(notices, 2):
            words += [w for w in t if rng.random() > 0.04] + [rng.choice(["z", "of", "license"]) for _ in range(rng.randint(0, 8))]
        rows.append((k, "".join(w + rng.choice([" ", " ", " ", "\n", "\n * ", "\n\n"] if rng.random() < 0.5 else [" "]) for w in words)))

    def in_order(run, phrase):
        best = [0] * (len(phrase) + 1)
        for w in run:
            for c in range(len(phrase), 0, -1):
                best[c] = best[c - 1] + 1 if w == phrase[c - 1] else best[c]
            for c in range(1, len(phrase) + 1):
                best[c] = max(best[c], best[c - 1])
        return best[-1]

    def labels(text):
        lines = [re.findall("[a-z0-9]+", x.lower()) for x in text.split("\n")]
        paragraphs = [[]]
        for x in lines:
            paragraphs = paragraphs[:-1] + [paragraphs[-1] + x] if x else paragraphs + [[]]
        found = {}
        for t, label in licenses.TEMPLATES.items():
            phrase, n = list(dict.fromkeys(t.split())), len(t.split()) * 3 // 2
            runs = [in_order(p[i : i + n], phrase) for p in paragraphs for i in range(len(p))]
            best = max([len(set(phrase) & set(x)) for x in lines] + runs)
            if 100 * best >= licenses.PERCENT * len(phrase):
                found[label] = best / len(phrase)
        return found

    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), phrases={}).collect()}
    wanted = {k: labels(t) for k, t in rows}
    assert {k: (r["labels"], r["score"]) for k, r in got.items()} == {k: (",".join(sorted(w)), max(w.values(), default=0.0)) for k, w in wanted.items()}
    assert any(wanted.values())


def test_templates_that_share_a_label(spark):
    templates = {"alpha beta gamma": "x", "delta epsilon zeta": "x"}
    df = spark.createDataFrame([(1, "Alpha beta GAMMA"), (2, "- delta\n- epsilon zeta"), (3, "alpha epsilon gamma")], "doc_id long, text string")
    assert [r["labels"] for r in licenses.scan_licenses(df, templates=templates).orderBy("doc_id").collect()] == ["x", "x", ""]


def test_hundreds_of_templates_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{rng.randint(0, 400) ** 2 // 400}" for _ in range(400)]
    templates = [(" ".join(rng.sample(words, rng.randint(4, 14))), f"l{k % 90}") for k in range(500)]
    rows = []
    for k in range(150):
        lines = []
        for _ in range(rng.randint(0, 6)):
            t = rng.choice(templates)[0].split()
            line = [w for w in t if rng.random() > 0.06] + rng.choices(words, k=rng.randint(0, 4))
            rng.shuffle(line)
            lines.append(" ".join(line) + "\n")  # an empty line behind each: no block is wider
        rows.append((k, "\n".join(lines)))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates, phrases={}).collect()}
    sets = [(set(t.split()), x) for t, x in templates]
    for k, text in rows:
        found = [(x, len(t & b) / len(t)) for b in (set(y.split()) for y in text.split("\n")) for t, x in sets if 100 * len(t & b) >= 90 * len(t)]
        assert got[k] == (",".join(sorted({x for x, _ in found})), max((p for _, p in found), default=0.0))


def test_language_id_on_held_out_rows(spark, odd, none, docs):
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(all_docs, per_label=100)
    held = all_docs.filter(langid.is_held_out(F.col("doc_id")))
    got = langid.identify(held, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    rows = langid.identify(odd, model).collect()
    assert len(rows) == len(ROWS) and {r["lang_pred"] for r in rows if r["doc_id"] in (4, 5, 6, 10)} == {"und"}
    assert langid.identify(none, model).count() == 0


def test_language_id_learns_every_language(spark):
    rng = random.Random(3)
    vocabulary = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for k in range(70)}
    names = [x for k, x in enumerate(vocabulary) for _ in range(12 if k < 69 else 6)]
    rows = [(k, " ".join(rng.choice(vocabulary[x]) for _ in range(30)), x) for k, x in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(df)
    assert sorted(model.languages) == sorted(vocabulary)
    got = langid.identify(df, model).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got if r["lang"] == "l69") and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.9 * len(got)


def test_rejection_of_other_languages(spark, docs):
    all_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(all_docs, per_label=100)
    foreign = ["xkcd qwrtp zxcvb mnbvc lkjhg fdsqw rtzpl kjhgf wqxzt", "Wszyscy ludzie rodz\u0105 si\u0119 wolni i r\u00f3wni pod wzgl\u0119dem swej godno\u015bci", "\u4eba\u4eba\u751f\u800c\u81ea\u7531", "\u0412\u0441\u0435 \u043b\u044e\u0434\u0438 \u0440\u043e\u0436\u0434\u0430\u044e\u0442\u0441\u044f \u0441\u0432\u043e\u0431\u043e\u0434\u043d\u044b\u043c\u0438"]
    best, p = model.predict(foreign)
    assert (best >= 0).all() and (p < model.least).all()
    plain = langid.LanguageModel(model.languages, model.by_bucket[:, :-1], model.bias[:-1], model.sharpness, model.least)
    assert (plain.predict(foreign)[1] >= model.least).any()  # without the learned class they would pass
    kept = langid.identify(all_docs.filter("lang is not null"), model, only_accepted=True)
    assert kept.columns == all_docs.columns and kept.count() >= 0.99 * all_docs.filter("lang is not null").count()
    assert 0.01 < langid.fitted_sharpness(np.array([[2.0, 0], [0, 2.0], [1.0, 0]]), np.array([0, 1, 1])) < 10


def test_training_rows_are_whole_and_bounded(spark):
    long = "x " * 50_000
    rows = [(k, long if k % 7 == 0 else f"text {k}", "a" if k % 3 else "b") for k in range(600)] + [(k, None, "a") for k in range(600, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    held = {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    texts, labels, counts = labelled_rows(df, None, {"a": 40, "b": 30})
    assert labels.count("a") == 40 and labels.count("b") == 30 and set(map(len, texts)) <= {len(long)} | set(range(5, 10))
    assert counts == {x: sum(1 for k, t, y in rows if t and y == x and k not in held) for x in "ab"}
    mine = labelled_rows(df.select("doc_id", "text"), df.select("doc_id", "label"), {"a": 40, "b": 30})
    assert sorted(zip(mine[0], mine[1])) == sorted(zip(texts, labels)) and mine[2] == counts
    assert sum(map(len, labelled_rows(df, None, 400, 300_000)[0])) < 2 * 400_100
    same = spark.createDataFrame([(7, f"t{k}", "a") for k in range(50)], "doc_id long, text string, label string")
    assert len(labelled_rows(same, None, 10)[0]) == 10  # one id for all rows: still a full sample


def slow_score(model, text):
    """The score of one text, window by window and word by word."""
    p, h = model.parameters, toxicity.HIDDEN
    sig = lambda x: 1 / (1 + np.exp(-x))
    words = re.findall(r"[0-9a-z@$*#\x80-\xff]+", (text or "").lower().encode().decode("latin-1"))
    vectors = []
    if not words:
        return 0.0
    for w in words:
        one = read_words([w.encode("latin-1").decode()], toxicity.BREAK)
        spots, _ = one.subwords(toxicity.CHAR_BUCKETS, toxicity.SIZES)
        v = np.concatenate([p["words"][int(one.hashes[0]) % toxicity.WORD_BUCKETS], p["chars"][spots].mean(0)])
        vectors.append(v @ p["input"] + p["bias"])
    best = None
    for a in range(0, 1 if len(words) <= 16 else len(words) - 16 + 8, 8):
        run = vectors[a : a + 16]
        states = []
        for d, order in ((0, run), (1, run[::-1])):
            s, mine = np.zeros(h), []
            for x in order:
                x = x[3 * h * d : 3 * h * (d + 1)]
                z, r = np.split(sig(x[: 2 * h] + s @ p["gates"][d]), 2)
                s = s + z * (np.tanh(x[2 * h :] + (r * s) @ p["state"][d]) - s)
                mine.append(s)
            states.append(mine if d == 0 else mine[::-1])
        joined = [np.concatenate(x) for x in zip(*states)]
        weight = np.exp([float((np.tanh(x @ p["look"] + p["look_bias"]) @ p["look_out"])[0]) for x in joined])
        logit = float((sum(w * x for w, x in zip(weight / weight.sum(), joined)) @ p["out"])[0] + p["out_bias"][0])
        best = logit if best is None else max(best, logit)
    return float(sig(model.sharpness * best + model.shift))


@pytest.fixture(scope="module")
def toxic_model(spark):
    d = "/root/testdata/sf0.1"
    return toxicity.fit_toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))


def test_toxicity_on_held_out_rows(spark, odd, none, toxic_model):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet").filter(langid.is_held_out(F.col("doc_id"))) for t in ("documents", "labels"))
    got = toxicity.score_toxicity(docs.join(labels, "doc_id"), toxic_model).collect()
    for toxic, least in ((0, 0.97), (1, 0.75)):
        mine = [r["predicted"] for r in got if r["toxic"] == toxic]
        assert len(mine) > 50 and sum(p == toxic for p in mine) >= least * len(mine)
    rows = toxicity.score_toxicity(odd, toxic_model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows) and toxicity.score_toxicity(none, toxic_model).count() == 0
    assert all(r["_text"] == "x" for r in rows) and all((r["predicted"] == 1) == (r["score"] >= 0.5) for r in rows)
    kept = toxicity.score_toxicity(odd, toxic_model, only_clean=True)
    assert kept.columns == odd.columns and kept.count() == sum(r["predicted"] == 0 for r in rows)


def test_toxicity_equals_a_slow_scorer(spark, toxic_model, docs):
    texts = [r[0] for r in docs.select("text").limit(25).collect()] + ["", None, "...", "a", "12 34", "un deux tr\u00e8s " * 9, "@$$ b*d #1 word!"]
    fast = toxic_model.score([x and x[:900] for x in texts])
    assert np.allclose(fast, [slow_score(toxic_model, x and x[:900]) for x in texts], atol=2e-4)
    assert np.allclose(fast, [toxic_model.score([x and x[:900]])[0] for x in texts], atol=1e-5)


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.new_parameters(rng).items()}
    x, mask = rng.normal(0, 1, (5, 3, 6 * toxicity.HIDDEN)), np.arange(5)[:, None] < np.array([5, 3, 1])
    want = np.array([0.3, -0.2, 0.5])
    loss = lambda: float((toxicity.forward(p, x, mask)[0] * want).sum())
    g, d_x = toxicity.backward(p, toxicity.forward(p, x, mask, keep=True)[1], want)
    for k in g:
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in p[k].shape)
            old = p[k][at]
            p[k][at] = old + 1e-2
            up = loss()
            p[k][at] = old - 1e-2
            down = loss()
            p[k][at] = old
            assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3, (k, at)
    x[0, 0, 0] += 1e-2
    up = loss()
    x[0, 0, 0] -= 2e-2
    assert abs((up - loss()) / 2e-2 - d_x[0, 0, 0]) < 2e-3


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, "/root/testdata/sf0.01").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns
        if k == 0:
            gone = before.join(docs, "doc_id", "left_anti").collect()
            assert sum(labels.get(r["doc_id"]) == 0 for r in gone) <= 0.05 * sum(x == 0 for x in labels.values())
        if k == 2:
            want = jaccard_components([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()])
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(d for d, w in want.items() if w[2])
    assert counts[1] > 0.8 * counts[0] and counts[2] > 0.98 * counts[1] and docs.count() > 0


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stage_on_odd_rows(spark, odd, none, tmp_path, k):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names and an empty table, stage by stage."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    _, stage = corpus_pipeline.STAGES[k]
    more = odd.unionByName(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source").withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    out = stage(spark, more, d)
    out.write.parquet(f"{tmp_path}/some")
    rows = spark.read.parquet(f"{tmp_path}/some").collect()
    empty = stage(spark, none, d)
    assert empty.count() == 0
    if k == 4:
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in more.collect()}
        return
    assert out.columns == odd.columns == empty.columns
    ids = [r["doc_id"] for r in rows]
    if k == 0:
        assert {4, 5, 6} <= set(ids) and ids.count(7) == 2 and len(rows) > 150
    if k == 1:
        assert not {4, 5, 6, 10} & set(ids) and len(rows) > 150
    if k == 2:
        assert {1, 4, 5, 6, 9, 10} <= set(ids) and 2 not in ids and 3 not in ids and 8 not in ids and ids.count(7) == 1 and ids.count(None) == 2
    if k == 3:
        assert not {4, 5, 6} & set(ids) and max(ids.count(x) for x in set(ids) - {None, 7}) <= 2
    whole = {r["doc_id"]: r["text"] for r in more.collect() if r["doc_id"] not in (None, 7)}
    assert all(r["text"] == whole[r["doc_id"]] for r in rows if r["doc_id"] in whole)


def test_storage_is_refused_on_a_cluster_without_a_shared_folder():
    class Far:
        conf = {}
        sparkContext = type("C", (), {"master": "local-cluster[3,2,3000]"})()

    with pytest.raises(ValueError):
        storage.shared_dir(Far)


def test_let_computes_once(spark):
    assert spark.range(1).select(columns.let(F.lit(3), lambda x: x + x)).first()[0] == 6


def test_scratch_folders_are_discarded(spark):
    kept = storage.stored(spark.range(3), "gone")
    assert kept.count() == 3
    storage.discard_scratch(spark)
    with pytest.raises(Exception):
        kept.count()


def test_names_that_differ_in_case(spark, odd):
    """Columns whose names differ in case only from an operator's are replaced, others stay."""
    df = odd.drop("score", "kept", "labels", "predicted", "row").select("*", F.lit(1).alias("SCORE"), F.lit(1).alias("Kept"), F.lit("y").alias("Labels"), F.lit(1).alias("Row"))
    model = langid.LanguageModel(["en"], np.zeros((4, 2)), np.zeros(2), 1.0, 0.0, True)
    assert [c for c in langid.identify(df, model).columns if c.lower() == "score"] == ["score"] and langid.identify(df, model).count() == len(ROWS)
    for out, name in ((licenses.scan_licenses(df), "labels"), (quality.quality(df), "kept")):
        assert [c.lower() for c in out.columns].count(name) == 1 and "Row" in out.columns and out.count() == len(ROWS)


def test_sifting_by_bitmaps_is_exact(spark, odd):
    rows = odd.unionByName(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), allowMissingColumns=True)
    ids = spark.range(0, 3000, 7).select(F.col("id").alias("doc_id"))
    inside, all_ids = {r[0] for r in ids.collect()}, [r["doc_id"] for r in rows.collect()]
    for bits in (1 << 26, 1 << 15, 8):  # the last one: a bitmap that tells nothing apart
        assert sorted(r["doc_id"] for r in minhash.among(rows, ids, bits).collect()) == sorted(x for x in all_ids if x in inside)
        out = minhash.without(rows, ids, bits)
        assert out.columns == rows.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == sorted((x is None, x or 0) for x in all_ids if x not in inside)
    assert minhash.without(rows, ids.filter("doc_id < 0")).count() == len(all_ids)


def test_driver_gives_free_memory_back(spark):
    jvm, server = spark.sparkContext._jvm, spark.sparkContext._jvm.java.lang.management.ManagementFactory
    collected = lambda: sum(b.getCollectionCount() for b in server.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    storage._next_rest = 0.0
    kept = [jvm.java.nio.ByteBuffer.allocate(50_000_000) for _ in range(6)]
    held = jvm.java.lang.Runtime.getRuntime().totalMemory()
    del kept
    gc.collect()
    before = collected()
    assert storage.stored(spark.range(3), "rest").count() == 3
    assert collected() == before + 1 and jvm.java.lang.Runtime.getRuntime().totalMemory() <= held
    assert storage.stored(spark.range(3), "rest").count() == 3 and collected() == before + 1  # not again at once
    storage._next_rest = 0.0


def test_negatives_hold_no_words_of_all_texts():
    texts = [f"{LONG} {k}" for k in range(40)] + [" \n", "", None]
    tracemalloc.start()
    made = langid.negatives(texts, 30, np.random.default_rng(2))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(made) == 30 and most < 20e6, most
