"""Near-duplicates by MinHash with sequential Bayesian verification.

1. Each text's set of five-word shingles gives a signature of 128 minima, 32 band
   hashes of four minima each, and a fingerprint. Equal sets are one class from then on.
2. Classes that share a band are candidates. In a bucket each class is paired
   with one leader, the class that shares most bands with others, so a bucket of
   n classes gives n - 1 pairs.
3. Signatures of a pair are compared 16 minima at a time; the pair is pruned when
   the posterior chance of a similarity at the threshold or above falls under
   the miss probability. Survivors are verified on their full sets.
4. Verified pairs make components. Buckets that still hold classes of several
   components get other leaders, twice, for the classes of other components than
   the leader's; then all pairs between components that were not tried, each time
   with step 3: no pair of a bucket stays unjudged unless already connected.

With 32 bands of four minima, a pair at similarity 0.75 shares no band with
probability 5e-6, at 0.85 with 1e-10.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolake.llm.components import components
from protolake.llm.kernels import BYTE_VALUES, SPACES, batch_chunks, joined_bytes, mixed, span_hashes, word_spans
from protolake.llm.rows import unused
from protolake.llm.storage import small_batches, stored

SHINGLE, BANDS, ROWS, BATCH = 5, 32, 4, 16
PERCENT, MISS = 75, 1e-6
#: Members, and their shingles, of a chunk of a bucket in the last round.
CHUNK, CHUNK_SHINGLES = 256, 1 << 18
_IS_SPACE = np.isin(np.arange(256), list(SPACES))
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
_MIX = np.uint64(0xD1342543DE82EF95)
_A, _B = (mixed(np.arange(BANDS * ROWS) + k * 1000) | np.uint64(1) for k in (1, 2))


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after another, and the offsets."""
    data, offsets = joined_bytes(texts)
    data = _LOWER[np.frombuffer(data, np.uint8)]
    starts, ends = word_spans(data, _IS_SPACE)
    words = span_hashes(BYTE_VALUES[data], starts, ends)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    last = np.arange(len(words)) - (np.cumsum(n) - n)[doc]  # place in its text
    code = words.copy()
    for k in range(1, SHINGLE):  # the words before, as far as the text goes; a short text's last word stands for all of it
        code[k:] = np.where(last[k:] >= k, code[k:] + words[:-k] * _MIX ** np.uint64(k), code[k:])
    keep = (last >= SHINGLE - 1) | ((n[doc] < SHINGLE) & (last == n[doc] - 1))
    code = mixed(code + np.minimum(n[doc], SHINGLE).astype(np.uint64))[keep]
    doc = doc[keep]
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
    code, doc = code[first], doc[first]
    return code, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(texts)))])


def signatures(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(non-empty texts, 128) minima as uint32."""
    sizes = np.diff(offsets)
    cuts = offsets[:-1][sizes > 0]
    out = np.empty((len(cuts), BANDS * ROWS), np.uint32)
    for k in range(BANDS * ROWS if len(cuts) else 0):
        out[:, k] = np.minimum.reduceat(((code * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), cuts)
    return out


def band_hashes(minima: np.ndarray) -> np.ndarray:
    """(texts, 32) hashes of four minima each; bands hash apart."""
    parts = minima.reshape(len(minima), BANDS, ROWS).astype(np.uint64)
    code = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        code = mixed(code * _MIX + parts[:, :, k])
    return code


SIGNED = "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sig binary"


def sign(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint (f1, f2), band hashes and the minima's low bytes; null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_chunks(batches, "text", 800_000):
            code, offsets = shingle_sets(batch.column("text"))
            sizes = np.diff(offsets)
            full = sizes > 0
            minima = signatures(code, offsets)
            f = np.zeros((2, len(sizes)), np.uint64)
            if len(code):
                cuts = offsets[:-1][full]
                f[0, full] = mixed(np.add.reduceat(mixed(code + np.uint64(1)), cuts) + sizes[full].astype(np.uint64))
                f[1, full] = mixed(np.bitwise_xor.reduceat(mixed(code * _MIX), cuts) ^ sizes[full].astype(np.uint64))
            place = np.full(len(sizes), -1)
            place[full] = np.arange(full.sum())
            bands = band_hashes(minima).view(np.int64)
            low = (minima & np.uint32(255)).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_shingles": sizes.astype(np.int64), "f1": f[0].view(np.int64), "f2": f[1].view(np.int64),
                "bands": pa.array([bands[k] if k >= 0 else None for k in place.tolist()], pa.list_(pa.int64())), "sig": pa.array([low[k].tobytes() if k >= 0 else None for k in place.tolist()], pa.binary()),
            })

    return small_batches(df).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNED)


@cache
def least_matches(percent: int = PERCENT, miss: float = MISS, n: int = BANDS * ROWS, batch: int = BATCH) -> tuple[int, ...]:
    """After each batch of minima, the fewest matches that keep a pair.

    With a uniform prior the similarity given m matches of n has a Beta(m + 1, n - m + 1)
    posterior, whose chance of threshold or more is that of at most m hits among n + 1 trials.
    """
    t, out = percent / 100, []
    for seen in range(batch, n + 1, batch):
        total, m = 0.0, 0
        while True:
            total += comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def survive(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Places of the pairs (rows of two byte matrices) that no batch prunes."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches()):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(1)
        alive = alive[matches[alive] >= least]
    return alive


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def prune(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (a, b) of class ids: those that the sequential test keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.select(["a", "b"]).take(pa.array(survive(_bytes(batch.column("sa")), _bytes(batch.column("sb")))))

    sig = lambda k, s: classes.select(F.col("id").alias(k), F.col("sig").alias(s))
    return pairs.join(sig("b", "sb"), "b").join(sig("a", "sa"), "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sifted(docs: DataFrame, ids: DataFrame, hit: str, most_bits: int) -> DataFrame:
    """docs with hit: whether a bitmap of the hashed ids (doc_id, distinct) has the row's; always true for those in ids, rarely for others while there are fewer than most_bits / 16. The bitmap's size is bounded."""
    bits = 1 << 15
    while bits < min(most_bits, 16 * ids.count()):
        bits *= 2
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    part, bitmap = unused(docs, "part"), unused(docs, "bitmap")
    maps = ids.select(spot("doc_id").alias("h")).groupBy(F.floor(F.col("h") / 32768).alias(part)).agg(F.expr("bitmap_construct_agg(h % 32768)").alias(bitmap))
    held = docs.withColumn(part, F.floor(spot("doc_id") / 32768)).join(F.broadcast(maps), part, "left")
    h = spot("doc_id") % 32768
    byte = F.conv(F.hex(F.substr(F.col(bitmap), (h / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.withColumn(hit, F.coalesce(F.getbit(byte, (h % 8).cast("int")) == 1, F.lit(False))).drop(part, bitmap)


def among(docs: DataFrame, ids: DataFrame, most_bits: int = 1 << 26) -> DataFrame:
    """Rows of docs whose doc_id is in ids (distinct). Others are sifted out before the shuffle by a bitmap of hashed ids, whose size is bounded."""
    hit = unused(docs, "hit")
    return _sifted(docs, ids, hit, most_bits).filter(F.col(hit)).drop(hit).join(ids, "doc_id")


def without(docs: DataFrame, ids: DataFrame, most_bits: int = 1 << 26) -> DataFrame:
    """Rows of docs whose doc_id is not in ids (distinct), null ids included. Rows that the bitmap clears stay where they are; only the others meet ids in a shuffle."""
    hit, own = unused(docs, "hit"), unused(docs, "own_id")
    marked = _sifted(docs, ids, hit, most_bits)
    open_ = marked.filter(F.col(hit)).drop(hit).join(ids.select(F.col("doc_id").alias(own)), F.col("doc_id") == F.col(own), "left_anti")
    return marked.filter(~F.col(hit)).drop(hit).unionByName(open_)


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Stored pairs (a, b) of documents whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_chunks(batches, "ta", 800_000):
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                (x, xo), (y, yo) = shingle_sets(part.column("ta")), shingle_sets(part.column("tb"))
                good = []
                for k in range(len(part)):
                    p, q = x[xo[k] : xo[k + 1]], y[yo[k] : yo[k + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * both >= PERCENT * (len(p) + len(q) - both) and both > 0)
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    needed = stored(among(docs, stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "minhash-needed")), "minhash-texts")
    text = lambda k, t: needed.select(F.col("doc_id").alias(k), F.col("text").alias(t))
    return pairs.join(text("b", "tb"), "b").join(text("a", "ta"), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def shared_counts(code: np.ndarray, offsets: np.ndarray, block: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of blocks of the 0/1 matrix of shingles that two sets or more hold."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    hashes, place = np.unique(code, return_inverse=True)
    common = np.bincount(place, minlength=len(hashes)) > 1
    number = np.cumsum(common) - 1
    keep = common[place]
    owner, column = owner[keep], number[place[keep]]
    out = np.zeros((n, n), np.float64)
    for a in range(0, int(common.sum()), block):
        mine = (column >= a) & (column < a + block)
        x = np.zeros((n, block), np.float32)
        x[owner[mine], column[mine] - a] = 1
        out += x @ x.T
    return out.astype(np.int64)


def spanning(rows: np.ndarray, columns: np.ndarray, n: int) -> list[int]:
    """Places of the pairs that connect what those before leave apart."""
    top, out = list(range(n)), []
    for k, (r, c) in enumerate(zip(rows.tolist(), columns.tolist())):
        while top[r] != r:
            top[r] = r = top[top[r]]
        while top[c] != c:
            top[c] = c = top[top[c]]
        if r != c:
            top[max(r, c)] = min(r, c)
            out.append(k)
    return out


def _surviving(table: pa.Table, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs of a group (between its two chunks, or inside its one) that lie in different components and that no batch of minima prunes."""
    part, sig, comp = table.column("part").to_numpy(), _bytes(table.column("sig").combine_chunks()), table.column("component").to_numpy()
    rows, columns = np.flatnonzero(part == low), np.flatnonzero(part == high)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for r in rows.tolist():
        others = columns[(comp[columns] != comp[r]) & ((columns > r) if low == high else True)]
        alive = others[survive(np.broadcast_to(sig[r], (len(others), sig.shape[1])), sig[others])]
        a.append(np.full(len(alive), r))
        b.append(alive)
    return np.concatenate(a), np.concatenate(b)


GROUPED = "bucket long, low int, high int, part int, id long, component long, sig binary"


def across(members: DataFrame, docs: DataFrame) -> DataFrame:
    """members (bucket, n, id, component, sig, n_shingles) of buckets with several components: verified links (a, b) between components.

    A bucket's members are dealt into chunks, and every two chunks meet in a group of
    their own, so no group holds more than about two chunks whatever the bucket's size;
    chunks are bounded by members and by shingles. Groups first meet with signatures
    only (128 bytes a member); texts go to the members that are left with a partner
    there. A group then judges its pairs and returns those that connect its members.
    """

    def sift(key, table):
        a, b = _surviving(table, key[1].as_py(), key[2].as_py())
        return table.take(pa.array(np.union1d(a, b)))

    def run(key, table):
        ids = table.column("id").to_numpy()
        a, b = _surviving(table, key[1].as_py(), key[2].as_py())
        if len(a):
            used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            code, offsets = shingle_sets(table.column("text").combine_chunks().take(pa.array(used)))
            i, j = place[: len(a)], place[len(a) :]
            sizes, both = np.diff(offsets), shared_counts(code, offsets)[i, j]
            good = np.flatnonzero((100 * both >= PERCENT * (sizes[i] + sizes[j] - both)) & (both > 0))
            good = good[spanning(i[good], j[good], len(used))]
            a, b = a[good], b[good]
        return pa.table({"a": np.minimum(ids[a], ids[b]).astype(np.int64), "b": np.maximum(ids[a], ids[b]).astype(np.int64)})

    sizes = members.groupBy("bucket").agg(F.greatest(F.ceil(F.max("n") / CHUNK), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    dealt = members.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(F.col("part"), k).alias("low"), F.greatest(F.col("part"), k).alias("high")))
    met = dealt.withColumn("p", F.explode(pairs)).select("bucket", "p.low", "p.high", "part", "id", "component", "sig")
    left = stored(met.groupBy("bucket", "low", "high").applyInArrow(sift, GROUPED), "minhash-sifted")
    if left.isEmpty():
        return left.select(F.col("id").alias("a"), F.col("id").alias("b"))
    texts = stored(among(docs, stored(left.select(F.col("id").alias("doc_id")).distinct(), "minhash-needed")).withColumnRenamed("doc_id", "id"), "minhash-texts")
    return left.join(texts, "id").select(*left.columns, "text").groupBy("bucket", "low", "high").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of doc_id and text.

    Documents are linked at a Jaccard similarity of 0.75 or more of their shingle sets.
    Null, empty and wordless texts have no shingle and are linked with nothing. Rows
    without doc_id are linked with nothing, have no component and are not kept. Rows
    that share a doc_id share its component. An empty table gives no row.
    """
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(sign(docs), "minhash-signed")
    linked = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(linked.groupBy("f1", "f2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")), "minhash-classes")
    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    in_shared = stored(buckets.join(shared, "bucket"), "minhash-buckets")
    weights = in_shared.groupBy("id").agg(F.sum("n").alias("weight"))
    central = in_shared.join(weights, "id").groupBy("bucket").agg((-F.max(F.struct("weight", (-F.col("id")).alias("id")))["id"]).alias("leader"))
    tried = stored(in_shared.join(central, "bucket").filter("id <> leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct(), "minhash-pairs")
    links = stored(verify(stored(prune(tried, classes), "minhash-survivors"), docs), "minhash-links")
    grouped = components(links)
    for turn in range(3):
        # buckets of three classes or more that still hold several components
        labelled = in_shared.filter("n > 2").join(grouped, "id", "left").select("bucket", "n", "id", F.coalesce("component", "id").alias("component"))
        ends = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), "id", "component")).alias("leader"))
        rest = stored(labelled.join(ends.filter("low < high").select("bucket", F.col("leader.id").alias("leader"), F.col("leader.component").alias("led")), "bucket"), "minhash-rest")
        if turn < 2:
            met = rest.filter("component <> led").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
            new = stored(met.join(tried, ["a", "b"], "left_anti"), "minhash-pairs")
            tried = tried.unionByName(new)
            more = stored(prune(new, classes), "minhash-survivors")
            found = more if more.isEmpty() else stored(verify(more, docs), "minhash-links")
        else:
            # buckets of the same classes are judged once
            alike = rest.groupBy("bucket").agg(F.count("*").alias("k"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("f")).groupBy("k", "f").agg(F.min("bucket").alias("bucket")).select("bucket")
            judged = stored(rest.join(alike, "bucket"), "minhash-rest")
            found = stored(across(judged.join(classes.select("id", "sig", "n_shingles"), "id"), docs), "minhash-links")
        if not found.isEmpty():
            grouped = components(grouped.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found))
    of_class = classes.select("f1", "f2", "id").join(grouped, "id", "left").select("f1", "f2", F.coalesce("component", "id").alias("of_class"))
    out = signed.select("doc_id", "n_shingles", "f1", "f2").join(of_class, ["f1", "f2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("of_class", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op3_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
