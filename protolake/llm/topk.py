"""Exact top-k inner-product search by multi-resolution segment statistics.

For a vector cut into segments, the mean and the deviation (root of the summed
squared distances from the mean) of each segment bound its inner product with
a query: at most the sum over segments of length * mean * mean + deviation *
deviation. That is a lower bound of the distance, as |q - x|^2 = |q|^2 + |x|^2
- 2 q.x. Bounds are taken coarse to fine, the finest with single components in
the front of the vector; vectors are first rotated so that the components with
most energy are in the front (a rotation leaves inner products as they are).
Only pairs that may still reach a query's k-th score get the exact integer product.

Queries and candidates meet in blocks of bounded size, of one vector length: a
pilot block of candidates is searched first, and its k-th scores are the
thresholds that the queries take to all other blocks, whose candidates with the
highest coarse estimates are looked at before the bounds. Every task keeps k rows
for each query; one more aggregation keeps the k best of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolake.llm.storage import stored

SCALE = 1024
PARTS = "query_id long, vec_id long, score long, exact long"


def levels(width: int) -> list[np.ndarray]:
    """Segment starts from coarse (one segment) to fine: equal segments of about four components at least, then single components for the first half, and for the first three quarters."""
    sizes, n = [], 1
    while n * 4 <= max(4, width):
        sizes.append(np.unique(np.arange(n) * width // n))
        n *= 4
    for front in (width // 2, width * 3 // 4):
        sizes.append(np.unique(np.concatenate([np.arange(front), np.arange(front, width, 4)])))
    return sizes


def statistics(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """sqrt(length) * mean and deviation of each segment, side by side (no deviations of single components): their inner products are the bounds."""
    length = np.diff(np.append(starts, x.shape[1]))
    total = np.add.reduceat(x, starts, axis=1)
    squares = np.add.reduceat(x * x, starts, axis=1)
    deviation = np.sqrt(np.maximum(0, squares - total**2 / length))
    return np.concatenate([total / np.sqrt(length), deviation[:, length > 1]], 1)


def rotation(x: np.ndarray) -> np.ndarray:
    """Orthogonal axes of a block, those with most energy first."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1]


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, kth: np.ndarray | None = None, step: int = 4096, least: int = 256):
    """The k best (score, smaller id) of the block for each query that reach kth (if given), its own row left out.

    Returns arrays query_id, vec_id, score, and the number of exact products beside the query's first row.
    """
    if not len(query_ids) or not len(ids):
        return (np.zeros(0, np.int64),) * 4
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    axes = rotation(vectors.astype(np.float64))
    q, x = queries.astype(np.float64) @ axes, vectors.astype(np.float64) @ axes
    # bounds of numbers with rounding errors: far more than what sums of such products can lose
    slack = 1e-9 * (1 + np.linalg.norm(q, axis=1).max() * np.linalg.norm(x, axis=1).max())
    stats = [(statistics(q, s), statistics(x, s)) for s in levels(q.shape[1])]
    front = max(1, q.shape[1] // 2)
    out_q, out_v, out_s, out_n = [], [], [], []
    for a in range(0, len(q), least):  # a few queries at a time bound the memory
        rows = slice(a, a + least)
        m = len(query_ids[rows])
        top = np.full((m, k), np.iinfo(np.int64).min)  # scores, best first
        who = np.full((m, k), -1, np.int64)
        given = np.full(m, -np.inf) if kth is None else kth[rows].astype(np.float64)
        products = np.zeros(m, np.int64)

        def exact(i, j, part):
            found = np.empty(len(i), np.int64)
            for c in range(0, len(i), 1 << 16):
                r = slice(c, c + (1 << 16))
                found[r] = np.einsum("ij,ij->i", queries[rows][i[r]], vectors[part][j[r]])
            return found

        for b in range(0, len(x), step):
            part = slice(b, b + step)
            # the candidates with the highest estimates by the front components give a first threshold
            some = min(4 * k, len(ids[part]))
            guess = q[rows][:, :front] @ x[part][:, :front].T
            near = np.argpartition(-guess, some - 1, axis=1)[:, :some]
            i, j = np.repeat(np.arange(m), some), near.ravel()
            first = exact(i, j, part).reshape(m, some)
            first[ids[part][near] == query_ids[rows][:, None]] = np.iinfo(np.int64).min
            products += some
            both = np.sort(np.concatenate([top, first], 1), axis=1)[:, -k]
            bar = np.maximum(given, both.astype(np.float64)) - slack
            i, j = np.nonzero(stats[0][0][rows] @ stats[0][1][part].T >= bar[:, None])
            for sq, sx in stats[1:]:  # finer bounds for what the coarser ones leave; in runs that fit the caches
                if 4 * len(i) > m * len(ids[part]):  # most pairs are left: one product of matrices
                    hit = np.zeros((m, len(ids[part])), bool)
                    hit[i, j] = True
                    i, j = np.nonzero(hit & (sq[rows] @ sx[part].T >= bar[:, None]))
                    continue
                keep = np.empty(len(i), bool)
                for c in range(0, len(i), 1 << 16):
                    r = slice(c, c + (1 << 16))
                    keep[r] = np.einsum("ij,ij->i", sq[rows][i[r]], sx[part][j[r]]) >= bar[i[r]]
                i, j = i[keep], j[keep]
            own = ids[part][j] == query_ids[rows][i]
            i, j = i[~own], j[~own]
            score = exact(i, j, part)
            products += np.bincount(i, minlength=m)
            reach = score >= given[i] - slack
            i, j, score = i[reach], j[reach], score[reach]
            i = np.concatenate([np.repeat(np.arange(m), k)[who.ravel() >= 0], i])
            v = np.concatenate([who[who >= 0], ids[part][j]])
            s = np.concatenate([top[who >= 0], score])
            rank = np.lexsort((v, -s, i))
            i, v, s = i[rank], v[rank], s[rank]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            first = place < k
            top[:], who[:] = np.iinfo(np.int64).min, -1
            top[i[first], place[first]], who[i[first], place[first]] = s[first], v[first]
        hit = who >= 0
        out_q.append(np.repeat(query_ids[rows], hit.sum(1)))
        out_v.append(who[hit])
        out_s.append(top[hit])
        lead = np.zeros(hit.shape, np.int64)
        lead[:, 0] = products
        out_n.append(lead[hit])
    return tuple(np.concatenate(x) for x in (out_q, out_v, out_s, out_n))


def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    if not n:
        return np.zeros((0, 0), np.int64)
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.int64)


def searched(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 8_000, query_rows: int = 8_000) -> DataFrame:
    """query_id, vec_id, score of every query's k best rows of each block of candidates that reach the pilot block's k-th score, and exact: products taken for the query there."""
    candidates = vectors.select("vec_id", "v").withColumn("width", F.size("v"))
    asked = queries.select("vec_id", "v").withColumn("width", F.size("v"))
    blocks, query_blocks = (max(1, -(-df.count() // n)) for df, n in ((candidates, block_rows), (asked, query_rows)))
    spread = lambda a, n: F.explode(F.sequence(F.lit(a), F.lit(n - 1)))
    right = candidates.select(F.col("vec_id").alias("id"), F.col("v").alias("x"), "width", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("vb"))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int"))
    keys = ("width", "qb", "vb")

    def search(key, a, b):
        kth = a.column("kth").combine_chunks().fill_null(-(2**62)).to_numpy() if len(a) else None
        q, v, s, n = best_of_block(a.column("vec_id").to_numpy().astype(np.int64), matrix(a.column("v"), len(a)), b.column("id").to_numpy().astype(np.int64), matrix(b.column("x"), len(b)), k, kth)
        return pa.table({"query_id": q, "vec_id": v, "score": s, "exact": n})

    def met(df, chosen, others):
        return df.withColumn("vb", F.lit(0) if chosen == 0 else spread(1, blocks)).groupBy(*keys).cogroup(others.withColumn("qb", spread(0, query_blocks)).groupBy(*keys)).applyInArrow(search, PARTS)

    pilot = met(left.withColumn("kth", F.lit(None).cast("long")), 0, right.filter("vb = 0"))
    if blocks == 1:
        return pilot
    pilot = stored(pilot, "topk-pilot")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    bars = pilot.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    armed = left.join(bars, left["vec_id"] == bars["query_id"], "left").drop("query_id")
    return pilot.unionByName(met(armed, 1, right.filter("vb > 0")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 8_000, query_rows: int = 8_000) -> DataFrame:
    """The k highest integer inner products for each query: query_id, rank, vec_id, score.

    Both tables have vec_id long and v array<long> without nulls; vectors are compared with those of
    their own length only. A query's own row (its vec_id) is no candidate. Ties go to the smaller vec_id;
    repeated rows count each, candidates and queries (in a group of their query_id). Empty tables give no row.
    """
    parts = searched(vectors, queries, k, block_rows, query_rows)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(df: DataFrame) -> DataFrame:
    """vec_id and floor(1024 x) of each component; vectors that are null, empty or hold null or non-finite components go."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.col("vec_id").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return df.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(SCALE) * c).cast("long")).alias("v"))


def op7_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
