"""Sum-of-squares packing of documents into sequences of at most 1024 tokens.

Documents longer than a sequence are cut from the end into whole sequences, so
only their first piece is shorter. Pieces are dealt into groups of bounded size
by a hash; each group is packed by one task. There pieces go longest first,
and each goes where the sum of the squared counts of open sequences per
remaining gap becomes smallest. A new sequence is opened only where no open
one has room: with new ones allowed at any time, 1 % more sequences were used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protolake.llm.encode import tokenizer_path, worker_encoder
from protolake.llm.kernels import batch_chunks
from protolake.llm.storage import small_batches, stored
from protolake.llm.token_files import with_end

CAPACITY = 1024
PIECES = "doc_id long, row_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, taken in the given order; lengths are 1 to capacity."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; 0 and capacity stay 0: they cost nothing
    of_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, s in enumerate(lengths.tolist()):
        # from gap g to g - s the sum changes by 2 (N[g-s] - N[g] + 1); at g = s by 1 - 2 N[s]
        have = open_bins[s:capacity]
        change = 2 * (open_bins[: capacity - s] - have + 1)
        if len(change):
            change[0] = 1 - 2 * have[0]
            change[have == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())  # the tightest of equals
        if len(change) and have[best]:
            gap = s + best
            b = of_gap[gap].pop()
            open_bins[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        bins[k], offsets[k] = b, capacity - gap
        if gap > s:
            of_gap[gap - s].append(b)
            open_bins[gap - s] += 1
    return bins, offsets


def cut_pieces(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of each piece; only first pieces may be shorter than whole sequences."""
    counts = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(lengths)), counts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    head = lengths - (counts - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, start, np.where(piece == 0, head[doc], capacity)


def token_pieces(df: DataFrame, end_id: int = 2, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Encode every text (null: empty) with end_id after it and cut it; one row for each piece."""
    tokenizer = tokenizer or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for batch in batch_chunks(batches):
            ids, lengths = with_end(*encoder.encode(batch.column("text")), end_id)
            doc, start, length = cut_pieces(lengths, capacity)
            at = (np.cumsum(lengths) - lengths)[doc] + start
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
            take = pa.array(doc)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(take), "row_id": batch.column("row_id").take(take), "piece": pa.array(doc * 0 + np.arange(len(doc)) - np.searchsorted(doc, doc), pa.int32()), "start": start, "length": length, "ids_crc32": np.array(crc, np.int64)})

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), F.col("text").cast("string").alias("text"))
    return small_batches(rows).mapInArrow(cut, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = 20_000) -> DataFrame:
    """Place stored pieces: adds sequence_id and offset.

    Whole pieces fill sequences of their own. The others are dealt into as many
    groups as keep about ``group_pieces`` in each, whatever the table's size.
    """
    short = F.col("length") < capacity
    n = pieces.filter(short).count()
    groups = max(1, round(n / group_pieces))

    def place(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row_id", "ascending")])
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), capacity)
        table = table.drop_columns(["g"])
        return table.append_column("sequence_id", pa.array(key[0].as_py() + groups * bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.filter(short).withColumn("g", F.pmod(F.xxhash64("doc_id", "row_id"), F.lit(groups)))
    packed = dealt.groupBy("g").applyInArrow(place, PLACED)
    whole = pieces.filter(~short).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def pack_documents(df: DataFrame, end_id: int = 2, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pack all documents; one row for each piece.

    Null or empty texts give one piece with the end id. Repeated rows are packed
    each. Null doc_ids stay null. An empty table gives no row. Only doc_id and text are read.
    """
    return pack(stored(token_pieces(df, end_id, capacity, tokenizer), "pieces"), capacity)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")
