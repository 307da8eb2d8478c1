"""Token-ID files in patched frame-of-reference (PFOR) blocks.

File format (little-endian), one file for each partition of the sorted input:

    magic "PFOR1\\0\\0\\0"
    payload     blocks of 128 ids less their block's minimum, packed at the block's width, 16 * width bytes each
    exceptions  uint32 overflow (id - minimum >> width) of ids that are too wide
    places      uint8 place in the block of each exception
    minimums    uint32 for each block
    widths      uint8 for each block
    block index uint64 payload start and uint64 first exception of each block, and of the end
    documents   int64 doc_id and int64 first id of each, and of the end
    footer      7 uint64: ids, blocks, exceptions, documents, start of exceptions, start of the block index, documents without an id (the first ones)

A block's width is the smallest that holds the given percentile of its ids; the
rest are exceptions. The last block is padded with its first id.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolake.llm.encode import tokenizer_path, worker_encoder
from protolake.llm.kernels import batch_chunks, ragged
from protolake.llm.storage import open_to_read, open_to_write, scratch, small_batches, stored

BLOCK = 128
_MAGIC = b"PFOR1\0\0\0"
_FOOTER = 56
MANIFEST = "file_no int, path string, n_docs long, n_ids long"
DOCUMENTS = "file_no int, doc_id long, start long, n_tokens long, ids_crc32 long"


def bit_widths(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.uint8)


def pack_blocks(ids: np.ndarray, percentile: float = 0.9):
    """ids (m, 128) -> payload bytes, minimums, widths, counts of exceptions, their overflows and places."""
    low = ids.min(axis=1)
    rest = ids - low[:, None]
    widths = np.sort(bit_widths(rest), axis=1)[:, int(np.ceil(percentile * BLOCK)) - 1]
    over = (rest.astype(np.uint64) >> widths[:, None].astype(np.uint64)).astype(np.uint32)
    rows, places = np.nonzero(over)
    sizes = widths.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(widths[widths > 0]).tolist():
        mine = np.flatnonzero(widths == w)
        bits = ((rest[mine][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        packed = np.packbits(bits.reshape(len(mine), -1), axis=1, bitorder="little")
        payload[ragged(starts[mine], sizes[mine])] = packed.ravel()
    return payload.tobytes(), low, widths, np.bincount(rows, minlength=len(ids)), over[rows, places], places.astype(np.uint8)


def unpack_blocks(payload: np.ndarray, low: np.ndarray, widths: np.ndarray, exceptions: np.ndarray, overflow: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The opposite of pack_blocks; ids (m, 128)."""
    out = np.zeros((len(low), BLOCK), np.uint32)
    sizes = widths.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    for w in np.unique(widths[widths > 0]).tolist():
        mine = np.flatnonzero(widths == w)
        bits = np.unpackbits(payload[ragged(starts[mine], sizes[mine])].reshape(len(mine), -1), axis=1, bitorder="little").reshape(len(mine), BLOCK, w)
        part = np.zeros((len(mine), BLOCK), np.uint32)
        for k in range(w):
            part |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        out[mine] = part
    rows = np.repeat(np.arange(len(low)), exceptions)
    out[rows, places] |= overflow << widths[rows].astype(np.uint32)
    return out + low[:, None]


class TokenFileWriter:
    """Streams documents into one file."""

    def __init__(self, uri: str, percentile: float = 0.9):
        self.out, self.percentile = open_to_write(uri), percentile
        self.out.write(_MAGIC)
        self.left = np.zeros(0, np.uint32)
        self.nulls = 0
        self.low, self.widths, self.counts, self.over, self.places, self.docs, self.lengths = [], [], [], [], [], [], []

    def add(self, doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Documents without an id must come first."""
        self.nulls += doc_ids.null_count
        self.docs.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.lengths.append(lengths)
        ids = np.concatenate([self.left, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.left = ids[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        if len(ids):
            payload, *rest = pack_blocks(ids.reshape(-1, BLOCK), self.percentile)
            self.out.write(payload)
            for kept, x in zip((self.low, self.widths, self.counts, self.over, self.places), rest):
                kept.append(x)

    def close(self) -> tuple[int, int]:
        """Ids and documents written."""
        if len(self.left):
            self._blocks(np.concatenate([self.left, np.full(-len(self.left) % BLOCK, self.left[0], np.uint32)]))
        cat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        low, widths, counts, over, places = cat(self.low, np.uint32), cat(self.widths, np.uint8), cat(self.counts, np.uint64), cat(self.over, np.uint32), cat(self.places, np.uint8)
        docs, lengths = cat(self.docs, np.int64), cat(self.lengths, np.int64)
        starts = lambda sizes: np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes.astype(np.uint64))])
        payload = starts(widths.astype(np.uint64) * np.uint64(BLOCK // 8)).astype(np.uint64)
        at = len(_MAGIC) + int(payload[-1])
        for x in (over, places, low, widths, payload, starts(counts), docs, starts(lengths).astype(np.int64)):
            self.out.write(x.tobytes())
        index = at + 5 * len(over) + 5 * len(low)
        n = int(lengths.sum())
        self.out.write(np.array([n, len(low), len(over), len(docs), at, index, self.nulls], np.uint64).tobytes())
        self.out.close()
        return n, len(docs)


class TokenFile:
    """Random access to one file by its block index."""

    def __init__(self, uri: str):
        self.file = open_to_read(uri)
        size = self.file.size()
        self.n, self.blocks, self.exceptions, self.n_docs, self.at, self.index, self.nulls = np.frombuffer(self.file.read_at(_FOOTER, size - _FOOTER), np.uint64).astype(np.int64).tolist()
        both = np.frombuffer(self._read(self.index, 16 * (self.blocks + 1)), np.uint64).astype(np.int64)
        self.payload, self.first = both[: self.blocks + 1], both[self.blocks + 1 :]
        at = self.index + 16 * (self.blocks + 1)
        self.doc_ids = np.frombuffer(self._read(at, 8 * self.n_docs), np.int64)
        self.starts = np.frombuffer(self._read(at + 8 * self.n_docs, 8 * (self.n_docs + 1)), np.int64)

    def _read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at) if n else b""

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop, from the blocks that hold them."""
        a, b = start // BLOCK, -(-stop // BLOCK)
        if b <= a:
            return np.zeros(0, np.uint32)
        p, q, x, y = int(self.payload[a]), int(self.payload[b]), int(self.first[a]), int(self.first[b])
        get = lambda at, n, kind: np.frombuffer(self._read(at, n * np.dtype(kind).itemsize), kind)
        over = get(self.at + 4 * x, y - x, np.uint32)
        places = get(self.at + 4 * self.exceptions + x, y - x, np.uint8)
        tail = self.at + 5 * self.exceptions
        low, widths = get(tail + 4 * a, b - a, np.uint32), get(tail + 4 * self.blocks + a, b - a, np.uint8)
        out = unpack_blocks(get(len(_MAGIC) + p, q - p, np.uint8), low, widths, np.diff(self.first[a : b + 1]), over, places)
        return out.ravel()[start - a * BLOCK : stop - a * BLOCK]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def close(self) -> None:
        self.file.close()


def with_end(flat: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text's ids with end_id after them, and their lengths."""
    lengths = np.diff(offsets) + 1
    out = np.empty(len(flat) + len(lengths), np.uint32)
    ends = np.cumsum(lengths) - 1
    mask = np.ones(len(out), bool)
    mask[ends] = False
    out[mask], out[ends] = flat, end_id
    return out, lengths


def write_token_files(df: DataFrame, path: str, end_id: int = 0, tokenizer: str | None = None, percentile: float = 0.9) -> DataFrame:
    """Write the texts' ids in ascending doc_id order; one manifest row for each file (file_no, path, n_docs, n_ids).

    Nulls in text count as empty; rows without doc_id come first and are counted
    in the file, so every 64-bit number is an id. Repeated doc_ids stay as many documents, ordered by
    their texts' hash. An empty table gives no file. Only doc_id and text are read.
    """
    tokenizer = tokenizer or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, writer, no = worker_encoder(tokenizer), None, TaskContext.get().partitionId()
        uri = f"{path}/ids-{no:06d}-{uuid.uuid4().hex}.pfor"
        for batch in batch_chunks(batches):
            writer = writer or TokenFileWriter(uri, percentile)
            ids, lengths = with_end(*encoder.encode(batch.column("text")), end_id)
            writer.add(batch.column("doc_id"), ids, lengths)
        if writer:
            n, docs = writer.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([no], pa.int32()), "path": [uri], "n_docs": [docs], "n_ids": [n]})

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    return stored(small_batches(rows).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame, most_ids: int = 1 << 20) -> DataFrame:
    """Read every file back: one row for each document, start counting from the first id of the first file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, uri, base in zip(*(batch.column(c).to_pylist() for c in ("file_no", "path", "base"))):
                f = TokenFile(uri)
                crc = np.zeros(f.n_docs, np.int64)
                d = 0
                for a in range(0, f.n, most_ids):  # documents may go on from one run of blocks to the next
                    b = min(a + most_ids, f.n)
                    data = memoryview(f.ids(a, b).astype("<u4").tobytes())
                    while d < f.n_docs and f.starts[d] < b:
                        s, e = max(int(f.starts[d]), a), min(int(f.starts[d + 1]), b)
                        crc[d] = zlib.crc32(data[4 * (s - a) : 4 * (e - a)], int(crc[d]))
                        if f.starts[d + 1] > b:
                            break
                        d += 1
                f.close()
                for x in range(0, f.n_docs, 10_000):
                    part = slice(x, x + 10_000)
                    yield pa.RecordBatch.from_pydict({"file_no": pa.array(np.full(len(crc[part]), no, np.int32)), "doc_id": pa.array(f.doc_ids[part], mask=np.arange(x, x + len(crc[part])) < f.nulls), "start": f.starts[:-1][part] + base, "n_tokens": np.diff(f.starts)[part], "ids_crc32": crc[part]})

    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return files.repartition(max(1, manifest.count())).mapInArrow(read, DOCUMENTS)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the token files and the checksum of its ids, as read back from them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, scratch(spark, "token-files"))
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
