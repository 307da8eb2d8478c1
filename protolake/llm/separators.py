"""Token counts from flat token files without an index.

A flat file holds little-endian uint16 ids (uint32 where the tokenizer has more
than 65536), each document followed by the end-of-document id, and nothing else. The scan splits files into blocks by
bytes, finds the end ids of each block with one vectorised comparison, and
stitches documents that cross blocks by a prefix scan over one summary row a
block (its count of ends and its last one).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protolake.llm.encode import tokenizer_path, worker_encoder
from protolake.llm.kernels import batch_chunks
from protolake.llm.storage import open_to_read, open_to_write, scratch, small_batches, stored
from protolake.llm.token_files import with_end

END_ID = 50256
WRITTEN = "path string, ordinal long, doc_id long, n_bytes long, id_bytes int"


def id_bytes(tokenizer: str, end_id: int) -> int:
    """2 if all ids fit in 16 bits, else 4."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True)
    return 2 if max(end_id, *vocabulary.values()) < 1 << 16 else 4


def write_flat_files(df: DataFrame, path: str, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Write one flat file for each partition; rows (path, ordinal, doc_id), and one (path, n_bytes, id_bytes) for each file.

    The end id is the special token's: its name in a text is encoded as ordinary
    text, so no text's own ids hold it. Null texts count as empty, null doc_ids
    stay null, repeated rows are written each; an empty table gives no file.
    """
    tokenizer = tokenizer or tokenizer_path()
    width = id_bytes(tokenizer, end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, n, size = worker_encoder(tokenizer, literal=True), None, 0, 0
        uri = f"{path}/flat-{uuid.uuid4().hex}.ids"
        for batch in batch_chunks(batches):
            out = out or open_to_write(uri)
            ids, _ = with_end(*encoder.encode(batch.column("text")), end_id)
            out.write(ids.astype(f"<u{width}").tobytes())
            size += width * len(ids)
            m = len(batch)
            yield pa.RecordBatch.from_pydict({"path": pa.array([uri] * m), "ordinal": np.arange(n, n + m), "doc_id": batch.column("doc_id"), "n_bytes": pa.nulls(m, pa.int64()), "id_bytes": pa.nulls(m, pa.int32())})
            n += m
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([uri]), "ordinal": pa.nulls(1, pa.int64()), "doc_id": pa.nulls(1, pa.int64()), "n_bytes": pa.array([size]), "id_bytes": pa.array([width], pa.int32())})

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(small_batches(rows).mapInArrow(write, WRITTEN), "flat-files")


def scan_flat_files(files: DataFrame, end_id: int = END_ID, block_bytes: int = 4 << 20, task_bytes: int = 256 << 20) -> DataFrame:
    """files: (path, n_bytes, id_bytes). One row for each document: path, ordinal, start (in ids), n_tokens without the end.

    Blocks are read one at a time; a task gets about task_bytes of them (less where that leaves cores
    idle), so the number of tasks follows the bytes. Empty files give no row. Ids after a file's
    last end belong to no document.
    """
    if block_bytes % 4:
        raise ValueError("block_bytes must hold whole ids")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, width, block in zip(*(batch.column(c).to_pylist() for c in ("path", "n_bytes", "id_bytes", "block"))):
                with open_to_read(uri) as f:
                    ids = np.frombuffer(f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes), f"<u{width}")
                ends = np.flatnonzero(ids == end_id) + block * (block_bytes // width)
                yield pa.RecordBatch.from_pydict({"path": [uri], "block": [block], "ends": pa.array([ends], pa.list_(pa.int64()))})

    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / block_bytes)))).filter("n_bytes > 0")
    size, n = files.agg(F.sum("n_bytes"), F.sum(F.ceil(F.col("n_bytes") / block_bytes))).first()
    n = max(-(-(size or 0) // task_bytes), min(n or 1, 4 * files.sparkSession.sparkContext.defaultParallelism), 1)
    found = stored(blocks.repartition(int(n)).mapInArrow(scan, "path string, block long, ends array<long>"), "ends")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select("path", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last")).select(
        "path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1).cast("long")).alias("carry"))
    stitched = found.join(carried, ["path", "block"])
    each = stitched.select("path", "base", F.posexplode(F.arrays_zip(F.col("ends").alias("stop"), F.concat(F.array("carry"), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))).alias("prior"))))
    return each.select("path", (F.col("base") + F.col("pos")).alias("ordinal"), (F.col("col.prior") + 1).alias("start"), (F.col("col.stop") - F.col("col.prior") - 1).alias("n_tokens")).filter("n_tokens >= 0")


def op8_separator_scan(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents: written as flat files, counted by scanning them for the end id."""
    written = write_flat_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "flat"))
    counted = scan_flat_files(written.filter("n_bytes is not null").select("path", "n_bytes", "id_bytes"))
    names = written.filter("ordinal is not null").select("path", "ordinal", "doc_id")
    return names.join(counted, ["path", "ordinal"]).select("doc_id", "start", "n_tokens")
