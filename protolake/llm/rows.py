"""Whole rows through an Arrow function that judges one text column.

Rows travel under positional names, so no column can clash with another one or
with what is added, whatever its name or case; the text goes to Python once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from protolake.llm.kernels import batch_chunks
from protolake.llm.storage import small_batches


def position(df: DataFrame, name: str) -> int:
    """Place of a column: by its exact name, else whatever its case."""
    names = df.columns
    return names.index(name) if name in names else [c.lower() for c in names].index(name.lower())


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def judged(df: DataFrame, text: str, added: list[StructField], judge: Callable[[list[str | None]], list], keep: Callable[[list], pa.Array] | None = None) -> DataFrame:
    """df with the added columns, which judge(texts) gives as arrays; columns of these names (in any case) are replaced.

    keep(arrays) may give a mask: then only those rows stay, and the added columns are left out.
    """
    names = df.columns
    gone = set() if keep else {f.name.lower() for f in added}
    stay = [k for k, c in enumerate(names) if c.lower() not in gone]
    at = position(df, text)
    plain = df.toDF(*[f"c{k}" for k in range(len(names))])
    own = at in stay and isinstance(df.schema[at].dataType, StringType)
    read = f"c{at}" if own else "judged_text"
    sent = plain.select(*[f"c{k}" for k in stay], *([] if own else [F.col(f"c{at}").cast("string").alias(read)]))
    out = StructType([StructField(f"c{k}", df.schema[k].dataType, True) for k in stay] + ([] if keep else [StructField(f"a{k}", f.dataType) for k, f in enumerate(added)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_chunks(batches, read, 500_000):
            found = judge(batch.column(read).to_pylist())
            rows = batch.select([f"c{k}" for k in stay])
            if keep:
                yield rows.filter(keep(found))
            else:
                yield pa.RecordBatch.from_pydict(dict(zip(rows.schema.names, rows.columns)) | {f"a{k}": x for k, x in enumerate(found)})

    return small_batches(sent).mapInArrow(run, out).toDF(*[names[k] for k in stay], *([] if keep else [f.name for f in added]))
