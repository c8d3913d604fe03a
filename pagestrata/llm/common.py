"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from pagestrata.session import checkpointed  # noqa: F401

#: White space of the word rule: space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of a batch on its way to a Python worker; each task holds some copies of one, in the JVM's native memory and the worker's.
BATCH = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pieces(batch: pa.RecordBatch, text: str, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``chunk_bytes`` of text each, one row at least."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > chunk_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def map_batches(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``docs.mapInArrow`` with batches of at most BATCH bytes, or one row. The session keeps that bound; a smaller one of its own stays."""
    conf = docs.sparkSession.conf
    if _bytes(conf.get(_BATCH_BYTES)) > BATCH:
        conf.set(_BATCH_BYTES, str(BATCH))
    return docs.mapInArrow(run, schema)


def _bytes(size: str) -> int:
    """A size as Spark writes it, such as 64m or 67108864b."""
    units = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    size = size.strip().lower()
    digits = size.rstrip("bgkm")
    return int(digits) * units[size[len(digits) :]]
