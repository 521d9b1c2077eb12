"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.scratch import checkpointed, written

__all__ = ["arrow_map", "batch_of", "blocks", "checkpointed", "crc32_is", "read_table", "texts_of", "written"]

#: Characters of text that one vectorised step holds at most, unless one text alone is longer.
BLOCK_CHARS = 800_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's own reader (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(texts: list[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of texts of about ``limit`` characters together; a longer text is a range of its own."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield a, i
            a, held = i, 0
        held += len(t)
    if a < len(texts):
        yield a, len(texts)


def arrow_map(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow without a shuffle; ``fn`` sees the batches of one partition as a stream."""
    return df.mapInArrow(fn, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as strings, null as the empty string."""
    return [t or "" for t in batch.column(column).to_pylist()]


def batch_of(schema: pa.Schema, **columns: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=schema.field(n).type) for n, c in columns.items()], names=list(columns))


def crc32_is(column: str, modulus: int, rest: int) -> Any:
    """Is crc32 of the column as text, modulo ``modulus``, equal to ``rest``? Null ids are never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == rest, F.lit(False))
