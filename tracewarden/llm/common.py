"""What the operators of this subpackage share: reading a table and walking Arrow batches."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of ``column`` in a piece take about ``most_bytes``.

    A single longer row makes a piece of its own; rows keep their order; empty batches vanish.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin, held = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and held + size > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size + 64
        if begin < batch.num_rows:
            yield batch.slice(begin)


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as the empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def released(*held: list | dict) -> None:
    """Empty what a worker holds and give freed memory back: workers live on for other operators' tasks."""
    for x in held:
        x.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
