"""Small helpers for the operators: tables, unused column names, Arrow columns."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _SHIPPED or not package.is_dir():
        return
    base = str(Path(tempfile.mkdtemp(prefix="package-")) / package.name)
    context.addPyFile(shutil.make_archive(base, "zip", package.parent, package.name))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until no column is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows."""
    return (batch for batch in batches if batch.num_rows)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for a task, after which its worker gives the memory back that it took.

    Spark keeps workers for later tasks, and more of them than cores where a stage passes
    rows to Python twice.  Each would go on holding the most that any task needed.
    """

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Free memory of Arrow and of the C library's heap goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim:
        trim(0)


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with a text column compressed, for a shuffle that only carries it.

    Texts take about half of what Spark's own shuffle compression leaves.
    """
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in rows(batches):
            found = [pack(t.as_py().encode("utf-8", "surrogatepass")) if t.is_valid else None for t in batch.column(at)]
            arrays = list(batch.columns)
            arrays[at] = pa.array(found, pa.binary())
            yield pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(arrays))])

    fields = list(df.schema.fields)
    fields[at] = T.StructField(column, T.BinaryType())
    return df.mapInArrow(tidy(run), T.StructType(fields))


def unpack(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value)
