"""Helpers that every training-data operator uses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.sources.shared import checkpointed, shared_folder  # noqa: F401

#: Rows that a kernel sees at a time. Spark also bounds a batch by bytes.
SLICE_ROWS = 512
SLICE_BYTES = 4_000_000

#: The white space of the contracts, as bytes.split() and SQL see it.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_holder: list = []


def holds(name: str, release: Callable[[], object]) -> None:
    """Says that a worker now holds the model of ``name``; what it held for another operator is released. Workers live through many stages, and one model at a time is enough."""
    if _holder and _holder[0] == name:
        return
    if _holder:
        _holder[1]()
    _holder[:] = name, release


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """Pieces of ``batch`` of a few MB, so that one kernel call holds little memory."""
    step = SLICE_ROWS
    if batch.num_rows:
        step = max(1, min(SLICE_ROWS, int(SLICE_BYTES * batch.num_rows / max(1, batch.column(text_at).nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_rows(df: DataFrame, kernel: Callable[..., list[tuple]], keys: list[str], text: str, schema: str) -> DataFrame:
    """A map over whole texts: ``kernel(list of texts)`` gives a tuple a text.

    Only ``keys`` and ``text`` are read from ``df``, so other columns, whatever
    their names, neither reach Python nor clash with the results. The result has
    the keys, then the columns of ``schema``.
    """
    kept = df.select(*[F.col(k) for k in keys], F.col(text).cast("string").alias("__text"))
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]] + [schema])
    n = len(keys)

    def mapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, n):
                rows = kernel(part.column(n).to_pylist())
                columns = list(zip(*rows, strict=True)) if rows else []
                arrays = [part.column(i) for i in range(n)] + [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        # A worker lives through many stages: what Arrow holds unused goes back.
        pa.default_memory_pool().release_unused()

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(out_schema).fields
    names = [f.name for f in fields]
    types = [to_arrow_type(f.dataType) for f in fields[n:]]
    return kept.mapInArrow(mapped, out_schema)


def crc_mod(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m``; null ids give null."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % F.lit(m)
