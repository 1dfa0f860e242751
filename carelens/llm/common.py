"""Helpers shared by the operators: folds, text normalisation, row batches, shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of rows that go to a Python worker at once. Spark's own limits (10,000 rows, 64 MB) let the texts of
#: a whole partition stand in the executor and again in its worker.
BATCH_BYTES = 2 << 20
#: What the tasks of one step leave in this worker process for the next ones: the step, and its things by key.
_KEPT: tuple[str, dict] = ("", {})


def in_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text mod ``modulus`` equals ``remainder`` (NULL for a NULL id)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII texts take the cheaper built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Cuts the lineage: later steps survive lost executors without redoing earlier ones.
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/carelens-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Let Spark hand this package to its Python workers (once per application).

    Only needed where the workers cannot import it already.
    """
    sc = spark.sparkContext
    if getattr(sc, "_carelens_shipped", False):
        return spark
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "carelens.zip")  # on the driver; Spark serves it from there
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._carelens_shipped = True
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Let rows go to Python workers about ``BATCH_BYTES`` at a time (a row at least), unless the session sets a limit."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BATCH_BYTES))
    return spark


def kept_by(step: str) -> dict:
    """What earlier tasks of ``step`` have left in this worker process; asked for as a task begins.

    Spark hands a worker on from step to step: what another step has left goes first, and freed
    Arrow memory goes back, so that a worker holds the caches of one step.
    """
    global _KEPT
    pa.default_memory_pool().release_unused()
    if _KEPT[0] != step:
        _KEPT = (step, {})
    return _KEPT[1]


def text_slices(batch: pa.RecordBatch, text: str = "text", limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with about ``limit`` bytes of text each (one row at least), NULL texts as ''.

    Bounds what a Python worker holds as objects, whatever the batch size and text lengths.
    """
    col = batch.column(batch.schema.get_field_index(text))
    start = size = 0
    lengths = pc.fill_null(pc.binary_length(col), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield _slice(batch, col, start, i)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield _slice(batch, col, start, len(lengths))


def _slice(batch: pa.RecordBatch, col: pa.Array, start: int, stop: int):
    return batch.slice(start, stop - start), [t or "" for t in col.slice(start, stop - start).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
