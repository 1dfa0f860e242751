"""A storage layout for the clinical tables that the report's filters can prune.

``obs`` is written Hive-partitioned by ``concept_id`` and ``encounter`` by
``encounter_type``: the report's ``concept_id IN (...)`` and encounter-type filters then
skip whole directories (``PartitionFilters`` in the plan) instead of reading every file.
Rows are range-partitioned on (partition column, patient) before writing, so a concept
holding a third of all observations is written by many tasks, and each task writes files
for a contiguous key range only (file count stays bounded). Within files rows are sorted by
patient and time, which keeps row groups selective for per-patient reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.sources.tables import ClinicalTables

PARTITIONED = {"obs": ("concept_id", "person_id", "obs_datetime"),
               "encounter": ("encounter_type", "patient_id", "encounter_datetime")}


ROWS_PER_FILE = 2_000_000


def _files(df: DataFrame, rows_per_file: int) -> int:
    """Files for a table, from its rows (for stored Parquet the count comes from the footers)."""
    return max(1, -(-df.count() // rows_per_file))


def write_clinical(tables: ClinicalTables, root: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write every table under ``root/<name>``; obs and encounter in the pruning layout."""
    for name, df in tables.as_dict().items():
        path, files = f"{root.rstrip('/')}/{name}", _files(df, rows_per_file)
        if name in PARTITIONED:
            part, *order = PARTITIONED[name]
            (df.repartitionByRange(files, part, order[0]).sortWithinPartitions(part, *order)
             .write.mode("overwrite").partitionBy(part).parquet(path))
        else:
            df.repartition(files).write.mode("overwrite").parquet(path)


#: Partition column of tables that are read by cohort.
BUCKET = "patient_bucket"
BUCKETS = 256


def bucket_of(key: str, buckets: int = BUCKETS):
    return F.expr(f"CAST(pmod(xxhash64(`{key}`), {int(buckets)}) AS int)")


def write_by_patient(df: DataFrame, path: str, key: str = "patient_id", buckets: int = BUCKETS, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``df`` partitioned by the hash bucket of its patient, so that a cohort's reads skip all other buckets.

    Rows are range-partitioned on (bucket, patient) first: a bucket with a third of all rows is
    written by many tasks, and every task writes files for few buckets.
    """
    df = df.withColumn(BUCKET, bucket_of(key, buckets))
    df.repartitionByRange(_files(df, rows_per_file), BUCKET, key).sortWithinPartitions(BUCKET, key).write.mode(
        "overwrite").partitionBy(BUCKET).parquet(path)


def cohort_rows(stored: DataFrame, cohort: DataFrame, key: str = "patient_id", buckets: int = BUCKETS) -> DataFrame:
    """Rows of a table written by ``write_by_patient`` whose ``key`` is in ``cohort``.

    The join names the bucket as well; where Spark broadcasts the cohort, it reads only the cohort's
    buckets (dynamic partition pruning; the range test below is what marks the cohort as selective).
    """
    ids = cohort.select(key).distinct().withColumn(BUCKET, bucket_of(key, buckets)).filter(f"{BUCKET} BETWEEN 0 AND {int(buckets) - 1}")
    return stored.join(ids, [BUCKET, key], "left_semi").select(*[F.col(f"`{c}`") for c in stored.columns if c != BUCKET])
