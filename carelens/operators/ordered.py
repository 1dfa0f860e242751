"""Row numbers and previous-row values inside groups, without a group in one task.

A window ``partitionBy(group).orderBy(...)`` sends every row of a group to one task, so a
single hot group (a placeholder patient, a visit that collected a third of all encounters)
becomes one straggler. Here rows are range-partitioned and sorted on (group, order) first, so a
hot group is spread over consecutive partitions, its buckets:

1. a table in the shared ``spark.checkpoint.dir`` fixes the partitions, each row with its
   bucket (the partition's number);
2. a window over (group, bucket) numbers the rows of a bucket;
3. an aggregate over (group, bucket) gives each bucket's row count and last row's values, and
   a window over those few rows (at most one per group and partition) gives what came before;
4. both are joined on (group, bucket).

All of it is built-in expressions on the columns as they are, so no value changes its type or
precision.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_within(df: DataFrame, group: str, order: list[str], seq_col: str,
                   lag: dict[str, str] | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``seq_col`` (1, 2, ... in ``order`` inside each ``group``) and, for each
    ``lag`` item ``column -> name``, the previous row's value inside the group.

    Rows with a NULL group form a group of their own. ``order`` sorts ascending with NULLs
    first; end it with a unique column to make the order total.
    """
    from carelens.session import ensure_checkpoint_dir

    spark = df.sparkSession
    lag = lag or {}
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/carelens-{uuid.uuid4().hex}/ordered"
    ranged = df.repartitionByRange(n, group, *order).withColumn("_bucket", F.spark_partition_id())
    ranged.write.parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)

    within = Window.partitionBy(group, "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = stored.withColumn("_n", F.row_number().over(within))
    for column, name in lag.items():
        numbered = numbered.withColumn(name, F.lag(column).over(within))

    last = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(lag)])
    edges = stored.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b")).agg(
        F.count(F.lit(1)).alias("_rows"), F.max(last).alias("_last"))
    buckets = Window.partitionBy("_g").orderBy("_b")
    edges = edges.withColumn("_before", F.sum("_rows").over(buckets.rowsBetween(Window.unboundedPreceding, -1)))
    edges = edges.withColumn("_prior", F.lag("_last").over(buckets)).filter("_before IS NOT NULL")
    carry = edges.select("_g", "_b", "_before", *[F.col(f"_prior._v{i}").alias(f"_c{i}") for i in range(len(lag))])

    out = numbered.join(carry, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")), "left")
    columns = [F.col(f"`{c}`") for c in df.columns]
    columns.append((F.col("_n") + F.coalesce("_before", F.lit(0))).cast("long").alias(seq_col))
    for i, name in enumerate(lag.values()):
        columns.append(F.when(F.col("_n") == 1, F.col(f"_c{i}")).otherwise(F.col(name)).alias(name))
    return out.select(*columns)
