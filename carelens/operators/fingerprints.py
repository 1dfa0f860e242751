"""Order-free fingerprints of tables, and the rows in which two snapshots differ.

Rows are hashed whole and added up by bucket of their id: number of rows, exclusive or and sum of the
hashes. Equal snapshots have equal fingerprints in whatever order and files they are stored. Rows
themselves are compared only in buckets that differ, so a check of an unchanged table shuffles
a bounded number of rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens.sources.names import quoted

BUCKETS = 4096
FINGERPRINT = "inside boolean, bucket long, n long, x long, s decimal(38,0)"


def _hashable(name: str, kind: T.DataType) -> Column:
    """A column as something that has a hash: maps as their sorted entries, variants and the like as JSON."""
    c = F.col(quoted(name))
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.to_json(F.struct(c.alias("v")))
    return c


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """64-bit hash of whole rows; which columns are NULL counts, too."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    parts = [_hashable(f.name, f.dataType) for f in fields]
    return F.xxhash64(F.lit(len(parts)), *parts, *[F.col(quoted(f.name)).isNull() for f in fields])


def _marked(df: DataFrame, row_id: str, inside: DataFrame | None, key: str, buckets: int, only: DataFrame | None = None) -> DataFrame:
    """id, inside, bucket, h of every row; ``inside``: the keys that make a row inside. ``only``: rows of these buckets (a few
    thousand at most), picked before any row is shuffled."""
    rows = df.select(F.col(quoted(row_id)).alias("id"), F.col(quoted(key)).alias("k"), row_hash(df).alias("h"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("long"))
    if only is not None:
        rows = rows.join(F.broadcast(only), "bucket", "left_semi")
    if inside is None:
        rows = rows.withColumn("inside", F.lit(False))
    else:
        ids = inside.select(F.col(quoted(key)).alias("k")).distinct().withColumn("hit", F.lit(True))
        rows = rows.join(ids, "k", "left").withColumn("inside", F.coalesce("hit", F.lit(False)))
    return rows.select("id", "inside", "bucket", "h")


def fingerprint(df: DataFrame, row_id: str, inside: DataFrame | None = None, key: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """inside, bucket, n, x, s of ``df``; at most 2 * ``buckets`` rows.

    ``inside`` (column ``key``): rows with these keys are added up apart from the others.
    """
    rows = _marked(df, row_id, inside, key or row_id, buckets)
    return rows.groupBy("inside", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.expr("bit_xor(h)").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("s"))


def digest(fingerprints: DataFrame) -> str:
    """One short text for a whole table from its fingerprint by bucket."""
    n, x, s = fingerprints.agg(F.sum("n"), F.expr("bit_xor(x)"), F.sum("s")).first()
    return f"{n or 0}:{x or 0}:{s or 0}"


def table_digest(df: DataFrame) -> str:
    """As ``digest`` for a table without an id; its column names and types belong to it."""
    n, x, s = df.select(row_hash(df).alias("h")).agg(
        F.count(F.lit(1)), F.expr("bit_xor(h)"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return f"{df.schema.simpleString()}:{n}:{x or 0}:{s or 0}"


def unequal_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """bucket: those in which the rows outside differ between two fingerprints."""
    b = before.filter("NOT inside").selectExpr("bucket", "struct(n, x, s) AS b")
    a = after.filter("NOT inside").selectExpr("bucket", "struct(n, x, s) AS a")
    return b.join(a, "bucket", "full").filter("NOT (a <=> b)").select("bucket")


def changes_outside(before: DataFrame, after: DataFrame, row_id: str, inside: DataFrame | None = None, key: str | None = None,
                    buckets: int = BUCKETS, fingerprints: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """id, status of the rows outside that were ``removed``, ``added`` or ``changed`` between two snapshots.

    Rows are outside if their ``key`` is not among those of ``inside``. ``fingerprints``: those of both
    snapshots, if known already. Rows that share an id are compared together.
    """
    key = key or row_id
    fb, fa = fingerprints or (fingerprint(before, row_id, inside, key, buckets), fingerprint(after, row_id, inside, key, buckets))
    differing = unequal_buckets(fb, fa)  # at most ``buckets`` rows

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = _marked(df, row_id, inside, key, buckets, differing).filter("NOT inside")
        return rows.groupBy("id").agg(F.struct(F.count(F.lit(1)), F.expr("bit_xor(h)"), F.sum(F.col("h").cast("decimal(38,0)"))).alias(name))

    b, a = side(before, "b"), side(after, "a").withColumnRenamed("id", "id_a")
    j = b.join(a, F.col("id").eqNullSafe(F.col("id_a")), "full").filter("NOT (a <=> b)")
    return j.select(F.coalesce("id", "id_a").alias(row_id), F.expr(
        "CASE WHEN a IS NULL THEN 'removed' WHEN b IS NULL THEN 'added' ELSE 'changed' END").alias("status"))


