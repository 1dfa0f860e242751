"""Exact duplicates by two Bloom passes; only possibly repeated rows are shuffled.

Pass one hashes every normalised text to one position of a bit filter and keeps the positions
that were hit more than once (counted map-side first, so a text with a third of all rows sends
one row per task). Pass two looks every row up in that filter, which is broadcast: its size is
fixed by ``filter_bits``, whatever the data. A row whose position was hit once is surely unique
and passes straight through; the others (copies, and a few false alarms) are grouped by the
SHA-256 of the text. A fuller filter only means more false alarms, never a wrong result.

Defined cases: a NULL text counts as empty; of equal texts the largest doc_id stays (a NULL id
is smaller than any other); rows that repeat id and text are one document and share a decision;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelens.llm.common import ascii_lower

#: 2 ** 25 bits are at most 1024 bitmaps of 4 KiB: 4 MiB to broadcast.
FILTER_BITS = 1 << 25
BITMAP_BITS = 1 << 15


def normal_text(text: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text), F.lit("")))


def repeated_positions(texts: Column, docs: DataFrame, filter_bits: int) -> DataFrame:
    """Bitmaps (bucket, bits) of the filter positions that more than one row of ``docs`` hits."""
    hits = docs.select(F.pmod(F.xxhash64(texts), F.lit(filter_bits)).cast("int").alias("position"))
    twice = hits.groupBy("position").count().filter("count > 1")
    return twice.groupBy(F.expr(f"position DIV {BITMAP_BITS}").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(position % {BITMAP_BITS})").alias("bits"))


def _flagged(docs: DataFrame, filter_bits: int) -> DataFrame:
    """``docs`` (with a normalised column text) with its SHA-256 and whether it may be repeated."""
    seen_twice = F.broadcast(repeated_positions(F.col("text"), docs, filter_bits))
    rows = docs.select(
        *[c for c in docs.columns if c != "text"], F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.pmod(F.xxhash64("text"), F.lit(filter_bits)).cast("int").alias("position"))
    return rows.join(seen_twice, F.expr(f"position DIV {BITMAP_BITS}") == F.col("bucket"), "left").withColumn(
        "maybe", F.coalesce(_bit("bits", f"position % {BITMAP_BITS}"), F.lit(False))).drop("bucket", "bits", "position")


def exact_groups(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    flagged = _flagged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), normal_text("text").alias("text")), filter_bits)
    alone = flagged.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    maybe = flagged.filter("maybe").select("doc_id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    copies = maybe.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return alone.unionByName(copies)


def without_copies(docs: DataFrame, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One whole row of ``docs`` for each normalised text: the one with the largest doc_id.

    Groups are reduced map-side, so a hot text sends one row per task.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    flagged = _flagged(docs.select(whole.alias("row"), normal_text("text").alias("text")), filter_bits)
    alone = flagged.filter(~F.col("maybe")).select("row")
    best = flagged.filter("maybe").groupBy("text_sha256").agg(
        F.max_by("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63)))).alias("row")).select("row")
    return alone.unionByName(best).select("row.*")


def _bit(bits: str, position: str) -> Column:
    """Whether a bit of a bitmap is set (bytes in order, the lowest bit of a byte first)."""
    byte = f"conv(hex(substring({bits}, ({position}) DIV 8 + 1, 1)), 16, 10)"
    return F.expr(f"bit_get(CAST({byte} AS int), ({position}) % 8) = 1")
