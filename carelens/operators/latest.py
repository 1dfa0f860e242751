"""Latest / first observation per (patient, concept), as of a cutoff.

These are the report's "join to MAX(obs_datetime)" and "ORDER BY ... LIMIT 1" patterns
written as window functions: a ``rank()`` keeps ties, a ``row_number()``-like order with an
``obs_id`` tie-break keeps one row. Spark plans both with a partial group limit before the
shuffle, so every map task ships at most the best rows of each (patient, concept).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.functions.dates import as_column


def _eligible(obs: DataFrame, cutoff: dt.datetime | Column | None, concepts=None) -> DataFrame:
    o = obs.filter(F.col("voided") == 0)
    if concepts is not None:
        o = o.filter(F.col("concept_id").isin(list(concepts)))
    if cutoff is not None:
        o = o.filter(F.col("obs_datetime") <= as_column(cutoff))
    return o


def rows_at_extreme(obs: DataFrame, cutoff=None, concepts=None, first: bool = False,
                    keys=("person_id", "concept_id")) -> DataFrame:
    """All non-voided rows at the latest (or first) ``obs_datetime`` of each key, ties kept.

    Written as the report writes it: a grouped MAX (or MIN), partial before the shuffle,
    then a semi join on (key, time). A huge tie group is then one hot join key, which
    adaptive execution splits across tasks, instead of one window partition in one task.
    """
    o = _eligible(obs, cutoff, concepts)
    agg = F.min("obs_datetime") if first else F.max("obs_datetime")
    extreme = o.groupBy(*keys).agg(agg.alias("obs_datetime"))
    return o.join(extreme, [*keys, "obs_datetime"], "left_semi")


def best_row(obs: DataFrame, cutoff=None, concepts=None, first: bool = False,
             keys=("person_id", "concept_id")) -> DataFrame:
    """Exactly one row per key: latest (highest obs_id on ties) or first (lowest obs_id)."""
    o = _eligible(obs, cutoff, concepts)
    if first:
        order = [F.col("obs_datetime").asc(), F.col("obs_id").asc()]
    else:
        order = [F.col("obs_datetime").desc(), F.col("obs_id").desc()]
    w = Window.partitionBy(*keys).orderBy(*order)
    return o.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def latest_obs_id(obs: DataFrame, cutoff=None, concepts=None) -> DataFrame:
    """Id of the latest non-voided observation per (person, concept) on or before the cutoff."""
    return best_row(obs, cutoff, concepts).select("person_id", "concept_id", "obs_id")


def first_last_dates(obs: DataFrame, cutoff=None, concepts=None) -> DataFrame:
    """First and last observation time per (person, concept): a plain grouped MIN / MAX."""
    return (
        _eligible(obs, cutoff, concepts)
        .groupBy("person_id", "concept_id")
        .agg(F.min("obs_datetime").alias("first_at"), F.max("obs_datetime").alias("last_at"),
             F.count(F.lit(1)).alias("n_obs"))
    )


def value_by_obs_id(ids: DataFrame, obs: DataFrame, id_col: str = "obs_id") -> DataFrame:
    """Look observations up by id (the report's per-id functions), as one join."""
    vals = obs.select(F.col("obs_id").alias(id_col), F.col("value_datetime").cast("date").alias("value_date"),
                      F.col("obs_datetime").cast("date").alias("obs_date"))
    return ids.join(vals, id_col, "left")
