"""Concept dictionary lookups.

Joins carry no broadcast hints: Spark broadcasts a side whose measured size is below its
threshold and shuffles (and splits hot keys) otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions.text import text_is

def english_names(concept_name: DataFrame, key: str = "concept_id", name: str = "name") -> DataFrame:
    """One preferred English name per concept (the smallest if a concept has several)."""
    return (
        concept_name.filter(text_is(F.col("locale"), "en") & (F.col("locale_preferred") == 1) & F.col("name").isNotNull())
        .groupBy(F.col("concept_id").alias(key))
        .agg(F.min("name").alias(name))
    )


def coded_value_names(obs: DataFrame, concept_name: DataFrame, value_col: str = "value_coded",
                      name_col: str = "name") -> DataFrame:
    """Attach the English preferred name of each coded value (NULL when it has none)."""
    return obs.join(english_names(concept_name, key=value_col, name=name_col), value_col, "left")


def ranked_names(concept_name: DataFrame) -> DataFrame:
    """concept_id, name, name_rank: the English preferred names with a number that orders like the (binary) text.

    Concepts are numbered within the group of those whose names share their first two bytes, so no task sorts
    the whole dictionary. Concepts of one name have numbers of their own.
    """
    head = "CAST(conv(rpad(hex(substring(CAST(name AS binary), 1, 2)), 4, '0'), 16, 10) AS long) AS head"
    groups = english_names(concept_name).selectExpr("concept_id", "name", head).groupBy("head").agg(
        F.sort_array(F.collect_list(F.struct("name", "concept_id"))).alias("names"))
    return groups.selectExpr("head", "posexplode(names) AS (at, c)").selectExpr(
        "c.concept_id", "c.name", "shiftleft(head, 40) + at AS name_rank")
