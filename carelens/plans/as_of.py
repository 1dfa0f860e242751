"""The line list's best values kept as a table and brought to a later report day from what is new.

A state holds for every person and read column the value of the best row and that row's packed key, so
states merge by taking the larger key. To go from one report day to a later one it takes

* observations loaded since, and stored ones that have only now come under a cutoff (their own, value or
  encounter time lies after the old day);
* all rows of persons that the caller names, because something of theirs was voided, changed or removed;
* all rows for questions whose other cutoffs (a quarter's end) have moved.

Only these rows go through the joins with encounters and names. Each kind is found by a semi join of its own, which
keeps no row that it does not need, and what was found is stored once, so nothing of it is made again for a second use.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.functions.dates import day_after
from carelens.operators.picks import PickPlan, best_state, merged
from carelens.plans import specs as S
from carelens.plans.line_list import DOUBLE_READS, LONG_READS, LineListParams, answer_reads, qualifying_rows
from carelens.session import ensure_checkpoint_dir, stored
from carelens.sources.tables import ClinicalTables

STATE = "person_id long, read_idx int, best decimal(38,0), v long, d double"


def report_state(spark: SparkSession, t: ClinicalTables, params: LineListParams) -> DataFrame:
    """The state of the whole report as of ``params.end``."""
    plan = S.line_list_plan(params.extended_concepts)
    reads, _, _ = answer_reads(plan)
    return best_state(qualifying_rows(spark, t, params, plan), plan, reads, LONG_READS, DOUBLE_READS)


def advanced(spark: SparkSession, state: DataFrame, t: ClinicalTables, before: LineListParams, after: LineListParams,
             loaded: DataFrame, redo: DataFrame) -> DataFrame:
    """The state as of ``after.end``, from ``state`` as of ``before.end``.

    ``t``: the tables as they are now. ``loaded`` (obs_id): observations that were not there for ``state``.
    ``redo`` (person_id): persons with a changed, voided or removed observation or encounter, or a changed person id.
    The dictionary must be the same for both (names are kept as numbers); with another one make the state anew.
    """
    if after.end < before.end or before.extended_concepts != after.extended_concepts:
        raise ValueError("a state goes forward in time, with the same questions")
    plan = S.line_list_plan(after.extended_concepts)
    reads, _, _ = answer_reads(plan)
    old, new = before.cutoffs(), after.cutoffs()
    moved = {s.key for s in plan.specs if s.cutoff_on and s.cutoff != "end" and old[s.cutoff] != new[s.cutoff]}
    again = [i for i, (k, _) in enumerate(reads) if k in moved]
    listed = ", ".join(map(str, again)) or "-1"
    late = day_after(before.end)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/carelens-{uuid.uuid4().hex}"
    # Refill counts belong to encounters: a fresh one can change the value of an older best row of its encounter, so the
    # one question that reads them is answered anew for the persons of that encounter.
    refills = _fresh(t, late, loaded, t.obs.filter((F.col("concept_id") == S.REFILL_DAYS) & F.col("encounter_id").isNotNull()))
    touched = t.obs.join(refills.select("encounter_id"), "encounter_id", "left_semi")
    persons = redo.selectExpr("person_id", "true AS whole").unionByName(touched.selectExpr("person_id", "false AS whole"))
    persons = stored(persons.filter("person_id IS NOT NULL").groupBy("person_id").agg(F.max("whole").alias("whole")), f"{root}/redo")
    counted = plan.specs[plan.index["prevq_pickup"]]
    by_refill = ", ".join(str(i) for i, (k, _) in enumerate(reads) if k == counted.key)

    def part(obs: DataFrame) -> DataFrame:
        rows = qualifying_rows(spark, t.with_tables(obs=obs), after, plan, facts=t.obs)
        return best_state(rows, plan, reads, LONG_READS, DOUBLE_READS)

    rows = _newly_under(t, plan, late, new["end"]).unionByName(_loaded(t.obs, loaded))
    rows = rows.unionByName(t.obs.join(redo.select("person_id"), "person_id", "left_semi").select(t.obs.columns))
    recount = t.obs.filter(F.col("concept_id").isin(list(counted.concepts)) | F.col("obs_id").isNull())
    rows = rows.unionByName(recount.join(persons, "person_id", "left_semi").select(t.obs.columns))
    out = part(rows).filter(f"read_idx NOT IN ({listed})")
    if again:
        concepts = sorted({c for s in plan.specs if s.key in moved for c in s.concepts} | {S.REFILL_DAYS})
        out = out.unionByName(part(t.obs.filter(F.col("concept_id").isin(concepts))).filter(f"read_idx IN ({listed})"))
    out = stored(out, f"{root}/new")
    # The kept rows of redone persons leave behind the one shuffle by person, which the merging groups use as well.
    both = state.filter(f"read_idx NOT IN ({listed})").withColumn("is_kept", F.lit(True)).unionByName(out.withColumn("is_kept", F.lit(False)))
    both = both.join(persons, "person_id", "left")
    return merged(both.filter(f"NOT is_kept OR whole IS NULL OR (NOT whole AND read_idx NOT IN ({by_refill}))"))


def _loaded(obs: DataFrame, loaded: DataFrame) -> DataFrame:
    return obs.join(loaded.select("obs_id"), "obs_id", "left_semi").select(obs.columns)


def _fresh(t: ClinicalTables, late: dt.datetime, loaded: DataFrame | None, obs: DataFrame) -> DataFrame:
    """Rows of ``obs`` loaded since, or whose own, value or encounter time is not before ``late`` (some come twice)."""
    encounters = t.encounter.filter(F.col("encounter_datetime") >= late).select("encounter_id")
    out = obs.filter((F.col("obs_datetime") >= late) | (F.col("value_datetime") >= late))
    out = out.unionByName(obs.join(encounters, "encounter_id", "left_semi").select(obs.columns))
    return out if loaded is None else out.unionByName(_loaded(obs, loaded))


def _newly_under(t: ClinicalTables, plan: PickPlan, late: dt.datetime, end: dt.datetime) -> DataFrame:
    """Observations with a time from ``late`` to ``end`` that some question compares with the report day (some come twice).

    Rows without an id, which no list of loaded ones can name, count by any time from ``late`` on.
    """
    def on(column: str):
        return F.col("concept_id").isin(sorted({c for s in plan.specs if s.cutoff_on == column for c in s.concepts}))

    encounters = t.encounter.filter(F.col("encounter_datetime").between(late, end)).select("encounter_id")
    out = t.obs.filter(F.col("obs_id").isNotNull() & ((on("obs_datetime") & F.col("obs_datetime").between(late, end))
                                                      | (on("value_datetime") & F.col("value_datetime").between(late, end))))
    by_encounter = t.obs.filter(F.col("obs_id").isNotNull() & on("encounter_datetime")).join(encounters, "encounter_id", "left_semi")
    return out.unionByName(by_encounter.select(t.obs.columns)).unionByName(_fresh(t, late, None, t.obs.filter(F.col("obs_id").isNull())))
