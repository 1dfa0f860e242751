"""Spec-driven "best observation per patient" selection.

The source report asks dozens of questions of the form *"the latest (or first, or any)
non-voided observation of concepts C for this patient, inside an encounter of type T,
on or before a cutoff"*, each as its own correlated subquery. Here every such question
is a row of a small spec table, and all of them are answered together:

1. one scan of ``obs`` restricted to the concepts of all specs (pushed to Parquet),
2. one join with ``encounter`` on ``encounter_id`` (plus per-encounter facts on the same key),
3. a broadcast join with the spec table (a fixed, code-defined list) on ``concept_id``,
4. one grouped aggregation per (patient, spec) that keeps the best row,
5. one grouped pivot per patient (``max(when(spec = k, value))``).

Every row gets a rank key (the ordering time as signed microseconds: larger is better,
NULL is worst) and a tie key (``obs_id``, negated for "first"/"any"; constant for specs
that keep ties). ``max(struct(rank, tie, columns...))`` is then the best row; for
``keep_ties`` specs each column is instead ``max(struct(rank, column))``, the largest value
among the rows at the best time, which is what the report's MAX over tied rows gives.
Both aggregations are partial before their shuffle, so a patient with a huge history, or a
huge set of rows stamped with one instant, ships at most one row per spec per map task.

``best_values`` is the cheaper form for reports that read few columns of each answer: rank and tie are packed into one
decimal number, every read value into a long or a double, and a hash aggregate keeps the value with the largest key.

``choose`` keeps the tall form instead (all best rows, ties included) with a ranked window.
Rows after the last cutoff of their concept are left out before the join with ``encounter``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens.operators.dictionary import coded_value_names

CUTOFF_COLUMNS = ("obs_datetime", "encounter_datetime", "value_datetime")
ORDER_COLUMNS = ("obs_datetime", "encounter_datetime", "value_datetime", "obs_id")


@dataclass(frozen=True)
class PickSpec:
    """One "best observation" question.

    key: name of the answer (used to read it back from the pivot).
    concepts: observation concepts that qualify.
    encounter_type / form_id: the observation's encounter must be non-voided and of this type / form.
    cutoff_on: column compared with the cutoff (None: no cutoff).
    cutoff: name of a cutoff instant supplied at run time (inclusive upper bound).
    order_on: column that ranks rows; "obs_id" means "any row" (lowest id).
    descending: latest (True) or first (False).
    keep_ties: keep all rows at the best time instead of one row.
    coded_in: the coded value must be one of these.
    named_only: drop rows whose coded value has no English preferred name before choosing.
    """

    key: str
    concepts: tuple[int, ...]
    encounter_type: int | None = None
    form_id: int | None = None
    cutoff_on: str | None = "obs_datetime"
    cutoff: str = "end"
    order_on: str = "obs_datetime"
    descending: bool = True
    keep_ties: bool = False
    coded_in: tuple[int, ...] | None = None
    named_only: bool = False

    def __post_init__(self):
        assert self.cutoff_on in (None, *CUTOFF_COLUMNS), self.cutoff_on
        assert self.order_on in ORDER_COLUMNS, self.order_on

    @property
    def needs_encounter(self) -> bool:
        return self.encounter_type is not None or self.form_id is not None


@dataclass
class PickPlan:
    """The specs of one report plus helpers to read answers back from the pivot."""

    specs: list[PickSpec]
    index: dict[str, int] = field(init=False)

    def __post_init__(self):
        keys = [s.key for s in self.specs]
        assert len(keys) == len(set(keys)), "duplicate spec keys"
        self.index = {s.key: i for i, s in enumerate(self.specs)}

    @property
    def concepts(self) -> list[int]:
        return sorted({c for s in self.specs for c in s.concepts})

    # Wide reports need a few hundred expressions; they are built from SQL text (one JVM
    # call each) rather than chained Column calls (tens of JVM calls each).
    def is_spec(self, key: str) -> Column:
        return F.expr(f"spec_idx = {self.index[key]}")

    def value(self, key: str, col: str | Column) -> Column | str:
        """Pivot aggregate: ``col`` of the row chosen for spec ``key`` (see ``best_per_spec``).

        For a column name the aggregate is returned as SQL text (``pivot`` aliases it inside
        the same text).
        """
        cond = f"spec_idx = {self.index[key]}"
        if isinstance(col, str):
            return f"max(CASE WHEN {cond} THEN `{col}` END)"
        return F.max(F.when(F.expr(cond), col))

    def any_of(self, keys: list[str]) -> Column:
        return F.expr(f"spec_idx IN ({', '.join(str(self.index[k]) for k in keys)})")

    def last_times(self, cutoffs: dict[str, dt.datetime]) -> dict[int, dt.datetime]:
        """By concept the latest ``obs_datetime`` that any spec takes; without the concepts that some spec takes at all times."""
        times: dict[int, dt.datetime] = {}
        for s in self.specs:
            for c in s.concepts:
                times[c] = max(times.get(c, dt.datetime.min), cutoffs[s.cutoff] if s.cutoff_on == "obs_datetime" else dt.datetime.max)
        return {c: at for c, at in times.items() if at != dt.datetime.max}

    def spec_frame(self, spark: SparkSession, cutoffs: dict[str, dt.datetime]) -> DataFrame:
        """The spec table: one row per (spec, concept); fixed size, defined in code."""
        rows = []
        for i, s in enumerate(self.specs):
            cut = cutoffs[s.cutoff] if s.cutoff_on else None
            for c in s.concepts:
                rows.append((
                    int(c), i, s.encounter_type, s.form_id, s.needs_encounter,
                    CUTOFF_COLUMNS.index(s.cutoff_on) + 1 if s.cutoff_on else 0, cut,
                    ORDER_COLUMNS.index(s.order_on), s.descending, s.keep_ties,
                    [int(x) for x in s.coded_in] if s.coded_in else None, s.named_only,
                ))
        schema = T.StructType([
            T.StructField("concept_id", T.LongType()), T.StructField("spec_idx", T.IntegerType()),
            T.StructField("s_enc_type", T.IntegerType()), T.StructField("s_form", T.IntegerType()),
            T.StructField("s_needs_enc", T.BooleanType()), T.StructField("s_cut_col", T.IntegerType()),
            T.StructField("s_cut_at", T.TimestampNTZType()), T.StructField("s_order_col", T.IntegerType()),
            T.StructField("s_desc", T.BooleanType()), T.StructField("s_ties", T.BooleanType()),
            T.StructField("s_coded_in", T.ArrayType(T.LongType())), T.StructField("s_named_only", T.BooleanType()),
        ])
        return spark.createDataFrame(rows, schema)


OBS_COLUMNS = ["obs_id", "person_id", "encounter_id", "concept_id", "obs_datetime", "value_coded",
               "value_numeric", "value_text", "value_datetime"]


def enrich_obs(obs: DataFrame, encounter: DataFrame, concept_name: DataFrame, concepts: list[int],
               encounter_types: list[int], forms: list[int], encounter_facts: DataFrame | None = None,
               names: DataFrame | None = None) -> DataFrame:
    """Non-voided observations of ``concepts`` with their (non-voided) encounter and coded-value name.

    The encounter side is cut to the types and forms any spec can use before the join.
    ``encounter_facts`` (one row per encounter_id) is attached to it first, so ``obs`` is joined
    once, on a shuffle of its own: adaptive execution can split a hot or NULL encounter_id there
    (two joins in a row on one shuffle would not be split). ``names`` (value_coded, name): what to attach
    as ``name`` instead of the coded value's name itself.
    """
    def listed(values) -> str:
        return ", ".join(str(int(v)) for v in values) or "NULL"

    # long literal lists as SQL text: one JVM call instead of one per value
    o = obs.filter(F.expr(f"voided = 0 AND concept_id IN ({listed(concepts)})")).select(*OBS_COLUMNS)
    e = encounter.filter(F.expr(f"voided = 0 AND (encounter_type IN ({listed(encounter_types)}) "
                                f"OR form_id IN ({listed(forms)}))")).select(
        "encounter_id", "encounter_type", "form_id", "encounter_datetime")
    if encounter_facts is not None:
        e = e.join(encounter_facts, "encounter_id", "full")
    joined = o.join(e, "encounter_id", "left")
    return coded_value_names(joined, concept_name) if names is None else joined.join(names, "value_coded", "left")


def _pick_column(code_col: str, names: tuple[str, ...], offset: int) -> Column:
    expr = None
    for i, n in enumerate(names):
        cond = F.col(code_col) == F.lit(i + offset)
        expr = F.when(cond, F.col(n)) if expr is None else expr.when(cond, F.col(n))
    return expr


_EPOCH = dt.datetime(1970, 1, 1)


def _micros(c: Column) -> Column:
    """Microseconds since 1970 of a wall-clock timestamp (no time zone involved)."""
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), c)


def candidates(enriched: DataFrame, spec_df: DataFrame) -> DataFrame:
    """Rows that qualify for each spec, with rank key ``_k`` and tie key ``_tb`` (larger is better)."""
    x = enriched.join(F.broadcast(spec_df), "concept_id")
    cut_value = _pick_column("s_cut_col", CUTOFF_COLUMNS, 1)
    passes = (
        (~F.col("s_needs_enc") | F.col("encounter_type").isNotNull())
        & (F.col("s_enc_type").isNull() | (F.col("encounter_type") == F.col("s_enc_type")))
        & (F.col("s_form").isNull() | (F.col("form_id") == F.col("s_form")))
        & ((F.col("s_cut_col") == 0) | (cut_value <= F.col("s_cut_at")))
        & (F.col("s_coded_in").isNull() | F.coalesce(F.array_contains("s_coded_in", F.col("value_coded")), F.lit(False)))
        & (~F.col("s_named_only") | F.col("name").isNotNull())
    )
    x = x.filter(passes)
    order_value = _micros(_pick_column("s_order_col", ORDER_COLUMNS[:3], 0))
    k = (F.when(F.col("s_order_col") == 3, F.lit(0).cast("long"))
         .when(F.col("s_desc"), order_value).otherwise(-order_value))
    tb = (F.when(F.col("s_ties"), F.lit(0).cast("long"))
          .when(F.col("s_desc"), F.col("obs_id")).otherwise(-F.col("obs_id")))
    return x.withColumn("_k", k).withColumn("_tb", tb)


def best_per_spec(cands: DataFrame, columns: list[str], derived: dict[str, Column] | None = None,
                  tie_columns: list[str] | None = None) -> DataFrame:
    """One row per (person, spec): the best row's ``columns``; for ``keep_ties`` specs each
    of ``tie_columns`` (default: all) is the largest value among the rows at the best time,
    and the other columns are NULL.

    ``derived`` columns are computed on every candidate row first, so conditions on a row
    (e.g. "the name, if the answer is X") are applied before ties are merged.
    """
    derived = derived or {}
    cols = list(columns) + list(derived)
    ties = cols if tie_columns is None else [c for c in cols if c in set(tie_columns) | set(derived)]
    x = cands.select("person_id", "spec_idx", "s_ties", "_k", "_tb", *columns,
                     *[e.alias(n) for n, e in derived.items()])
    best = ", ".join(f"`{c}`" for c in ["_k", "_tb", *cols])
    aggs = [F.expr(f"max(struct({best})) AS _best"), F.expr("max(s_ties) AS _ties")]
    aggs += [F.expr(f"max(CASE WHEN s_ties THEN struct(_k, `{c}` AS v) END) AS `_t_{c}`") for c in ties]
    g = x.groupBy("person_id", "spec_idx").agg(*aggs)
    return g.selectExpr("person_id", "spec_idx", *[
        (f"CASE WHEN _ties THEN `_t_{c}`.v ELSE _best.`{c}` END AS `{c}`" if c in ties
         else f"CASE WHEN _ties THEN NULL ELSE _best.`{c}` END AS `{c}`") for c in cols])


#: Bounds of a packed key's parts: times lie within +-10^18 microseconds, ties (64 bits) within +-10^19.
NO_TIME = -(10 ** 18)
TIE_SPAN = 2 * 10 ** 19
NO_VALUE = -(2 ** 63)


def double_order(x: str) -> str:
    """SQL for a long that orders as the double ``x`` does (exact; NaN is largest, NULL stays NULL)."""
    a = f"abs({x})"
    e = f"CAST(floor(log2({a})) AS int)"
    e = f"({e} + CASE WHEN {a} >= pow(2D, {e} + 1) THEN 1 WHEN {a} < pow(2D, {e}) THEN -1 ELSE 0 END)"  # log2 is rounded
    size = (f"CASE WHEN isnan({x}) THEN 9223372036854775807 WHEN {a} > 1.7976931348623157E308D THEN 9223372036854775806 "
            f"WHEN {a} < 2.2250738585072014E-308D THEN CAST({a} / 4.9E-324D AS long) "
            f"ELSE ({e} + 1023) * 4503599627370496L + CAST(({a} / pow(2D, {e}) - 1) * 4503599627370496D AS long) END")
    return f"CASE WHEN {x} IS NOT NULL THEN IF({x} < 0, -1L, 1L) * ({size}) END"


def micros(timestamp: str) -> str:
    """SQL for the microseconds since 1970 of a wall-clock timestamp."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {timestamp})"


def from_micros(value: str) -> str:
    return f"timestampadd(MICROSECOND, {value}, TIMESTAMP_NTZ'1970-01-01 00:00:00')"


def packed_key(time: str, tie: str) -> str:
    """SQL for one number that orders by ``time`` (a long, NULL least), then by ``tie`` (a long, NULL least)."""
    return (f"CAST(coalesce({time}, {NO_TIME}L) AS decimal(38, 0)) * {TIE_SPAN} + "
            f"CAST(coalesce({tie}, CAST('{NO_VALUE}' AS long)) AS decimal(38, 0))")


def best_state(cands: DataFrame, plan: PickPlan, reads: list[tuple[str, str]], longs: dict[str, str],
               doubles: dict[str, str]) -> DataFrame:
    """person_id, read_idx, best, v, d: of each (question, column) in ``reads`` the column's value in the person's best row,
    and that row's packed key (states of one list of reads can be merged, see ``merged``).

    ``longs`` and ``doubles`` say by SQL what a column's number is (in ``v`` or ``d``). For ``keep_ties`` questions it is the
    largest value among the rows at the best time. All state is fixed-width, so this is a hash aggregate, partial
    before its shuffle, and a row of the shuffle holds one value.
    """
    names = [*longs, *doubles]
    rows = [(plan.index[k], i, names.index(c)) for i, (k, c) in enumerate(reads)]
    table = cands.sparkSession.createDataFrame(rows, "spec_idx int, read_idx int, read_column int")  # a fixed list

    def lane(columns: dict[str, str]) -> str:
        whens = " ".join(f"WHEN {names.index(c)} THEN {e}" for c, e in columns.items() if any(c == x for _, x in reads))
        return f"CASE read_column {whens} END" if whens else "NULL"

    x = cands.join(F.broadcast(table), "spec_idx").selectExpr(
        "person_id", "read_idx", "s_ties", "_k", "_tb", f"read_column >= {len(longs)} AS is_double",
        f"CAST({lane(longs)} AS long) AS v", f"CAST({lane(doubles)} AS double) AS d")
    tie = f"CASE WHEN NOT s_ties THEN _tb WHEN is_double THEN {double_order('d')} ELSE v END"
    x = x.selectExpr("person_id", "read_idx", "v", "d", f"{packed_key('_k', tie)} AS best")
    return merged(x)


def merged(states: DataFrame) -> DataFrame:
    """The best of several states (a union of them): the value with the largest key."""
    return states.groupBy("person_id", "read_idx").agg(
        F.expr("max(best) AS best"), F.expr("max_by(v, best) AS v"), F.expr("max_by(d, best) AS d"))


def best_values(cands: DataFrame, plan: PickPlan, reads: list[tuple[str, str]], longs: dict[str, str],
                doubles: dict[str, str]) -> DataFrame:
    """person_id, read_idx, v, d of ``best_state``."""
    return best_state(cands, plan, reads, longs, doubles).drop("best")


def choose(cands: DataFrame, keep: list[str]) -> DataFrame:
    """Tall answers: the best row per (person, spec), every tied row for ``keep_ties`` specs (none for rows without a person).

    A ranked window, so the qualifying rows are made and shuffled once. Before that shuffle Spark cuts the rows of each map
    task to its best of each group; rows that tie at the top of one group are read sorted by one task, from disk if need be.
    """
    best_first = Window.partitionBy("person_id", "spec_idx").orderBy(F.col("_k").desc_nulls_last(), F.col("_tb").desc_nulls_last())
    rows = cands.filter("person_id IS NOT NULL").select("person_id", "spec_idx", "_k", "_tb", *[c for c in keep if c != "person_id"])
    return rows.withColumn("_rank", F.rank().over(best_first)).filter("_rank = 1").select("person_id", "spec_idx", *keep)


CARRIED = ["obs_id", "encounter_id", "obs_datetime", "value_coded", "value_numeric", "value_text",
           "value_datetime", "encounter_datetime", "form_id", "name"]


def plan_candidates(spark: SparkSession, obs: DataFrame, encounter: DataFrame, concept_name: DataFrame,
                    plan: PickPlan, cutoffs: dict[str, dt.datetime], extra_forms: list[int] = (),
                    encounter_facts: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Qualifying rows of every spec in ``plan`` (see ``candidates``).

    ``extra_forms``: encounter forms whose id must be visible on rows even though no spec
    filters on them.
    """
    types = sorted({s.encounter_type for s in plan.specs if s.encounter_type is not None})
    forms = sorted({s.form_id for s in plan.specs if s.form_id is not None} | set(extra_forms))
    last = plan.last_times(cutoffs)
    if last:
        listed = ", ".join(f"{c}L, TIMESTAMP_NTZ'{at.isoformat(sep=' ')}'" for c, at in last.items())
        obs = obs.filter(F.expr(f"coalesce(obs_datetime <= element_at(map({listed}), concept_id), true)"))
    enriched = enrich_obs(obs, encounter, concept_name, plan.concepts, types, forms, encounter_facts, names)
    return candidates(enriched, plan.spec_frame(spark, cutoffs))


def pick(spark: SparkSession, obs: DataFrame, encounter: DataFrame, concept_name: DataFrame,
         plan: PickPlan, cutoffs: dict[str, dt.datetime], carried: list[str] = CARRIED,
         extra_forms: list[int] = ()) -> DataFrame:
    """Tall answers: (person_id, spec_idx, carried columns...) for every spec in ``plan``."""
    return choose(plan_candidates(spark, obs, encounter, concept_name, plan, cutoffs, extra_forms), carried)


def spread_left_join(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join on ``key``; rows without one, which match nothing, are dealt out by ``spread`` (of the key's type), not to one task."""
    rows = left.withColumn("_spread", F.expr(f"coalesce(`{key}`, `{spread}`)"))
    found = right.withColumnRenamed(key, "_key")
    return rows.join(found, (F.col(key) == F.col("_key")) & (F.col("_spread") == F.col("_key")), "left").drop("_spread", "_key")


def pivot(best: DataFrame, aggregates: dict[str, Column | str]) -> DataFrame:
    """One row per person with the named aggregates (``PickPlan.value`` and friends);
    aggregates given as SQL text are aliased in the text itself (one JVM call each)."""
    return best.groupBy("person_id").agg(*[
        F.expr(f"{e} AS `{n}`") if isinstance(e, str) else e.alias(n) for n, e in aggregates.items()])
