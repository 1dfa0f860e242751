"""Bulk, audited record corrections.

The source scripts back up rows with a SELECT, run an UPDATE or DELETE for one id, and
re-run the SELECT to check. Here a corrections table drives one join per table; the
result is a new snapshot (Parquet has no in-place UPDATE), the before image is a semi
join, and verification is a full outer join of the stored rows before and after.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens.operators.fingerprints import changes_outside, digest, fingerprint, row_hash, table_digest
from carelens.operators.runs import Run
from carelens.sources.names import free_name, quoted, renamed, whole_row
from carelens.sources.versions import rewrite_hits


def _requests(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One request per key (duplicates resolved to the smallest values, deterministically)."""
    best = df.groupBy(*keys).agg(F.min(F.struct(*values)).alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def requests_from_findings(outside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Correction requests for encounters found outside their visit's bounds
    (``quality.encounters_outside_visit``): move each such encounter to its visit's start,
    and make the visit span the whole day it started (00:00:00 to 23:59:59), as the source
    fix does for one visit."""
    enc = outside.select("visit_id", F.col("encounter_datetime").alias("bad_datetime"),
                         F.col("date_started").alias("new_datetime")).distinct()
    day = F.col("date_started").cast("date").cast("timestamp_ntz")
    vis = outside.select("visit_id", day.alias("new_start"),
                         F.timestamp_add("SECOND", F.lit(86399), day).alias("new_stop")).distinct()
    return enc, vis


def _corrected(table: DataFrame, requests: DataFrame, on: dict[str, str], values: dict[str, str], flag: str | None) -> DataFrame:
    """``table`` with ``values`` (column: request column) where the columns of ``on`` equal a request's."""
    req, names = renamed(requests, table)
    j = table.join(req, [F.col(quoted(c)) == F.col(quoted(names[r])) for c, r in on.items()], "left")
    hit = F.col(quoted(names[next(iter(on.values()))])).isNotNull()
    lower = {c.lower(): r for c, r in values.items()}
    cols = [F.when(hit, F.col(quoted(names[lower[c.lower()]]))).otherwise(F.col(quoted(c))).alias(c) if c.lower() in lower else F.col(quoted(c))
            for c in table.columns]
    return j.select(*cols, *([hit.alias(flag)] if flag else []))


def correct_encounters(encounter: DataFrame, corrections: DataFrame, flag: str | None = "corrected") -> DataFrame:
    """Encounter snapshot where ``encounter_datetime`` equal to a request's ``bad_datetime`` in
    the request's visit becomes ``new_datetime``; every other row is unchanged.

    Adds ``flag`` (true for changed rows; numbered if the table has such a column), None adds none.
    """
    req = _requests(corrections, ["visit_id", "bad_datetime"], ["new_datetime"])
    return _corrected(encounter, req, {"visit_id": "visit_id", "encounter_datetime": "bad_datetime"}, {"encounter_datetime": "new_datetime"},
                      flag and free_name(flag, encounter))


def correct_visits(visit: DataFrame, corrections: DataFrame, flag: str | None = "corrected") -> DataFrame:
    """Visit snapshot with requested start and stop written over the listed visits (``flag`` as above)."""
    req = _requests(corrections, ["visit_id"], ["new_start", "new_stop"])
    return _corrected(visit, req, {"visit_id": "visit_id"}, {"date_started": "new_start", "date_stopped": "new_stop"},
                      flag and free_name(flag, visit))


def before_image(table: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Every row of ``table`` whose ``key`` is targeted, as it is."""
    return table.join(targets.select(key).distinct(), key, "left_semi").select(*whole_row(table))


def backup(table: DataFrame, targets: DataFrame, key: str, run_id: str) -> DataFrame:
    """Before image, stamped with the run (``backup_run``; numbered if the table has such a column)."""
    return before_image(table, targets, key).withColumn(free_name("backup_run", table), F.lit(run_id))


def verify(before: DataFrame, after: DataFrame, row_id: str, compare: list[str]) -> DataFrame:
    """Row-level diff of two snapshots on ``row_id``: unchanged / changed / removed / added."""
    b = before.select(row_id, F.struct(*compare).alias("_b"))
    a = after.select(row_id, F.struct(*compare).alias("_a"))
    j = b.join(a, row_id, "full")
    status = (F.when(F.col("_a").isNull(), "removed").when(F.col("_b").isNull(), "added")
              .when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed"))
    return j.select(row_id, status.alias("status"))


def requested_visits(enc_requests: DataFrame, visit_requests: DataFrame) -> DataFrame:
    return enc_requests.select("visit_id").union(visit_requests.select("visit_id")).distinct()


def correction_report(enc_before: DataFrame, enc_after: DataFrame, vis_before: DataFrame, vis_after: DataFrame,
                      targets: DataFrame) -> DataFrame:
    """Per requested visit, what a correction did: the whole rows of ``targets`` before and after it are
    compared for both tables, so rows that appeared or vanished are seen as well.

    status: ``applied`` (times of an encounter or the visit changed), ``damaged`` (rows were added or
    lost, or other columns changed) or ``no_change``. The four inputs may be snapshots read back from storage.
    """
    ids = targets.select("visit_id").distinct()

    def compared(before: DataFrame, after: DataFrame, row_id: str, columns: list[str], prefix: str) -> DataFrame:
        rest = [c for c in before.columns if c not in columns]

        def side(df: DataFrame, end: str) -> DataFrame:
            # the few compared values are made first, so that no whole row is shuffled
            rows = df.select(F.col("visit_id").alias(f"_v{end}"), F.col(row_id).alias(f"_{end}"), F.struct(*columns).alias(f"_times_{end}"),
                             row_hash(df, rest).alias(f"_rest_{end}"))
            return rows.join(ids.withColumnRenamed("visit_id", f"_v{end}"), f"_v{end}", "left_semi")

        j = side(before, "b").join(side(after, "a"), F.col("_b") == F.col("_a"), "full")
        both = F.col("_b").isNotNull() & F.col("_a").isNotNull()

        def total(condition):
            return F.sum(F.when(condition, 1).otherwise(0)).cast("long")

        return j.groupBy(F.coalesce("_vb", "_va").alias("visit_id")).agg(
            total(F.col("_b").isNotNull()).alias(f"n_{prefix}"),
            total(both & ~F.col("_times_b").eqNullSafe(F.col("_times_a"))).alias(f"n_{prefix}_changed"),
            total(F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_rest_a") != F.col("_rest_b"))).alias(f"n_{prefix}_damaged"))

    enc = compared(enc_before, enc_after, "encounter_id", ["encounter_datetime"], "encounters")
    vis = compared(vis_before, vis_after, "visit_id", ["date_started", "date_stopped"], "visits")
    out = ids.join(enc, "visit_id", "left").join(vis, "visit_id", "left").fillna(0)
    return out.select(
        "visit_id", "n_encounters", "n_encounters_changed", (F.col("n_visits_changed") > 0).alias("visit_changed"),
        F.expr("CASE WHEN n_encounters_damaged + n_visits_damaged > 0 THEN 'damaged' "
               "WHEN n_encounters_changed + n_visits_changed > 0 THEN 'applied' ELSE 'no_change' END").alias("status"))


def outside_report(tables: dict[str, tuple[DataFrame, DataFrame, str]], targets: DataFrame, key: str,
                   fingerprints: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """table_name, row_id, status of rows beyond the requested ``key`` values that differ between two snapshots.

    ``tables``: (before, after, id column) by name. A correction must leave this empty.
    """
    out = None
    for name, (before, after, row_id) in tables.items():
        found = changes_outside(before, after, row_id, targets, key, fingerprints=(fingerprints or {}).get(name)).select(
            F.lit(name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), "status")
        out = found if out is None else out.unionByName(found)
    return out


def purge_biometrics(biometricinfo: DataFrame, biometricverificationinfo: DataFrame,
                     patients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both biometric tables without the given patients (verification first, then enrollment)."""
    ids = patients.select("patient_id").distinct()
    return tuple(t.join(ids, "patient_id", "left_anti").select(*whole_row(t)) for t in (biometricinfo, biometricverificationinfo))


def purge_report(cap_before: DataFrame, ver_before: DataFrame, cap_after: DataFrame, ver_after: DataFrame,
                 patients: DataFrame) -> DataFrame:
    """Per purged patient the rows of both biometric tables before and after; none may be left."""
    parts = [(cap_before, "n_enrolled"), (cap_after, "n_enrolled_left"), (ver_before, "n_verified"), (ver_after, "n_verified_left")]
    names = [n for _, n in parts]
    out = patients.select("patient_id").distinct()
    for df, name in parts:
        out = out.join(df.groupBy("patient_id").agg(F.count(F.lit(1)).alias(name)), "patient_id", "left")
    return out.fillna(0, names).select(
        "patient_id", *names, F.expr("CASE WHEN n_enrolled_left + n_verified_left = 0 THEN 'purged' ELSE 'rows_left' END").alias("status"))


def reenrolment_check(purged: DataFrame, biometricinfo: DataFrame) -> DataFrame:
    """Whether purged patients were captured again: enrollment rows after their purge.

    ``purged``: patient_id, purged_at (the last purge counts).
    """
    p = purged.groupBy("patient_id").agg(F.max("purged_at").alias("purged_at"))
    later = biometricinfo.select("patient_id", "date_created").join(p, "patient_id").filter("date_created > purged_at")
    found = later.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_new"), F.min("date_created").alias("first_new_at"))
    return p.join(found, "patient_id", "left").select(
        "patient_id", "purged_at", F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"), "first_new_at",
        F.when(F.col("n_new") > 0, "re_enrolled").otherwise("missing").alias("status"))


def _same_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after``, if it has the columns and types of ``before``."""
    old, new = [(f.name, f.dataType) for f in before.schema], [(f.name, f.dataType) for f in after.schema]
    if old != new:
        raise ValueError(f"a snapshot must have the columns of its table: {sorted(set(map(str, old)) ^ set(map(str, new)))}")
    return after


def apply_corrections(encounter: DataFrame, visit: DataFrame, enc_requests: DataFrame, visit_requests: DataFrame,
                      out_root: str, run_id: str) -> dict[str, str]:
    """The whole correction workflow as one job sequence, each step a written table (``runs.Run``):

    1. store the requests and the fingerprints of both tables,
    2. back up every encounter and visit row of the requested visits (``backups/``),
    3. write the corrected encounter and visit snapshots to new paths (``<run_id>/``),
    4. read backups and snapshots back and write what changed for each visit (``<run_id>/report``), and
       every row beyond the requested visits that differs (``<run_id>/outside``; empty unless something is wrong).

    Nothing is changed in place. A run that failed goes on from its first missing step when it is called
    again, a finished one returns its paths; another input under its id is refused. Returns the paths.
    """
    run = Run(encounter.sparkSession, out_root, run_id)
    tables = {"encounter": (encounter, "encounter_id"), "visit": (visit, "visit_id")}

    def fingerprint_of(name: str, df: DataFrame, targets: DataFrame) -> DataFrame:
        return fingerprint(df, tables[name][1], targets, "visit_id")

    def digests(t: dict[str, DataFrame], fresh: bool) -> dict[str, str]:
        return {name: f"{df.schema.simpleString()}:" + digest(t[f"{name}_before"] if fresh else fingerprint_of(name, df, t["targets"]))
                for name, (df, _) in tables.items()}

    t, _ = run.prepare(
        {"encounter_requests": enc_requests, "visit_requests": visit_requests},
        {"targets": lambda t: requested_visits(t["encounter_requests"], t["visit_requests"]),
         **{f"{n}_before": lambda t, n=n, df=df: fingerprint_of(n, df, t["targets"]) for n, (df, _) in tables.items()}}, digests)
    targets, backups = t["targets"], f"{out_root.rstrip('/')}/backups"
    old = {n: run.step(f"{n}_backup", lambda df=df: before_image(df, targets, "visit_id"), f"{backups}/{n}/backup_run={run_id}")
           for n, (df, _) in tables.items()}
    new = {"encounter": run.step("encounter", lambda: _same_columns(encounter, correct_encounters(encounter, t["encounter_requests"], None))),
           "visit": run.step("visit", lambda: _same_columns(visit, correct_visits(visit, t["visit_requests"], None)))}
    prints = {n: (t[f"{n}_before"], run.step(f"{n}_after", lambda n=n: fingerprint_of(n, new[n], targets))) for n in tables}
    run.step("outside", lambda: outside_report({n: (df, new[n], i) for n, (df, i) in tables.items()}, targets, "visit_id", prints))
    run.step("report", lambda: correction_report(old["encounter"], new["encounter"], old["visit"], new["visit"], targets))
    return {"backups": backups, **{n: f"{run.path}/{n}" for n in ("encounter", "visit", "report", "outside")}}


def correct_stored(spark: SparkSession, tables: dict[str, tuple[DataFrame, T.StructType]], enc_requests: DataFrame,
                   visit_requests: DataFrame, out_root: str, run_id: str) -> dict[str, DataFrame]:
    """Correct stored versions by file: only files that hold a row of a requested visit are written anew.

    ``tables``: the version (``sources.versions``) and schema of ``encounter`` and ``visit``. Resumable like
    ``apply_corrections``: requests, then for each table its new version. Returns the new versions by name.
    """
    run = Run(spark, out_root, run_id)
    t, _ = run.prepare({"encounter_requests": enc_requests, "visit_requests": visit_requests}, {},
                       lambda t, fresh: {n: table_digest(v.select("path")) for n, (v, _) in tables.items()})
    changes = {"encounter": lambda df: correct_encounters(df, t["encounter_requests"], None),
               "visit": lambda df: correct_visits(df, t["visit_requests"], None)}
    return {n: run.step(f"{n}_version", lambda n=n, v=v, schema=schema: rewrite_hits(
        spark, v, schema, t[f"{n}_requests"], "visit_id", changes[n], f"{run.path}/{n}")) for n, (v, schema) in tables.items()}


def apply_purge(biometricinfo: DataFrame, biometricverificationinfo: DataFrame, patients: DataFrame, out_root: str,
                run_id: str, purged_at: dt.datetime | None = None) -> dict[str, str]:
    """Back up, purge and verify both biometric tables as written tables, and log the purge.

    Goes on where a failed run stopped, like ``apply_corrections``. The log (``<out_root>/purged``,
    patient_id, purged_at) is only ever added to; ``without_purged`` keeps later loads of old
    rows from bringing them back. ``purged_at``: now, unless given; a rerun keeps the time of the first try.
    """
    run = Run(biometricinfo.sparkSession, out_root, run_id)
    tables = {"biometricverificationinfo": biometricverificationinfo, "biometricinfo": biometricinfo}
    at = (purged_at or dt.datetime.now()).isoformat(sep=" ")
    t, at = run.prepare({"patients": patients.select("patient_id").distinct()}, {},
                        lambda t, fresh: {n: table_digest(df) for n, df in tables.items()}, note=at)
    ids, backups = t["patients"], f"{out_root.rstrip('/')}/backups"
    old = {n: run.step(f"{n}_backup", lambda df=df: before_image(df, ids, "patient_id"), f"{backups}/{n}/backup_run={run_id}")
           for n, df in tables.items()}
    run.step("log", lambda: ids.filter("patient_id IS NOT NULL").select("patient_id", F.lit(at).cast("timestamp_ntz").alias("purged_at")),
             f"{out_root.rstrip('/')}/purged/run={run_id}")
    cap, ver = purge_biometrics(biometricinfo, biometricverificationinfo, ids)
    new = {n: run.step(n, lambda n=n, df=df: _same_columns(tables[n], df))
           for n, df in (("biometricverificationinfo", ver), ("biometricinfo", cap))}
    run.step("report", lambda: purge_report(old["biometricinfo"], old["biometricverificationinfo"], new["biometricinfo"],
                                            new["biometricverificationinfo"], ids))
    return {"report": f"{run.path}/report", "backups": backups, "log": f"{out_root.rstrip('/')}/purged", **{n: f"{run.path}/{n}" for n in tables}}


def purge_log(spark: SparkSession, out_root: str) -> DataFrame:
    """patient_id, purged_at of all runs that purged under ``out_root``."""
    return spark.read.schema("patient_id long, purged_at timestamp_ntz, run string").parquet(f"{out_root.rstrip('/')}/purged").select(
        "patient_id", "purged_at")


def without_purged(biometric: DataFrame, log: DataFrame, created: str = "date_created") -> DataFrame:
    """Rows of a biometric table that no logged purge concerns: those of patients never purged, and those
    created after the patient's last purge. Rows of purged patients without a time go, too."""
    last = log.groupBy("patient_id").agg(F.max("purged_at").alias("purged_at"))
    last, names = renamed(last, biometric)
    j = biometric.join(last, F.col("patient_id") == F.col(names["patient_id"]), "left")
    at = F.col(names["purged_at"])
    return j.filter(at.isNull() | F.coalesce(F.col(created) > at, F.lit(False))).select(*whole_row(biometric))
