"""Command line: the reference's "edit a date or an id, run the script" workflow as Spark jobs.

    python -m carelens line-list --tables ROOT --end 2024-12-25 --out PATH [--display --csv]
    python -m carelens investigate visits --tables ROOT --ids 12739,15480 --out PATH
    python -m carelens correct --tables ROOT --encounter-requests P --visit-requests P --out ROOT2 --run-id R
    python -m carelens purge-biometrics --tables ROOT --ids 12739 --out ROOT2 --run-id R
    python -m carelens check outside-visit --tables ROOT --out PATH

``ROOT`` holds one Parquet dataset per clinical table (``ROOT/obs``, ``ROOT/encounter``, ...).
Ids are a comma-separated list or the path of a Parquet dataset with the id column. Under
spark-submit the cluster's session is used; ``--local`` starts a local one.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os
import sys

from pyspark.sql import DataFrame, SparkSession


def _session(local: bool) -> SparkSession:
    if local:
        from carelens.session import local_session
        return local_session()
    return SparkSession.builder.appName("carelens").getOrCreate()


def _ids(spark: SparkSession, spec: str, column: str) -> DataFrame:
    if os.path.exists(spec) or "://" in spec:
        return spark.read.parquet(spec).select(column)
    return spark.createDataFrame([(int(x),) for x in spec.split(",") if x.strip()], f"{column} long")


def _write(df: DataFrame, path: str, csv: bool) -> None:
    if csv:
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="carelens")
    ap.add_argument("--local", action="store_true", help="start a local Spark session")
    sub = ap.add_subparsers(dest="cmd", required=True)

    ll = sub.add_parser("line-list")
    ll.add_argument("--tables", required=True)
    ll.add_argument("--end", required=True, type=dt.date.fromisoformat)
    ll.add_argument("--today", type=dt.date.fromisoformat)
    ll.add_argument("--partner", default=None, help="implementing partner printed in the IP column")
    ll.add_argument("--extended", action="store_true")
    ll.add_argument("--display", action="store_true")
    ll.add_argument("--legacy-text-max", action="store_true")
    ll.add_argument("--checkpoint", action="store_true")
    ll.add_argument("--out", required=True)
    ll.add_argument("--csv", action="store_true")

    inv = sub.add_parser("investigate")
    inv.add_argument("what", choices=["visits", "encounters", "visit-details", "start-encounters", "biometrics"])
    inv.add_argument("--tables", required=True)
    inv.add_argument("--ids", required=True, help="patient ids (visit ids for encounters / visit-details)")
    inv.add_argument("--out", required=True)
    inv.add_argument("--csv", action="store_true")

    cor = sub.add_parser("correct")
    cor.add_argument("--tables", required=True)
    cor.add_argument("--encounter-requests", required=True, help="Parquet: visit_id, bad_datetime, new_datetime")
    cor.add_argument("--visit-requests", required=True, help="Parquet: visit_id, new_start, new_stop")
    cor.add_argument("--out", required=True)
    cor.add_argument("--run-id", required=True)

    pur = sub.add_parser("purge-biometrics")
    pur.add_argument("--tables", required=True)
    pur.add_argument("--ids", required=True)
    pur.add_argument("--out", required=True)
    pur.add_argument("--run-id", required=True)

    ree = sub.add_parser("check-reenrolment")
    ree.add_argument("--tables", required=True)
    ree.add_argument("--purged", required=True, help="Parquet: patient_id, purged_at")
    ree.add_argument("--out", required=True)
    ree.add_argument("--csv", action="store_true")

    chk = sub.add_parser("check")
    chk.add_argument("what", choices=["outside-visit", "implausible", "duplicates", "visit-bounds"])
    chk.add_argument("--tables", required=True)
    chk.add_argument("--earliest", type=dt.date.fromisoformat, default=dt.date(1900, 1, 1))
    chk.add_argument("--latest", type=dt.date.fromisoformat, default=dt.date.today())
    chk.add_argument("--out", required=True)
    chk.add_argument("--csv", action="store_true")

    a = ap.parse_args(argv)
    spark = _session(a.local)
    from carelens.sources.tables import ClinicalTables
    t = ClinicalTables.read_parquet(spark, a.tables)

    if a.cmd == "line-list":
        from carelens.plans.line_list import LineListParams, line_list
        p = LineListParams(end=a.end, today=a.today, implementing_partner=a.partner,
                           extended_concepts=a.extended, checkpoint_answers=a.checkpoint)
        _write(line_list(spark, t, p, display=a.display or a.csv, legacy_text_max=a.legacy_text_max), a.out, a.csv)
    elif a.cmd == "investigate":
        from carelens.operators import investigate as I
        if a.what == "visits":
            df = I.patient_visits(t.visit, _ids(spark, a.ids, "patient_id"))
        elif a.what == "encounters":
            df = I.encounter_chronology(t.encounter, _ids(spark, a.ids, "visit_id"))
        elif a.what == "visit-details":
            df = I.visit_details(t.visit, _ids(spark, a.ids, "visit_id"))
        elif a.what == "start-encounters":
            df = I.start_encounters(t.encounter, _ids(spark, a.ids, "patient_id"))
        else:
            df = I.biometric_records(t.biometricinfo, t.biometricverificationinfo, _ids(spark, a.ids, "patient_id"))
        _write(df, a.out, a.csv)
    elif a.cmd == "correct":
        from carelens.operators.corrections import apply_corrections
        paths = apply_corrections(t.encounter, t.visit, spark.read.parquet(a.encounter_requests),
                                  spark.read.parquet(a.visit_requests), a.out, a.run_id)
        print(paths)
    elif a.cmd == "purge-biometrics":
        from carelens.operators.corrections import apply_purge
        paths = apply_purge(t.biometricinfo, t.biometricverificationinfo, _ids(spark, a.ids, "patient_id"), a.out, a.run_id)
        print({"patients_with_rows_left": spark.read.parquet(paths["report"]).filter("status <> 'purged'").count(), **paths})
    elif a.cmd == "check-reenrolment":
        from carelens.operators.corrections import reenrolment_check
        _write(reenrolment_check(spark.read.parquet(a.purged), t.biometricinfo), a.out, a.csv)
    else:
        from carelens.operators import quality as Q
        if a.what == "outside-visit":
            df = Q.encounters_outside_visit(t.encounter, t.visit)
        elif a.what == "implausible":
            df = Q.implausible_datetimes(t.encounter, t.visit, t.obs, a.earliest, a.latest)
        elif a.what == "duplicates":
            df = Q.duplicate_biometrics(t.biometricinfo)
        else:
            df = Q.invalid_visit_bounds(t.visit)
        _write(df, a.out, a.csv)
    return 0


if __name__ == "__main__":
    sys.exit(main())
