"""Corrections (with backup and verification), quality checks and cohort investigation."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from carelens.operators import corrections as C
from carelens.operators import investigate as I
from carelens.operators import quality as Q
from tests.clinical import D, T, Rows

BAD = T(1019, 10, 30)


def tables(spark):
    r = Rows()
    r.patient(1, gate=False)
    r.patient(2, gate=False)
    r.t["visit"] += [
        (10, 1, 1, T(2015, 6, 24), T(2015, 6, 24, 23, 59, 59), 8, 0),   # E18 visit
        (11, 1, 1, T(2016, 1, 1), None, 8, 0),                          # missing stop
        (12, 2, 1, T(2016, 2, 2), T(2016, 2, 1), 8, 0),                 # inverted
    ]
    r.encounter(1, 25, 13, BAD, eid=100, visit_id=10)
    r.encounter(1, 25, 13, T(2015, 6, 24, 10), eid=101, visit_id=10)
    r.encounter(1, 12, 14, T(2016, 1, 1, 9), eid=102, visit_id=11)
    r.encounter(2, 25, 13, T(2016, 2, 3), eid=103, visit_id=12, voided=1)
    r.t["biometricinfo"] += [(1, T(2023, 1, 1)), (1, T(2023, 1, 1, 5)), (2, T(2023, 2, 1))]
    r.t["biometricverificationinfo"] += [(1, T(2023, 3, 1), 1), (2, T(2023, 3, 2), 4)]
    return r.tables(spark)


def requests(spark):
    enc = spark.createDataFrame([(10, BAD, T(2015, 6, 24))], "visit_id long, bad_datetime timestamp_ntz, new_datetime timestamp_ntz")
    vis = spark.createDataFrame([(10, T(2015, 6, 24), T(2015, 6, 24, 23, 59, 59))],
                                "visit_id long, new_start timestamp_ntz, new_stop timestamp_ntz")
    return enc, vis


def test_e18_only_exact_match_changes(spark):
    t = tables(spark)
    enc, _ = requests(spark)
    out = {r["encounter_id"]: r for r in C.correct_encounters(t.encounter, enc).collect()}
    assert out[100]["encounter_datetime"] == T(2015, 6, 24) and out[100]["corrected"]
    assert out[101]["encounter_datetime"] == T(2015, 6, 24, 10) and not out[101]["corrected"]
    assert len(out) == 4


def test_corrections_idempotent_and_backup_restores(spark):
    t = tables(spark)
    enc, vis = requests(spark)
    once = C.correct_encounters(t.encounter, enc).drop("corrected")
    twice = C.correct_encounters(once, enc).drop("corrected")
    assert sorted(once.collect()) == sorted(twice.collect())
    before = C.backup(t.encounter, enc, "visit_id", "r1")
    assert sorted(before.select("encounter_id").toPandas()["encounter_id"]) == [100, 101]
    # before image + untouched rows = original table
    cols = t.encounter.columns
    untouched = once.join(enc.select("visit_id"), "visit_id", "left_anti").select(*cols)
    restored = untouched.unionByName(before.select(*cols))
    assert sorted(restored.collect()) == sorted(t.encounter.collect())


def report(spark, t, enc, vis):
    after = C.correct_encounters(t.encounter, enc), C.correct_visits(t.visit, vis)
    out = C.correction_report(t.encounter, after[0], t.visit, after[1], C.requested_visits(enc, vis))
    return {r["visit_id"]: (r["n_encounters"], r["n_encounters_changed"], r["visit_changed"], r["status"]) for r in out.collect()}


def test_correction_report(spark):
    t = tables(spark)
    enc, vis = requests(spark)
    # requested bounds equal the stored ones
    assert report(spark, t, enc, vis) == {10: (2, 1, False, "applied")}


def test_report_sees_visit_only_and_empty_corrections(spark):
    t = tables(spark)
    enc, vis = requests(spark)
    only = spark.createDataFrame([(11, T(2016, 1, 1), T(2016, 1, 1, 23, 59, 59)), (10, T(2015, 6, 24), T(2015, 6, 24, 23, 59, 59))], vis.schema)
    assert report(spark, t, enc.filter("false"), only) == {10: (2, 0, False, "no_change"), 11: (1, 0, True, "applied")}


def test_report_sees_lost_and_added_rows(spark):
    t = tables(spark)
    ids = spark.createDataFrame([(10,)], "visit_id long")
    added = t.encounter.unionByName(t.encounter.filter("encounter_id = 101").withColumn("encounter_id", F.lit(999).cast("long")))
    for after in (t.encounter.filter("encounter_id <> 101"), added):
        r = C.correction_report(t.encounter, after, t.visit, t.visit, ids).first()
        assert r["status"] == "damaged"


def test_e19_purge(spark):
    t = tables(spark)
    cap, ver = C.purge_biometrics(t.biometricinfo, t.biometricverificationinfo, spark.createDataFrame([(1,)], "patient_id long"))
    assert [r["patient_id"] for r in cap.collect()] == [2]
    assert [r["patient_id"] for r in ver.collect()] == [2]
    left = I.biometric_records(cap, ver, spark.createDataFrame([(1,)], "patient_id long"))
    assert left.count() == 0  # the verification step expects 0 rows
    ids = spark.createDataFrame([(1,)], "patient_id long")
    check = C.purge_report(t.biometricinfo, t.biometricverificationinfo, cap, ver, ids).collect()
    assert [tuple(r) for r in check] == [(1, 2, 0, 1, 0, "purged")]
    left = C.purge_report(t.biometricinfo, t.biometricverificationinfo, cap, t.biometricverificationinfo, ids).first()
    assert left["status"] == "rows_left" and left["n_verified_left"] == 1


def test_reenrolment(spark):
    t = tables(spark)
    purged = spark.createDataFrame([(1, T(2023, 1, 1, 2)), (2, T(2023, 2, 1)), (3, T(2023, 2, 1))], "patient_id long, purged_at timestamp_ntz")
    got = {r["patient_id"]: (r["n_new"], r["status"]) for r in C.reenrolment_check(purged, t.biometricinfo).collect()}
    assert got == {1: (1, "re_enrolled"), 2: (0, "missing"), 3: (0, "missing")}


def test_quality_checks(spark):
    t = tables(spark)
    outside = {r["encounter_id"]: r["problem"] for r in Q.encounters_outside_visit(t.encounter, t.visit).collect()}
    assert outside == {100: "before_start"}  # 103 is voided, 102 has an open visit
    bounds = {r["visit_id"]: r["problem"] for r in Q.invalid_visit_bounds(t.visit).collect()}
    assert bounds == {11: "missing_stop", 12: "stop_before_start"}
    odd = Q.implausible_datetimes(t.encounter, t.visit, t.obs, D(1990, 1, 1), D(2024, 12, 31)).collect()
    assert [(r["table_name"], r["row_id"]) for r in odd] == [("encounter", 100)]
    dup = Q.duplicate_biometrics(t.biometricinfo).collect()
    assert [(r["patient_id"], r["n_records"]) for r in dup] == [(1, 2)]
    same_day = Q.duplicate_biometrics(t.biometricinfo, same_day=True).collect()
    assert [r["patient_id"] for r in same_day] == [1]


def test_investigation_chain(spark):
    t = tables(spark)
    cohort = Q.encounters_outside_visit(t.encounter, t.visit)
    visits = I.patient_visits(t.visit, cohort.select("patient_id")).orderBy("visit_seq").collect()
    assert [(r["visit_id"], r["visit_seq"]) for r in visits] == [(10, 1), (11, 2)]
    assert visits[0]["raw_date_started"] == "2015-06-24 00:00:00"
    chron = I.encounter_chronology(t.encounter, cohort.select("visit_id")).orderBy("encounter_seq").collect()
    assert [r["encounter_id"] for r in chron] == [100, 101]
    assert chron[0]["raw_encounter_datetime"] == "1019-10-30 00:00:00"
    assert chron[0]["gap_micros"] is None and chron[1]["gap_micros"] > 0
    det = I.visit_details(t.visit, cohort.select("visit_id")).collect()
    assert [r["visit_id"] for r in det] == [10]
    starts = I.start_encounters(t.encounter, spark.createDataFrame([(2,)], "patient_id long")).collect()
    assert [(r["encounter_id"], r["voided"]) for r in starts] == [(103, 1)]


def test_apply_corrections_writes_new_snapshots(spark, tmp_path):
    t = tables(spark)
    enc, vis = requests(spark)
    paths = C.apply_corrections(t.encounter, t.visit, enc, vis, str(tmp_path), "run1")
    after = {r["encounter_id"]: r["encounter_datetime"] for r in spark.read.parquet(paths["encounter"]).collect()}
    assert after[100] == T(2015, 6, 24) and len(after) == 4
    backup = spark.read.parquet(paths["backups"] + "/encounter")
    assert sorted(r["encounter_id"] for r in backup.collect()) == [100, 101]
    assert backup.first()["backup_run"] == "run1"
    report = spark.read.parquet(paths["report"]).collect()
    assert report[0]["status"] == "applied"


def test_requests_from_findings_reproduce_the_source_fix(spark):
    t = tables(spark)
    enc, vis = C.requests_from_findings(Q.encounters_outside_visit(t.encounter, t.visit))
    assert [tuple(r) for r in enc.collect()] == [(10, BAD, T(2015, 6, 24))]
    assert [tuple(r) for r in vis.collect()] == [(10, T(2015, 6, 24), T(2015, 6, 24, 23, 59, 59))]
    fixed = {r["encounter_id"]: r["encounter_datetime"] for r in C.correct_encounters(t.encounter, enc).collect()}
    assert fixed[100] == T(2015, 6, 24) and fixed[101] == T(2015, 6, 24, 10)


def test_a_run_id_is_used_once(spark, tmp_path):
    t = tables(spark)
    enc, vis = requests(spark)
    paths = C.apply_corrections(t.encounter, t.visit, enc, vis, str(tmp_path), "run1")
    fixed = spark.read.parquet(paths["encounter"])
    with pytest.raises(AnalysisException):
        C.apply_corrections(fixed, t.visit, enc, vis, str(tmp_path), "run1")
    C.apply_corrections(t.encounter, t.visit, enc, vis, str(tmp_path), "run2")
    backup = spark.read.parquet(str(tmp_path / "backups" / "encounter"))
    assert backup.filter("backup_run = 'run1' AND encounter_datetime = timestamp_ntz'1019-10-30 00:00:00'").count() == 1
    assert backup.groupBy("backup_run").count().filter("count = 2").count() == 2


def test_whole_rows_are_kept(spark, tmp_path):
    """Columns that no report declares reach snapshots and backups."""
    t = tables(spark)
    enc, vis = requests(spark)
    more = t.encounter.withColumn("uuid", F.concat(F.lit("u"), F.col("encounter_id").cast("string"))).withColumn("`odd name", F.lit(1))
    more = more.withColumnRenamed("`odd name", "odd name")
    v = t.visit.withColumn("creator", F.lit("c"))
    paths = C.apply_corrections(more, v, enc, vis, str(tmp_path), "r")
    assert spark.read.parquet(paths["encounter"]).dtypes == more.dtypes
    assert spark.read.parquet(paths["visit"]).columns == v.columns
    assert set(more.columns) < set(spark.read.parquet(paths["backups"] + "/encounter").columns)
    cap = t.biometricinfo.withColumn("template", F.lit("x"))
    ids = spark.createDataFrame([(1,)], "patient_id long")
    out = C.apply_purge(cap, t.biometricverificationinfo, ids, str(tmp_path), "p")
    assert spark.read.parquet(out["biometricinfo"]).columns == cap.columns
    assert spark.read.parquet(out["backups"] + "/biometricinfo").filter("template = 'x'").count() == 2
    assert spark.read.parquet(out["report"]).first()["status"] == "purged"
    assert "template" in I.biometric_records(cap, t.biometricverificationinfo).columns


class Stop(Exception):
    pass


def _stop_after(monkeypatch, n):
    """Runs fail when the n-th manifest entry has been written; returns the list of entries."""
    from carelens.operators import runs

    real, seen = runs.Run._record, []

    def record(self, step, *args):
        real(self, step, *args)
        seen.append(step)
        if len(seen) == n:
            raise Stop(step)

    monkeypatch.setattr(runs.Run, "_record", record)
    return seen


def _content(spark, paths, names):
    out = {n: sorted(map(str, spark.read.parquet(paths[n]).collect())) for n in names}
    for t in ("encounter", "visit"):
        out["backup " + t] = sorted(map(str, spark.read.parquet(f"{paths['backups']}/{t}").collect()))
    return out


def test_a_failed_run_goes_on(spark, tmp_path, monkeypatch):
    """Whatever the step after which a run fails, calling it again ends with the same tables."""
    t = tables(spark)
    enc, vis = requests(spark)
    seen = _stop_after(monkeypatch, 0)
    whole = C.apply_corrections(t.encounter, t.visit, enc, vis, str(tmp_path / "whole"), "r1")
    steps = list(seen)
    names = ("encounter", "visit", "report", "outside")
    want = _content(spark, whole, names)
    assert steps[:3] == ["encounter_requests", "visit_requests", "targets"] and steps[5] == "inputs" and steps[-1] == "report"
    for n in (3, 6, 7, 9, 12):
        root = str(tmp_path / f"fails{n}")
        with monkeypatch.context() as m:
            _stop_after(m, n)
            with pytest.raises(Stop):
                C.apply_corrections(t.encounter, t.visit, enc, vis, root, "r1")
        done = _stop_after(monkeypatch, 0)
        paths = C.apply_corrections(t.encounter, t.visit, enc, vis, root, "r1")
        assert done == (steps if n < 6 else steps[n:]) and _content(spark, paths, names) == want
        monkeypatch.undo()
    done = _stop_after(monkeypatch, 0)
    assert C.apply_corrections(t.encounter, t.visit, enc, vis, str(tmp_path / "whole"), "r1") == whole and done == []


def test_a_half_written_step_is_written_anew(spark, tmp_path):
    t = tables(spark)
    enc, vis = requests(spark)
    t.encounter.limit(1).write.parquet(str(tmp_path / "r1" / "encounter"))  # without a manifest entry
    t.encounter.limit(1).write.parquet(str(tmp_path / "backups" / "encounter" / "backup_run=r1"))
    paths = C.apply_corrections(t.encounter, t.visit, enc, vis, str(tmp_path), "r1")
    assert spark.read.parquet(paths["encounter"]).count() == 4
    assert spark.read.parquet(paths["backups"] + "/encounter").count() == 2


def test_another_input_is_refused(spark, tmp_path):
    from carelens.operators.runs import RunIdTaken

    t = tables(spark)
    enc, vis = requests(spark)
    C.apply_corrections(t.encounter, t.visit, enc, vis, str(tmp_path), "r1")
    one_more = t.visit.unionByName(t.visit.limit(1).withColumn("visit_id", F.lit(99).cast("long")))
    for args, what in (((t.encounter, one_more, enc, vis), "visit"),
                       ((t.encounter, t.visit, enc.filter("false"), vis), "encounter_requests"),
                       ((t.encounter.withColumn("x", F.lit(1)), t.visit, enc, vis), "encounter")):
        with pytest.raises(RunIdTaken, match=what):
            C.apply_corrections(*args, str(tmp_path), "r1")


ODD_NAMES = ["a.b", "corrected", "new_datetime", "bad_datetime", "_visit_id", "backup_run", "new_start", "tick`s", "id", "k", "h", "bucket", "inside"]


def test_stored_names_do_not_clash(spark, tmp_path):
    """Dots, backticks and the names of requests and helpers are ordinary stored columns."""
    t = tables(spark)
    enc, vis = requests(spark)
    e, v, cap = t.encounter, t.visit, t.biometricinfo
    for c in ODD_NAMES:
        e, v, cap = e.withColumn(c, F.lit("own")), v.withColumn(c, F.lit("own")), cap.withColumn(c, F.lit("own"))
    paths = C.apply_corrections(e, v, enc, vis, str(tmp_path), "r")
    after = spark.read.parquet(paths["encounter"])
    assert after.columns == e.columns and spark.read.parquet(paths["visit"]).columns == v.columns
    assert after.filter("encounter_id = 100 AND encounter_datetime = timestamp_ntz'2015-06-24 00:00:00' AND `a.b` = 'own' AND corrected = 'own'").count() == 1
    kept = spark.read.schema(e.schema).parquet(paths["backups"] + "/encounter/backup_run=r")
    assert kept.filter("backup_run = 'own'").count() == 2
    assert spark.read.parquet(paths["report"]).first()["status"] == "applied" and spark.read.parquet(paths["outside"]).count() == 0
    assert C.correct_encounters(e, enc).filter("corrected_1").count() == 1 and C.correct_visits(v, vis).filter("corrected_1").count() == 1
    assert C.backup(e, enc, "visit_id", "x").filter("backup_run_1 = 'x'").count() == 2
    out = C.apply_purge(cap, t.biometricverificationinfo, spark.createDataFrame([(1,)], "patient_id long"), str(tmp_path), "p")
    assert spark.read.parquet(out["biometricinfo"]).columns == cap.columns


def test_changes_beyond_the_request_are_seen(spark):
    t = tables(spark)
    targets = spark.createDataFrame([(10,)], "visit_id long")

    def found(after, before=t.encounter):
        return {(r["row_id"], r["status"]) for r in C.outside_report({"encounter": (before, after, "encounter_id")}, targets, "visit_id").collect()}

    assert found(t.encounter.repartition(3).orderBy(F.desc("encounter_id"))) == set()
    assert found(t.encounter.filter("encounter_id <> 102")) == {(102, "removed")}
    assert found(t.encounter.filter("encounter_id <> 100")) == set()  # inside: the report's concern
    assert found(t.encounter.withColumn("form_id", F.expr("IF(encounter_id IN (101, 103), NULL, form_id)"))) == {(103, "changed")}
    assert found(t.encounter.withColumn("encounter_id", F.expr("IF(encounter_id = 103, 900, encounter_id)"))) == {(103, "removed"), (900, "added")}
    # A copy of a row, and a value that moved to the next column, are changes.
    assert found(t.encounter.unionByName(t.encounter.filter("encounter_id = 102"))) == {(102, "changed")}
    swapped = t.encounter.withColumn("provider_id", F.expr("IF(encounter_id = 102, NULL, provider_id)"))
    other = t.encounter.withColumn("provider_id", F.expr("IF(encounter_id = 102, location_id, provider_id)")).withColumn(
        "location_id", F.expr("IF(encounter_id = 102, NULL, location_id)"))
    assert found(swapped.withColumn("location_id", F.lit(8)), other) >= {(102, "changed")}
    # Rows without an id, and columns of any type.
    odd = t.encounter.withColumn("encounter_id", F.expr("IF(encounter_id = 102, NULL, encounter_id)")).withColumn(
        "m", F.expr("map('a', 1, 'b', 2)")).withColumn("s", F.expr("struct(array(1, NULL) AS x)"))
    assert found(odd, odd.withColumn("m", F.expr("map('b', 2, 'a', 1)"))) == set()
    assert found(odd.filter("encounter_id IS NOT NULL"), odd) == {(None, "removed")}


def test_report_sees_other_columns(spark):
    t = tables(spark)
    ids = spark.createDataFrame([(10,)], "visit_id long")
    after = t.encounter.withColumn("provider_id", F.expr("IF(encounter_id = 101, 77, provider_id)"))
    assert C.correction_report(t.encounter, after, t.visit, t.visit, ids).first()["status"] == "damaged"


def test_a_failed_purge_goes_on_and_old_rows_stay_away(spark, tmp_path, monkeypatch):
    t = tables(spark)
    ids = spark.createDataFrame([(1,), (None,)], "patient_id long")
    at = T(2023, 1, 1, 2)
    with monkeypatch.context() as m:
        _stop_after(m, 4)
        with pytest.raises(Stop):
            C.apply_purge(t.biometricinfo, t.biometricverificationinfo, ids, str(tmp_path), "p", at)
    out = C.apply_purge(t.biometricinfo, t.biometricverificationinfo, ids, str(tmp_path), "p")  # keeps the first time
    assert {(r["patient_id"], r["status"]) for r in spark.read.parquet(out["report"]).collect()} == {(1, "purged"), (None, "purged")}
    log = C.purge_log(spark, str(tmp_path))
    assert [tuple(r) for r in log.collect()] == [(1, at)]
    # The old table is loaded again, with a row without a time: only what came after the purge is seen.
    again = t.biometricinfo.unionByName(spark.createDataFrame([(1, None), (3, None)], t.biometricinfo.schema))
    left = C.without_purged(again, log)
    assert sorted(map(str, left.collect())) == sorted(map(str, again.filter("patient_id <> 1 OR date_created > timestamp_ntz'2023-01-01 02:00:00'").collect()))
    assert C.reenrolment_check(log, left).first()["status"] == "re_enrolled"
    C.apply_purge(left, t.biometricverificationinfo, ids, str(tmp_path), "p2", T(2024, 1, 1))
    assert C.purge_log(spark, str(tmp_path)).count() == 2 and C.without_purged(again, C.purge_log(spark, str(tmp_path))).filter("patient_id = 1").count() == 0


def _driver_rows(spark, root):
    """A few rows of the driver tables the clinical ones are made from."""
    import datetime as dt
    day = lambda n: dt.datetime(1998, 1, 1) + dt.timedelta(days=n)
    frames = {
        "customer": ([(i, f"c{i}", i % 3, 0.0, "X") for i in range(20)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(i, i % 20, "O", 1.0, day(i % 90), "1-URGENT") for i in range(300)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(i % 300, i % 50, i % 7, i % 5, 1.0, 1.0, 0.0, 0.0, "N", "O", day(i % 80)) for i in range(900)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                     "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "part": ([(i, f"p{i}", "b", "t", 1, 1.0) for i in range(50)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "nation": ([(i, f"n{i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "r")], "r_regionkey int, r_name string"),
        "events": ([(1, day(1), 1, "signup", 1.0, "{}")], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_visits_are_grouped_once_for_the_workflows(spark, tmp_path, monkeypatch):
    """Visits come from all observations; a workflow that reads them many times must not group them anew each time."""
    from carelens import entry_queries as Q
    d = _driver_rows(spark, tmp_path)
    outside = Q.QUERIES["outside_changes"](spark, d)
    assert "l_shipdate" not in outside._jdf.queryExecution().executedPlan().toString()
    assert outside.count() > 0
    read = []
    apply = Q.C.apply_corrections
    monkeypatch.setattr(Q.C, "apply_corrections", lambda enc, vis, *a: read.append((enc, vis)) or apply(enc, vis, *a))
    assert Q.QUERIES["correction_verify"](spark, d).count() > 0
    assert "l_shipdate" not in read[0][1]._jdf.queryExecution().executedPlan().toString()


def test_rows_of_equal_buckets_are_left_out_before_the_shuffle(spark):
    from carelens.operators.fingerprints import changes_outside, fingerprint
    before = spark.range(500).selectExpr("id", "id % 50 AS visit_id", "id * 2 AS v")
    after = before.selectExpr("id", "visit_id", "IF(id IN (7, 60), 0L, v) AS v").filter("id <> 8")
    inside = spark.createDataFrame([(10,)], "visit_id long")
    found = changes_outside(before, after, "id", inside, "visit_id")
    assert sorted(map(tuple, found.collect())) == [(7, "changed"), (8, "removed")]
    prints = tuple(fingerprint(x, "id", inside, "visit_id") for x in (before, after))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = changes_outside(before, after, "id", inside, "visit_id", fingerprints=prints)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    at = plan.index("BroadcastHashJoin [bucket")
    marked = plan.index("LeftOuter", plan.index("SortMergeJoin [k#"))
    assert marked < at  # nearer to the scan: the rows are cut first
