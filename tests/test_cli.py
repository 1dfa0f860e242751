"""The command line runs the report, an investigation, a correction run and a check."""

from carelens.__main__ import main
from tests.clinical import T
from tests.test_line_list_rules import build


def test_cli_workflow(spark, tmp_path):
    root = str(tmp_path / "emr")
    build().tables(spark).write_parquet(root)
    out = str(tmp_path / "ll")
    assert main(["line-list", "--tables", root, "--end", "2024-12-25", "--today", "2025-01-01", "--out", out]) == 0
    ll = spark.read.parquet(out)
    assert len(ll.columns) == 114 and ll.filter("patient_id = 7").first()["CurrentARTStatus"] == "LTFU"
    csv = str(tmp_path / "ll_csv")
    main(["line-list", "--tables", root, "--end", "2024-12-25", "--out", csv, "--csv"])
    assert spark.read.option("header", True).csv(csv).count() == ll.count()
    vis = str(tmp_path / "vis")
    main(["investigate", "encounters", "--tables", root, "--ids", "1,2", "--out", vis])
    assert spark.read.parquet(vis).count() == 0  # the hand rows carry no visit ids
    chk = str(tmp_path / "chk")
    main(["check", "implausible", "--tables", root, "--earliest", "2016-01-01", "--latest", "2024-06-30", "--out", chk])
    assert spark.read.parquet(chk).count() > 0
    req_e = str(tmp_path / "req_e")
    req_v = str(tmp_path / "req_v")
    spark.createDataFrame([(1, T(2020, 1, 1), T(2020, 1, 2))],
                          "visit_id long, bad_datetime timestamp_ntz, new_datetime timestamp_ntz").write.parquet(req_e)
    spark.createDataFrame([(1, T(2020, 1, 2), T(2020, 1, 2, 23, 59, 59))],
                          "visit_id long, new_start timestamp_ntz, new_stop timestamp_ntz").write.parquet(req_v)
    assert main(["correct", "--tables", root, "--encounter-requests", req_e, "--visit-requests", req_v,
                 "--out", str(tmp_path / "fix"), "--run-id", "r1"]) == 0
    assert main(["purge-biometrics", "--tables", root, "--ids", "25", "--out", str(tmp_path / "purge"),
                 "--run-id", "r1"]) == 0
    assert spark.read.parquet(str(tmp_path / "purge" / "r1" / "biometricinfo")).filter("patient_id = 25").count() == 0
