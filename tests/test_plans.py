"""Plan checks: no Python in the hot path, no cartesian products, one window over obs."""

import re

from carelens.plans.line_list import LineListParams, line_list
from tests.clinical import D
from tests.test_line_list_rules import build


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_list_plan_shape(spark):
    t = build().tables(spark)
    df = line_list(spark, t, LineListParams(end=D(2024, 12, 25), today=D(2025, 1, 1)))
    plan = plan_text(df)
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert "CartesianProduct" not in plan
    # every observation question is answered by one grouped aggregation per patient: no window,
    # and obs is read twice (the answers and the per-encounter facts)
    assert len(re.findall(r"\bWindow \[", plan)) == 0
    assert len(re.findall(r"FileScan parquet|Scan ExistingRDD\[obs_id", plan)) >= 1
    # nested-loop joins only attach the one-row site header
    assert len(re.findall(r"BroadcastNestedLoopJoin", plan)) <= 3


def test_best_rows_of_obs_need_no_sort(spark, tmp_path):
    """Up to the chosen values there are hash aggregates only; sorted ones read a row per patient and answer."""
    from carelens.operators.picks import best_values, plan_candidates
    from carelens.plans import specs as S
    from carelens.plans.line_list import DOUBLE_READS, LONG_READS, encounter_refills, encounter_texts
    from carelens.operators.dictionary import ranked_names
    from carelens.sources.tables import ClinicalTables
    build().tables(spark).write_parquet(str(tmp_path))
    t = ClinicalTables.read_parquet(spark, str(tmp_path))
    p = LineListParams(end=D(2024, 12, 25), today=D(2025, 1, 1))
    plan = S.line_list_plan()
    cands = plan_candidates(spark, t.obs, t.encounter, t.concept_name, plan, p.cutoffs(), extra_forms=[S.FORM_CARE_CARD],
                            encounter_facts=encounter_refills(t.obs),
                            names=ranked_names(t.concept_name).selectExpr("concept_id AS value_coded", "name_rank AS name"))
    reads = [(s.key, c) for s in plan.specs for c in [*LONG_READS, *DOUBLE_READS]]
    text = plan_text(best_values(cands, plan, reads, LONG_READS, DOUBLE_READS))
    assert "HashAggregate(keys=[person_id" in text and "max_by(" in text
    sorted_aggregates = re.findall(r"SortAggregate\(key[^\n]*", text)
    assert all("concept_id" in a and "person_id" not in a for a in sorted_aggregates), sorted_aggregates  # the dictionary's alone
    assert "SortAggregate" not in plan_text(encounter_texts(t.obs))
    whole = plan_text(line_list(spark, t, p))
    obs_sorts = [a for a in re.findall(r"SortAggregate\(key[^\n]*", whole) if "obs_" in a or "value_" in a]
    assert not obs_sorts, obs_sorts


def test_obs_scan_has_pushed_concept_filter(spark, tmp_path):
    from carelens.sources.tables import ClinicalTables
    t = build().tables(spark)
    t.write_parquet(str(tmp_path))
    stored = ClinicalTables.read_parquet(spark, str(tmp_path))
    df = line_list(spark, stored, LineListParams(end=D(2024, 12, 25), today=D(2025, 1, 1)))
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    obs_scans = [blk for blk in text.split("Scan parquet")[1:] if "/obs]" in blk.split("\n\n")[0]]
    assert obs_scans, "obs is read"
    for blk in obs_scans:
        head = blk.split("\n\n")[0]
        assert "PushedFilters: [" in head and "concept_id" in head.split("PushedFilters:")[1].split("\n")[0]
        # only the needed columns are read
        schema = head.split("ReadSchema:")[1].split("\n")[0]
        assert "value_text" not in schema or "165966" in head


def test_no_join_is_forced_to_broadcast(spark):
    from carelens.operators.dictionary import coded_value_names
    t = build().tables(spark)
    assert "hint" not in coded_value_names(t.obs, t.concept_name)._jdf.queryExecution().analyzed().toString().lower()


def test_null_heavy_encounter_key_is_split(spark):
    """60 % of the observations have no encounter: adaptive execution splits that partition of the join."""
    from pyspark.sql import functions as F

    from carelens.operators.picks import enrich_obs
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.shuffle.partitions": "8",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings if k != "spark.sql.adaptive.autoBroadcastJoinThreshold"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ids = spark.range(0, 60_000, 1, 6)
        obs = ids.select(F.col("id").alias("obs_id"), (F.col("id") % 500).alias("person_id"),
                         F.when(F.col("id") % 10 >= 6, F.col("id") % 4000).alias("encounter_id"),
                         F.lit(856).cast("long").alias("concept_id"), F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'").alias("obs_datetime"),
                         (F.col("id") % 50).alias("value_coded"), F.col("id").cast("double").alias("value_numeric"),
                         F.col("id").cast("string").alias("value_text"), F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'").alias("value_datetime"),
                         F.lit(0).alias("voided"))
        enc = spark.range(4000).select(F.col("id").alias("encounter_id"), F.lit(11).alias("encounter_type"), F.lit(14).alias("form_id"),
                                       F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'").alias("encounter_datetime"), F.lit(0).alias("voided"))
        facts = obs.groupBy("encounter_id").agg(F.max("value_numeric").alias("encounter_refill")).filter("encounter_id IS NOT NULL")
        names = spark.range(50).select(F.col("id").alias("concept_id"), F.lit("n").alias("name"), F.lit("en").alias("locale"),
                                       F.lit(1).alias("locale_preferred"))
        out = enrich_obs(obs, enc, names, [856], [11], [14], facts).groupBy("person_id").agg(F.max("encounter_refill"), F.count("name"))
        assert out.count() == 500
        out.collect()
        assert "SortMergeJoin(skew=true)" in plan_text(out)
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_section_joins_only_what_it_reads(spark, tmp_path):
    from carelens.sources.tables import ClinicalTables
    build().tables(spark).write_parquet(str(tmp_path))
    t = ClinicalTables.read_parquet(spark, str(tmp_path))
    df = line_list(spark, t, LineListParams(end=D(2024, 12, 25), today=D(2025, 1, 1)), section="address_fallback")
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    read = sorted(set(re.findall(r"Location: \w+ \[.*/(\w+)\]", text)))
    assert read == ["encounter", "obs", "patient", "patient_identifier", "person", "person_address"]


def test_unknown_questions_are_an_error():
    import pytest

    from carelens.plans import specs as S
    with pytest.raises(KeyError):
        S.line_list_plan(keep=frozenset({"L"}))
    with pytest.raises(KeyError):
        S.line_list_plan(keep=frozenset({"weight"})).value("height", "value_numeric")


def test_partitioned_layout_prunes_obs_by_concept(spark, tmp_path):
    from carelens.sources.layout import write_clinical
    from carelens.sources.tables import ClinicalTables
    t = build().tables(spark)
    write_clinical(t, str(tmp_path), rows_per_file=10)
    stored = ClinicalTables.read_parquet(spark, str(tmp_path))
    p = LineListParams(end=D(2024, 12, 25), today=D(2025, 1, 1))
    df = line_list(spark, stored, p)
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    obs_scans = [blk.split("\n\n")[0] for blk in text.split("Scan parquet")[1:] if "/obs]" in blk.split("\n\n")[0]]
    assert obs_scans and all("PartitionFilters: [" in b and "concept_id" in b.split("PartitionFilters:")[1].split("\n")[0]
                             for b in obs_scans)
    # same answers as the unpartitioned tables
    want = sorted(map(str, line_list(spark, t, p).collect()))
    assert sorted(map(str, df.collect())) == want


def test_reader_conforms_stored_types(spark, tmp_path):
    from carelens.sources.tables import ClinicalTables
    t = build().tables(spark)
    t.write_parquet(str(tmp_path))
    # rewrite patient with a tinyint flag and without one declared column elsewhere
    spark.createDataFrame([(1, 0)], "patient_id long, voided tinyint").write.mode("overwrite").parquet(
        str(tmp_path / "patient"))
    spark.createDataFrame([(1, 5)], "PATIENT_ID long, program_id int").write.mode("overwrite").parquet(
        str(tmp_path / "patient_program"))
    stored = ClinicalTables.read_parquet(spark, str(tmp_path))
    assert dict(stored.patient.dtypes)["voided"] == "int"
    row = stored.patient_program.first()
    assert row["patient_id"] == 1 and row["date_enrolled"] is None and row["voided"] is None


def test_reader_keeps_undeclared_columns(spark, tmp_path):
    from carelens.sources.tables import ClinicalTables
    t = build().tables(spark)
    t.write_parquet(str(tmp_path))
    spark.createDataFrame([(b"x", 1, "u")], "template binary, patient_id long, uuid string").write.mode("overwrite").parquet(
        str(tmp_path / "biometricinfo"))
    assert ClinicalTables.read_parquet(spark, str(tmp_path)).biometricinfo.columns == ["patient_id", "date_created", "template", "uuid"]


def test_replaced_tables_are_read_anew(spark, tmp_path):
    """A query sees new contents of a table under the same path, also by a file: path."""
    import shutil

    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    for name in ("customer", "orders", "lineitem", "part", "nation", "region", "events"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    query = E.queries()["duplicate_biometrics"]
    first = query(spark, f"file://{tmp_path}").count()
    events = spark.read.parquet(f"{sf}/events.parquet").filter("user_id % 5 = 0")
    (tmp_path / "events.parquet").unlink()
    events.write.parquet(str(tmp_path / "events.parquet"))
    second = query(spark, f"file://{tmp_path}").count()
    assert 0 < second < first


def test_checkpoint_folder_is_required_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from carelens.session import ensure_checkpoint_dir
    conf = SimpleNamespace(get=lambda k, d=None: d, set=lambda k, v: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(cluster)


def _no_broadcast(spark, frame):
    """``frame()`` planned with joins of shuffled rows only, and the plan's text."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = frame()
        return df, plan_text(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_mostly_null_keys_do_not_deal_out_rows(spark):
    """Most best values read no name and most patients no free text: such rows must not meet in one task."""
    t = build().tables(spark)
    for section in (None, "treatment_outcome", "care_entry_point"):
        params = LineListParams(end=D(2024, 12, 25), today=D(2025, 1, 1))
        _, plan = _no_broadcast(spark, lambda: line_list(spark, t, params, section=section))
        assert not re.findall(r"Exchange hashpartitioning\((?:name_rank|care_entry_encounter)#\d+L?, \d+\)", plan)


def test_rows_without_a_key_are_dealt_out_by_another_column(spark):
    from pyspark.sql import functions as F

    from carelens.operators.picks import spread_left_join
    left = spark.range(4000).select(F.col("id").alias("n"), F.expr("IF(id % 10 = 3, id % 7, NULL)").alias("k"))
    right = spark.createDataFrame([(i, f"t{i}") for i in range(5)] + [(2, "again"), (None, "none")], "k long, t string")
    df, _ = _no_broadcast(spark, lambda: spread_left_join(left, right, "k", "n"))
    want = left.join(right, "k", "left").select("n", "k", "t")
    assert sorted(map(str, df.select("n", "k", "t").collect())) == sorted(map(str, want.collect()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(old, ("-1", "false")):
            spark.conf.set(k, v)
        sizes = [r["count"] for r in spread_left_join(left, right, "k", "n").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(sizes) < 2 * sum(sizes) / 4
