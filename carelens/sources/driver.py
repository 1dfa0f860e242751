"""Adapters from the driver's star-schema tables to the clinical tables.

The driver ships TPC-H-like tables (customer, orders, lineitem, part, nation, region,
events). Reports and checks in this repo run on them through a *concept-coded* mapping:
customers are patients, orders are encounters (and visits), line items are
observations, parts are the concept dictionary and events are biometric captures.
Every mapping is a deterministic column expression over the given tables, read anew by every
query, so the same rows can be rebuilt in another SQL engine for oracle comparisons.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.sources.tables import ClinicalTables

# ---------------------------------------------------------------------------
# Fixed values of the mapping (they must be identical in the oracle SQL).
# ---------------------------------------------------------------------------
# Encounter type and form of an order, chosen by o_orderkey % 7 and % 5.
ENCOUNTER_TYPE_CYCLE = [11, 12, 13, 14, 15, 23, 25]
FORM_CYCLE = [23, 27, 30, 13, 14]
# Concepts recorded in each encounter type; a line item takes list[l_partkey % len]
# (no list of 13: parts divisible by 13 are voided).
CONCEPTS_BY_TYPE = {
    11: [856, 165987, 166422, 5497, 167079, 167088, 166697, 167090, 167082, 164980, 159951],
    12: [5089, 5090, 1342, 5085, 5086, 5356, 1659, 5096, 166256, 166257, 166258, 166259, 166260, 166008],
    13: [165708, 159368, 164506, 164513, 164507, 164514, 165702, 165703, 166148, 165050, 162240, 166276, 166363, 1113],
    14: [166369, 160554, 160540, 165242, 160534, 165839, 165966, 159431],
    15: [165470, 165469, 165889, 166349, 166348, 166347, 166255, 166267, 166272, 166275],
    23: [143264, 140238, 832, 133027, 165967, 166141, 165968, 164852, 166096, 165727, 165975, 165972, 165969, 165986,
         166142, 166143, 166144],
    25: [159599, 1712, 1054, 1542],
}
# Coded answers: a line item with l_suppkey % 3 = 0 answers ANSWER_CODES[(l_suppkey + l_partkey) % 25],
# every other one answers its part key.
ANSWER_CODES = [1, 2, 1679, 159492, 160578, 166285, 166276, 166363, 165681, 165692, 160529, 5622, 160034, 160563,
                165240, 165241, 160546, 5271, 160542, 161629, 165788, 160545, 165838, 160539, 165512]
# Orders with o_orderkey % 10 = 3 fall into one placeholder visit, those with % 50 = 7 into none.
PLACEHOLDER_VISIT = 17  # its bounds are inverted, so all its encounters are findings
# English preferred names of the answers (165692 deliberately has none).
ANSWER_NAMES = {
    1: "Yes", 2: "No", 1679: "Yes", 159492: "Transferred out", 160578: "Female sex worker",
    166285: "Men who have sex with men", 166276: "Community based model", 166363: "Facility based model",
    165681: "TDF-3TC-DTG", 160529: "TB clinic", 5622: "Other", 160034: "Death",
    160563: "Transferred in", 165240: "TRANSFER IN ", 165241: "Transfer in with records", 160546: "STI clinic",
    5271: "Family planning", 160542: "Outpatient", 161629: "Ward", 165788: "Blood bank", 160545: "Outreach",
    165838: "Standalone", 160539: "VCT centre", 165512: "PMTCT",
}
REPORT_DAY = dt.date(1999, 6, 30)
TODAY = dt.date(2001, 1, 1)
BIRTH_BASE = dt.date(1950, 1, 1)
PROGRAM_BASE = dt.datetime(1998, 1, 1)

DRIVER_TABLES = ("customer", "orders", "lineitem", "part", "nation", "region", "events")


def read_driver(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in names}


def _cycle(values: list[int], key: Column) -> Column:
    """values[key % len(values)] via a literal array (folded to a constant by the optimizer)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % F.lit(len(values))).cast("int") + 1)


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("int")


def encounter_type_of(orderkey: Column) -> Column:
    return _cycle(ENCOUNTER_TYPE_CYCLE, orderkey).cast("int")


def form_of(orderkey: Column) -> Column:
    return _cycle(FORM_CYCLE, orderkey).cast("int")


def concept_of(orderkey: Column, partkey: Column) -> Column:
    """CONCEPTS_BY_TYPE[type of the order][partkey % len] as two literal-array lookups."""
    lists = [CONCEPTS_BY_TYPE[t] for t in ENCOUNTER_TYPE_CYCLE]
    by_type = F.array(*[F.array(*[F.lit(c) for c in cs]) for cs in lists])
    sizes = F.array(*[F.lit(len(cs)) for cs in lists])
    t = (orderkey % F.lit(len(lists))).cast("int") + 1
    slot = (partkey % F.element_at(sizes, t)).cast("int") + 1
    return F.element_at(F.element_at(by_type, t), slot).cast("long")


def answer_of(partkey: Column, suppkey: Column) -> Column:
    return F.when(suppkey % 3 == 0, _cycle(ANSWER_CODES, suppkey + partkey)).otherwise(partkey).cast("long")


def visit_of() -> Column:
    """Visit of an order: one per customer and year, but for the placeholder and the orders of none."""
    return F.expr(f"CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 10 = 3 THEN {PLACEHOLDER_VISIT}L "
                  "ELSE o_custkey * 10000 + year(o_orderdate) END")


def build_encounter(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("encounter_id"),
        F.col("o_custkey").alias("patient_id"),
        visit_of().alias("visit_id"),
        encounter_type_of(k).alias("encounter_type"),
        form_of(k).alias("form_id"),
        (k % 5 + 1).cast("int").alias("provider_id"),
        F.lit(8).cast("int").alias("location_id"),
        F.expr("timestampadd(MICROSECOND, o_orderkey * 7919 % 1000000, timestampadd(HOUR, o_orderkey % 24, o_orderdate))")
        .alias("encounter_datetime"),
        F.col("o_orderdate").alias("date_created"),
        _flag(k % 11 == 0).alias("voided"),
        # columns that no report declares; corrections and backups carry them along
        F.concat(F.lit("enc-"), k.cast("string")).alias("uuid"),
        F.col("o_orderpriority").alias("creator"),
    )


def build_obs(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate",
                         "l_returnflag", "l_linestatus")
    od = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    j = li.join(od, "l_orderkey")
    obs_id = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
    return j.select(
        obs_id.cast("long").alias("obs_id"),
        F.col("o_custkey").alias("person_id"),
        F.when(F.col("l_orderkey") % 29 != 5, F.col("l_orderkey")).alias("encounter_id"),
        concept_of(F.col("l_orderkey"), F.col("l_partkey")).alias("concept_id"),
        F.col("l_shipdate").alias("obs_datetime"),
        answer_of(F.col("l_partkey"), F.col("l_suppkey")).alias("value_coded"),
        F.col("l_quantity").alias("value_numeric"),
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("value_text"),
        F.expr("timestampadd(DAY, l_linenumber, l_shipdate)").alias("value_datetime"),
        _flag(F.col("l_partkey") % 13 == 0).alias("voided"),
    )


def build_concept_name(spark: SparkSession, part: DataFrame) -> DataFrame:
    answer_keys = list(ANSWER_CODES)
    base = part.filter((F.col("p_partkey") % 10 != 0) & ~F.col("p_partkey").isin(answer_keys))
    # the server's comparison ignores case and trailing blanks, so these are all English
    english = base.select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"),
                          F.when(F.col("p_partkey") % 7 == 3, "EN ").otherwise("en").alias("locale"), F.lit(1).alias("locale_preferred"))
    french = base.filter(F.col("p_partkey") % 7 == 0).select(
        F.col("p_partkey").alias("concept_id"), F.concat(F.lit("fr:"), F.col("p_name")).alias("name"),
        F.lit("fr").alias("locale"), F.lit(1).alias("locale_preferred"))
    synonym = base.filter(F.col("p_partkey") % 9 == 0).select(
        F.col("p_partkey").alias("concept_id"), F.concat(F.lit("alt:"), F.col("p_name")).alias("name"),
        F.lit("en").alias("locale"), F.lit(0).alias("locale_preferred"))
    answers = spark.createDataFrame(
        [(int(k), v, "en", 1) for k, v in ANSWER_NAMES.items()],
        "concept_id long, name string, locale string, locale_preferred int",
    )
    return english.unionByName(french).unionByName(synonym).unionByName(answers).select(
        F.col("concept_id").cast("long"), "name", "locale", F.col("locale_preferred").cast("int"))


def build_visit(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One row per visit of any order, from its first to its last shipping day."""
    o = orders.select("o_orderkey", "o_custkey", visit_of().alias("visit_id")).filter("visit_id IS NOT NULL")
    j = o.join(lineitem.select("l_orderkey", "l_shipdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    v = j.groupBy("visit_id").agg(F.min("o_custkey").alias("patient_id"), F.min("l_shipdate").alias("lo"),
                                  F.max("l_shipdate").alias("hi"))
    k = F.col("visit_id")
    inverted = k % 17 == 0
    return v.select(
        "visit_id", F.when(k % 101 != 50, F.col("patient_id")).alias("patient_id"),
        (k % 3 + 1).cast("int").alias("visit_type_id"),
        F.when(inverted, F.col("hi")).otherwise(F.col("lo")).alias("date_started"),
        F.when(k % 13 == 0, F.lit(None)).when(inverted, F.col("lo"))
        .otherwise(F.expr("timestampadd(SECOND, 86399, hi)")).alias("date_stopped"),
        F.lit(8).cast("int").alias("location_id"),
        _flag(k % 19 == 0).alias("voided"),
        F.concat(F.lit("vis-"), k.cast("string")).alias("uuid"),
    )


def build_tables(spark: SparkSession, sf_dir: str) -> ClinicalTables:
    """All clinical tables from one driver directory (lazy; nothing is read yet)."""
    d = read_driver(spark, sf_dir)
    c, o, li = d["customer"], d["orders"], d["lineitem"]
    ck = F.col("c_custkey")
    patient = c.select(ck.alias("patient_id"), _flag(ck % 50 == 0).alias("voided"))
    person = c.select(
        ck.alias("person_id"),
        F.when(ck % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
        F.when(ck % 89 == 0, F.lit(None).cast("date"))
        .otherwise(F.date_add(F.lit(BIRTH_BASE), ((ck * 37) % 20000).cast("int"))).alias("birthdate"),
    )
    person_name = c.select(ck.alias("person_id"), F.lit(1).alias("preferred"),
                           F.col("c_name").alias("family_name"), F.col("c_mktsegment").alias("given_name")).unionByName(
        c.filter(ck % 4 == 0).select(ck.alias("person_id"), F.lit(0).alias("preferred"),
                                     F.concat(F.lit("Old "), F.col("c_name")).alias("family_name"),
                                     F.col("c_mktsegment").alias("given_name")))
    person_address = c.select(
        ck.alias("person_id"), F.lit(1).alias("preferred"),
        F.concat(F.lit("Plot "), F.col("c_nationkey").cast("string")).alias("address1"),
        F.when(ck % 3 == 0, F.lit(None).cast("string")).when(ck % 3 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("Block "), ck.cast("string"))).alias("address2"),
        F.concat(F.lit("State "), (F.col("c_nationkey") % 5).cast("string")).alias("state_province"),
        F.concat(F.lit("LGA "), F.col("c_nationkey").cast("string")).alias("city_village"),
    )
    person_attribute = c.select(ck.alias("person_id"), F.lit(8).alias("person_attribute_type_id"),
                                F.concat(F.lit("080"), ck.cast("string")).alias("value"),
                                _flag(ck % 23 == 0).alias("voided"))
    ident4 = c.filter(ck % 41 != 0).select(ck.alias("patient_id"), F.concat(F.lit("PEP"), ck.cast("string")).alias("identifier"),
                                           F.lit(4).alias("identifier_type"),
                                           F.concat(F.lit("u-"), ck.cast("string")).alias("uuid"))
    ident4b = c.filter(ck % 97 == 5).select(ck.alias("patient_id"), F.concat(F.lit("PEPB"), ck.cast("string")).alias("identifier"),
                                            F.lit(4).alias("identifier_type"),
                                            F.concat(F.lit("v-"), ck.cast("string")).alias("uuid"))
    ident5 = c.filter(ck % 3 != 0).select(ck.alias("patient_id"), F.concat(F.lit("HN"), ck.cast("string")).alias("identifier"),
                                          F.lit(5).alias("identifier_type"),
                                          F.concat(F.lit("h-"), ck.cast("string")).alias("uuid"))
    patient_identifier = ident4.unionByName(ident4b).unionByName(ident5).withColumn(
        "identifier_type", F.col("identifier_type").cast("int"))
    patient_program = c.filter(ck % 4 == 1).select(
        ck.alias("patient_id"), F.lit(5).cast("int").alias("program_id"),
        F.expr(f"timestampadd(DAY, CAST(c_custkey % 365 AS INT), TIMESTAMP_NTZ '{PROGRAM_BASE:%Y-%m-%d %H:%M:%S}')").alias("date_enrolled"),
        F.lit(0).cast("int").alias("voided"))
    ev = d["events"]
    biometricinfo = ev.filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("patient_id"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("date_created"),
        F.concat(F.lit("tpl-"), F.col("event_id").cast("string")).alias("template"), F.col("value").alias("quality"))
    biometricverificationinfo = ev.filter(F.col("event_type") == "view").select(
        F.col("user_id").alias("patient_id"), F.col("ts").alias("date_created"),
        F.get_json_object("props", "$.k").cast("int").alias("recapture_count"),
        F.concat(F.lit("ver-"), F.col("event_id").cast("string")).alias("template"))
    n, r = d["nation"], d["region"]
    # the facility's settings, derived from the whole nation table (one row of aggregates)
    site = n.groupBy().agg(F.min("n_regionkey").alias("rk"), F.count(F.lit(1)).alias("cnt"),
                           F.min("n_name").alias("nm"))
    global_property = site.select(
        F.explode(F.array(
            F.struct(F.lit("partner_reporting_lga_code").alias("property"),
                     F.concat(F.lit("LGA-"), F.col("rk").cast("string")).alias("property_value")),
            F.struct(F.lit("Facility_Datim_Code").alias("property"),
                     F.concat(F.lit("DATIM-"), F.col("cnt").cast("string")).alias("property_value")),
            F.struct(F.lit("FACILITY_name ").alias("property"), F.col("nm").alias("property_value")),
        )).alias("p")).select("p.property", "p.property_value")
    location = r.select((F.col("r_regionkey") + 8).cast("int").alias("location_id"), F.col("r_name").alias("state_province"))
    address_hierarchy_entry = n.select(F.concat(F.lit("lga-"), F.col("n_regionkey").cast("string"), F.lit(" ")).alias("user_generated_id"),
                                       F.col("n_name").alias("name"))
    return ClinicalTables(
        patient=patient, person=person, person_name=person_name, person_address=person_address,
        person_attribute=person_attribute, patient_identifier=patient_identifier,
        encounter=build_encounter(o), visit=build_visit(o, li), obs=build_obs(li, o),
        concept_name=build_concept_name(spark, d["part"]), patient_program=patient_program,
        biometricinfo=biometricinfo, biometricverificationinfo=biometricverificationinfo,
        global_property=global_property, location=location, address_hierarchy_entry=address_hierarchy_entry,
    )
