"""Per-patient reductions of the identity, programme, biometric and site tables.

Each function returns at most one row per patient (or per patient and identifier), so
the report can left-join them without fan-out. Where the source report let the server
pick an arbitrary row (a loose GROUP BY), a deterministic rule is used and named here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions.text import text_is, text_key


def active_patients(patient: DataFrame, person: DataFrame) -> DataFrame:
    """Non-voided patients that have a person row: (patient_id, gender, birthdate)."""
    p = patient.filter(F.col("voided") == 0).select("patient_id")
    people = person.select(F.col("person_id").alias("patient_id"), "gender", "birthdate")
    return p.join(people, "patient_id")


def identifier_rows(patient_identifier: DataFrame, identifier_type: int) -> DataFrame:
    """One row per (patient, identifier of the type); texts that differ in case or trailing blanks are one identifier.

    identifier and uuid are the smallest stored ones.
    """
    return (
        patient_identifier.filter(F.col("identifier_type") == identifier_type)
        .groupBy("patient_id", text_key(F.col("identifier")).alias("_key"))
        .agg(F.min("identifier").alias("identifier"), F.min("uuid").alias("uuid"))
        .drop("_key")
    )


def first_identifier(patient_identifier: DataFrame, identifier_type: int, alias: str) -> DataFrame:
    """Smallest identifier of a type per patient."""
    return (
        patient_identifier.filter(F.col("identifier_type") == identifier_type)
        .groupBy("patient_id")
        .agg(F.min("identifier").alias(alias))
    )


def preferred_name(person_name: DataFrame) -> DataFrame:
    """Preferred name per person (smallest (family, given) pair if several are preferred)."""
    best = (
        person_name.filter(F.col("preferred") == 1)
        .groupBy(F.col("person_id").alias("patient_id"))
        .agg(F.min(F.struct("family_name", "given_name")).alias("n"))
    )
    return best.select("patient_id", F.col("n.family_name").alias("family_name"), F.col("n.given_name").alias("given_name"))


def preferred_address(person_address: DataFrame) -> DataFrame:
    """Preferred address per person (smallest row if several are preferred)."""
    best = (
        person_address.filter(F.col("preferred") == 1)
        .groupBy(F.col("person_id").alias("patient_id"))
        .agg(F.min(F.struct("address1", "address2", "state_province", "city_village")).alias("a"))
    )
    return best.select("patient_id", *[F.col(f"a.{c}").alias(c) for c in
                                       ("address1", "address2", "state_province", "city_village")])


def attribute_value(person_attribute: DataFrame, attribute_type: int, alias: str) -> DataFrame:
    """Smallest non-voided value of a person attribute type."""
    return (
        person_attribute.filter((F.col("person_attribute_type_id") == attribute_type) & (F.col("voided") == 0))
        .groupBy(F.col("person_id").alias("patient_id"))
        .agg(F.min("value").alias(alias))
    )


def program_enrolment(patient_program: DataFrame, program_id: int, alias: str) -> DataFrame:
    """Earliest non-voided enrolment into a programme."""
    return (
        patient_program.filter((F.col("program_id") == program_id) & (F.col("voided") == 0))
        .groupBy("patient_id")
        .agg(F.min("date_enrolled").alias(alias))
    )


def biometric_capture(biometricinfo: DataFrame) -> DataFrame:
    """Capture status per patient: that a row exists, and the earliest capture time (may be NULL)."""
    return biometricinfo.groupBy("patient_id").agg(F.lit(1).alias("captured"), F.min("date_created").alias("capture_at"))


def biometric_recapture(biometricverificationinfo: DataFrame) -> DataFrame:
    """Latest verification per patient and the recapture count recorded with it."""
    best = biometricverificationinfo.groupBy("patient_id").agg(
        F.max(F.struct("date_created", "recapture_count")).alias("r"))
    return best.select("patient_id", F.col("r.date_created").alias("recapture_at"),
                       F.col("r.recapture_count").alias("recapture_count"))


def site_config(global_property: DataFrame, location: DataFrame, address_hierarchy_entry: DataFrame,
                location_id: int = 8, lga_property: str = "partner_reporting_lga_code",
                datim_property: str = "Facility_Datim_Code", name_property: str = "Facility_Name") -> DataFrame:
    """The report's site header as exactly one row (global aggregates always return one row)."""
    gp = global_property.groupBy().agg(
        F.min(F.when(text_is(F.col("property"), lga_property), F.col("property_value"))).alias("lga_code"),
        F.min(F.when(text_is(F.col("property"), datim_property), F.col("property_value"))).alias("Datim_Code"),
        F.min(F.when(text_is(F.col("property"), name_property), F.col("property_value"))).alias("FacilityName"),
    )
    state = location.filter(F.col("location_id") == location_id).groupBy().agg(F.min("state_province").alias("State"))
    # The hierarchy can be large: keep only entries of the configured code (semi join
    # against the one-row property frame), then reduce them to one row.
    lga = (
        address_hierarchy_entry.join(F.broadcast(gp.select("lga_code")),
                                     text_key(F.col("user_generated_id")) == text_key(F.col("lga_code")), "left_semi")
        .groupBy().agg(F.min("name").alias("LGA"))
    )
    # one-row aggregates as scalar subqueries of the one-row property frame
    return gp.select(state.scalar().alias("State"), lga.scalar().alias("LGA"), "Datim_Code", "FacilityName")
