"""Spark schemas of the clinical tables (inferred from how the reports use them).

All columns are nullable; timestamps are wall-clock ``TIMESTAMP_NTZ``.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, D, TS, F = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.TimestampNTZType(), T.DoubleType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


SCHEMAS: dict[str, T.StructType] = {
    "patient": _schema(("patient_id", L), ("voided", I)),
    "person": _schema(("person_id", L), ("gender", S), ("birthdate", D)),
    "person_name": _schema(("person_id", L), ("preferred", I), ("family_name", S), ("given_name", S)),
    "person_address": _schema(
        ("person_id", L), ("preferred", I), ("address1", S), ("address2", S), ("state_province", S), ("city_village", S)
    ),
    "person_attribute": _schema(("person_id", L), ("person_attribute_type_id", I), ("value", S), ("voided", I)),
    "patient_identifier": _schema(("patient_id", L), ("identifier", S), ("identifier_type", I), ("uuid", S)),
    "encounter": _schema(
        ("encounter_id", L), ("patient_id", L), ("visit_id", L), ("encounter_type", I), ("form_id", I),
        ("provider_id", I), ("location_id", I), ("encounter_datetime", TS), ("date_created", TS), ("voided", I),
    ),
    "visit": _schema(
        ("visit_id", L), ("patient_id", L), ("visit_type_id", I), ("date_started", TS), ("date_stopped", TS),
        ("location_id", I), ("voided", I),
    ),
    "obs": _schema(
        ("obs_id", L), ("person_id", L), ("encounter_id", L), ("concept_id", L), ("obs_datetime", TS),
        ("value_coded", L), ("value_numeric", F), ("value_text", S), ("value_datetime", TS), ("voided", I),
    ),
    "concept_name": _schema(("concept_id", L), ("name", S), ("locale", S), ("locale_preferred", I)),
    "patient_program": _schema(("patient_id", L), ("program_id", I), ("date_enrolled", TS), ("voided", I)),
    "biometricinfo": _schema(("patient_id", L), ("date_created", TS)),
    "biometricverificationinfo": _schema(("patient_id", L), ("date_created", TS), ("recapture_count", I)),
    "global_property": _schema(("property", S), ("property_value", S)),
    "location": _schema(("location_id", I), ("state_province", S)),
    "address_hierarchy_entry": _schema(("user_generated_id", S), ("name", S)),
    # Inputs of the re-aimed correction operators (one row per target instead of a literal id).
    "encounter_corrections": _schema(("visit_id", L), ("bad_datetime", TS), ("new_datetime", TS)),
    "visit_corrections": _schema(("visit_id", L), ("new_start", TS), ("new_stop", TS)),
}

TABLE_NAMES = tuple(n for n in SCHEMAS if not n.endswith("_corrections"))
