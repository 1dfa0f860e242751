"""A bundle of clinical DataFrames and Parquet loaders for it."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from carelens.sources.schemas import SCHEMAS, TABLE_NAMES


@dataclass(frozen=True)
class ClinicalTables:
    """The clinical tables a report or correction reads. Every field is a lazy DataFrame."""

    patient: DataFrame
    person: DataFrame
    person_name: DataFrame
    person_address: DataFrame
    person_attribute: DataFrame
    patient_identifier: DataFrame
    encounter: DataFrame
    visit: DataFrame
    obs: DataFrame
    concept_name: DataFrame
    patient_program: DataFrame
    biometricinfo: DataFrame
    biometricverificationinfo: DataFrame
    global_property: DataFrame
    location: DataFrame
    address_hierarchy_entry: DataFrame

    def with_tables(self, **changes: DataFrame) -> "ClinicalTables":
        return replace(self, **changes)

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @classmethod
    def read_parquet(cls, spark: SparkSession, root: str) -> "ClinicalTables":
        """Read ``root/<table>`` Parquet datasets and conform them to the declared schemas.

        Columns are read as stored and cast to the declared type (e.g. a UTC-adjusted
        timestamp becomes wall-clock time in the session zone, a tinyint flag an int); a
        declared column the files lack is NULL. Casts to the stored type are no-ops, so
        filters still reach the Parquet reader.
        """
        frames = {}
        for name in TABLE_NAMES:
            frames[name] = conform(spark.read.parquet(f"{root.rstrip('/')}/{name}"), name)
        return cls(**frames)

    def write_parquet(self, root: str, mode: str = "overwrite") -> None:
        for name, df in self.as_dict().items():
            df.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the declared columns of table ``name`` in order and type, then all other
    columns as they are (whole rows reach backups and corrections; reports read what they need)."""
    have = {c.lower(): c for c in df.columns}
    exprs = []
    for f in SCHEMAS[name].fields:
        src = have.pop(f.name.lower(), None)
        exprs.append(f"CAST({'`' + src + '`' if src else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`")
    return df.selectExpr(*exprs, *[f"`{c}`" for c in df.columns if have.get(c.lower()) == c])


def empty_frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def tables_from_rows(spark: SparkSession, **rows: list) -> ClinicalTables:
    """Small in-memory tables (tests and examples); missing tables are empty."""
    frames = {}
    for name in TABLE_NAMES:
        data = rows.get(name, [])
        frames[name] = spark.createDataFrame(data, SCHEMAS[name])
    return ClinicalTables(**frames)
