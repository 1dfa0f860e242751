"""Runs of several written tables that can be taken up again where they failed.

A run is a folder. Each of its steps is a table; once a table is whole, a one-row entry with its name,
schema and place is written to the run's manifest. A step without an entry counts as not done,
whatever a failed job has left at its place, and is written anew. The first entry (``inputs``) holds
digests of all that the run was given: a run id that was begun with one input is refused for
another.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens.operators.fingerprints import table_digest

ENTRY = "step string, path string, schema string, note string"


class RunIdTaken(AnalysisException):
    """A run id was used before for another input."""


class Run:
    """The folder ``<root>/<run_id>`` and its manifest."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.id = spark, run_id
        self.path = f"{root.rstrip('/')}/{run_id}"

    def _entry_path(self, step: str) -> str:
        return f"{self.path}/_manifest/{step}"

    def entry(self, step: str):
        """The manifest row of a step, or None while the step is not done."""
        try:
            rows = self.spark.read.schema(ENTRY).parquet(self._entry_path(step)).take(1)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition()):
                raise
            return None
        return rows[0] if rows else None

    def _record(self, step: str, path: str, schema: str, note: str) -> None:
        # A failed write of the entry itself leaves a folder without rows, which is written over.
        row = self.spark.createDataFrame([(step, path, schema, note)], ENTRY)
        row.coalesce(1).write.mode("overwrite").parquet(self._entry_path(step))

    def _read(self, entry) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        return self.spark.read.schema(schema).parquet(entry["path"])

    def step(self, name: str, make: Callable[[], DataFrame], path: str | None = None, again: bool = False) -> DataFrame:
        """The table of a step: as stored if the manifest has it (and not ``again``), else made and written now."""
        entry = None if again else self.entry(name)
        if entry is None:
            path = path or f"{self.path}/{name}"
            df = make()
            df.write.mode("overwrite").parquet(path)
            self._record(name, path, df.schema.json(), "")
            entry = self.entry(name)
        return self._read(entry)

    def prepare(self, given: dict[str, DataFrame], stored: dict[str, Callable[[dict], DataFrame]],
                digests: Callable[[dict, bool], dict[str, str]], note: str = "") -> tuple[dict[str, DataFrame], str]:
        """Store the ``stored`` tables and claim the run id for its inputs; (the stored tables, the note of the first claim).

        ``given``: the small inputs (requests), written once so that later steps do not compute them again.
        ``digests`` gets the stored tables, and whether they have just been made, and says by name what identifies the
        large inputs. A run begun before must have had the same of all, else RunIdTaken is raised.
        """
        claimed = self.entry("inputs")
        if claimed is not None:
            known = json.loads(claimed["note"])
            own = {k: table_digest(df) for k, df in given.items()}
            tables = {k: self._read(self.entry(k)) for k in [*given, *stored]}
            own |= digests(tables, False)
            if own != known["digests"]:
                differing = sorted(k for k in own | known["digests"] if own.get(k) != known["digests"].get(k))
                raise RunIdTaken(f"run id {self.id!r} was used for another input: {', '.join(differing)} differ")
            return tables, known["note"]
        # Not claimed: whatever an earlier try has stored may come from another input.
        tables = {k: self.step(k, lambda df=df: df, again=True) for k, df in given.items()}
        own = {k: table_digest(df) for k, df in tables.items()}
        for k, make in stored.items():
            tables[k] = self.step(k, lambda make=make: make(tables), again=True)
        own |= digests(tables, True)
        self._record("inputs", self.path, "", json.dumps({"digests": own, "note": note}))
        return tables, note

    def steps(self) -> DataFrame:
        """step, path of all finished steps."""
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/_manifest/*").select("step", "path").filter(F.col("step") != "inputs")
