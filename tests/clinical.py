"""Tiny hand-written clinical tables for rule tests."""

from __future__ import annotations

import datetime as dt

from carelens.sources.tables import tables_from_rows

D = dt.date
T = dt.datetime


class Rows:
    """Collects rows per table; ids are assigned in insertion order unless given."""

    def __init__(self):
        self.t = {n: [] for n in (
            "patient", "person", "person_name", "person_address", "person_attribute", "patient_identifier",
            "encounter", "visit", "obs", "concept_name", "patient_program", "biometricinfo",
            "biometricverificationinfo", "global_property", "location", "address_hierarchy_entry")}
        self._enc = 1000
        self._obs = 100000

    def patient(self, pid, birthdate=D(1990, 1, 1), gender="F", voided=0, pepids=("PEP{}",), gate=True):
        self.t["patient"].append((pid, voided))
        self.t["person"].append((pid, gender, birthdate))
        for i, p in enumerate(pepids):
            self.t["patient_identifier"].append((pid, p.format(pid), 4, f"uuid-{pid}-{i}"))
        if gate:
            self.encounter(pid, 14, 23, T(2020, 1, 1))
        return pid

    def encounter(self, pid, etype, form, at, voided=0, eid=None, visit_id=None):
        if eid is None:
            self._enc += 1
            eid = self._enc
        self.t["encounter"].append((eid, pid, visit_id, etype, form, 1, 8, at, at, voided))
        return eid

    def obs(self, pid, concept, at, eid=None, coded=None, num=None, text=None, vdt=None, voided=0, oid=None):
        if oid is None:
            self._obs += 1
            oid = self._obs
        self.t["obs"].append((oid, pid, eid, concept, at, coded, num, text, vdt, voided))
        return oid

    def name(self, code, name, locale="en", preferred=1):
        self.t["concept_name"].append((code, name, locale, preferred))

    def tables(self, spark):
        return tables_from_rows(spark, **self.t)
