"""The queries of the core and their SQL, by name."""

from __future__ import annotations

from imaging_engine.functions import deid, imaging, text
from imaging_engine.operators import compact, compare, pivot, ready_files, skew, templates, volume
from imaging_engine.plans import pipelines
from imaging_engine.sources import dicom, files
from imaging_engine.streaming import ingest

MODULES = [skew, pivot, compact, ready_files, compare, deid, imaging, volume, text, templates, dicom, files, ingest, pipelines]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in getattr(m, "SQL", {}).items()}
