"""The queries of the subpackage and their SQL, by name."""

from __future__ import annotations

from imaging_engine.llm import encodings, history, personal, tiling, transducer


def queries() -> dict:
    fs = [personal.p2_found, personal.p2_scrubbed, history.p5_found, history.p5_decisions, transducer.p6_ids, tiling.p7_found, tiling.p7_coverage, encodings.p8_found, encodings.p8_restored]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {"p7_found": tiling.P7_SQL}
