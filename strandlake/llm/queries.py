"""The queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of the problems and their queries.
QUERIES = {
    "unify": ("p1_forms", "p1_classes", "p1_found"),
    "formatdup": ("p3_records", "p3_found"),
    "encode": ("p6_ids",),
    "langid": ("p4_documents", "p4_segments", "p4_found"),
    "pack": ("p7_containers", "p7_fill"),
    "severity": ("p8_scores", "p8_sources", "p8_found"),
    "pii": ("p2_redacted", "p2_found"),
    "survivor": ("p5_survivors", "p5_found"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, names in QUERIES.items() for name in names}


def oracle_sql() -> dict[str, str]:
    from strandlake.llm import formatdup

    return {"p3_found": formatdup.P3_SQL}
