"""Queries over the test tables, each with the SQL that must give the same rows."""

from checks.registry import COVERS, ORACLE, QUERIES

from checks import texts, sections, tables, retrieval, reports, streams  # noqa: E402,F401  (they register themselves)

__all__ = ["COVERS", "ORACLE", "QUERIES"]
