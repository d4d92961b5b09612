"""Queries by name, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from . import lexical, reports, texts

QUERIES = {**texts.QUERIES, **lexical.QUERIES, **reports.QUERIES}
ORACLE_SQL = {**texts.ORACLE_SQL, **lexical.ORACLE_SQL, **reports.ORACLE_SQL}
