"""Every registered query, with the DuckDB text that must give the same rows."""

from __future__ import annotations

from tessera.plans import analysis, coding, colour, numeric, quantisation, rates, scans, streams

QUERIES = colour.QUERIES | quantisation.QUERIES | coding.QUERIES | analysis.QUERIES | rates.QUERIES | scans.QUERIES | numeric.QUERIES | streams.QUERIES
ORACLE_SQL = colour.ORACLE_SQL | quantisation.ORACLE_SQL | coding.ORACLE_SQL | analysis.ORACLE_SQL | rates.ORACLE_SQL | scans.ORACLE_SQL | numeric.ORACLE_SQL | streams.ORACLE_SQL

