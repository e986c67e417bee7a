"""Named queries over the driver's tables and their SQL twins."""

from aerolith.plans import basics, dynamics, extras, series_sql, spectra, streams

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (basics, dynamics, spectra, streams, extras):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
ORACLE_SQL |= series_sql.ORACLE_SQL
