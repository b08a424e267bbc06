"""The registered queries over the driver's tables, and the same queries as DuckDB SQL."""

from . import audits, continuous, controls, ranking, rest, scalars, sequences, signals, stores, tables

_PARTS = (ranking, tables, sequences, scalars, audits, stores, rest, signals, controls, continuous)
QUERIES: dict = {k: v for m in _PARTS for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _PARTS for k, v in m.ORACLE_SQL.items()}
