"""DuckDB SQL that gives the same rows as each named query, over the same tables."""

from oracles.sql import oracle_sql

__all__ = ["oracle_sql"]
