"""Run a query on Spark and its oracle on DuckDB, and compare the rows."""

from __future__ import annotations

import contextlib
import io
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isinf(value) or math.isnan(value):
            return str(value)
        return repr(value)
    return repr(value)


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(row[i]) for i in order) for row in rows)


KINDS = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def differences(df, con, sql, limit: int = 5) -> list[str]:
    """Empty when column names, types and all rows agree."""
    found = []
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    for field in df.schema.fields:
        kind = KINDS.get(field.dataType.simpleString(), field.dataType.simpleString())
        if field.name in types and types[field.name] != kind:
            found.append(f"type of {field.name}: {kind} / {types[field.name]}")
    left_names, left = canonical(df.columns, [tuple(r) for r in df.collect()])
    right_names, right = canonical(names, result.fetchall())
    if left_names != right_names:
        return [*found, f"columns {left_names} / {right_names}"]
    if len(left) != len(right):
        found.append(f"rows {len(left)} / {len(right)}")
    if left != right:
        a, b = set(left), set(right)
        found += [f"only spark: {x}" for x in sorted(a - b)[:limit]]
        found += [f"only duckdb: {x}" for x in sorted(b - a)[:limit]]
    if not left:
        found.append("no rows")
    return found


# Nodes that pair rows without a key, or that leave the JVM.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow")


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def unwanted_nodes(df) -> list[str]:
    plan = plan_of(df)
    return [node for node in UNWANTED if node in plan]
