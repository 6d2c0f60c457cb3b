"""Column families chosen by name, and small numeric expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sector_columns(df: DataFrame, prefix: str = "naics") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    left_out = set(skip)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in left_out
    ]


def family(
    df: DataFrame,
    prefix: str | None = None,
    contains: str | None = None,
    numbered: tuple[str, int, int] | None = None,
) -> list[str]:
    """Names that start with, contain, or are ``stem`` plus a number in a range."""
    chosen = []
    for name in df.columns:
        if prefix is not None and name.startswith(prefix):
            chosen.append(name)
        elif contains is not None and contains in name:
            chosen.append(name)
        elif numbered is not None:
            stem, low, high = numbered
            rest = name[len(stem):]
            if name.startswith(stem) and rest.isdigit() and low <= int(rest) <= high:
                chosen.append(name)
    return chosen


def select_family(
    df: DataFrame, first: Iterable[str] = (), drop: Iterable[str] = (), rest: bool = False, **rule
) -> DataFrame:
    """One projection: ``first``, then the family, then (``rest``) all others."""
    order = list(dict.fromkeys([*first, *(family(df, **rule) if rule else [])]))
    if rest:
        order += [c for c in df.columns if c not in order]
    gone = set(drop)
    return df.select(*[F.col(f"`{c}`") for c in order if c not in gone])


def prefix_numbered(df: DataFrame, low: int, high: int, prefix: str = "y") -> DataFrame:
    """Rename columns that are bare numbers in a range, as in ``1996 -> y1996``."""
    return df.withColumnsRenamed({c: prefix + c for c in family(df, numbered=("", low, high))})


def clean_names(df: DataFrame) -> DataFrame:
    """Lower snake case; a leading digit gets an ``x`` in front."""
    renamed = {}
    for name in df.columns:
        tidy = re.sub(r"[^0-9a-z]+", "_", name.lower().replace("%", "percent")).strip("_")
        renamed[name] = "x" + tidy if tidy[:1].isdigit() else tidy
    return df.withColumnsRenamed(renamed)


def ratio_sql(top: str, bottom: str) -> str:
    """SQL text of ``top / bottom`` where x/0 is infinite and 0/0 is missing."""
    top, bottom = f"CAST({top} AS DOUBLE)", f"CAST({bottom} AS DOUBLE)"
    return (
        f"CASE WHEN {bottom} = 0 AND {top} > 0 THEN DOUBLE('Infinity')"
        f" WHEN {bottom} = 0 AND {top} < 0 THEN DOUBLE('-Infinity')"
        f" ELSE try_divide({top}, {bottom}) END"
    )


def ratio(top: str, bottom: str) -> Column:
    """Ratio of two columns given by name, or by SQL expression."""
    return F.expr(ratio_sql(top, bottom))


def total_sql(expression: str) -> str:
    return f"coalesce(sum({expression}), 0)"


def total(column: Column | str) -> Column:
    """Sum that skips missing values and is 0 when there is nothing to add."""
    return F.coalesce(F.sum(column), F.lit(0))


def lookup(code: Column, table: dict, otherwise: Column | None = None) -> Column:
    """Constant dictionary lookup; an unknown code gives ``otherwise`` (default NULL)."""
    chain = F.lit(None) if otherwise is None else otherwise
    for key, value in reversed(table.items()):
        chain = F.when(code == key, F.lit(value)).otherwise(chain)
    return chain
