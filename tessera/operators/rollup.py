"""Roll-ups to a coarser level and grouped totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.columns import numeric_columns, ratio, total_sql
from tessera.functions.keys import level_key
from tessera.operators.joins import members


def rollup(
    df: DataFrame,
    key: str,
    level: str,
    by: Sequence[str] = ("year",),
    measures: Sequence[str] | None = None,
    out: str | None = None,
    widths: Mapping[str, int] = fv.KEY_LEVELS,
) -> DataFrame:
    """Sum every numeric column over the places inside each ``level`` place.

    The sums combine on the map side, so a place with very many members costs no
    more in the shuffle than any other.
    """
    by, out = list(by), out or level
    summed = list(measures) if measures is not None else numeric_columns(df, by)
    return df.groupBy(level_key(F.col(key), level, widths).alias(out), *by).agg(
        *[F.expr(f"{total_sql(c)} AS {c}") for c in summed]
    )


def grouped_totals(df: DataFrame, by: Sequence[str], **named: str) -> DataFrame:
    """Grouped sums under new names: ``grouped_totals(df, ["year"], jobs="job_tot")``."""
    return df.groupBy(*by).agg(*[F.expr(f"{total_sql(c)} AS {name}") for name, c in named.items()])


def member_totals(
    df: DataFrame, key: str, counties: DataFrame, by: Sequence[str], widths: Mapping[str, int] = fv.KEY_LEVELS, **named: str
) -> DataFrame:
    """Grouped sums over the places whose county is listed."""
    keyed = df.withColumn("stcofips", level_key(F.col(key), "county", widths))
    return grouped_totals(members(keyed, "stcofips", counties), by, **named)


def flagged_share(df: DataFrame, measure: str, by: Sequence[str], **flags: str) -> DataFrame:
    """Share of a measure held by flagged rows, one column per flag (SQL conditions)."""
    return df.groupBy(*by).agg(
        *[
            ratio(total_sql(f"CASE WHEN {flag} THEN {measure} END"), f"sum({measure})").alias(name)
            for name, flag in flags.items()
        ]
    )


def level_density(
    df: DataFrame, key: str, level: str, measure: str, area: str, by=("year",), widths: Mapping[str, int] = fv.KEY_LEVELS,
    out: str = "jobs_sqmi",
) -> DataFrame:
    """Roll up measure and area, then their ratio as ``out``, at a coarser level."""
    rolled = rollup(df, key, level, by, [measure, area], widths=widths)
    return rolled.withColumn(out, ratio(measure, area))


def total_row(df: DataFrame, label: str, text: str = "Total") -> DataFrame:
    """Append the grand total over every numeric column; other text is NULL.

    ``label`` has to be different in every row.  Rows and total come out of one
    aggregation, so the input is computed once.
    """
    numbers = set(numeric_columns(df))
    others = [c for c in df.columns if c != label]
    sums = [
        F.expr(
            f"CASE WHEN grouping({label}) = 1 THEN {total_sql(f'`{c}`')} ELSE max(`{c}`) END AS `{c}`"
            if c in numbers
            else f"CASE WHEN grouping({label}) = 0 THEN max(`{c}`) END AS `{c}`"
        )
        for c in others
    ]
    sets = df.groupingSets([[F.col(label)], []], F.col(label))
    rows = sets.agg(F.expr(f"grouping({label}) AS _all"), *sums)
    named = rows.withColumn(label, F.expr(f"CASE WHEN _all = 1 THEN '{text}' ELSE {label} END"))
    return named.select(*df.columns)
