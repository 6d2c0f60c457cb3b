"""Cluster categories under a grid of density cuts and minimum shares.

Two ways lead to the same numbers.  Row by row, ``categories_long`` and
``cluster_flags`` write out every place once per definition.  For summaries,
``cluster_profile`` sums the places by (category, minimums exceeded) first, and
``expand_definitions`` applies the definitions to that small table, so the grid
never multiplies the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.columns import total, total_sql


# Tiles of 20 below 17, and a missing tile, are "low density" under the two finer cuts.
FINE_CUT = """CASE WHEN dense_cat_20 < 17 OR dense_cat_20 IS NULL THEN 'low density'
    WHEN dense_cat_20 = 17 THEN 'p80' WHEN dense_cat_20 = 18 THEN 'p85'"""

CATEGORIES = {
    "mapvar_20": f"{FINE_CUT} WHEN dense_cat_20 = 19 THEN 'p90' WHEN dense_cat_20 = 20 THEN 'cluster' END",
    "mapvar_10": f"{FINE_CUT} WHEN dense_cat_10 = 10 THEN 'cluster' END",
    "mapvar_5": """CASE WHEN dense_cat_20 >= 17 THEN 'cluster'
        WHEN dense_cat_20 < 17 THEN 'low density' END""",
}


def map_categories(df: DataFrame) -> DataFrame:
    """Category of a place under each cut, from its tiles of 20 and of 10."""
    return df.withColumns({cut: F.expr(rule) for cut, rule in CATEGORIES.items()})


def categories_long(df: DataFrame) -> DataFrame:
    """One row per place and cut; tile columns dropped."""
    dropped = [c for c in df.columns if "dense_cat" in c or "most_dense" in c]
    wide = df.drop(*dropped)
    ids = [c for c in wide.columns if c not in fv.CUT_COLUMNS]
    return wide.unpivot(ids, list(fv.CUT_COLUMNS), "num_quant", "mapvar")


def named_minimum(share: float) -> tuple[str, float]:
    """Name and factor of a minimum share; an unknown share acts as zero."""
    return fv.MINIMUM_SHARES.get(float(share), fv.MINIMUM_SHARES[0.0])


def grid_minimum(share: float) -> tuple[str, float]:
    """Name and factor of a share in a grid, percent of the metro's count: any number is itself."""
    return fv.MINIMUM_SHARES.get(float(share), (f"pp_{float(share):g}".replace(".", "_"), float(share) / 100))


def minimum_grid(minimums: Sequence[float]) -> Column:
    """Array of (share, name, factor) rows."""
    rows = ", ".join(
        "named_struct('share', {}D, 'name', '{}', 'factor', {}D)".format(float(m), *grid_minimum(m))
        for m in minimums
    )
    return F.expr(f"array({rows})")


def metro_minimums(
    df: DataFrame, measure: str = "job_tot", minimums: Sequence[float] = tuple(fv.MINIMUM_SHARES)
) -> DataFrame:
    """Minimum count per metro, year and minimum share, from one row per place."""
    totals = df.groupBy("cbsa", "cbsa_name", "year").agg(total(measure).alias(measure))
    grid = totals.withColumn("_m", F.explode(minimum_grid(minimums)))
    return grid.select(
        "cbsa",
        "cbsa_name",
        "year",
        measure,
        F.col("_m.name").alias("pp_min"),
        (F.col(measure) * F.col("_m.factor")).alias("job_min"),
    )


def minimums_lookup(
    met_jobs: DataFrame, share: float, cbsa: str | None = None, year: int | None = None
) -> DataFrame:
    """Rows of one minimum share, for all metros or one metro and year."""
    name = named_minimum(share)[0]
    found = met_jobs.filter(F.col("pp_min") == name)
    if cbsa is not None:
        found = found.filter(F.col("cbsa") == cbsa)
    if year is not None:
        found = found.filter(F.col("year") == year)
    return found.select("cbsa", "year", "job_min")


def apply_minimum_sql(category: str, measure: str, minimum: str) -> str:
    """A cluster at or under the minimum is only dense; other categories stay."""
    return (
        f"CASE WHEN {category} = 'cluster' AND {measure} > {minimum} THEN 'cluster'"
        f" WHEN {category} = 'cluster' AND {measure} <= {minimum} THEN 'high density'"
        f" WHEN {category} <> 'cluster' THEN {category} END"
    )


def cluster_flags(
    long: DataFrame,
    minimums: Sequence[float] = fv.NATIONAL_MINIMUMS,
    measure: str = "job_tot",
    metro_total: str = "metro_total",
) -> DataFrame:
    """Every place under every cut and minimum share, row by row.

    ``metro_total`` is the metro's sum of the measure on every row, as the ranking
    leaves it there, so nothing is joined back and any grid of minimums will do.
    """
    grid = long.withColumn("_m", F.explode(minimum_grid(minimums)))
    return (
        grid.withColumns({"job_min": F.expr(f"{metro_total} * _m.factor"), "pp_min": F.col("_m.share")})
        .withColumn("mapvar", F.expr(apply_minimum_sql("mapvar", measure, "job_min")))
        .drop("_m", metro_total)
    )


def exceeded_sql(measure: str, metro_total: str, minimums: Sequence[float]) -> str:
    """Bit ``j`` is set when the measure exceeds minimum ``j`` of the grid."""
    return " + ".join(
        f"CAST({measure} > {metro_total} * {grid_minimum(share)[1]!r}D AS INT) * {1 << j}"
        for j, share in enumerate(minimums)
    )


def cluster_profile(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str],
    minimums: Sequence[float],
    measure: str = "job_tot",
) -> DataFrame:
    """Sums by key, category under each cut and minimums exceeded.

    Input has one row per place with ``mapvar_*`` and ``metro_total``.  The output
    has a few dozen rows per key whatever the number of places or definitions.
    """
    exceeds = F.expr(f"{exceeded_sql(measure, 'metro_total', minimums)} AS _exceeds")
    return df.groupBy(*keys, *fv.CUT_COLUMNS, exceeds).agg(
        F.expr("count(1) AS _units"), *[F.expr(f"{total_sql(m)} AS {m}") for m in measures]
    )


def expand_definitions(
    profile: DataFrame,
    minimums: Sequence[float],
    cuts: Sequence[str] = fv.CUT_COLUMNS,
) -> DataFrame:
    """The profile under every (cut, minimum): ``num_quant``, ``pp_min``, ``mapvar``."""
    definitions = ", ".join(
        f"named_struct('num_quant', '{cut}', 'pp_min', {float(share)}D,"
        f" 'mapvar', {apply_minimum_sql(cut, f'(_exceeds & {1 << j})', '0')})"
        for cut in cuts
        for j, share in enumerate(minimums)
    )
    kept = [c for c in profile.columns if c not in ("_exceeds", *fv.CUT_COLUMNS)]
    return profile.selectExpr(*[f"`{c}`" for c in kept], f"inline(array({definitions}))")
