"""Exact ranks, tiles and quantiles inside groups of any size.

A window ordered inside a group puts the whole group in one task, which fails when
one group, or one value, holds a third of all rows.  Here the rows are range
partitioned by (group, value, unit) instead.  The unit key is unique, so no
partition has to hold a whole group or all copies of a value.  Each row gets its
position in that order, the positions are staged, and a small table with one row
per (group, partition) turns them into ranks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import total_sql
from tessera.operators.joins import join_summary
from tessera.sources.staging import stage

PARTITION_BITS = 33  # monotonically_increasing_id: row number in the low 33 bits


def rank_rows(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    unit: Sequence[str],
    descending: bool = False,
    group_totals: Mapping[str, str] | None = None,
    rank: str = "rank",
    size: str = "group_size",
) -> DataFrame:
    """Add the 1-based ``rank`` of ``value`` in its group and the group's ``size``.

    ``unit`` breaks ties and has to make rows unique within a group.  Rows without a
    value get no rank and do not count in ``size``.  ``group_totals`` adds sums over
    all rows of the group (new name -> summed column) at no further pass.
    """
    group, unit, group_totals = list(group), list(unit), dict(group_totals or {})
    by_value = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    order = [F.col(g).asc_nulls_first() for g in group] + [by_value] + [F.col(u).asc() for u in unit]
    placed = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("_run", F.shiftright("_pos", PARTITION_BITS))

    # One row per (group, partition): at most groups + partitions rows.
    whole = f"OVER (PARTITION BY {', '.join(f'`{g}`' for g in group) or '0'})"
    earlier = whole[:-1] + " ORDER BY _run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    runs = (
        placed.groupBy(*group, "_run")
        .agg(
            F.expr("min(_pos) AS _first"),
            F.expr(f"count(`{value}`) AS _count"),
            *[F.expr(f"{total_sql(source)} AS `_sum_{name}`") for name, source in group_totals.items()],
        )
        .selectExpr(
            *[f"`{g}`" for g in group],
            "_run",
            f"_first - coalesce(sum(_count) {earlier}, 0) AS _base",
            f"sum(_count) {whole} AS `{size}`",
            *[f"sum(`_sum_{name}`) {whole} AS `{name}`" for name in group_totals],
        )
    )
    ranked = join_summary(placed, runs, [*group, "_run"], "inner")
    position = F.expr(f"CASE WHEN `{value}` IS NOT NULL THEN _pos - _base + 1 END")
    return ranked.withColumn(rank, position).drop("_pos", "_run", "_base")


def keep_rows(df: DataFrame, label: str) -> DataFrame:
    """Rows kept as they come, for ranking or selection that reads them more than once.

    Worth it where they are costly to make and few beside what they are made of.
    """
    return stage(df, label)


def tile_sql(rank: str, size: str, tiles: int, method: str = "large_first") -> str:
    """SQL text of the tile number of a rank.

    ``large_first`` gives the SQL ``ntile`` sizes, ``floor`` the older even spread.
    """
    if method == "floor":
        return f"CAST(floor({tiles} * ({rank} - 1) / {size}) + 1 AS INT)"
    if method != "large_first":
        raise ValueError(f"unknown tile method {method!r}")
    small, extra = f"({size} DIV {tiles})", f"({size} % {tiles})"
    in_large = f"{extra} * ({small} + 1)"
    return (
        f"CAST(CASE WHEN {rank} <= {in_large} THEN ceil({rank} / ({small} + 1))"
        f" ELSE {extra} + ceil(try_divide({rank} - {in_large}, {small})) END AS INT)"
    )


def with_tiles(
    df: DataFrame,
    tiles: Sequence[int],
    group: Sequence[str],
    value: str,
    unit: Sequence[str],
    method: str = "large_first",
    group_totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """All tile columns ``dense_cat_n`` and flags ``most_dense_n`` from one ranking."""
    ranked = rank_rows(df, group, value, unit, group_totals=group_totals, rank="_rank", size="_size")
    tiled = ranked.withColumns(
        {f"dense_cat_{n}": F.expr(tile_sql("_rank", "_size", n, method)) for n in tiles}
    )
    return tiled.withColumns(
        {f"most_dense_{n}": F.expr(f"dense_cat_{n} = {n}") for n in tiles}
    ).drop("_rank", "_size")


def top_tiles(
    df: DataFrame, group: Sequence[str], value: str, unit: Sequence[str], tiles: int = 100, above: int = 97
) -> DataFrame:
    """Rows in the tiles numbered above ``above``; no group means the whole table."""
    ranked = rank_rows(df, group, value, unit, rank="_rank", size="_size")
    return ranked.filter(f"{tile_sql('_rank', '_size', tiles)} > {above}").drop("_rank", "_size")


def quantiles(
    df: DataFrame,
    group: Sequence[str],
    measures: Sequence[str],
    unit: Sequence[str],
    probabilities: Mapping[str, float],
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group and measure.

    The exact order statistics are picked out of one ranking of all measures, so a
    group never has to fit in one task.  Missing values are skipped; a group without
    any value has NULL quantiles.
    """
    group, unit = list(group), list(unit)
    keep = list(dict.fromkeys([*group, *unit]))
    long = df.selectExpr(
        *[f"`{c}`" for c in keep], *[f"CAST(`{m}` AS DOUBLE) AS `{m}`" for m in measures]
    ).unpivot(keep, list(measures), "measure", "value")
    ranked = rank_rows(long, [*group, "measure"], "value", unit, rank="_rank", size="n")
    # Each quantile lies between two order statistics: pick both by rank.
    spot = {name: f"((n - 1) * {float(p)}D)" for name, p in probabilities.items()}
    picks, between = [], []
    for name, at in spot.items():
        for side in ("floor", "ceil"):
            hit = f"_rank = CAST({side}({at}) AS BIGINT) + 1"
            picks.append(F.expr(f"max(CASE WHEN {hit} THEN value END) AS `_{side}_{name}`"))
        lo, hi = f"`_floor_{name}`", f"`_ceil_{name}`"
        line = f"{lo} + ({at} - floor({at})) * ({hi} - {lo})"
        between.append(f"CASE WHEN {lo} = {hi} THEN {lo} ELSE {line} END AS `{name}`")
    grouped = ranked.groupBy(*group, "measure", "n").agg(*picks)
    return grouped.selectExpr(*[f"`{g}`" for g in group], "measure", "n", *between)


def approximate_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: Mapping[str, float], accuracy: int = 10000
) -> DataFrame:
    """Sketch-based alternative for exploring; not linearly interpolated."""
    found = F.percentile_approx(value, [float(p) for p in probabilities.values()], accuracy)
    return (
        df.groupBy(*group)
        .agg(found.alias("_q"))
        .select(*group, *[F.get("_q", i).alias(name) for i, name in enumerate(probabilities)])
    )
