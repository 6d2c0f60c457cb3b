"""Exact order statistics and tiles by selection: no sort of a large group, no copy of it.

Groups of at most ``WINDOW_ROWS`` rows are one task's work: an ordered window, or Spark's own
``percentile``.  Larger ones are selected from.  A sketch per group brackets every wanted rank between two values.  One pass then counts:
rows between brackets fall together into one counter each, rows inside a bracket are counted
by value, so a value that holds a third of all rows is one counter too.  Running sums over
these few counters give the exact value at each rank.  A tile ends at a pair of value and unit:
the unit is looked for only where rows of one value fall into two tiles, and only among them.

Rows are read once for the sketch and once for the counts (a third time to label tiles).  Where
they come out of costly steps, stage them first; what is already a table is never copied.
Values are compared as doubles; ``ranking`` sorts, and ranks values of any type.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.columns import total_sql
from tessera.operators.joins import join_nullsafe
from tessera.operators.ranking import rank_rows, tile_sql
from tessera.sources.staging import stage

WINDOW_ROWS = 100_000
ACCURACY = 10_000  # ranks of the sketch are off by at most one part in this
MISSED = "'a rank lies outside its bracket: raise the accuracy'"


def by_size(
    df: DataFrame, group: Sequence[str], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``small`` for the rows of groups that one task can hold, ``large`` for the others."""
    sizes = df.groupBy(*group).agg(F.count("*").alias("_size"))
    if (sizes.agg(F.max("_size")).first()[0] or 0) <= WINDOW_ROWS:
        return small(df)
    hot = stage(sizes.filter(F.col("_size") > WINDOW_ROWS).select(*group), "large-groups")
    rest, hot_rows = (join_nullsafe(df, hot, group, how) for how in ("left_anti", "left_semi"))
    return small(rest).unionByName(large(hot_rows))


def _number(value: str) -> str:
    """SQL text: NaN stands with the largest, where the sketch can place it."""
    return f"CASE WHEN isnan(CAST(`{value}` AS DOUBLE)) THEN DOUBLE('Infinity') ELSE CAST(`{value}` AS DOUBLE) END"


def brackets(
    df: DataFrame,
    group: Sequence[str],
    measures: Sequence[str],
    near: Sequence[float],
    margin: float,
    whole_below: int = 0,
    totals: Mapping[str, str] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Per group and measure: ``n`` values and ``spans``, an interval around each probability.

    ``near`` is ascending.  Groups of fewer than ``whole_below`` values have one interval
    that holds everything.  ``totals`` adds sums over all rows (new name -> column).
    """
    ends = [p for q in near for p in (max(q - margin, 0.0), min(q + margin, 1.0))]
    listed = f"array({', '.join(f'{p!r}D' for p in ends)})"
    sketched = df.groupBy(*group).agg(
        *[F.expr(f"count(`{m}`) AS `_n{i}`") for i, m in enumerate(measures)],
        *[F.expr(f"percentile_approx({_number(m)}, {listed}, {accuracy}) AS `_e{i}`") for i, m in enumerate(measures)],
        *[F.expr(f"{total_sql(f'`{source}`')} AS `{name}`") for name, source in (totals or {}).items()],
    )

    def spans(i: int) -> str:
        low, high = f"_e{i}[2 * k]", f"_e{i}[2 * k + 1]"
        open_low = f"_n{i} < {whole_below} OR {listed}[2 * k] <= 0"
        open_high = f"_n{i} < {whole_below} OR {listed}[2 * k + 1] >= 1 OR {high} = DOUBLE('Infinity')"
        return (
            f"transform(sequence(0, {len(near) - 1}), k -> named_struct("
            f"'lo', CASE WHEN {open_low} THEN DOUBLE('-Infinity') ELSE {low} END,"
            f" 'hi', CASE WHEN {open_high} THEN DOUBLE('NaN') ELSE {high} END))"
        )

    rows = ", ".join(
        f"named_struct('measure', '{m}', 'n', _n{i}, 'spans', {spans(i)})" for i, m in enumerate(measures)
    )
    return stage(
        sketched.selectExpr(*[f"`{g}`" for g in group], *[f"`{t}`" for t in totals or {}], f"inline(array({rows}))"),
        "brackets",
    )


def _passed(points: str, count: int, after: str) -> str:
    """SQL text: how many of the sorted ``points`` a row has passed, by binary search.

    ``after`` is a condition on ``{p}``, true for the first points of the array.
    """
    steps = ", ".join(str(1 << k) for k in reversed(range(max(count, 1).bit_length())))
    here = after.replace("{p}", f"get({points}, i + s - 1)")
    return f"aggregate(array({steps}), 0, (i, s) -> CASE WHEN i + s <= size({points}) AND {here} THEN i + s ELSE i END)"


def _segment(count: int) -> str:
    """SQL text: 2k - 1 for a value inside interval k (from 1), 2k for one after it and before the next."""
    return f"2 * _k - CASE WHEN _k > 0 AND v <= get(spans, _k - 1).hi THEN 1 ELSE 0 END"


def order_statistics(
    df: DataFrame, found: DataFrame, group: Sequence[str], measures: Sequence[str], intervals: int, ranks: str
) -> DataFrame:
    """One row per group, measure and wanted rank that there is: its struct and the value there.

    ``ranks`` is SQL text over n for an array of structs with the field ``rank`` (from 0).
    Adds ``value``, how many values are ``below`` it and how many are ``equal`` to it.  ``found``
    comes from :func:`brackets`.
    """
    keys = [*group, "measure"]
    values = ", ".join(f"named_struct('measure', '{m}', 'v', CAST(`{m}` AS DOUBLE))" for m in measures)
    long = df.selectExpr(*[f"`{g}`" for g in group], f"inline(array({values}))").filter("v IS NOT NULL")
    placed = join_nullsafe(long, found.select(*keys, "spans"), keys, "inner")
    placed = placed.withColumn("_k", F.expr(_passed("spans", intervals, "v >= {p}.lo")))
    placed = placed.withColumn("_seg", F.expr(_segment(intervals)))
    counted = placed.groupBy(*keys, "_seg", F.expr("CASE WHEN _seg % 2 = 1 THEN v END AS v")).agg(F.count("*").alias("_c"))
    before = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY _seg, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    running = counted.withColumn("_below", F.expr(f"coalesce(sum(_c) {before}, 0)"))
    sized = join_nullsafe(running, found.select(*keys, "n"), keys, "inner")
    here = f"filter({ranks}, r -> _below <= r.rank AND r.rank < _below + _c)"
    value = f"CASE WHEN _seg % 2 = 1 THEN v ELSE raise_error({MISSED}) END AS value"
    named = [f"`{k}`" for k in keys]
    return sized.selectExpr(*named, "_seg", "v", "_below AS below", "_c AS equal", f"explode({here}) AS rank").selectExpr(
        *named, "rank", value, "below", "equal"
    )


def select_quantiles(
    df: DataFrame, group: Sequence[str], measures: Sequence[str], probabilities: Mapping[str, float], accuracy: int = ACCURACY
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group and measure.

    Missing values are skipped; a group without any value has NULL quantiles.
    """
    group = list(group)
    if not group:
        whole = select_quantiles(df.withColumn("_whole", F.lit(0)), ["_whole"], measures, probabilities, accuracy)
        return whole.drop("_whole")
    return by_size(
        df, group, lambda rows: _held_quantiles(rows, group, measures, probabilities),
        lambda rows: _selected_quantiles(rows, group, measures, probabilities, accuracy),
    )


def _held_quantiles(df: DataFrame, group: Sequence[str], measures: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    listed = ", ".join(f"{float(p)!r}D" for p in probabilities.values())
    held = [F.expr(f"count(`{m}`) AS `_n{i}`") for i, m in enumerate(measures)]
    held += [F.expr(f"percentile(CAST(`{m}` AS DOUBLE), array({listed})) AS `_q{i}`") for i, m in enumerate(measures)]
    parts = [
        f"named_struct('measure', '{m}', 'n', `_n{i}`, {', '.join(f"'{name}', `_q{i}`[{k}]" for k, name in enumerate(probabilities))})"
        for i, m in enumerate(measures)
    ]
    return df.groupBy(*group).agg(*held).selectExpr(*[f"`{g}`" for g in group], f"inline(array({', '.join(parts)}))")


def _selected_quantiles(
    df: DataFrame, group: Sequence[str], measures: Sequence[str], probabilities: Mapping[str, float], accuracy: int
) -> DataFrame:
    near = sorted({float(p) for p in probabilities.values()})
    # Interpolated ranks are off by a row or two from those that the sketch answers for.
    margin = 10 / accuracy
    found = brackets(df, group, measures, near, margin, int(3 / (margin - 1 / accuracy)), accuracy=accuracy)
    spot = {name: f"((n - 1) * {float(p)!r}D)" for name, p in probabilities.items()}
    both = [(f"_{side}_{name}", f"CAST({side}({at}) AS BIGINT)") for name, at in spot.items() for side in ("floor", "ceil")]
    ranks = f"array({', '.join(f"named_struct('name', '{name}', 'rank', {rank})" for name, rank in both)})"
    hits = order_statistics(df, found, group, measures, len(near), ranks)
    keys = [*group, "measure"]
    picked = hits.groupBy(*keys).agg(*[F.expr(f"max(CASE WHEN rank.name = '{name}' THEN value END) AS `{name}`") for name, _ in both])
    between = []
    for name, at in spot.items():
        lo, hi = f"`_floor_{name}`", f"`_ceil_{name}`"
        line = f"{lo} + ({at} - floor({at})) * ({hi} - {lo})"
        between.append(f"CASE WHEN {lo} = {hi} THEN {lo} ELSE {line} END AS `{name}`")
    whole = join_nullsafe(found.select(*keys, "n"), picked, keys)
    return whole.selectExpr(*[f"`{g}`" for g in group], "measure", "n", *between)


# --- tiles ------------------------------------------------------------------------------------

#: Last rank of tile t of K in a group of n, from 1: SQL text by method.
LAST_RANK: dict[str, Callable[[int, int], str]] = {
    "large_first": lambda t, k: f"({t} * (n DIV {k}) + least({t}, n % {k}))",
    "floor": lambda t, k: f"CAST(ceil({t}D * n / {k}) AS BIGINT)",
}


def tile_cuts(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    unit: Sequence[str],
    wanted: Sequence[tuple[int, int]],
    method: str = "large_first",
    totals: Mapping[str, str] | None = None,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """Per group: totals, ``cuts``, the sorted ends of the wanted (tiles, tile), and ``labels``.

    A cut has ``value`` and ``unit`` of the tile's last row; ``whole`` is 1, and the unit NULL,
    where all rows of the value are in that tile or before it.  A group without values has none.
    """
    if method not in LAST_RANK:
        raise ValueError(f"unknown tile method {method!r}")
    near = sorted({t / k for k, t in wanted})
    # Tile sizes differ by one, so a tile's end is off its share by up to K/4 rows: wide
    # intervals, and everything inside where these are narrower than that.
    margin, off = 5 / accuracy, max(k for k, _ in wanted) / 4 + 2
    found = brackets(df, group, [value], near, margin, int(off / (margin - 1 / accuracy)), totals, accuracy)
    ends = ", ".join(f"named_struct('tiles', {k}, 'tile', {t}, 'rank', {LAST_RANK[method](t, k)} - 1)" for k, t in wanted)
    stats = order_statistics(df, found, group, [value], len(near), f"array({ends})")
    place = "rank.rank - below + 1"
    stats = stage(
        stats.selectExpr(*[f"`{g}`" for g in group], "value", "rank.tiles", "rank.tile",
                         f"CASE WHEN {place} < equal THEN {place} END AS place"), "cut-values",
    )
    split = stats.filter("place IS NOT NULL")
    key = f"`{unit[0]}`" if len(unit) == 1 else f"struct({', '.join(unit)})"
    if split.isEmpty():
        kind = df.selectExpr(f"{key} AS unit").schema["unit"].dataType
        placed = stats.withColumn("unit", F.lit(None).cast(kind))
    else:
        # Only rows of a value that falls into two tiles are ranked, once for all its cuts.
        hot = stage(split.select(*group, "value").distinct(), "hot-values")
        rows = df.select(*dict.fromkeys([*group, *unit]), F.col(value).cast("double").alias("value"))
        among = [*group, "value"]
        ranked = rank_rows(join_nullsafe(rows, hot, among, "inner"), among, unit[0], unit, rank="place")
        ends = ranked.selectExpr(*[f"`{c}`" for c in among], "place", f"{key} AS unit")
        placed = join_nullsafe(stats, stage(join_nullsafe(ends, split.select(*among, "place").distinct(), [*among, "place"], "inner"), "cut-units"),
                               [*among, "place"])
    cut = "struct(value, CASE WHEN place IS NULL THEN 1 ELSE 0 END AS whole, unit, tiles, tile)"
    cuts = placed.groupBy(*group).agg(F.expr(f"sort_array(collect_list({cut})) AS cuts"))
    sizes = found.select(*group, *(totals or {}))
    # The tiles of a row that has passed so many cuts: worked out here, once per group.
    tiles = ", ".join(f"size(filter(slice(cuts, 1, i), x -> x.tiles = {k})) + 1 AS tile_{k}" for k in {k: 0 for k, _ in wanted})
    labels = F.expr(f"transform(sequence(0, size(cuts)), i -> struct({tiles}))")
    return stage(join_nullsafe(sizes, cuts.withColumn("labels", labels), group), "cuts")


def after_sql(value: str, unit: Sequence[str], cut: str) -> str:
    """SQL text: a row comes after a cut; not without a value."""
    key = f"`{unit[0]}`" if len(unit) == 1 else f"struct({', '.join(unit)})"
    v = f"CAST(`{value}` AS DOUBLE)"
    return f"coalesce({v} > {cut}.value OR ({v} = {cut}.value AND {cut}.whole = 0 AND {key} > {cut}.unit), false)"


def placed_rows(
    df: DataFrame, group: Sequence[str], value: str, unit: Sequence[str], totals: Mapping[str, str] | None = None
) -> DataFrame:
    """``_rank`` and ``_size`` of a row among the values of its group, and totals, by windows."""
    inside = Window.partitionBy(*group)
    order = inside.orderBy(F.col(value).asc_nulls_last(), *[F.col(u).asc() for u in unit])
    rank = F.when(F.col(value).isNotNull(), F.row_number().over(order))
    sums = {name: F.coalesce(F.sum(source).over(inside), F.lit(0)) for name, source in (totals or {}).items()}
    return df.withColumns({"_rank": rank, "_size": F.count(value).over(inside), **sums})


def select_tiles(
    df: DataFrame,
    tiles: Sequence[int],
    group: Sequence[str],
    value: str,
    unit: Sequence[str],
    method: str = "large_first",
    group_totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Tile columns ``dense_cat_n`` and flags ``most_dense_n``: SQL ``ntile`` by value, then unit.

    ``unit`` has to make rows unique within a group; rows without a value have no tile.
    ``group_totals`` adds sums over all rows of the group (new name -> summed column).
    """
    if not group:
        whole = select_tiles(df.withColumn("_whole", F.lit(0)), tiles, ["_whole"], value, unit, method, group_totals)
        return whole.drop("_whole")
    group, unit = list(group), list(unit)
    wanted = [(n, t) for n in tiles for t in range(1, n)]

    def small(rows: DataFrame) -> DataFrame:
        ranked = placed_rows(rows, group, value, unit, group_totals)
        return ranked.withColumns({f"dense_cat_{n}": F.expr(tile_sql("_rank", "_size", n, method)) for n in tiles}).drop("_rank", "_size")

    def large(rows: DataFrame) -> DataFrame:
        cut = join_nullsafe(rows, tile_cuts(rows, group, value, unit, wanted, method, group_totals), group, "inner")
        passed = cut.withColumn("_passed", F.expr(_passed("cuts", len(wanted), after_sql(value, unit, "{p}"))))
        tile = {f"dense_cat_{n}": F.expr(f"CASE WHEN `{value}` IS NOT NULL THEN get(labels, _passed).tile_{n} END") for n in tiles}
        return passed.withColumns(tile).drop("cuts", "labels", "_passed")

    flags = {f"most_dense_{n}": F.expr(f"dense_cat_{n} = {n}") for n in tiles}
    return by_size(df, group, small, large).withColumns(flags)


def flag_top(
    df: DataFrame, group: Sequence[str], value: str, unit: Sequence[str], tiles: int = 100, above: int = 97, flag: str = "top"
) -> DataFrame:
    """Adds whether a row lies in the tiles numbered above ``above``; false without a value."""
    if not group:
        return flag_top(df.withColumn("_whole", F.lit(0)), ["_whole"], value, unit, tiles, above, flag).drop("_whole")
    group, unit = list(group), list(unit)

    def small(rows: DataFrame) -> DataFrame:
        ranked = placed_rows(rows, group, value, unit)
        return ranked.withColumn(flag, F.expr(f"coalesce({tile_sql('_rank', '_size', tiles)} > {above}, false)")).drop("_rank", "_size")

    def large(rows: DataFrame) -> DataFrame:
        cut = join_nullsafe(rows, tile_cuts(rows, group, value, unit, [(tiles, above)]), group, "inner")
        return cut.withColumn(flag, F.expr(after_sql(value, unit, "get(cuts, 0)"))).drop("cuts", "labels")

    return by_size(df, group, small, large)


def select_top(
    df: DataFrame, group: Sequence[str], value: str, unit: Sequence[str], tiles: int = 100, above: int = 97
) -> DataFrame:
    """Rows in the tiles numbered above ``above``; no group means the whole table."""
    return flag_top(df, group, value, unit, tiles, above, "_top").filter("_top").drop("_top")
