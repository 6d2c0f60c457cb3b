"""Descriptive statistics, and the tables behind plots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import fixed_values as fv
from tessera.functions.columns import ratio, total, total_sql
from tessera.functions.keys import level_key, short_name
from tessera.operators.joins import attach, join_nullsafe, join_summary, non_members
from tessera.operators.ranking import rank_rows
from tessera.operators.selection import flag_top, select_quantiles, select_top


def finite_sql(value: str) -> str:
    return f"{value} IS NOT NULL AND NOT isnan({value}) AND abs({value}) < DOUBLE('Infinity')"


def job_places(lehd: DataFrame, widths: Mapping[str, int] = fv.KEY_LEVELS) -> DataFrame:
    """Places with their state and county keys and jobs per square mile."""
    return lehd.select(
        "tract",
        "year",
        level_key(F.col("tract"), "county", widths).alias("stcofips"),
        level_key(F.col("tract"), "state", widths).alias("stfips"),
        "job_tot",
        "ALAND_SQMI",
        ratio("job_tot", "ALAND_SQMI").alias("jobs_sqmi"),
    )


def pop_density(
    population: DataFrame, area: DataFrame, crosswalk: DataFrame, widths: Mapping[str, int] = fv.KEY_LEVELS
) -> DataFrame:
    """Population per square mile with metro and short metro name."""
    dense = attach(population, area.select("tract", "ALAND_SQMI"), "tract").select(
        "tract",
        level_key(F.col("tract"), "county", widths).alias("stcofips"),
        "pop",
        "ALAND_SQMI",
        ratio("pop", "ALAND_SQMI").alias("pop_sqmi"),
    )
    named = attach(dense, crosswalk.select("stcofips", "cbsa", "cbsa_name"), "stcofips")
    return named.withColumn("short_name", short_name(F.col("cbsa_name")))


def most_dense(
    places: DataFrame, value: str = "jobs_sqmi", by: Sequence[str] = ("year",), unit: str = "tract"
) -> DataFrame:
    """Places in tiles 98 to 100 of 100 over the whole period."""
    return select_top(places, by, value, [unit])


def dense_share(
    places: DataFrame, measure: str, value: str, by: Sequence[str] = ("year",), unit: str = "tract"
) -> DataFrame:
    """Share of a measure held by the densest places, and how many they are."""
    marked = flag_top(places, by, value, [unit], flag="_top")
    return marked.groupBy(*by).agg(
        ratio(total_sql(f"CASE WHEN _top THEN {measure} END"), f"sum({measure})").alias("dense_share"),
        F.expr("count_if(_top) AS dense_units"),
    )


def dense_coverage(dense: DataFrame, crosswalk: DataFrame, by: Sequence[str] = ("year",)) -> DataFrame:
    """Metros represented, places without a metro, places in top metros."""
    placed = attach(
        dense, crosswalk.select("stcofips", "cbsa", "cbsa_name", "top100"), "stcofips"
    )
    per_metro = placed.groupBy(*by, "cbsa_name").agg(
        F.count_if(F.col("cbsa").isNull()).alias("no_metro"), total("top100").alias("top100")
    )
    return per_metro.groupBy(*by).agg(
        F.count("cbsa_name").alias("metros"),
        F.sum("no_metro").alias("no_metro"),
        F.sum("top100").alias("top100"),
    )


def freq_table(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts per value; missing values are not counted."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(*by, column)
        .agg(F.count(F.lit(1)).alias("Freq"))
    )


def metro_medians(
    places: DataFrame,
    crosswalk: DataFrame,
    dense: DataFrame,
    measures: Sequence[str] = ("job_tot", "ALAND_SQMI", "jobs_sqmi"),
) -> DataFrame:
    """Medians per top metro and year beside the number of its densest places."""
    top = crosswalk.filter(F.col("top100") == 1).select("stcofips", "cbsa", "cbsa_name")
    inside = places.filter(F.col("ALAND_SQMI") > 0).join(top, "stcofips")
    medians = select_quantiles(inside, ["cbsa", "cbsa_name", "year"], measures, {"median": 0.5})
    wide = medians.groupBy("cbsa", "cbsa_name", "year").agg(
        *[F.max(F.when(F.col("measure") == m, F.col("median"))).alias(m) for m in measures]
    )
    metro = crosswalk.select("stcofips", "cbsa_name")
    counts = freq_table(attach(dense, metro, "stcofips"), "cbsa_name", ["year"])
    return wide.join(counts, ["cbsa_name", "year"], "left").withColumn(
        "short_name", short_name(F.col("cbsa_name"))
    )


def density_corr(
    places: DataFrame, population: DataFrame, by: Sequence[str] = ("year",)
) -> DataFrame:
    """Correlation of job and population density over places with positive area.

    Places that lack either value are left out, and counted in ``unmatched``.
    """
    joined = join_nullsafe(
        places,
        population.select("tract", "stcofips", "ALAND_SQMI", "pop", "pop_sqmi"),
        ["tract", "stcofips", "ALAND_SQMI"],
    ).filter(F.col("ALAND_SQMI") > 0)
    both = F.col("jobs_sqmi").isNotNull() & F.col("pop_sqmi").isNotNull()
    return joined.groupBy(*by).agg(
        F.corr(F.when(both, F.col("jobs_sqmi")), F.when(both, F.col("pop_sqmi"))).alias("correlation"),
        F.count_if(both).alias("units"),
        F.count_if(~both).alias("unmatched"),
    )


def argmax(
    df: DataFrame, by: Sequence[str], measure: str, unit: str, wanted: Sequence[str]
) -> DataFrame:
    """Values at the largest ``measure``; the first unit wins a tie."""
    usable = df.filter(F.col(measure).isNotNull())
    best = F.min_by(F.struct(unit, measure, *wanted), F.struct(-F.col(measure), F.col(unit)))
    return usable.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def six_number_summary(
    df: DataFrame, measures: Sequence[str], unit: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of missing values.

    ``unit`` is not needed any more: no order of equal values enters.
    """
    cut = select_quantiles(df, by, measures, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})
    plain = df.groupBy(*by).agg(
        *[F.avg(F.col(m).cast("double")).alias(f"_mean_{m}") for m in measures],
        *[F.count_if(F.col(m).isNull()).alias(f"_na_{m}") for m in measures],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"),
                F.col(f"_mean_{m}").alias("mean"),
                F.col(f"_na_{m}").alias("missing"),
            )
            for m in measures
        ]
    )
    means = plain.select(*by, F.inline(rows))
    return join_nullsafe(cut, means, [*by, "measure"], "inner").select(
        *by, "measure", "min", "q1", "median", "mean", "q3", "max", "missing"
    )


def flag_counts(df: DataFrame, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """TRUE, FALSE and missing counts of a flag."""
    return df.groupBy(*by).agg(
        F.count_if(F.col(flag)).alias("n_true"),
        F.count_if(~F.col(flag)).alias("n_false"),
        F.count_if(F.col(flag).isNull()).alias("n_missing"),
    )


def linear_fit(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of ``y`` on ``x``."""
    yc, xc = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*by).agg(
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_r2(yc, xc).alias("r2"),
        F.regr_count(yc, xc).alias("n"),
    )


def rank_categories(df: DataFrame, category: str, measure: str, by: Sequence[str] = ()) -> DataFrame:
    """Categories in the order a bar chart shows them: by mean, largest first."""
    means = df.groupBy(*by, category).agg(F.avg(measure).alias("mean"))
    return rank_rows(means, by, "mean", [category], descending=True, rank="position", size="_n").drop("_n")


def stack_fill(df: DataFrame, bar: Sequence[str], value: str) -> DataFrame:
    """Part of each row in the sum of its bar."""
    sums = df.groupBy(*bar).agg(F.sum(value).alias("_bar"))
    return (
        join_summary(df, sums, list(bar))
        .withColumn("part", ratio(value, "_bar"))
        .drop("_bar")
    )


def bin_bounds(df: DataFrame, value: str, bins: int, by: Sequence[str]) -> DataFrame:
    """Per group: lower end and width of equal bins over the finite values."""
    ends = [f"min({value}) AS lo", f"(max({value}) - min({value})) / {bins} AS width"]
    return df.filter(finite_sql(value)).groupBy(*by).agg(*[F.expr(e) for e in ends])


def histogram(
    df: DataFrame, value: str, by: Sequence[str], bins: int = fv.HISTOGRAM_BINS
) -> DataFrame:
    """Counts in equal-width bins, closed on the left, the last one on both sides.

    Without groups the bounds are one row, and come in as a scalar subquery.
    """
    bounds = bin_bounds(df, value, bins, by)
    usable = df.filter(finite_sql(value)).select(*by, value)
    if by:
        placed = join_summary(usable, bounds, list(by), "inner")
    else:
        ends = bounds.select(F.struct("lo", "width")).scalar()
        placed = usable.withColumn("_ends", ends).select(value, "_ends.*")
    slot = f"least(coalesce(floor(try_divide({value} - lo, width)), 0), {bins - 1})"
    return (
        placed.groupBy(*by, "lo", "width", F.expr(f"CAST({slot} AS INT) AS bin"))
        .agg(F.expr("count(1) AS n"))
        .selectExpr(*by, "bin", "lo + bin * width AS lower", "lo + (bin + 1) * width AS upper", "n")
    )


def freq_polygon(
    df: DataFrame, value: str, by: Sequence[str], bins: int = fv.HISTOGRAM_BINS
) -> DataFrame:
    """Bin mid-points and counts, empty bins included."""
    every = bin_bounds(df, value, bins, by).selectExpr(
        *by, "lo", "width", f"explode(sequence(0, {bins - 1})) AS bin"
    )
    counts = histogram(df, value, by, bins).select(*by, "bin", "n")
    return join_nullsafe(every, counts, [*by, "bin"]).selectExpr(
        *by, "bin", "lo + (bin + 0.5D) * width AS mid", "coalesce(n, 0) AS n"
    )


# Rule-of-thumb kernel width; falls back when the values hardly vary.
BANDWIDTH = """0.9D * pow(CAST(n AS DOUBLE), -0.2D) * CASE
    WHEN least(sd, (q3 - q1) / 1.34D) > 0 THEN least(sd, (q3 - q1) / 1.34D)
    WHEN sd > 0 THEN sd ELSE 1D END"""

REACH = 9  # bandwidths: exp(-81 / 2) is below 1e-17


def density_curve(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    unit: Sequence[str],
    points: int = fv.CURVE_POINTS,
    limits: tuple[float, float] = fv.CURVE_RANGE,
    bins: int = 4096,
) -> DataFrame:
    """Gaussian kernel density on an even grid, over the values inside the limits.

    Rows are counted into fine bins, each standing at the mean of its values, and the bins of a
    group become one array.  A point adds up the bins within ``REACH`` bandwidths, a slice of
    that array, so no row is made for a bin and a point.  With bin width w and bandwidth h
    the curve is off by at most (w / h)^2 / 8 times the height of a single kernel, 0.4 / h; what
    lies beyond the reach adds less than 1e-17 of it.  Where h falls below w (nearly all values
    the same) the first says nothing: take more ``bins``.  ``unit`` is not needed any more.
    """
    low, high = limits
    by = list(by)
    inside = df.filter(F.col(value).between(low, high)).select(*by, value)
    quartiles = select_quantiles(inside, by, [value], {"q1": 0.25, "q3": 0.75})
    spread = inside.groupBy(*by).agg(F.expr(f"stddev_samp({value}) AS sd"))
    kernel = (
        join_nullsafe(quartiles, spread, by, "inner")
        .filter("n > 1")
        .selectExpr(*by, "n", f"{BANDWIDTH} AS bw")
    )
    fine, step = (high - low) / bins, (high - low) / (points - 1)
    slot = f"least(floor(({value} - {low}D) / {fine}D), {bins - 1})"
    binned = inside.groupBy(*by, F.expr(f"CAST({slot} AS INT) AS bin")).agg(
        F.expr("CAST(count(1) AS DOUBLE) AS c"), F.expr(f"avg({value}) AS m")
    )
    # One array a group costs far more than its bytes say: deal the groups before.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = (
        binned.repartition(tasks, *by)
        .groupBy(*by)
        .agg(F.expr("sort_array(collect_list(struct(bin, c, m))) AS b"))
        # Empty bins in between, so that a place in the array is a bin.
        .withColumn("_gaps", F.expr("transform(b, (x, i) -> x.bin - if(i = 0, -1, b[i - 1].bin) - 1)"))
        .withColumn("_none", F.expr("named_struct('bin', -1, 'c', 0D, 'm', 0D)"))
        .withColumn("bins", F.expr("flatten(transform(b, (x, i) -> concat(array_repeat(_none, _gaps[i]), array(x))))"))
        .drop("b", "_gaps", "_none")
    )
    sized = join_nullsafe(filled, kernel, by, "inner")
    x = f"({low}D + p * {step}D)"
    first = f"greatest(CAST(floor((p * {step}D - {REACH}D * bw) / {fine}D) AS BIGINT), 0)"
    reach = f"CAST(ceil({2 * REACH}D * bw / {fine}D) AS BIGINT) + 2"
    near = f"slice(bins, CAST({first} + 1 AS INT), CAST(least({reach}, {bins}) AS INT))"
    bump = f"s.c * exp(-0.5D * (({x} - s.m) / bw) * (({x} - s.m) / bw))"
    sums = f"transform(sequence(0, {points - 1}), p -> aggregate({near}, 0D, (a, s) -> a + {bump}))"
    return sized.selectExpr(*by, "n", "bw", f"posexplode({sums}) AS (point, _sum)").selectExpr(
        *by, "point", f"{low}D + point * {step}D AS x", "_sum / (n * bw * sqrt(2D * pi())) AS y"
    )


def box_stats(df: DataFrame, value: str, by: Sequence[str], unit: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and number of outliers; ``unit`` is not needed any more."""
    by = list(by)
    hinges = select_quantiles(df, by, [value], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fenced = join_summary(df.select(*by, value), hinges, by, "inner")
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return fenced.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def ordinary_places(places: DataFrame, crosswalk: DataFrame, dense: DataFrame) -> DataFrame:
    """Places of top metros with positive area that are not among the densest."""
    top = crosswalk.filter(F.col("top100") == 1).select("stcofips", "cbsa", "cbsa_name")
    inside = places.filter(F.col("ALAND_SQMI") > 0).join(top, "stcofips")
    return non_members(inside, dense, ["tract", "year"])
