"""Place tables derived from a star schema of customers, orders and order lines.

The key copies the prefix hierarchy: region (2) + nation (3) + customer (19) + last digit
of the order (1) + order (19), so state, county, tract, block group and block are prefixes
of it (``LEVELS``).  The parts hold any BIGINT, so no two customers or orders share a key.
Counts are summed quantities, sectors are part types, periods are all order years.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import total
from tessera.sources.staging import stage

# Part type -> sector column of the count table.
TYPE_SECTORS = {
    "ECONOMY": "naics_11",
    "LARGE": "naics_22",
    "MEDIUM": "naics_31to33",
    "PROMO": "naics_44to45",
    "SMALL": "naics_48to49",
    "STANDARD": "naics_92",
}

# Part type -> series id of the second source; government has two series.
TYPE_SERIES = {
    "ECONOMY": "RE11AXAC",
    "LARGE": "RE22AXAC",
    "MEDIUM": "REMFAXAC",
    "PROMO": "RERTAXAC",
    "SMALL": "RERWAXAC",
    "STANDARD": "REGVLAXAC",
}
LARGE_GOVERNMENT = "REGVFAXAC"  # STANDARD parts above size 25

# Years of the orders and of the shipments.
ALL_YEARS = tuple(range(1995, 2002))


# Place keys as SQL text over the joined customer, nation and order columns.
COUNTY = "concat(lpad(CAST(n_regionkey AS STRING), 2, '0'), lpad(CAST(n_nationkey AS STRING), 3, '0'))"
TRACT = f"concat({COUNTY}, lpad(CAST(c_custkey AS STRING), 19, '0'))"
BLOCK = f"concat({TRACT}, CAST(o_orderkey % 10 AS STRING), lpad(CAST(o_orderkey AS STRING), 19, '0'))"
LEVELS = {"state": 2, "county": 5, "tract": 24, "blkgrp": 25}
METRO_NUMBER = "CAST(n_nationkey % 4 AS STRING)"


# Columns and types of the star schema's files.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def in_years(column: str, years: Sequence[int]) -> str:
    """SQL text: a date lies in one of the years, as ranges that reach the scan."""
    ranges: list[list[int]] = []
    for year in sorted(set(years)):
        if ranges and ranges[-1][1] == year:
            ranges[-1][1] = year + 1
        else:
            ranges.append([year, year + 1])
    return " OR ".join(
        f"({column} >= timestamp_ntz'{a}-01-01' AND {column} < timestamp_ntz'{b}-01-01')" for a, b in ranges
    )


class Star:
    """Lazy place tables over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """Declared schema, so building a plan reads no file."""
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def located(self, df: DataFrame, customer_key: str, counties: DataFrame | None = None) -> DataFrame:
        """Add the customer's and its nation's keys; ``counties`` (stcofips) keeps those places only.

        One join after the other, so that each dimension is sized by its own files.
        """
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        if counties is not None:
            nation = nation.join(counties, F.expr(f"{COUNTY} = stcofips"), "left_semi")
        return df.join(customer, F.expr(f"{customer_key} = c_custkey")).join(
            nation, F.expr("c_nationkey = n_nationkey")
        )

    def customers(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        return self.table("customer").join(nation, F.expr("c_nationkey = n_nationkey"))

    def typed_lines(self, *columns: str) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_type", "p_size")
        line = self.table("lineitem").select("l_orderkey", "l_partkey", *columns)
        return line.join(part, F.expr("l_partkey = p_partkey"))

    def orders(self, *columns: str, years: Sequence[int] | None = None) -> DataFrame:
        """Orders; years become date ranges that reach the scan."""
        orders = self.table("orders")
        if years is not None:
            orders = orders.filter(in_years("o_orderdate", years))
        return orders.select("o_orderkey", "o_custkey", *columns)

    def wac(
        self, years: Sequence[int] | None = None, counties: DataFrame | None = None, measures: Sequence[str] | None = None
    ) -> DataFrame:
        """Block counts by year, one column per sector; of all places or those in ``counties``.

        ``measures`` names the wanted columns (default: all).  Parts are joined for sectors only:
        every line has a part, so jobs alone need none, and no line is shuffled by part.

        Without limits, lines are summed per order before they meet the orders: an order
        with very many lines combines on the map side, the join needs no second shuffle of
        the sums, and keys are spelled out once per order instead of once per line.  With
        years or counties, the orders are cut down first and only their lines are summed;
        the sums are shuffled by block, so the join below them can still be split where an
        order has very many lines.  The orders of a few counties are staged: where their true
        size is under the broadcast threshold, no line of another order is shuffled.
        """
        names = ["job_tot", *TYPE_SECTORS.values()]
        names = [c for c in names if measures is None or c in measures]
        sums = [F.expr("sum(l_quantity) AS job_tot")] if "job_tot" in names else []
        sums += [
            F.expr(f"sum(CASE WHEN p_type = '{kind}' THEN l_quantity ELSE 0D END) AS {sector}")
            for kind, sector in TYPE_SECTORS.items() if sector in names
        ]
        counts = [f"CAST({c} AS BIGINT) AS {c}" for c in names]
        typed = any(c in names for c in TYPE_SECTORS.values())
        # Lines without a part key count in neither form.
        plain = self.table("lineitem").filter("l_partkey IS NOT NULL").select("l_orderkey", "l_quantity")
        lines = self.typed_lines("l_quantity") if typed else plain
        orders = self.orders("o_orderdate", years=years)
        if years is None and counties is None:
            per_order = lines.groupBy("l_orderkey").agg(*sums)
            placed = self.located(per_order.join(orders, F.expr("l_orderkey = o_orderkey")), "o_custkey")
            return placed.selectExpr(f"{BLOCK} AS fips", "year(o_orderdate) AS year", *counts)
        placed = self.located(orders, "o_custkey", counties).selectExpr(
            "o_orderkey", f"{BLOCK} AS fips", "year(o_orderdate) AS year"
        )
        placed = stage(placed, "kept-orders") if counties is not None else placed
        joined = lines.join(placed, F.expr("l_orderkey = o_orderkey"))
        return joined.groupBy("fips", "year").agg(*sums).selectExpr("fips", "year", *counts)

    def area(self) -> DataFrame:
        """Tract land area; missing for negative balances, zero for small ones."""
        land = "sum(CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS DOUBLE) END)"
        return self.customers().groupBy(F.expr(f"{TRACT} AS tract")).agg(F.expr(f"{land} AS ALAND_SQMI"))

    def crosswalk(self) -> DataFrame:
        """All counties; nations from 20 on are not in a metropolitan area."""
        small = "concat('U', CAST(n_nationkey AS STRING))"
        return self.table("nation").selectExpr(
            f"{COUNTY} AS stcofips",
            f"CASE WHEN n_nationkey < 20 THEN concat('M', {METRO_NUMBER}) ELSE {small} END AS cbsa",
            f"""CASE WHEN n_nationkey >= 20 THEN concat('Small ', {small})
                     WHEN n_nationkey % 4 = 0 THEN 'Solo, R0'
                     ELSE concat('City', {METRO_NUMBER}, '-Town, R', {METRO_NUMBER}) END AS cbsa_name""",
            """CASE WHEN n_nationkey < 20 THEN 'Metropolitan Statistical Area'
                    ELSE 'Micropolitan Statistical Area' END AS metro_micro""",
            "CASE WHEN n_nationkey < 20 AND n_nationkey % 4 < 3 THEN 1 ELSE 0 END AS top100",
        )

    def emp(self, years: Sequence[int] | None = None) -> DataFrame:
        """Second source in thousands by ship year, with an all-industries row.

        Every county has every series.  Years become date ranges on the lines' scan.
        """
        lines = self.typed_lines("l_quantity", "l_shipdate")
        if years is not None:
            lines = lines.filter(in_years("l_shipdate", years))
        years = tuple(years or ALL_YEARS)
        kinds = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in TYPE_SERIES.items())
        series = f"CASE WHEN p_type = 'STANDARD' AND p_size > 25 THEN '{LARGE_GOVERNMENT}' ELSE CASE p_type {kinds} END END"
        shipped = [
            F.expr(f"sum(CASE WHEN year(l_shipdate) = {y} THEN l_quantity ELSE 0D END) AS q{y}") for y in years
        ]
        per_order = lines.withColumn("series", F.expr(series)).groupBy("l_orderkey", "series").agg(*shipped)
        by_county = (
            self.located(per_order.join(self.orders(), F.expr("l_orderkey = o_orderkey")), "o_custkey")
            .groupBy(F.expr(f"{COUNTY} AS stcofips"), "series")
            .agg(*[F.expr(f"sum(q{y}) AS q{y}") for y in years])
        )
        names = ", ".join(f"'{name}'" for name in (*TYPE_SERIES.values(), LARGE_GOVERNMENT))
        pairs = self.table("nation").selectExpr(f"{COUNTY} AS stcofips", f"explode(array({names})) AS series")
        keys = [F.col("stcofips"), F.col("series")]
        return (
            pairs.join(by_county, ["stcofips", "series"], "left")
            .groupingSets([keys, keys[:1]], *keys)
            .agg(
                F.expr("grouping(series) AS _all"),
                *[F.expr(f"coalesce(sum(q{y}), 0D) / 1000D AS `{y}`") for y in years],
            )
            .selectExpr(
                "stcofips", "CASE WHEN _all = 1 THEN 'RETAXAC' ELSE series END AS DBcode", *[f"`{y}`" for y in years]
            )
        )

    def population(self) -> DataFrame:
        per_customer = self.table("orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
        return (
            self.customers()
            .join(per_customer, F.expr("c_custkey = o_custkey"), "left")
            .groupBy(F.expr(f"{TRACT} AS tract"))
            .agg((total("n") * 100).alias("pop"))
        )

    def block_area(self) -> DataFrame:
        """Land area by block, from order totals."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
        return self.located(orders, "o_custkey").selectExpr(
            f"{BLOCK} AS fips", "CAST(floor(o_totalprice / 10000) AS DOUBLE) AS ALAND_SQMI"
        )

    def centres(self) -> DataFrame:
        """Metro centres: M1 is missing (0/0)."""
        return (
            self.table("nation")
            .filter("n_nationkey < 20")
            .selectExpr(
                f"concat('M', {METRO_NUMBER}) AS cbsa",
                "CASE WHEN n_nationkey % 4 = 1 THEN 0D ELSE CAST(30 + n_nationkey % 4 AS DOUBLE) END AS lat",
                "CASE WHEN n_nationkey % 4 = 1 THEN 0D ELSE CAST(-80 - n_nationkey % 4 AS DOUBLE) END AS lon",
            )
            .distinct()
        )

    def bounds(self) -> DataFrame:
        """One square ring per tract with positive area; the others have none."""
        placed = self.area().filter("ALAND_SQMI > 0").selectExpr(
            "tract AS geoid",
            "CAST(substring(tract, 6, 16) AS DOUBLE) AS x",
            "CAST(substring(tract, 22, 3) AS DOUBLE) AS y",
            "sqrt(ALAND_SQMI) AS side",
        )
        return squares(placed)

    def county_bounds(self) -> DataFrame:
        """One square ring per county, side one, placed by nation and region number."""
        return squares(
            self.table("nation").selectExpr(
                f"{COUNTY} AS geoid",
                "CAST(n_nationkey AS DOUBLE) AS x",
                "CAST(n_regionkey AS DOUBLE) AS y",
                "1D AS side",
            )
        )


def squares(placed: DataFrame) -> DataFrame:
    """Boundary rows with one closed square ring per place."""
    corners = ", ".join(
        f"named_struct('lon', x + side * {dx}, 'lat', y + side * {dy})"
        for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    )
    return placed.selectExpr("geoid", f"array(array({corners})) AS rings")
