"""One SQL text per query, put together from named common table expressions."""

from __future__ import annotations

import re

# The sector columns that the star schema fills.
SECTORS = ("naics_11", "naics_22", "naics_31to33", "naics_44to45", "naics_48to49", "naics_92")

# Part type of each sector column, in the same order.
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

# Series id of each part type, in the same order.
SERIES = ("RE11AXAC", "RE22AXAC", "REMFAXAC", "RERTAXAC", "RERWAXAC", "REGVLAXAC")

# All series and years of the second source; the last series is the second one of government.
ALL_SERIES = (*SERIES, "REGVFAXAC")
ALL_YEARS = tuple(range(1995, 2002))
EMP_YEARS = ", ".join(f"y{y}" for y in ALL_YEARS)

# Labels of the sector columns, in the same order.
LABELS = ("Logging", "Utilities", "Manufacturing", "Retail", "Logistics", "Public administration")

# Codes of the sector columns in the second source, in the same order.
HARMONISED = ("naics_11", "naics_22", "naics_MF", "naics_RT", "naics_RW", "naics_GV")


def r(expression: str, places: int = 6) -> str:
    return f"(round({expression}, {places}) + CAST(0 AS DOUBLE))"


def ratio(top: str, bottom: str) -> str:
    a, b = f"CAST({top} AS DOUBLE)", f"CAST({bottom} AS DOUBLE)"
    return (
        f"(CASE WHEN {b} = 0 AND {a} > 0 THEN CAST('inf' AS DOUBLE)"
        f" WHEN {b} = 0 AND {a} < 0 THEN CAST('-inf' AS DOUBLE)"
        f" WHEN {b} = 0 THEN NULL ELSE {a} / {b} END)"
    )


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def total(expression: str) -> str:
    return f"CAST(coalesce(sum({expression}), 0) AS BIGINT)"


def pad(column: str, width: int) -> str:
    return f"lpad(CAST({column} AS VARCHAR), {width}, '0')"


def pick(column: str, keys, values) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in zip(keys, values))
    return f"CASE {column} {cases} END"


def short(name: str) -> str:
    return f"CASE WHEN split_part({name}, '-', 1) = '' THEN {name} ELSE split_part({name}, '-', 1) END"


COUNTY = f"concat({pad('n_regionkey', 2)}, {pad('n_nationkey', 3)})"
TRACT = f"concat({COUNTY}, {pad('c_custkey', 19)})"
FIPS = f"concat({TRACT}, CAST(o_orderkey % 10 AS VARCHAR), {pad('o_orderkey', 19)})"
CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey"
SUMS = ", ".join(f"{total(s)} AS {s}" for s in SECTORS)
BY_SECTOR = ", ".join(
    f"{big(f'''sum(CASE WHEN p_type = '{t}' THEN l_quantity ELSE 0 END)''')} AS {s}"
    for s, t in zip(SECTORS, TYPES)
)
SECTOR_LIST = ", ".join(SECTORS)
NOT_04 = "(substr(tract, 1, 2) <> '04' OR tract IS NULL)"
SQMI = ratio("job_tot", "ALAND_SQMI")
TILES = ", ".join(
    f"CASE WHEN density IS NOT NULL THEN CAST(ntile({n}) OVER "
    f"(PARTITION BY cbsa, year, density IS NULL ORDER BY density, tract) AS INT) END AS dense_cat_{n}"
    for n in (20, 10, 5)
)
DENSE_FLAGS = ", ".join(f"dense_cat_{n} = {n} AS most_dense_{n}" for n in (20, 10, 5))
LOW = "WHEN dense_cat_20 < 17 OR dense_cat_20 IS NULL THEN 'low density' WHEN dense_cat_20 = 17 THEN 'p80' WHEN dense_cat_20 = 18 THEN 'p85'"
TOP_COUNTIES = "SELECT stcofips FROM xwalk WHERE top100 = 1"
METRO = "City1-Town, R1"

CTES = {
    "wac": f"""
        SELECT {FIPS} AS fips, CAST(year(o_orderdate) AS INT) AS year,
               {big('sum(l_quantity)')} AS job_tot, {BY_SECTOR}
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
        GROUP BY 1, 2""",
    "area": f"""
        SELECT {TRACT} AS tract,
               sum(CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 100) AS DOUBLE) END) AS ALAND_SQMI
        FROM {CUSTOMERS} GROUP BY 1""",
    "xwalk_all": f"""
        SELECT {COUNTY} AS stcofips,
               CASE WHEN n_nationkey < 20 THEN concat('M', CAST(n_nationkey % 4 AS VARCHAR))
                    ELSE concat('U', CAST(n_nationkey AS VARCHAR)) END AS cbsa,
               CASE WHEN n_nationkey >= 20 THEN concat('Small U', CAST(n_nationkey AS VARCHAR))
                    WHEN n_nationkey % 4 = 0 THEN 'Solo, R0'
                    ELSE concat('City', CAST(n_nationkey % 4 AS VARCHAR), '-Town, R', CAST(n_nationkey % 4 AS VARCHAR))
               END AS cbsa_name,
               CASE WHEN n_nationkey < 20 AND n_nationkey % 4 < 3 THEN 1 ELSE 0 END AS top100,
               n_nationkey < 20 AS metropolitan
        FROM nation""",
    "xwalk": "SELECT stcofips, cbsa, cbsa_name, top100 FROM xwalk_all WHERE metropolitan",
    "emp_parts": f"""
        SELECT {COUNTY} AS stcofips, year(l_shipdate) AS y, l_quantity AS q,
               CASE WHEN p_type = 'STANDARD' AND p_size > 25 THEN 'REGVFAXAC'
                    ELSE {pick('p_type', TYPES, SERIES)} END AS series
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey""",
    "emp_pairs": f"SELECT {COUNTY} AS stcofips, unnest([{', '.join(f"'{x}'" for x in ALL_SERIES)}]) AS series FROM nation",
    "emp_sums": f"""
        SELECT p.stcofips, p.series, {', '.join(f"coalesce(sum(CASE WHEN y = {y} THEN q END), 0) AS q{y}" for y in ALL_YEARS)}
        FROM emp_pairs p LEFT JOIN emp_parts e ON p.stcofips = e.stcofips AND p.series = e.series GROUP BY 1, 2""",
    "emp": f"""
        SELECT stcofips, series AS DBcode, {', '.join(f"q{y} / CAST(1000 AS DOUBLE) AS y{y}" for y in ALL_YEARS)}
        FROM emp_sums UNION ALL
        SELECT stcofips, 'RETAXAC', {', '.join(f"sum(q{y}) / CAST(1000 AS DOUBLE)" for y in ALL_YEARS)}
        FROM emp_sums GROUP BY 1""",
    "pop": f"""
        SELECT {TRACT} AS tract, {big('count(o_orderkey) * 100')} AS pop
        FROM {CUSTOMERS} LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "centres": """
        SELECT DISTINCT concat('M', CAST(n_nationkey % 4 AS VARCHAR)) AS cbsa,
               CASE WHEN n_nationkey % 4 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(30 + n_nationkey % 4 AS DOUBLE) END AS lat,
               CASE WHEN n_nationkey % 4 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(-80 - n_nationkey % 4 AS DOUBLE) END AS lon
        FROM nation WHERE n_nationkey < 20""",
    "bounds": """
        SELECT tract AS geoid, CAST(substr(tract, 6, 16) AS DOUBLE) AS x, CAST(substr(tract, 22, 3) AS DOUBLE) AS y,
               sqrt(ALAND_SQMI) AS s FROM area WHERE ALAND_SQMI > 0""",
    "corners": """
        SELECT * FROM (VALUES (1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, 0, 0)) AS c(k, dx, dy)""",
    "lehd": f"""
        SELECT t.tract, t.year, t.job_tot, {', '.join('t.' + s for s in SECTORS)}, area.ALAND_SQMI
        FROM (SELECT substr(fips, 1, 24) AS tract, year, {total('job_tot')} AS job_tot, {SUMS}
              FROM wac GROUP BY 1, 2) t LEFT JOIN area USING (tract)""",
    "dens": f"""
        SELECT tract, year, job_tot, ALAND_SQMI, {SQMI} AS density, cbsa, cbsa_name, top100, {SECTOR_LIST}
        FROM lehd LEFT JOIN xwalk ON substr(tract, 1, 5) = stcofips""",
    "tiles": f"SELECT *, {DENSE_FLAGS} FROM (SELECT *, {TILES} FROM dens)",
    "cats": f"""
        SELECT *, CASE {LOW} WHEN dense_cat_20 = 19 THEN 'p90' WHEN dense_cat_20 = 20 THEN 'cluster' END AS mapvar_20,
               CASE {LOW} WHEN dense_cat_10 = 10 THEN 'cluster' END AS mapvar_10,
               CASE WHEN dense_cat_20 IS NULL THEN NULL WHEN dense_cat_20 >= 17 THEN 'cluster' ELSE 'low density' END AS mapvar_5
        FROM tiles""",
    "long": f"""
        SELECT tract, year, job_tot, ALAND_SQMI, density, cbsa, cbsa_name, top100, {SECTOR_LIST}, num_quant, mapvar
        FROM cats UNPIVOT INCLUDE NULLS (mapvar FOR num_quant IN (mapvar_20, mapvar_10, mapvar_5))""",
    "grid": """
        SELECT share, name, CAST(f AS DOUBLE) AS factor FROM (VALUES
            (CAST(0 AS DOUBLE), 'zero_pp', '0'), (CAST(0.25 AS DOUBLE), 'oquart_pp', '0.0025'),
            (CAST(0.5 AS DOUBLE), 'half_pp', '0.005'), (CAST(0.75 AS DOUBLE), 'tquart_pp', '0.0075'),
            (CAST(1 AS DOUBLE), 'one_pp', '0.01')) AS g(share, name, f)""",
    "met_jobs": f"""
        SELECT cbsa, cbsa_name, year, job_tot, name AS pp_min, job_tot * factor AS job_min, share
        FROM (SELECT cbsa, cbsa_name, year, {total('job_tot')} AS job_tot FROM dens GROUP BY 1, 2, 3) m, grid""",
    "flags": f"""
        SELECT l.* EXCLUDE (mapvar), m.share AS pp_min, m.job_min,
               CASE WHEN l.mapvar = 'cluster' AND l.job_tot > m.job_min THEN 'cluster'
                    WHEN l.mapvar = 'cluster' AND l.job_tot <= m.job_min THEN 'high density'
                    WHEN l.mapvar <> 'cluster' THEN l.mapvar END AS mapvar
        FROM long l JOIN met_jobs m ON l.cbsa IS NOT DISTINCT FROM m.cbsa AND l.year = m.year""",
    "kept_flags": f"SELECT * FROM flags WHERE {NOT_04}",
    "shown_metros": "SELECT DISTINCT cbsa, cbsa_name FROM xwalk WHERE top100 = 1",
    "summary_all": f"""
        SELECT f.cbsa, m.cbsa_name, f.year, f.num_quant, f.pp_min AS min, {total('job_tot')} AS jobs,
               {total("CASE WHEN mapvar = 'cluster' THEN job_tot END")} AS cluster_jobs,
               {big('count(*)')} AS tr_ct,
               {total("CASE WHEN mapvar = 'high density' THEN 1 END")} AS high_ct,
               {total("CASE WHEN mapvar = 'cluster' THEN 1 END")} AS cluster_ct
        FROM flags f JOIN shown_metros m ON f.cbsa = m.cbsa GROUP BY 1, 2, 3, 4, 5""",
    "metros": "SELECT DISTINCT cbsa, cbsa_name FROM xwalk WHERE top100 = 1 AND cbsa <> 'M2'",
    "summary": f"""
        SELECT f.cbsa, m.cbsa_name, f.year, f.num_quant, f.pp_min AS min, {total('job_tot')} AS jobs,
               {total("CASE WHEN mapvar = 'cluster' THEN job_tot END")} AS cluster_jobs,
               {big('count(*)')} AS tr_ct,
               {total("CASE WHEN mapvar = 'high density' THEN 1 END")} AS high_ct,
               {total("CASE WHEN mapvar = 'cluster' THEN 1 END")} AS cluster_ct
        FROM kept_flags f JOIN metros m ON f.cbsa = m.cbsa GROUP BY 1, 2, 3, 4, 5""",
    "shares": f"""
        SELECT * REPLACE ({pick('num_quant', ('mapvar_20', 'mapvar_10', 'mapvar_5'),
                                ('95th percentile', '90th percentile', '80th percentile'))} AS num_quant),
               {ratio('cluster_ct', 'tr_ct')} AS cluster_share,
               {ratio('cluster_jobs', 'jobs')} * 100 AS job_share FROM summary""",
    "natl_jobs": f"SELECT year, {total('job_tot')} AS natl_job_tot FROM lehd WHERE {NOT_04} GROUP BY 1",
    "top_jobs": f"""
        SELECT year, {total('job_tot')} AS natl_job_tot FROM lehd
        WHERE {NOT_04} AND substr(tract, 1, 5) IN ({TOP_COUNTIES}) GROUP BY 1""",
    "in_clusters": f"""
        SELECT year, {pick('num_quant', ('mapvar_20', 'mapvar_10', 'mapvar_5'),
                           ('Top 5 percent', 'Top 10 percent', 'Top 20 percent'))} AS density_cut,
               pp_min, {total('job_tot')} AS jobs
        FROM kept_flags WHERE mapvar = 'cluster' GROUP BY 1, 2, 3""",
    "sector_long": f"""
        SELECT tract, year, job_tot, ALAND_SQMI, naics, jobs FROM lehd
        UNPIVOT INCLUDE NULLS (jobs FOR naics IN ({SECTOR_LIST})) WHERE {NOT_04}""",
    "sector_tot": f"""
        SELECT naics, {total('CASE WHEN year = 1996 THEN jobs END')} AS emp_1996,
               {total('CASE WHEN year = 1997 THEN jobs END')} AS emp_1997 FROM sector_long GROUP BY 1""",
    "sector_shares": """
        SELECT naics, emp_1996, share_1996, emp_1997, share_1997, emp_1997 - emp_1996 AS job_change,
               share_1997 - share_1996 AS share_change
        FROM (SELECT *, CAST(emp_1996 AS DOUBLE) / CAST(sum(emp_1996) OVER () AS DOUBLE) * 100 AS share_1996,
                     CAST(emp_1997 AS DOUBLE) / CAST(sum(emp_1997) OVER () AS DOUBLE) * 100 AS share_1997
              FROM sector_tot)""",
    "cluster_mix": f"""
        SELECT naics, pp_min, max(CASE WHEN year = 1996 THEN share END) AS x1996,
               max(CASE WHEN year = 1997 THEN share END) AS x1997
        FROM (SELECT f.year, f.pp_min, s.naics,
                     CAST(sum(s.jobs) AS DOUBLE) / CAST(sum(s.job_tot) AS DOUBLE) * 100 AS share
              FROM flags f JOIN sector_long s ON f.tract = s.tract AND f.year = s.year
              WHERE f.num_quant = 'mapvar_10' AND f.mapvar = 'cluster' AND f.year IN (1996, 1997)
              GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "county": f"""
        SELECT substr(fips, 1, 5) AS stcofips, {total('job_tot')} AS job_tot, {SUMS}
        FROM wac WHERE year = 1997 GROUP BY 1""",
    "emp_total": f"SELECT stcofips, 'RET' AS industry, {EMP_YEARS} FROM emp WHERE DBcode = 'RETAXAC'",
    "emp_sector": f"""
        SELECT stcofips, {pick('DBcode', ALL_SERIES, (*HARMONISED, 'naics_GV'))} AS naics,
               {', '.join(f'sum(y{y}) AS y{y}' for y in ALL_YEARS)}
        FROM emp WHERE DBcode <> 'RETAXAC' GROUP BY 1, 2""",
    "county_check": f"""
        SELECT *, {ratio('delta', 'm_tot')} AS percent_delta FROM (
            SELECT stcofips, job_tot, y1997, y1997 * 1000 AS m_tot, job_tot - y1997 * 1000 AS delta
            FROM county JOIN emp_total USING (stcofips))""",
    "county_sector": f"""
        SELECT c.stcofips, c.job_tot, c.naics, c.jobs, e.y1997
        FROM (SELECT stcofips, job_tot, {pick('code', SECTORS, HARMONISED)} AS naics, jobs
              FROM county UNPIVOT INCLUDE NULLS (jobs FOR code IN ({SECTOR_LIST}))) c
        LEFT JOIN emp_sector e ON c.stcofips = e.stcofips AND c.naics = e.naics""",
    "sector_check": f"""
        SELECT *, {ratio('delta', 'm_tot')} AS percent_delta, substr(naics, 7) AS short_name FROM (
            SELECT naics, jobs, y1997, y1997 * 1000 AS m_tot, jobs - y1997 * 1000 AS delta FROM (
                SELECT naics, {total('jobs')} AS jobs, coalesce(sum(y1997), CAST(0 AS DOUBLE)) AS y1997
                FROM county_sector GROUP BY 1)) WHERE naics <> 'naics_11'""",
    "metro_names": f"SELECT DISTINCT cbsa, cbsa_name, {short('cbsa_name')} AS short_name FROM xwalk",
    "metro_check": f"""
        SELECT *, {ratio('delta', 'm_tot')} AS percent_delta FROM (
            SELECT cbsa, job_tot, y1997, top100, y1997 * 1000 AS m_tot, job_tot - y1997 * 1000 AS delta FROM (
                SELECT cbsa, {total('job_tot')} AS job_tot, coalesce(sum(y1997), CAST(0 AS DOUBLE)) AS y1997,
                       {total('top100')} AS top100
                FROM county LEFT JOIN emp_total USING (stcofips) LEFT JOIN xwalk USING (stcofips) GROUP BY 1))
        LEFT JOIN metro_names USING (cbsa) WHERE top100 > 0""",
    "metro_sector": f"""
        SELECT *, CASE WHEN m_tot > 0 THEN delta / m_tot ELSE CAST(0 AS DOUBLE) END AS percent_delta,
               CASE WHEN job_tot > 0 THEN delta / job_tot ELSE CAST(0 AS DOUBLE) END AS delta_share FROM (
            SELECT cbsa, naics, job_tot, jobs, y1997, y1997 * 1000 AS m_tot, jobs - y1997 * 1000 AS delta FROM (
                SELECT cbsa, naics, {total('job_tot')} AS job_tot, {total('jobs')} AS jobs,
                       coalesce(sum(y1997), CAST(0 AS DOUBLE)) AS y1997
                FROM county_sector JOIN xwalk USING (stcofips) WHERE top100 = 1 GROUP BY 1, 2))
        LEFT JOIN metro_names USING (cbsa)""",
    "pop_ranked": """
        SELECT *, CASE WHEN pop_sqmi IS NOT NULL THEN ntile(100) OVER
               (PARTITION BY pop_sqmi IS NULL ORDER BY pop_sqmi, tract) END AS tile FROM pop_places""",
    "places": f"""
        SELECT tract, year, substr(tract, 1, 5) AS stcofips, substr(tract, 1, 2) AS stfips, job_tot,
               ALAND_SQMI, {SQMI} AS jobs_sqmi FROM lehd""",
    "ranked": """
        SELECT *, CASE WHEN jobs_sqmi IS NOT NULL THEN ntile(100) OVER
               (PARTITION BY year, jobs_sqmi IS NULL ORDER BY jobs_sqmi, tract) END AS tile FROM places""",
    "most_dense": "SELECT * EXCLUDE (tile) FROM ranked WHERE tile > 97",
    "usual": """
        SELECT p.*, x.cbsa, x.cbsa_name FROM places p JOIN xwalk x USING (stcofips)
        WHERE x.top100 = 1 AND p.ALAND_SQMI > 0
          AND NOT EXISTS (SELECT 1 FROM most_dense d WHERE d.tract = p.tract AND d.year = p.year)""",
    "block_groups": f"""
        SELECT blkgrp, year, job_tot, ALAND_SQMI, {SQMI} AS density, cbsa, cbsa_name FROM (
            SELECT substr(fips, 1, 25) AS blkgrp, year, {total('job_tot')} AS job_tot FROM wac GROUP BY 1, 2) j
        LEFT JOIN (SELECT substr({FIPS}, 1, 25) AS blkgrp, sum(CAST(floor(o_totalprice / 10000) AS DOUBLE)) AS ALAND_SQMI
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) a
        USING (blkgrp) LEFT JOIN xwalk ON substr(blkgrp, 1, 5) = stcofips""",
    "block_tiles": f"SELECT * FROM (SELECT *, {TILES.replace(', tract)', ', blkgrp)')} FROM block_groups)",
    "deltas": """
        SELECT CASE WHEN naics NOT IN ('naics_22', 'naics_61', 'naics_62', 'naics_GV') THEN percent_delta END AS percent_delta,
               delta_share FROM metro_sector""",
    "pop_places": f"""
        SELECT tract, substr(tract, 1, 5) AS stcofips, pop, ALAND_SQMI, {ratio('pop', 'ALAND_SQMI')} AS pop_sqmi
        FROM pop LEFT JOIN area USING (tract)""",
    "cuts": """
        SELECT cbsa, cbsa_name, year, percentile, n FROM (
            SELECT cbsa, cbsa_name, year, quantile_cont(density, 0.8) AS p80, quantile_cont(density, 0.85) AS p85,
                   quantile_cont(density, 0.9) AS p90, quantile_cont(density, 0.95) AS p95
            FROM dens WHERE top100 = 1 GROUP BY 1, 2, 3)
        UNPIVOT INCLUDE NULLS (n FOR percentile IN (p80, p85, p90, p95))""",
    "national_sectors": f"""
        SELECT naics, jobs FROM (SELECT {SUMS} FROM wac) UNPIVOT INCLUDE NULLS (jobs FOR naics IN ({SECTOR_LIST}))""",
    "curve_rows": """
        SELECT cbsa, year, density FROM dens WHERE density BETWEEN 0 AND 15000 AND cbsa IS NOT NULL""",
    "curve_width": """
        SELECT cbsa, year, n, CAST(0.9 AS DOUBLE) * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34)
                    WHEN sd > 0 THEN sd ELSE 1 END * pow(CAST(n AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS bw
        FROM (SELECT cbsa, year, count(*) AS n, stddev_samp(density) AS sd,
                     quantile_cont(density, 0.75) - quantile_cont(density, 0.25) AS iqr
              FROM curve_rows GROUP BY 1, 2) WHERE n > 1""",
    "shown_rows": f"""
        SELECT cbsa, year, density FROM dens WHERE density BETWEEN 0 AND 15000 AND cbsa_name = '{METRO}' AND year = 1997 AND {NOT_04}""",
    "shown_width": """
        SELECT cbsa, year, n, CAST(0.9 AS DOUBLE) * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34)
                    WHEN sd > 0 THEN sd ELSE 1 END * pow(CAST(n AS DOUBLE), CAST(-0.2 AS DOUBLE)) AS bw
        FROM (SELECT cbsa, year, count(*) AS n, stddev_samp(density) AS sd,
                     quantile_cont(density, 0.75) - quantile_cont(density, 0.25) AS iqr
              FROM shown_rows GROUP BY 1, 2) WHERE n > 1""",
    "shown_bins": """
        SELECT cbsa, year, least(floor(density / (CAST(15000 AS DOUBLE) / 4096)), 4095) AS bin, count(*) AS c, avg(density) AS centre
        FROM shown_rows GROUP BY 1, 2, 3""",
    "revised": f"""
        SELECT * REPLACE ({SQMI} AS density) FROM (
            SELECT * REPLACE (CASE WHEN year = 1997 AND job_tot % 2 = 1 THEN job_tot * 2 ELSE job_tot END AS job_tot) FROM dens)""",
    "hops": """
        SELECT tract AS old, concat(tract, 'a') AS new, 1 AS weight FROM area WHERE substr(tract, 1, 5) = '04024'
        UNION ALL SELECT concat(tract, 'a'), concat(tract, 'b'), 1 FROM area WHERE substr(tract, 1, 5) = '04024'
        UNION ALL SELECT concat(tract, 'b'), concat('04019', substr(tract, 6), CAST(k AS VARCHAR)), k
                  FROM area, (VALUES (1), (2)) AS v(k) WHERE substr(tract, 1, 5) = '04024'
        UNION ALL SELECT tract, '04009', 5 FROM area WHERE substr(tract, 1, 5) = '04014'""",
    "curve_bins": """
        SELECT cbsa, year, least(floor(density / (CAST(15000 AS DOUBLE) / 4096)), 4095) AS bin, count(*) AS c, avg(density) AS centre
        FROM curve_rows GROUP BY 1, 2, 3""",
}


def depends(text: str) -> list[str]:
    words = set(re.findall(r"\b[a-z_]+\b", re.sub(r"'[^']*'", "", text)))
    return [name for name in CTES if name in words]


def with_tables(body: str) -> str:
    """Put the needed common table expressions, in order of need, before a query."""
    done: list[str] = []

    def need(name: str) -> None:
        for other in depends(CTES[name]):
            if other != name:
                need(other)
        if name not in done:
            done.append(name)

    for name in depends(body):
        need(name)
    ctes = ",\n".join(f"{name} AS ({CTES[name]})" for name in done)
    return f"WITH {ctes}\n{body}" if ctes else body


def national_pair(denominator: str) -> str:
    side = "SELECT i.*, {share} AS share FROM in_clusters i JOIN {table} USING (year) WHERE year = {year}"
    share = ratio("jobs", "natl_job_tot") + " * 100"
    first, second = (side.format(share=share, table=denominator, year=y) for y in (1996, 1997))
    return f"""SELECT a.density_cut AS "Density", a.pp_min AS "Minimum job share",
        a.jobs AS "Jobs in clusters 1996", {r('a.share')} AS "% of jobs in clusters 1996",
        b.jobs AS "Jobs in clusters 1997", {r('b.share')} AS "% of jobs in clusters 1997"
        FROM ({first}) a JOIN ({second}) b ON a.density_cut = b.density_cut AND a.pp_min = b.pp_min"""


def histogram_rows(column: str) -> str:
    return f"""SELECT year, CAST(least(coalesce(floor(({column} - lo) / nullif(width, 0)), 0), 29) AS INT) AS bin,
        lo, width FROM places JOIN (
            SELECT year, min({column}) AS lo, (max({column}) - min({column})) / 30 AS width FROM places
            WHERE {column} IS NOT NULL AND NOT isinf({column}) GROUP BY 1) USING (year)
        WHERE {column} IS NOT NULL AND NOT isinf({column})"""


def summary_of(measure: str) -> str:
    q = lambda p: r(f"quantile_cont(CAST({measure} AS DOUBLE), {p})")
    return f"""SELECT year, '{measure}' AS measure, {r(f'min(CAST({measure} AS DOUBLE))')} AS min, {q(0.25)} AS q1,
        {q(0.5)} AS median, {r(f'avg(CAST({measure} AS DOUBLE))')} AS mean, {q(0.75)} AS q3,
        {r(f'max(CAST({measure} AS DOUBLE))')} AS max,
        {big(f'count(*) - count({measure})')} AS missing FROM places GROUP BY 1"""


def medians(column: str) -> str:
    return r(f"median(CAST(p.{column} AS DOUBLE))") + f" AS {column}"


BODIES = {
    "scan_area_tsv": "SELECT tract, ALAND_SQMI, substr(tract, 1, 5) AS stcofips FROM area",
    "stage_roundtrip": "SELECT * FROM lehd",
    "export_csv": "SELECT tract, year, job_tot, ALAND_SQMI FROM lehd",
    "stack_periods": "SELECT tract, year, job_tot, CASE WHEN year >= 1996 THEN naics_92 END AS naics_92 FROM lehd",
    "pad_code": """SELECT c_custkey,
        lpad(CAST(c_custkey AS VARCHAR), CAST((SELECT max(length(CAST(c_custkey AS VARCHAR))) FROM customer) AS INT), '0') AS code,
        CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 3 THEN CAST(c_custkey AS VARCHAR)
             ELSE lpad(CAST(c_custkey AS VARCHAR), 3, '0') END AS code3 FROM customer""",
    "key_levels": """SELECT fips, year, job_tot, substr(fips, 1, 2) AS state, substr(fips, 1, 5) AS county,
        substr(fips, 1, 24) AS tract, substr(fips, 1, 25) AS blkgrp FROM wac""",
    "remap_codes": f"""SELECT CASE WHEN substr(fips, 1, 5) = '04024' THEN concat('04019', substr(fips, 6, 18), '0')
            ELSE substr(fips, 1, 24) END AS tract, year, {total('job_tot')} AS job_tot FROM wac GROUP BY 1, 2""",
    "remap_chain": f"""SELECT * FROM (WITH RECURSIVE sized AS (SELECT *, sum(weight) OVER (PARTITION BY old) AS whole FROM hops),
        walk AS (SELECT old, new, weight AS num, whole AS den FROM sized
                 UNION ALL SELECT w.old, s.new, w.num * s.weight, w.den * s.whole FROM walk w JOIN sized s ON s.old = w.new),
        ends AS (SELECT old, new, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den FROM walk WHERE new NOT IN (SELECT old FROM hops)),
        counts AS (SELECT substr(fips, 1, 24) AS tract, year, {total('job_tot')} AS job_tot FROM wac GROUP BY 1, 2),
        parts AS (SELECT tract, year, coalesce(new, tract) AS new, job_tot, coalesce(num, 1) AS num, coalesce(den, 1) AS den
                  FROM counts LEFT JOIN ends ON tract = old),
        floors AS (SELECT *, job_tot * num // den AS f,
                       row_number() OVER (PARTITION BY tract, year ORDER BY CAST(job_tot * num % den AS DOUBLE) / den DESC, new) AS place
                   FROM parts)
        SELECT new AS tract, year, {total('f + more')} AS job_tot FROM (
            SELECT new, year, f, CASE WHEN place <= job_tot - sum(f) OVER (PARTITION BY tract, year) THEN 1 ELSE 0 END AS more FROM floors)
        GROUP BY 1, 2)""",
    "scan_problems": f"""SELECT p."column", p.expected, p.raw, {big('p.cells')} AS cells, {big('p.cells')} AS rows_hit,
            {big('c.rows_read')} AS rows_read, {big('c.areas')} AS areas, {big('c.blocks')} AS blocks FROM (
        SELECT 'ALAND_SQMI' AS "column", 'double' AS expected, 'n/a' AS raw, count(*) AS cells FROM area WHERE tract LIKE '%7'
        UNION ALL SELECT 'BLOCKS', 'int', 'twelve', count(*) FROM area WHERE tract LIKE '%3') p,
        (SELECT count(*) AS rows_read, count(CASE WHEN tract NOT LIKE '%7' THEN ALAND_SQMI END) AS areas,
                count(CASE WHEN tract NOT LIKE '%3' THEN 1 END) AS blocks FROM area) c""",
    "refresh_period": """SELECT tract, job_tot, density, cbsa, CASE WHEN density IS NOT NULL THEN CAST(ntile(20) OVER
            (PARTITION BY cbsa, year, density IS NULL ORDER BY density, tract) AS INT) END AS dense_cat_20, year,
        year IN (1997, 2001) AS rebuilt FROM revised""",
    "national_clusters_restricted": f"""SELECT year, {pick('num_quant', ('mapvar_20', 'mapvar_10', 'mapvar_5'), ('Top 5 percent', 'Top 10 percent', 'Top 20 percent'))} AS "Density",
        pp_min AS "Minimum job share", jobs AS "Jobs in clusters", {r(ratio('jobs', 'all_jobs') + ' * 100')} AS "% of jobs in clusters" FROM (
            SELECT year, num_quant, pp_min, {total("CASE WHEN mapvar = 'cluster' AND top100 = 1 THEN job_tot END")} AS jobs,
                   {total('CASE WHEN top100 = 1 THEN job_tot END')} AS all_jobs, count(CASE WHEN mapvar = 'cluster' AND top100 = 1 THEN 1 END) AS units
            FROM kept_flags GROUP BY 1, 2, 3) WHERE units > 0""",
    "dashboard_describe": f"""SELECT s.cbsa, s.cbsa_name, s.year, s.tr_ct, s.jobs, c.lat, c.lon FROM (
        SELECT DISTINCT cbsa, cbsa_name, year, tr_ct, jobs FROM summary_all WHERE cbsa_name = '{METRO}' AND year = 1997) s
        LEFT JOIN (SELECT * FROM centres WHERE cbsa <> 'M2') c ON s.cbsa = c.cbsa""",
    "dashboard_distribution": f"""SELECT cbsa, year, CAST(point AS INT) AS point, {r('CAST(point AS DOUBLE) * (CAST(15000 AS DOUBLE) / 511)', 8)} AS x,
        {r('s / (n * bw * sqrt(2 * pi()))', 8)} AS y, {r('p80', 8)} AS p80, {r('p90', 8)} AS p90, {r('p95', 8)} AS p95
        FROM (SELECT cbsa, year, n, bw, point,
                 sum(c * exp(CAST(-0.5 AS DOUBLE) * pow((CAST(point AS DOUBLE) * (CAST(15000 AS DOUBLE) / 511)
                     - centre) / bw, 2))) AS s
              FROM shown_bins JOIN shown_width USING (cbsa, year), range(0, 512) g(point) GROUP BY 1, 2, 3, 4, 5)
        JOIN (SELECT cbsa, year, max(CASE WHEN percentile = 'p80' THEN n END) AS p80,
                 max(CASE WHEN percentile = 'p90' THEN n END) AS p90, max(CASE WHEN percentile = 'p95' THEN n END) AS p95
              FROM cuts GROUP BY 1, 2) USING (cbsa, year)""",
    "rollup_buckets": "SELECT tract, year, job_tot, ALAND_SQMI FROM lehd",
    "moments_by_state": f"""SELECT substr(tract, 1, 2) AS stfips, year, {big('count(*)')} AS n, {r('avg(ALAND_SQMI)')} AS mean,
        {r('stddev_samp(ALAND_SQMI)')} AS sd, min(ALAND_SQMI) AS min, max(ALAND_SQMI) AS max, {r('corr(job_tot, ALAND_SQMI)')} AS correlation,
        {r('regr_slope(job_tot, ALAND_SQMI)')} AS slope, {r('regr_intercept(job_tot, ALAND_SQMI)')} AS intercept
        FROM lehd WHERE ALAND_SQMI IS NOT NULL AND job_tot IS NOT NULL GROUP BY 1, 2""",
    "distinct_over_years": f"""SELECT cbsa, {big('count(DISTINCT tract)')} AS tracts, span FROM dens, (
            VALUES ('one', 1997, 1997), ('two', 1996, 1997), ('all', 1995, 2001)) AS spans(span, low, high)
        WHERE job_tot > 0 AND year BETWEEN low AND high GROUP BY 1, 3""",
    "window_layer": """SELECT geoid, x AS west, y AS south, x + s AS east, y + s AS north FROM bounds
        WHERE x <= 12 AND x + s >= 2 AND y <= 600 AND y + s >= 100""",
    "compose_key": f"""SELECT o_orderkey, concat({COUNTY},
        lpad(CAST(o_custkey AS VARCHAR), CAST((SELECT max(length(CAST(o_custkey AS VARCHAR))) FROM orders) AS INT), '0'),
        lpad(CAST(o_orderkey AS VARCHAR), CAST((SELECT max(length(CAST(o_orderkey AS VARCHAR))) FROM orders) AS INT), '0')) AS fips
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "sector_label": f"SELECT naics, {pick('naics', SECTORS, LABELS)} AS naics_label, jobs FROM national_sectors",
    "harmonise_sector": f"SELECT naics, jobs, {pick('naics', SECTORS, HARMONISED)} AS harmonised FROM national_sectors",
    "split_id": f"""SELECT stcofips, split_part(DBcode, 'A', 1) AS industry, split_part(DBcode, 'A', 2) AS sep,
        split_part(DBcode, 'A', 3) AS geo, {EMP_YEARS} FROM emp""",
    "select_family": f"SELECT stcofips, DBcode AS dbcode, {', '.join(f'y{y}' for y in ALL_YEARS if y >= 1997)} FROM emp",
    "short_name": f"SELECT stcofips, cbsa_name, {short('cbsa_name')} AS short_name FROM xwalk_all",
    "xwalk_subset": "SELECT DISTINCT cbsa, cbsa_name FROM xwalk WHERE top100 = 1",
    "exclude_regions": f"""SELECT tract, year, cbsa, job_tot FROM dens
        WHERE {NOT_04} AND (cbsa IS NULL OR cbsa <> 'M2')""",
    "universe_filter": """SELECT tract AS geoid, ALAND_SQMI FROM area
        WHERE TRY_CAST(substr(tract, 1, 2) AS INT) < 57 AND substr(tract, 1, 2) NOT IN ('02', '15')""",
    "coords_backfill": """SELECT cbsa, CASE WHEN cbsa = 'M2' THEN CAST(29.5 AS DOUBLE)
            WHEN lat = 0 AND lon = 0 OR lat IS NULL THEN CAST(41.5 AS DOUBLE) ELSE lat END AS lat,
        CASE WHEN cbsa = 'M2' THEN CAST(-98.5 AS DOUBLE)
            WHEN lat = 0 AND lon = 0 OR lat IS NULL THEN CAST(-71.25 AS DOUBLE) ELSE lon END AS lon FROM centres""",
    "join_area_metro": """SELECT tract, year, job_tot, ALAND_SQMI, substr(tract, 1, 5) AS stcofips, cbsa, cbsa_name FROM dens""",
    "join_nullsafe": f"""SELECT d.tract, d.year, d.cbsa, d.job_tot, m.metro_jobs FROM dens d LEFT JOIN (
        SELECT cbsa, year, {total('job_tot')} AS metro_jobs FROM dens GROUP BY 1, 2) m
        ON d.cbsa IS NOT DISTINCT FROM m.cbsa AND d.year = m.year""",
    "merge_periods": f"""SELECT a.county, a.job_tot AS job_tot_1996, b.job_tot AS job_tot_1997
        FROM (SELECT substr(fips, 1, 5) AS county, {total('job_tot')} AS job_tot FROM wac WHERE year = 1996 GROUP BY 1) a
        JOIN (SELECT substr(fips, 1, 5) AS county, {total('job_tot')} AS job_tot FROM wac WHERE year = 1997 GROUP BY 1) b
        ON a.county = b.county""",
    "thresholds_full_join": f"""SELECT cbsa, cbsa_name, percentile, {r('a.n')} AS n_1996, {r('b.n')} AS n_1997
        FROM (SELECT * FROM cuts WHERE year = 1996) a FULL JOIN (SELECT * FROM cuts WHERE year = 1997) b
        USING (cbsa, cbsa_name, percentile)""",
    "geo_attribute_join": """SELECT geoid, tract, job_tot, density, ALAND_SQMI, dense_cat_20, dense_cat_10, dense_cat_5,
        most_dense_20, most_dense_10, most_dense_5, mapvar_20, mapvar_10, mapvar_5, x AS west, y + s AS north
        FROM bounds JOIN cats ON geoid = tract""",
    "select_group_units": """SELECT tract, year, job_tot, ALAND_SQMI FROM lehd
        WHERE substr(tract, 1, 5) IN (SELECT stcofips FROM xwalk WHERE top100 = 1 AND cbsa = 'M1')""",
    "anti_dense": "SELECT tract, year, cbsa_name, jobs_sqmi FROM usual",
    "rollup_tract": "SELECT * FROM lehd",
    "rollup_county": f"SELECT substr(fips, 1, 5) AS stcofips, year, {total('job_tot')} AS job_tot, {SUMS} FROM wac GROUP BY 1, 2",
    "rollup_state_density": f"""SELECT *, {SQMI} AS jobs_sqmi FROM (
        SELECT substr(tract, 1, 2) AS state, year, {total('job_tot')} AS job_tot,
               coalesce(sum(ALAND_SQMI), CAST(0 AS DOUBLE)) AS ALAND_SQMI FROM lehd GROUP BY 1, 2)""",
    "rollup_county_density": f"""SELECT *, {SQMI} AS jobs_sqmi FROM (
        SELECT substr(tract, 1, 5) AS county, year, {total('job_tot')} AS job_tot,
               coalesce(sum(ALAND_SQMI), CAST(0 AS DOUBLE)) AS ALAND_SQMI FROM lehd GROUP BY 1, 2)""",
    "tile_shares": "SELECT year, "
    + ", ".join(
        f"{r(f'CAST(sum(CASE WHEN most_dense_{n} THEN job_tot ELSE 0 END) AS DOUBLE) / CAST(sum(job_tot) AS DOUBLE)')} AS top_{n}"
        for n in (20, 10, 5)
    )
    + " FROM tiles GROUP BY 1",
    "national_totals": "SELECT * FROM natl_jobs",
    "top_metro_totals": "SELECT * FROM top_jobs",
    "dense_share": f"""SELECT year, {r("CAST(sum(CASE WHEN tile > 97 THEN job_tot ELSE 0 END) AS DOUBLE) / CAST(sum(job_tot) AS DOUBLE)")} AS dense_share,
        {total('CASE WHEN tile > 97 THEN 1 END')} AS dense_units FROM ranked GROUP BY 1""",
    "metro_medians": f"""SELECT m.*, f.Freq, {short('m.cbsa_name')} AS short_name FROM (
            SELECT cbsa, cbsa_name, year, {medians('job_tot')}, {medians('ALAND_SQMI')}, {medians('jobs_sqmi')}
            FROM places p JOIN xwalk USING (stcofips) WHERE top100 = 1 AND p.ALAND_SQMI > 0 GROUP BY 1, 2, 3) m
        LEFT JOIN (SELECT cbsa_name, year, {big('count(*)')} AS Freq FROM most_dense JOIN xwalk USING (stcofips) GROUP BY 1, 2) f
        ON m.cbsa_name = f.cbsa_name AND m.year = f.year""",
    "metro_thresholds": f"SELECT cbsa, cbsa_name, year, percentile, {r('n')} AS n FROM cuts",
    "six_number_summary": f"{summary_of('job_tot')} UNION ALL {summary_of('jobs_sqmi')}",
    "flag_counts": f"""SELECT year, {total('CASE WHEN most_dense_20 THEN 1 END')} AS n_true,
        {total('CASE WHEN NOT most_dense_20 THEN 1 END')} AS n_false,
        {total('CASE WHEN most_dense_20 IS NULL THEN 1 END')} AS n_missing FROM tiles GROUP BY 1""",
    "freq_table": f"SELECT year, cbsa_name, {big('count(*)')} AS Freq FROM most_dense JOIN xwalk USING (stcofips) GROUP BY 1, 2",
    "dense_coverage": f"""SELECT year, {big('count(DISTINCT cbsa_name)')} AS metros,
        {total('CASE WHEN cbsa IS NULL THEN 1 END')} AS no_metro, {total('top100')} AS top100
        FROM most_dense LEFT JOIN xwalk USING (stcofips) GROUP BY 1""",
    "argmax_area": """SELECT stcofips, tract, pop, ALAND_SQMI FROM (
        SELECT *, row_number() OVER (PARTITION BY stcofips ORDER BY pop DESC, tract) AS k FROM pop_places) WHERE k = 1""",
    "industry_totals": f"""SELECT naics, {pick('naics', SECTORS, LABELS)} AS naics_label, emp_1996, {r('share_1996')} AS share_1996,
            emp_1997, {r('share_1997')} AS share_1997, job_change, {r('share_change')} AS share_change FROM sector_shares
        UNION ALL
        SELECT 'Total', NULL, {total('emp_1996')}, {r('sum(share_1996)')}, {total('emp_1997')}, {r('sum(share_1997)')},
            {total('job_change')}, {r('sum(share_change)')} FROM sector_shares""",
    "density_corr": f"""SELECT year, {r('corr(jobs_sqmi, pop_sqmi)')} AS correlation,
        {total('CASE WHEN jobs_sqmi IS NOT NULL AND pop_sqmi IS NOT NULL THEN 1 END')} AS units,
        {total('CASE WHEN jobs_sqmi IS NULL OR pop_sqmi IS NULL THEN 1 END')} AS unmatched
        FROM places p LEFT JOIN pop_places q ON p.tract = q.tract AND p.ALAND_SQMI IS NOT DISTINCT FROM q.ALAND_SQMI
        WHERE p.ALAND_SQMI > 0 GROUP BY 1""",
    "density_tiles": """SELECT tract, year, job_tot, ALAND_SQMI, density, cbsa, cbsa_name, dense_cat_20, dense_cat_10,
        dense_cat_5, most_dense_20, most_dense_10, most_dense_5 FROM tiles""",
    "top_percentiles": "SELECT * FROM most_dense",
    "unpivot_sectors": "SELECT * FROM sector_long",
    "pivot_years": f"""SELECT county, {', '.join(f"CAST(max(CASE WHEN year = {y} THEN job_tot END) AS BIGINT) AS year_{y}" for y in ALL_YEARS)} FROM (
            SELECT substr(fips, 1, 5) AS county, year, {total('job_tot')} AS job_tot FROM wac GROUP BY 1, 2) GROUP BY 1""",
    "overview_table": f"""SELECT num_quant AS "Density threshold", min AS "Min % jobs", cluster_jobs AS "Jobs in clusters",
        cluster_ct AS "Number of clusters", {r('job_share')} AS "% jobs in clusters"
        FROM shares WHERE cbsa_name = '{METRO}' AND year = 1997 ORDER BY 2, 1""",
    "rank_categories": f"""SELECT year, cbsa_name, {r('mean')} AS mean,
        row_number() OVER (PARTITION BY year ORDER BY mean DESC, cbsa_name NULLS FIRST) AS position FROM (
            SELECT year, cbsa_name, avg(jobs_sqmi) AS mean FROM places LEFT JOIN xwalk USING (stcofips)
            WHERE ALAND_SQMI > 0 GROUP BY 1, 2)""",
    "tract_density": "SELECT tract, year, job_tot, ALAND_SQMI, density, cbsa, cbsa_name FROM dens",
    "block_density": "SELECT * FROM block_groups",
    "block_categories": f"""SELECT blkgrp, year, cbsa, density,
        CASE {LOW} WHEN dense_cat_20 = 19 THEN 'p90' WHEN dense_cat_20 = 20 THEN 'cluster' END AS mapvar_20,
        CASE {LOW} WHEN dense_cat_10 = 10 THEN 'cluster' END AS mapvar_10,
        CASE WHEN dense_cat_20 IS NULL THEN NULL WHEN dense_cat_20 >= 17 THEN 'cluster' ELSE 'low density' END AS mapvar_5
        FROM block_tiles""",
    "block_quantiles": " UNION ALL ".join(
        f"""SELECT year, '{m}' AS measure, {big(f'count({m})')} AS n, """
        + ", ".join(f"{r(f'quantile_cont(CAST({m} AS DOUBLE), {p / 100})')} AS p{p}" for p in (80, 90, 95))
        + " FROM block_groups GROUP BY 1"
        for m in ("job_tot", "density")
    ),
    "map_categories": "SELECT tract, year, cbsa, mapvar_20, mapvar_10, mapvar_5 FROM cats",
    "categories_long": "SELECT tract, year, job_tot, ALAND_SQMI, density, cbsa, cbsa_name, num_quant, mapvar FROM long",
    "metro_minimums": f"SELECT cbsa, cbsa_name, year, job_tot, pp_min, {r('job_min')} AS job_min FROM met_jobs",
    "minimums_lookup": f"SELECT cbsa, year, {r('job_min')} AS job_min FROM met_jobs WHERE pp_min = 'half_pp'",
    "cluster_flags": f"""SELECT tract, year, cbsa, job_tot, num_quant, pp_min, {r('job_min')} AS job_min, mapvar FROM flags""",
    "metro_summary": "SELECT * FROM summary",
    "metro_summary_all": "SELECT * FROM summary_all",
    "dashboard_overview": f"""SELECT {pick('num_quant', ('mapvar_20', 'mapvar_10', 'mapvar_5'),
                                ('95th percentile', '90th percentile', '80th percentile'))} AS "Density threshold",
        min AS "Min % jobs", cluster_jobs AS "Jobs in clusters", cluster_ct AS "Number of clusters",
        {r(ratio('cluster_jobs', 'jobs') + ' * 100')} AS "% jobs in clusters"
        FROM summary_all WHERE cbsa_name = '{METRO}' AND year = 1997""",
    "pop_dense_share": f"""SELECT {r("CAST(sum(CASE WHEN tile > 97 THEN pop ELSE 0 END) AS DOUBLE) / CAST(sum(pop) AS DOUBLE)")} AS dense_share,
        {total('CASE WHEN tile > 97 THEN 1 END')} AS dense_units FROM pop_ranked""",
    "pop_linear_fit": f"""SELECT {r('regr_slope(pop, ALAND_SQMI)')} AS slope, {r('regr_intercept(pop, ALAND_SQMI)')} AS intercept,
        {r('regr_r2(pop, ALAND_SQMI)')} AS r2, {big('regr_count(pop, ALAND_SQMI)')} AS n FROM pop_places""",
    "block_density_metro": "SELECT * FROM block_groups WHERE cbsa = 'M1'",
    "recon_metro_sector_unguarded": f"""SELECT cbsa, naics, job_tot, jobs, {r('y1997')} AS y1997, {r('m_tot')} AS m_tot,
        {r('delta')} AS delta, {r(ratio('delta', 'm_tot'))} AS percent_delta, {r('delta_share')} AS delta_share,
        cbsa_name, short_name FROM metro_sector""",
    "metro_shares": f"""SELECT * REPLACE ({r('cluster_share')} AS cluster_share, {r('job_share')} AS job_share) FROM shares""",
    "metro_two_year": "SELECT a.cbsa, a.cbsa_name, a.num_quant, a.min, "
    + ", ".join(
        f"{t}.{c} AS {c}_{y}" if c not in ("cluster_share", "job_share") else f"{r(f'{t}.{c}')} AS {c}_{y}"
        for t, y in (("a", 1996), ("b", 1997))
        for c in ("jobs", "cluster_jobs", "tr_ct", "high_ct", "cluster_ct", "cluster_share", "job_share")
    )
    + """ FROM (SELECT * FROM shares WHERE year = 1996) a JOIN (SELECT * FROM shares WHERE year = 1997) b
        ON a.cbsa = b.cbsa AND a.num_quant = b.num_quant AND a.min = b.min""",
    "national_clusters": f"""SELECT year, density_cut AS "Density", pp_min AS "Minimum job share", jobs AS "Jobs in clusters",
        {r(ratio('jobs', 'natl_job_tot') + ' * 100')} AS "% of jobs in clusters"
        FROM in_clusters JOIN natl_jobs USING (year)""",
    "national_two_year": national_pair("natl_jobs"),
    "national_two_year_topmetro": national_pair("top_jobs"),
    "industry_cluster_shares": f"SELECT naics, pp_min, {r('x1996')} AS x1996, {r('x1997')} AS x1997 FROM cluster_mix",
    "location_quotient": f"""SELECT naics, {pick('naics', SECTORS, LABELS)} AS naics_label, pp_min,
        {r('x1996')} AS x1996, {r('x1997')} AS x1997, {r('share_1996')} AS share_1996, {r('share_1997')} AS share_1997,
        {r(ratio('x1996', 'share_1996'))} AS lq_1996, {r(ratio('x1997', 'share_1997'))} AS lq_1997
        FROM cluster_mix LEFT JOIN sector_shares USING (naics)""",
    "recon_prepare": f"""SELECT stcofips, naics, {', '.join(f"{r(f'y{y}')} AS y{y}" for y in ALL_YEARS)} FROM emp_sector
        UNION ALL SELECT stcofips, industry, {', '.join(r(f'y{y}') for y in ALL_YEARS)} FROM emp_total""",
    "recon_county": f"""SELECT stcofips, job_tot, {r('y1997')} AS y1997, {r('m_tot')} AS m_tot, {r('delta')} AS delta,
        {r('percent_delta')} AS percent_delta FROM county_check""",
    "recon_overall": f"""SELECT {r('sum(delta)')} AS delta, {r('sum(m_tot)')} AS m_tot,
        {r('sum(delta) / sum(m_tot)')} AS percent_delta FROM county_check""",
    "recon_sector": f"""SELECT naics, jobs, {r('y1997')} AS y1997, {r('m_tot')} AS m_tot, {r('delta')} AS delta,
        {r('percent_delta')} AS percent_delta, short_name FROM sector_check""",
    "recon_metro": f"""SELECT cbsa, job_tot, {r('y1997')} AS y1997, top100, {r('m_tot')} AS m_tot, {r('delta')} AS delta,
        {r('percent_delta')} AS percent_delta, cbsa_name, short_name FROM metro_check""",
    "recon_metro_sector": f"""SELECT cbsa, naics, job_tot, jobs, {r('y1997')} AS y1997, {r('m_tot')} AS m_tot,
        {r('delta')} AS delta, {r('percent_delta')} AS percent_delta, {r('delta_share')} AS delta_share,
        cbsa_name, short_name FROM metro_sector""",
    "recon_wide_gap": f"""SELECT cbsa, cbsa_name, {r('percent_delta')} AS percent_delta,
        CAST(CASE WHEN abs(percent_delta) > abs((SELECT sum(delta) / sum(m_tot) FROM county_check)) THEN 1 ELSE 0 END AS INT) AS wide_gap,
        abs(percent_delta) > 0.05 AS over_limit FROM metro_check""",
    "recon_long": f"""SELECT naics, short_name, 'jobs' AS source, {r('CAST(jobs AS DOUBLE)')} AS job_ct FROM sector_check
        UNION ALL SELECT naics, short_name, 'm_tot', {r('m_tot')} FROM sector_check""",
    "recon_histogram": f"""SELECT bin, {r('lo + bin * width')} AS lower, {r('lo + (bin + 1) * width')} AS upper,
        {big('count(*)')} AS n FROM (
            SELECT lo, width, CAST(least(coalesce(floor((percent_delta - lo) / nullif(width, 0)), 0), 29) AS INT) AS bin
            FROM county_check, (SELECT min(percent_delta) AS lo, (max(percent_delta) - min(percent_delta)) / 30 AS width
                FROM county_check WHERE percent_delta IS NOT NULL AND NOT isinf(percent_delta))
            WHERE percent_delta IS NOT NULL AND NOT isinf(percent_delta)) GROUP BY bin, lo, width""",
    "recon_delta_summary": " UNION ALL ".join(
        f"""SELECT '{m}' AS measure, {r(f'min({m})')} AS min, {r(f'quantile_cont({m}, 0.25)')} AS q1,
        {r(f'quantile_cont({m}, 0.5)')} AS median, {r(f'avg({m})')} AS mean, {r(f'quantile_cont({m}, 0.75)')} AS q3,
        {r(f'max({m})')} AS max, {big(f'count(*) - count({m})')} AS missing FROM deltas"""
        for m in ("percent_delta", "delta_share")
    ),
    "pop_density": f"""SELECT tract, stcofips, pop, ALAND_SQMI, pop_sqmi, cbsa, cbsa_name, {short('cbsa_name')} AS short_name
        FROM pop_places LEFT JOIN xwalk USING (stcofips)""",
    "histogram": f"""SELECT year, bin, {r('lo + bin * width')} AS lower, {r('lo + (bin + 1) * width')} AS upper,
        {big('count(*)')} AS n FROM ({histogram_rows('jobs_sqmi')}) GROUP BY year, bin, lo, width""",
    "freq_polygon": f"""SELECT e.year, e.bin, {r('e.lo + (e.bin + CAST(0.5 AS DOUBLE)) * e.width')} AS mid,
        {big('count(h.bin)')} AS n FROM (
            SELECT DISTINCT year, lo, width, CAST(k AS INT) AS bin FROM ({histogram_rows('ALAND_SQMI')}), range(0, 30) t(k)) e
        LEFT JOIN ({histogram_rows('ALAND_SQMI')}) h ON e.year = h.year AND e.bin = h.bin
        GROUP BY e.year, e.bin, e.lo, e.width""",
    "density_curve": f"""SELECT cbsa, year, CAST(point AS INT) AS point, {r('CAST(point AS DOUBLE) * (CAST(15000 AS DOUBLE) / 511)', 8)} AS x,
        {r('s / (n * bw * sqrt(2 * pi()))', 8)} AS y, {r('p80', 8)} AS p80, {r('p90', 8)} AS p90, {r('p95', 8)} AS p95
        FROM (SELECT cbsa, year, n, bw, point,
                 sum(c * exp(CAST(-0.5 AS DOUBLE) * pow((CAST(point AS DOUBLE) * (CAST(15000 AS DOUBLE) / 511)
                     - centre) / bw, 2))) AS s
              FROM curve_bins JOIN curve_width USING (cbsa, year), range(0, 512) g(point) GROUP BY 1, 2, 3, 4, 5)
        JOIN (SELECT cbsa, year, max(CASE WHEN percentile = 'p80' THEN n END) AS p80,
                 max(CASE WHEN percentile = 'p90' THEN n END) AS p90, max(CASE WHEN percentile = 'p95' THEN n END) AS p95
              FROM cuts GROUP BY 1, 2) USING (cbsa, year)""",
    "box_stats": f"""SELECT cbsa_name, year, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
        {r('min(CASE WHEN ok THEN jobs_sqmi END)')} AS whisker_low, {r('max(CASE WHEN ok THEN jobs_sqmi END)')} AS whisker_high,
        {total('CASE WHEN NOT ok THEN 1 END')} AS outliers FROM (
            SELECT u.*, q1, median, q3,
                   jobs_sqmi BETWEEN q1 - (q3 - q1) * CAST(1.5 AS DOUBLE) AND q3 + (q3 - q1) * CAST(1.5 AS DOUBLE) AS ok
            FROM usual u JOIN (
                SELECT cbsa_name, year, quantile_cont(jobs_sqmi, 0.25) AS q1, quantile_cont(jobs_sqmi, 0.5) AS median,
                       quantile_cont(jobs_sqmi, 0.75) AS q3 FROM usual GROUP BY 1, 2) USING (cbsa_name, year))
        GROUP BY cbsa_name, year, q1, median, q3""",
    "linear_fit": f"""SELECT year, {r('regr_slope(job_tot, ALAND_SQMI)')} AS slope, {r('regr_intercept(job_tot, ALAND_SQMI)')} AS intercept,
        {r('regr_r2(job_tot, ALAND_SQMI)')} AS r2, {big('regr_count(job_tot, ALAND_SQMI)')} AS n FROM places GROUP BY 1""",
    "stack_fill": f"""SELECT cbsa, naics, jobs,
        {r('CAST(jobs AS DOUBLE) / CAST(sum(jobs) OVER (PARTITION BY cbsa) AS DOUBLE)')} AS part FROM metro_sector""",
    "boundary_vertices": """SELECT x + s * dx AS long, y + s * dy AS lat, CAST(k AS INT) AS "order", CAST(1 AS INT) AS ring,
        geoid AS tract FROM bounds, corners""",
    "choropleth_rows": f"""SELECT v.long, v.lat, v."order", v.ring, v.stcofips, d.year, d.dense_places, d.top_jobs_sqmi FROM (
        SELECT CAST(n_nationkey + dx AS DOUBLE) AS long, CAST(n_regionkey + dy AS DOUBLE) AS lat, CAST(k AS INT) AS "order",
               CAST(1 AS INT) AS ring, {COUNTY} AS stcofips FROM nation, corners) v LEFT JOIN (
        SELECT stcofips, year, {big('count(*)')} AS dense_places, max(jobs_sqmi) AS top_jobs_sqmi FROM most_dense GROUP BY 1, 2) d
        USING (stcofips)""",
    "cluster_view": f"""SELECT geoid, tract, job_tot, density, ALAND_SQMI, mapvar, x AS west, y + s AS north
        FROM bounds JOIN kept_flags ON geoid = tract
        WHERE cbsa_name = '{METRO}' AND year = 1997 AND num_quant = 'mapvar_10' AND pp_min = 0.25""",
    "dashboard_view": f"""SELECT geoid, tract, job_tot, density, ALAND_SQMI, mapvar, x AS west, y + s AS north
        FROM bounds JOIN kept_flags ON geoid = tract
        WHERE cbsa_name = '{METRO}' AND year = 1997 AND num_quant = 'mapvar_10' AND pp_min = 0.25""",
    "describe_metro": f"""SELECT s.cbsa, s.cbsa_name, s.year, s.tr_ct, s.jobs, c.lat, c.lon FROM (
        SELECT DISTINCT cbsa, cbsa_name, year, tr_ct, jobs FROM shares WHERE cbsa_name = '{METRO}' AND year = 1997) s
        LEFT JOIN centres c ON s.cbsa = c.cbsa""",
}


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(body) for name, body in BODIES.items()}
