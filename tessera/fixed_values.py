"""Values that have to be exactly these for results to be right.

Everything here is a fixed value: code lists, labels, shares and cut names that
published result tables depend on.
"""

# Number of characters of the place key at each level.
KEY_LEVELS = {"state": 2, "county": 5, "tract": 11, "blkgrp": 12}

# Sector code -> label.
SECTOR_LABELS = {
    "naics_11": "Logging",
    "naics_21": "Extraction",
    "naics_22": "Utilities",
    "naics_23": "Construction",
    "naics_31to33": "Manufacturing",
    "naics_42": "Wholesale",
    "naics_44to45": "Retail",
    "naics_48to49": "Logistics",
    "naics_51": "Information",
    "naics_52": "Finance & insurance",
    "naics_53": "Real estate",
    "naics_54": "Prof/sci/tech services",
    "naics_55": "Management",
    "naics_56": "Admin & waste management",
    "naics_61": "Education",
    "naics_62": "Health care",
    "naics_71": "Arts",
    "naics_72": "Hospitality",
    "naics_81": "Other services",
    "naics_92": "Public administration",
}

# Sector codes of the first source -> codes of the second source.
HARMONISED_SECTORS = {"31to33": "MF", "44to45": "RT", "48to49": "RW", "92": "GV"}

# Second source, industry code of the all-industries row.
ALL_INDUSTRIES = "RET"

# Sectors left out of two-source comparisons.
UNCOMPARABLE_SECTOR = "naics_11"
UNRELIABLE_SECTORS = ("naics_22", "naics_61", "naics_62", "naics_GV")

# Tile counts, and the cluster cut each of them stands for.
TILE_COUNTS = (20, 10, 5)
CUT_COLUMNS = ("mapvar_20", "mapvar_10", "mapvar_5")

# How a cut is named in the national and in the metro tables.
NATIONAL_CUT_NAMES = {
    "mapvar_20": "Top 5 percent",
    "mapvar_10": "Top 10 percent",
    "mapvar_5": "Top 20 percent",
}
METRO_CUT_NAMES = {
    "mapvar_20": "95th percentile",
    "mapvar_10": "90th percentile",
    "mapvar_5": "80th percentile",
}

# Dashboard choice number -> cut.
CUT_CHOICES = {1: "mapvar_20", 2: "mapvar_10", 3: "mapvar_5"}

# Minimum share in percent -> (name, factor on the metro's jobs).
MINIMUM_SHARES = {
    0.0: ("zero_pp", 0.0),
    0.25: ("oquart_pp", 0.0025),
    0.5: ("half_pp", 0.005),
    0.75: ("tquart_pp", 0.0075),
    1.0: ("one_pp", 0.01),
}

# The shorter grid used by the national tables.
NATIONAL_MINIMUMS = (0.25, 0.5, 0.75)

# Density cut-points kept per metro.
THRESHOLD_PERCENTILES = {"p80": 0.80, "p85": 0.85, "p90": 0.90, "p95": 0.95}

# Regions without comparable data, and the metros they empty.
EXCLUDED_STATES = ("25", "56")
EXCLUDED_METROS_NATIONAL = ("14460",)
EXCLUDED_METROS_DASHBOARD = ("14460", "49340")

# Contiguous universe, state codes below the bound except these.
STATE_CODE_BOUND = 57
STATES_OUTSIDE_UNIVERSE = ("02", "15")

# Metro class kept by the crosswalk.
METROPOLITAN = "Metropolitan Statistical Area"

# Metro centres set by hand, (cbsa, lat, lon).
CENTRE_OVERRIDES = (
    ("38300", 40.4313473, -80.05054),
    ("41700", 29.4813572, -98.6544876),
    ("49180", 36.1045516, -80.3134975),
)

# Density curve grid and the range of values it is drawn over.
CURVE_POINTS = 512
CURVE_RANGE = (0.0, 15000.0)

# Bins of a histogram, wide gap between two sources.
HISTOGRAM_BINS = 30
WIDE_GAP = 0.05
