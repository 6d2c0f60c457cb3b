"""Tessera: density clusters over hierarchical places, as Spark DataFrame operators.

The package is a library of ``DataFrame -> DataFrame`` functions.  Counts keyed by
a prefix-coded place are rolled up, turned into densities, tiled inside each
region and period, labelled as clusters under a grid of definitions, and
summarised nationally, by region and by sector.
"""

__version__ = "0.1.0"
