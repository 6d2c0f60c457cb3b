"""Fixed schemas of the inputs.  Place keys are text: they have leading zeros."""

from __future__ import annotations

from pyspark.sql import types as T

from tessera import fixed_values as fv


def schema(**fields: str) -> T.StructType:
    types = {
        "text": T.StringType(),
        "int": T.IntegerType(),
        "long": T.LongType(),
        "double": T.DoubleType(),
    }
    return T.StructType([T.StructField(n, types[t], True) for n, t in fields.items()])


AREA = schema(GEOID="text", ALAND_SQMI="double")
CROSSWALK = schema(stcofips="text", cbsa="text", cbsa_name="text", metro_micro="text", top100="int")
CENTRES = schema(cbsa="text", cbsa_name="text", lat="double", lon="double")
POPULATION = schema(tract="text", pop="long")
BLOCK_AREA = schema(county="text", tract="double", block="text", LandSQMI="double")
COUNTS = schema(fips="text", job_tot="long", **{code: "long" for code in fv.SECTOR_LABELS})
