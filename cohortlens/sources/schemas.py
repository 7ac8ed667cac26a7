"""Explicit schemas of the count, attribute and panel tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Measure columns of the count tables, in request order.
MEASURES = (
    "B19013_001E", "B19301_001E",
    "B15002_019E", "B15002_032E", "B15002_033E", "B15002_034E", "B15002_035E",
    "B15002_002E", "B15002_015E", "B15002_016E", "B15002_017E", "B15002_018E",
    "B08301_001E", "B08301_003E", "B08301_004E", "B08301_010E", "B08301_019E", "B08301_021E",
    "B02001_001E", "B02001_002E", "B02001_003E",
    "B01002_001E", "B01003_001E",
)
# Measures that are not whole numbers.
FRACTIONAL_MEASURES = ("B01002_001E",)
# Key columns of the count tables.
COUNT_KEYS = ("GEO_ID", "NAME", "state", "county", "tract")
# Columns of the attribute tables.
ATTRIBUTES = (
    "STATEFP10", "COUNTYFP10", "TRACTCE10", "GEOID10", "NAME10", "NAMELSAD10",
    "MTFCC10", "FUNCSTAT10", "ALAND10", "AWATER10", "INTPTLAT10", "INTPTLON10",
)
# Derived features of the panel.
FEATURES = (
    "ed_total", "ed_fem", "ed_male",
    "trans_solo", "trans_pool", "trans_public", "trans_walk", "trans_remote",
    "race_white", "race_black",
    "med_house_inc", "per_cap_inc", "med_age", "population",
)
PANEL_KEYS = (*COUNT_KEYS, "year")


def measure_type(name: str) -> T.DataType:
    return T.DoubleType() if name in FRACTIONAL_MEASURES else T.LongType()


COUNT_SCHEMA = T.StructType(
    [T.StructField(m, measure_type(m)) for m in MEASURES]
    + [T.StructField(k, T.StringType()) for k in COUNT_KEYS]
    + [T.StructField("year", T.IntegerType())]
)

ATTRIBUTE_SCHEMA = T.StructType([T.StructField(a, T.StringType()) for a in ATTRIBUTES])
