"""The tract study: counts -> features -> cohort -> label -> neighbours -> model matrix -> models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import safe_ratio, strict_sum, text_after, typed
from cohortlens.operators.cohort import eligible_cohort, group_percentile
from cohortlens.operators.dataset import complete_rows, positive_rows
from cohortlens.operators.lookahead import lookahead_label
from cohortlens.operators.nearest import nearest
from cohortlens.operators.neighbor_features import neighbor_features, neighbor_features_upto
from cohortlens.operators.scale import materialise
from cohortlens.sources.schemas import FEATURES, PANEL_KEYS

# Numerators and denominators of the ratio features.
WOMEN_DEGREES = ("B15002_032E", "B15002_033E", "B15002_034E", "B15002_035E")
WOMEN_TOTAL = "B15002_019E"
MEN_DEGREES = ("B15002_015E", "B15002_016E", "B15002_017E", "B15002_018E")
MEN_TOTAL = "B15002_002E"
COMMUTERS = "B08301_001E"
COMMUTING = {
    "trans_solo": "B08301_003E",
    "trans_pool": "B08301_004E",
    "trans_public": "B08301_010E",
    "trans_walk": "B08301_019E",
    "trans_remote": "B08301_021E",
}
PEOPLE = "B02001_001E"
GROUPS = {"race_white": "B02001_002E", "race_black": "B02001_003E"}
RENAMED = {
    "med_house_inc": "B19013_001E",
    "per_cap_inc": "B19301_001E",
    "med_age": "B01002_001E",
    "population": "B01003_001E",
}
# Features averaged over neighbours, and features added up.
NEIGHBOR_MEANS = (
    "ed_total", "trans_solo", "trans_pool", "trans_public", "trans_walk", "trans_remote",
    "race_white", "race_black", "per_cap_inc", "med_house_inc", "med_age",
)
NEIGHBOR_TOTALS = ("population", "land_area")
# Columns of the model matrix, in order.
OWN_FEATURES = (
    "year", "ed_total", "trans_solo", "trans_pool", "trans_public", "trans_walk", "trans_remote",
    "race_white", "race_black", "med_house_inc", "per_cap_inc", "med_age", "population", "ALAND10",
)
MODEL_FEATURES = (*OWN_FEATURES, *[f"n_{c}" for c in (*NEIGHBOR_MEANS, *NEIGHBOR_TOTALS)])
LABEL = "gent"


@dataclass(frozen=True)
class StudySettings:
    """Thresholds, sizes and grouping of the study.

    ``group`` are the columns that, with the year, form the groups of percentiles and benchmarks;
    ``neighbor_group`` those inside which neighbours are searched. Columns in ``screened`` must be
    above 0 (``keep_zero``: not below 0) for a row to count.
    """

    cohort_p: float = 0.10
    benchmark_p: float = 0.20
    growth: float = 0.20
    horizon: int = 3
    max_base_year: int = 2015
    neighbors: int = 10
    benchmark: str = "future"
    match: str = "any"
    group: tuple[str, ...] = ("state",)
    neighbor_group: tuple[str, ...] = ("state",)
    screened: tuple[str, ...] = ("B19013_001E",)
    keep_zero: bool = False


def strip_prefix(counts: DataFrame) -> DataFrame:
    """``GEO_ID`` reduced to the part after ``US``, kept as text so a leading zero survives."""
    return counts.withColumn("GEO_ID", text_after("GEO_ID", "US"))


def clean_counts(counts: DataFrame, s: StudySettings = StudySettings()) -> DataFrame:
    """Complete rows whose screened columns are positive, by default the median income."""
    complete = complete_rows(strip_prefix(counts))
    if not s.keep_zero:
        return positive_rows(complete, s.screened)
    for c in s.screened:
        complete = complete.filter(F.col(c) >= 0)
    return complete


def derived_features() -> dict[str, Column]:
    """The 14 feature expressions."""
    return {
        "ed_total": safe_ratio(
            strict_sum([*WOMEN_DEGREES, *MEN_DEGREES]), strict_sum([WOMEN_TOTAL, MEN_TOTAL])
        ),
        "ed_fem": safe_ratio(strict_sum(WOMEN_DEGREES), WOMEN_TOTAL),
        "ed_male": safe_ratio(strict_sum(MEN_DEGREES), MEN_TOTAL),
        **{name: safe_ratio(c, COMMUTERS) for name, c in COMMUTING.items()},
        **{name: safe_ratio(c, PEOPLE) for name, c in GROUPS.items()},
        **{name: F.col(c) for name, c in RENAMED.items()},
    }


def feature_panel(counts: DataFrame, s: StudySettings = StudySettings()) -> DataFrame:
    """Six keys and fourteen features per tract and year."""
    features = derived_features()
    return clean_counts(counts, s).select(*PANEL_KEYS, *[features[f].alias(f) for f in FEATURES])


def _needed(panel: DataFrame, s: StudySettings) -> DataFrame:
    """The panel, complete in its keys, without the key columns that no later step reads."""
    used = {"GEO_ID", "state", "year", *s.group, *s.neighbor_group}
    return panel.drop(*[c for c in PANEL_KEYS if c not in used])


def typed_attributes(attributes: DataFrame) -> DataFrame:
    """Internal point and land area of each tract; land area needs 64 bits."""
    return attributes.select(
        "GEOID10",
        typed("INTPTLAT10", "double").alias("INTPTLAT10"),
        typed("INTPTLON10", "double").alias("INTPTLON10"),
        typed("ALAND10", "bigint").alias("ALAND10"),
    )


def with_attributes(rows: DataFrame, attributes: DataFrame, how: str = "inner") -> DataFrame:
    """Attributes (text or typed) joined on the tract id.

    ``inner`` equals a left join followed by dropping rows with NULLs.
    """
    places = attributes if dict(attributes.dtypes)["ALAND10"] == "bigint" else typed_attributes(attributes)
    joined = rows.join(places, rows["GEO_ID"] == places["GEOID10"], how)
    return joined.na.drop() if how == "inner" else joined


def income_percentiles(panel: DataFrame, s: StudySettings = StudySettings()) -> DataFrame:
    """Cohort threshold and benchmark per group and year, from the same passes, stored."""
    both = {"threshold": s.cohort_p, "benchmark": s.benchmark_p}
    return materialise(group_percentile(panel, [*s.group, "year"], "med_house_inc", both), "income")


def cohort(
    panel: DataFrame, s: StudySettings = StudySettings(), income: DataFrame | None = None
) -> DataFrame:
    """Tracts with a low median income in their group and base year."""
    return eligible_cohort(
        panel, [*s.group, "year"], "med_house_inc", s.cohort_p, max_year=s.max_base_year, thresholds=income,
        stored=income is not None,
    )


def labelled_cohort(panel: DataFrame, s: StudySettings = StudySettings()) -> DataFrame:
    """The cohort and whether each tract moved up within the horizon."""
    income = income_percentiles(panel, s)
    return lookahead_label(
        cohort(panel, s, income),
        panel,
        id="GEO_ID",
        group=list(s.group),
        growth_col="per_cap_inc",
        level_col="med_house_inc",
        horizon=s.horizon,
        growth=s.growth,
        p=s.benchmark_p,
        benchmark=s.benchmark,
        match=s.match,
        benchmarks=income.drop("threshold"),
        stored=True,
        label=LABEL,
    )


def base_years(panel: DataFrame, s: StudySettings = StudySettings()) -> DataFrame:
    """Rows of the years that a cohort is drawn from; neighbours are searched in the same year."""
    return panel.filter(F.col("year") <= s.max_base_year)


def tract_neighbors(
    located: DataFrame, k: int, queries: DataFrame | None = None, group: Sequence[str] = ("state",)
) -> DataFrame:
    """The k nearest tracts in the same group and year; ``located`` is a stored table."""
    return nearest(
        located, "GEO_ID", "INTPTLAT10", "INTPTLON10", [*group, "year"], k, queries, stored=True
    )


def tract_neighbor_features(near: DataFrame, located: DataFrame, strict: bool = True) -> DataFrame:
    side = located.withColumn("land_area", F.col("ALAND10"))
    return neighbor_features(
        near, side, id="GEO_ID", weight="population",
        mean_cols=NEIGHBOR_MEANS, sum_cols=NEIGHBOR_TOTALS, strict=strict,
    )


def model_matrix(
    counts: DataFrame, attributes: DataFrame, s: StudySettings = StudySettings(), keep_all: bool = False
) -> DataFrame:
    """Key, 27 features and label per eligible tract and base year, complete rows only.

    The feature panel feeds the cohort, the labels, the neighbour search and the neighbour
    features, so it is written once, and so are the typed attributes. ``keep_all`` keeps
    ``ed_fem`` and ``ed_male`` too.
    """
    attributes = materialise(typed_attributes(attributes), "attributes")
    panel = materialise(_needed(feature_panel(counts, s), s), "panel")
    labelled = labelled_cohort(panel, s)
    located = materialise(with_attributes(base_years(panel, s), attributes), "located")
    rows = materialise(with_attributes(labelled, attributes), "labelled")
    near = tract_neighbors(located, s.neighbors, rows.select("GEO_ID", "state", "year"), s.neighbor_group)
    around = tract_neighbor_features(near, located)
    extra = ["ed_fem", "ed_male"] if keep_all else []
    return (
        rows.join(around, ["GEO_ID", "year"])
        .select("GEO_ID", "state", *MODEL_FEATURES, *extra, LABEL)
        .na.drop()
    )


def neighbor_sweep_tables(
    counts: DataFrame, attributes: DataFrame, most: int, s: StudySettings = StudySettings()
) -> tuple[DataFrame, DataFrame]:
    """Labelled rows with their own features, and their neighbour summaries for 1 to ``most`` neighbours.

    The neighbours are searched once; every count is a running summary over their ranks.
    """
    attributes = materialise(typed_attributes(attributes), "attributes")
    panel = materialise(_needed(feature_panel(counts, s), s), "panel")
    located = materialise(with_attributes(base_years(panel, s), attributes), "located")
    rows = materialise(with_attributes(labelled_cohort(panel, s), attributes), "labelled")
    near = tract_neighbors(located, most, rows.select("GEO_ID", "state", "year"), s.neighbor_group)
    upto = neighbor_features_upto(
        near, located.withColumn("land_area", F.col("ALAND10")), id="GEO_ID", weight="population",
        mean_cols=NEIGHBOR_MEANS, sum_cols=NEIGHBOR_TOTALS,
    )
    return rows.select("GEO_ID", *OWN_FEATURES, LABEL).na.drop(), materialise(upto, "upto")
