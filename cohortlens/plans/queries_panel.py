"""Queries on percentile cohorts, look-ahead labels, neighbours and the whole study."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import weighted_mean
from cohortlens.operators.cohort import eligible_cohort, group_percentile
from cohortlens.operators.lookahead import forward_max, lookahead_label
from cohortlens.operators.nearest import nearest, neighbor_columns
from cohortlens.operators.neighbor_features import (
    neighbor_columns_wide,
    neighbor_features,
    neighbor_features_upto,
)
from cohortlens.operators.scale import join_group_stats, materialise, new_table_path
from cohortlens.plans.derived_tables import (
    MAX_BASE_YEAR,
    attribute_table,
    count_table,
    embedding_points,
    spend_panel,
    study_tables,
)
from cohortlens.plans.oracles import CTES, sql
from cohortlens.plans.registry import query
from cohortlens.plans.study import (
    MODEL_FEATURES,
    NEIGHBOR_MEANS,
    StudySettings,
    cohort,
    feature_panel,
    labelled_cohort,
    model_matrix,
    tract_neighbors,
    with_attributes,
)
from cohortlens.sources.tables import read_csv, write_csv

SETTINGS = StudySettings(max_base_year=MAX_BASE_YEAR)
#: Thresholds that fill both classes on the derived tables, for the models.
MODEL_SETTINGS = StudySettings(max_base_year=MAX_BASE_YEAR, growth=4.0, benchmark_p=0.8)


def study_matrix(spark, sf_dir, settings=SETTINGS):
    """The study's model matrix over the derived tables."""
    return model_matrix(*study_tables(spark, sf_dir), settings)


def _panel(spark, sf_dir):
    return materialise(feature_panel(count_table(spark, sf_dir)), "panel")


@query(
    "A03 F03",
    sql("select state, year, round(quantile_cont(cast(med as double), 0.1), 4) as p10 from spend where year <= 1998 group by all", "spend"),
)
def percentile_10(spark, sf_dir):
    """10th percentile of yearly spending per state and base year."""
    base = spend_panel(spark, sf_dir).filter(F.col("year") <= MAX_BASE_YEAR)
    p = group_percentile(base, ["state", "year"], "med", 0.10, "p10")
    return p.withColumn("p10", F.round("p10", 4))


@query(
    "A03 A04",
    sql("""select state, year, round(quantile_cont(cast(med as double), 0.1), 4) as p10,
                  round(quantile_cont(cast(med as double), 0.2), 4) as p20 from spend group by state, year""", "spend"),
)
def percentiles_of_large_groups(spark, sf_dir):
    """The way for large groups, a search for ranks over the bits of the values, on all groups."""
    p = group_percentile(
        spend_panel(spark, sf_dir), ["state", "year"], "med", {"p10": 0.1, "p20": 0.2}, whole_group_rows=20
    )
    return p.withColumns({c: F.round(c, 4) for c in ("p10", "p20")})


@query(
    "F05 J03",
    sql("""select s.id, s.state, s.year, s.med, t.top from spend s
           join (select state, year, max(med) as top from spend group by all) t using (state, year)""", "spend"),
)
def salted_group_maximum(spark, sf_dir):
    """Group statistics joined the way that is used when they are too many to broadcast."""
    spend = spend_panel(spark, sf_dir).select("id", "state", "year", "med")
    top = spend.groupBy("state", "year").agg(F.max("med").alias("top"))
    return join_group_stats(spend, top, ["state", "year"], max_broadcast_rows=0)


@query(
    "J08 W01 T03 D02",
    """with p as (
         select vec_id as id, label as state,
                case when vec_id % 100 = 7 then 1e16 else cast(embedding[1] as double) end as x, cast(embedding[2] as double) as y
         from embeddings)
       select a.id, cast(r as integer) as rank, nid, round(dist, 6) as dist from (
         select a.id, b.id as nid, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) as dist,
                row_number() over (partition by a.id order by sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.id) as r
         from p a join p b on a.state = b.state and a.id <> b.id) a where r <= 3""",
)
def nearest_points_with_outliers(spark, sf_dir):
    """Neighbours when one point in a hundred lies 1e16 away from the rest."""
    points = embedding_points(spark, sf_dir).withColumn("lat", F.when(F.col("id") % 100 == 7, F.lit(1e16)).otherwise(F.col("lat")))
    near = nearest(points, "id", "lat", "lon", ["state"], 3)
    return near.select("id", "rank", "nid", F.round("dist", 6).alias("dist"))


@query(
    "A04",
    sql("select state, year, round(quantile_cont(cast(med as double), 0.2), 4) as p20 from spend group by all", "spend"),
)
def percentile_20(spark, sf_dir):
    """20th percentile per state and year, all years."""
    p = group_percentile(spend_panel(spark, sf_dir), ["state", "year"], "med", 0.20, "p20")
    return p.withColumn("p20", F.round("p20", 4))


@query(
    "A05",
    sql("""select year, round(quantile_cont(cast(med as double), 0.1), 4) as p10,
                  round(quantile_cont(cast(med as double), 0.2), 4) as p20 from spend group by year""", "spend"),
)
def yearly_quantiles(spark, sf_dir):
    """Linear-interpolated quantiles over the whole frame per year."""
    p = group_percentile(spend_panel(spark, sf_dir), ["year"], "med", {"p10": 0.1, "p20": 0.2})
    return p.withColumns({c: F.round(c, 4) for c in ("p10", "p20")})


@query("A03 A04", sql("""select state, round(quantile_cont(cast(pop as double), 0.1), 4) as p10,
                         round(quantile_cont(cast(pop as double), 0.2), 4) as p20 from spend group by state""", "spend"))
def percentile_of_levels(spark, sf_dir):
    """Built-in percentile for a value with few distinct levels (orders per year)."""
    p = group_percentile(spend_panel(spark, sf_dir), ["state"], "pop", {"p10": 0.1, "p20": 0.2}, method="hash")
    return p.withColumns({c: F.round(c, 4) for c in ("p10", "p20")})


@query("J03 F05 F03 A03", sql("select id, state, year, med, pci, pop from spend_cohort", "spend_cohort"))
def spending_cohort(spark, sf_dir):
    """Customers at or below the 10th percentile of their state and year."""
    panel = materialise(spend_panel(spark, sf_dir), "panel")
    return eligible_cohort(panel, ["state", "year"], "med", 0.10, max_year=MAX_BASE_YEAR)


_LABEL = """
select c.id, c.state, c.year,
       cast(case when coalesce((e.best - c.pci) / nullif(c.pci, 0) >= {growth}, false)
                   or coalesce({hit}, false) then 1 else 0 end as integer) as label
from spend_cohort c left join (
  select b.id, b.year, max(f.pci) as best, bool_or(f.med >= bf.bench) as any_future,
         bool_or(f.med >= bb.bench) as any_base, arg_min(f.med >= bf.bench, f.year) as first_future,
         arg_min(f.med >= bb.bench, f.year) as first_base
  from spend_cohort b join spend f on f.id = b.id and f.year between b.year + 1 and b.year + 3
  join bench bf on bf.state = f.state and bf.year = f.year
  join bench bb on bb.state = b.state and bb.year = b.year
  group by b.id, b.year) e on e.id = c.id and e.year = c.year
"""


def _label_sql(hit: str, growth: float, p: float) -> str:
    return sql(
        _LABEL.format(hit=hit, growth=growth),
        "spend_cohort",
        bench=f"select state, year, quantile_cont(cast(med as double), {p}) as bench from spend group by all",
    )


def _labels(spark, sf_dir, **options):
    panel = materialise(spend_panel(spark, sf_dir), "panel")
    eligible = eligible_cohort(panel, ["state", "year"], "med", 0.10, max_year=MAX_BASE_YEAR)
    labelled = lookahead_label(
        eligible, panel, id="id", group=["state"], growth_col="pci", level_col="med", **options
    )
    return labelled.select("id", "state", "year", "label")


@query("J04 J05 A12 A13 F06 X11 D01", _label_sql("e.any_future", 0.2, 0.2))
def label_any_year(spark, sf_dir):
    """Growth of 20 % or the 20th percentile of any of the next three years."""
    return _labels(spark, sf_dir)


@query("J04 J05 A12 A13 F06 X11", _label_sql("e.any_future", 4.0, 0.8))
def label_any_year_strict(spark, sf_dir):
    """The same label with thresholds that leave both classes well filled."""
    return _labels(spark, sf_dir, growth=4.0, p=0.8)


@query("J06 A14", _label_sql("e.first_base", 4.0, 0.8))
def label_first_year_base(spark, sf_dir):
    """Only the first later year, against the benchmark of the base year."""
    return _labels(spark, sf_dir, growth=4.0, p=0.8, benchmark="base", match="first")


@query("J06 A13", _label_sql("e.any_base", 4.0, 0.8))
def label_any_year_base(spark, sf_dir):
    """Any later year against the benchmark of the base year."""
    return _labels(spark, sf_dir, growth=4.0, p=0.8, benchmark="base")


@query("J05 A14", _label_sql("e.first_future", 4.0, 0.8))
def label_first_year_future(spark, sf_dir):
    """Only the first later year, against that year's benchmark."""
    return _labels(spark, sf_dir, growth=4.0, p=0.8, match="first")


@query(
    "W02 A12",
    sql("""select id, year, med, max(med) over (partition by id order by year range between 1 following and 3 following) as forward_max
           from spend""", "spend"),
)
def forward_window_max(spark, sf_dir):
    """Largest spending of the next three calendar years per customer and year."""
    return forward_max(spend_panel(spark, sf_dir), "id", "year", "med")


def _points(spark, sf_dir):
    return materialise(embedding_points(spark, sf_dir), "points")


@query("J08 W01 T03 D02", sql("select state, id, rank, nid, round(dist, 7) as dist from point_near", "point_near"))
def nearest_points(spark, sf_dir):
    """The ten nearest vectors of the same label, with distance."""
    near = nearest(_points(spark, sf_dir), "id", "lat", "lon", ["state"], 10, stored=True)
    return near.withColumn("dist", F.round("dist", 7))


@query(
    "J08 W01",
    sql("""select id, rank, nid, round(dist, 7) as dist from (
             select *, cast(row_number() over (partition by id order by dist, nid) as integer) as rank from (
               select a.id, b.id as nid,
                      sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) as dist
               from points a join points b on a.id <> b.id)) where rank <= 5""", "points"),
)
def nearest_points_ungrouped(spark, sf_dir):
    """The five nearest vectors over the whole frame."""
    near = nearest(_points(spark, sf_dir), "id", "lat", "lon", [], 5, stored=True)
    return near.withColumn("dist", F.round("dist", 7))


@query(
    "J09 P04",
    sql("select id, "
        + ", ".join(f"any_value(nid) filter (rank = {r + 1}) as neighbor{r}" for r in range(10))
        + " from point_near group by id", "point_near"),
)
def neighbor_ids_wide(spark, sf_dir):
    """Neighbour ids as columns neighbor0 .. neighbor9."""
    near = nearest(_points(spark, sf_dir), "id", "lat", "lon", ["state"], 10, stored=True)
    return neighbor_columns(near, ["id"], 10)


def _dated(points):
    return points.withColumn("year", F.lit(2010))


@query(
    "J09 P04 P10",
    sql("select n.id, "
        + ", ".join(f"any_value(p.{c}) filter (rank = {r + 1}) as \"{r}_{c}\"" for r in range(3) for c in ("f1", "pop"))
        + """, round((sum(f1 * pop) filter (rank <= 3)) / nullif(sum(pop) filter (rank <= 3), 0), 6) as mean_f1
            from point_near n join points p on p.id = n.nid group by n.id""", "point_near", "points"),
)
def neighbor_features_wide(spark, sf_dir):
    """Features of the three nearest as prefixed columns, and their weighted mean across columns."""
    points = _dated(_points(spark, sf_dir))
    near = nearest(points, "id", "lat", "lon", ["state", "year"], 3, stored=True)
    wide = neighbor_columns_wide(near, points, id="id", year="year", columns=["f1", "pop"], k=3)
    mean = weighted_mean([f"{r}_f1" for r in range(3)], [f"{r}_pop" for r in range(3)])
    return wide.withColumn("mean_f1", F.round(mean, 6)).drop("year")


def _point_summary(strict: bool) -> str:
    guard = "case when count({f} * pop) = count(*) then {m} end" if strict else "{m}"
    columns = []
    for f in ("f1", "f2"):
        mean = f"sum({f} * pop) / nullif(sum(pop) filter ({f} is not null), 0)"
        columns.append(f"round({guard.format(f=f, m=mean)}, 6) as n_{f}")
    return (
        f"select n.id, {', '.join(columns)}, cast(sum(pop) as bigint) as n_pop "
        "from point_near n join points p on p.id = n.nid group by n.id"
    )


def _summarise_points(spark, sf_dir, strict):
    points = _dated(_points(spark, sf_dir))
    near = nearest(points, "id", "lat", "lon", ["state", "year"], 10, stored=True)
    summary = neighbor_features(
        near, points, id="id", weight="pop", mean_cols=["f1", "f2"], sum_cols=["pop"], strict=strict
    )
    return summary.drop("year").withColumns({c: F.round(c, 6) for c in ("n_f1", "n_f2")})


@query("A10 A11 J09 M18", sql(_point_summary(True), "point_near", "points"))
def neighbor_means_strict(spark, sf_dir):
    """Weighted means over ten neighbours, NULL when one of them lacks the value."""
    return _summarise_points(spark, sf_dir, True)


@query("A10 A11", sql(_point_summary(False), "point_near", "points"))
def neighbor_means_lenient(spark, sf_dir):
    """Weighted means over the neighbours that have the value."""
    return _summarise_points(spark, sf_dir, False)


@query(
    "M15 A10",
    sql("""select n.id, k.k, round(case when count(f1 * pop) = k.k then sum(f1 * pop) / nullif(sum(pop), 0) end, 6) as n_f1,
                  cast(sum(pop) as bigint) as n_pop
           from point_near n join (select cast(unnest(range(1, 11)) as integer) as k) k on n.rank <= k.k
           join points p on p.id = n.nid group by n.id, k.k""", "point_near", "points"),
)
def neighbor_means_upto(spark, sf_dir):
    """Neighbour summaries for every neighbour count from 1 to 10 in one pass."""
    points = _dated(_points(spark, sf_dir))
    near = nearest(points, "id", "lat", "lon", ["state", "year"], 10, stored=True)
    upto = neighbor_features_upto(near, points, id="id", weight="pop", mean_cols=["f1"], sum_cols=["pop"])
    return upto.select("id", "k", F.round("n_f1", 6).alias("n_f1"), "n_pop")


@query("J03 F05", sql("select * from cohort", "cohort"))
def tract_cohort(spark, sf_dir):
    """Eligible tracts of the study."""
    return cohort(_panel(spark, sf_dir), SETTINGS)


@query("J04 J05 A12 A13 X11 U01", sql("select * from labelled", "labelled"))
def tract_labels(spark, sf_dir):
    """Labelled cohort of the study."""
    return labelled_cohort(_panel(spark, sf_dir), SETTINGS)


@query(
    "J08 J02 W01 T03",
    sql("select state, year, GEO_ID, rank, nid, round(dist, 6) as dist from near", "near"),
)
def tract_neighbor_list(spark, sf_dir):
    """The ten nearest tracts of every eligible tract, in its state and year."""
    panel = _panel(spark, sf_dir)
    located = materialise(with_attributes(panel, attribute_table(spark, sf_dir)), "located")
    near = tract_neighbors(located, SETTINGS.neighbors, cohort(panel, SETTINGS))
    return near.withColumn("dist", F.round("dist", 6))


_ROUNDED = [f"n_{c}" for c in NEIGHBOR_MEANS]


@query(
    "M18 P11 J01 J09 A10 A11 F01",
    sql("select GEO_ID, state, "
        + ", ".join(f"round({c}, 6) as {c}" if c in _ROUNDED else c for c in MODEL_FEATURES)
        + ", gent from matrix where "
        + " and ".join(f"{c} is not null" for c in MODEL_FEATURES), "matrix"),
)
def study_model_matrix(spark, sf_dir):
    """The whole study up to the model matrix: 27 features and the label."""
    return study_matrix(spark, sf_dir).withColumns({c: F.round(c, 6) for c in _ROUNDED})


#: One frame of all states: percentiles per year, neighbours over the whole frame of the year.
FRAME_SETTINGS = StudySettings(max_base_year=MAX_BASE_YEAR, group=(), neighbor_group=(), neighbors=20)


def _whole_frame(text: str) -> str:
    """The same SQL with the year alone as group, and 20 neighbours."""
    for old, new in (
        ("select state, year, quantile", "select year, quantile"), ("group by state, year", "group by year"),
        ("using (state, year)", "using (year)"), ("p20.state = f.state and ", ""),
        ("q.state = c.state and ", ""), ("rank <= 10", "rank <= 20"),
    ):
        text = text.replace(old, new)
    return text


_FRAME = {n: _whole_frame(CTES[n]) for n in ("p10", "p20", "cohort", "labelled", "located", "placed", "near", "around")}
_KEPT = [*MODEL_FEATURES, "ed_fem", "ed_male"]


@query(
    "M18 J04 J08 A03 A04",
    sql("select placed.GEO_ID, state, "
        + ", ".join(f"round({c}, 6) as {c}" if c in _ROUNDED else ("placed.year" if c == "year" else c) for c in _KEPT)
        + ", gent from placed join around on around.GEO_ID = placed.GEO_ID and around.year = placed.year where "
        + " and ".join(f"{'placed.' if c == 'year' else ''}{c} is not null" for c in _KEPT),
        "panel", "attributes", **_FRAME),
)
def single_frame_matrix(spark, sf_dir):
    """The study over one frame: no state in any group, 20 neighbours, both degree shares kept."""
    matrix = model_matrix(*study_tables(spark, sf_dir), FRAME_SETTINGS, keep_all=True)
    return matrix.withColumns({c: F.round(c, 6) for c in _ROUNDED})


_NATIONAL = [*NEIGHBOR_MEANS, "population", "ALAND10", "ed_fem", "ed_male"]


@query(
    "S07 J09 P04",
    sql("select n.GEO_ID, n.year, "
        + ", ".join(f"round(any_value(p.{c}) filter (rank = {r + 1}), 9) as \"{r}_{c}\"" for r in range(10) for c in _NATIONAL)
        + " from near n join located p on p.GEO_ID = n.nid and p.year = n.year group by n.GEO_ID, n.year", "near", "located"),
)
def wide_neighbor_table(spark, sf_dir):
    """The final wide table, ten neighbours by fifteen columns, written as CSV and read back by name."""
    panel = _panel(spark, sf_dir)
    located = materialise(with_attributes(panel, attribute_table(spark, sf_dir)), "located")
    near = tract_neighbors(located, 10, cohort(panel, SETTINGS))
    wide = neighbor_columns_wide(near, located, id="GEO_ID", year="year", columns=_NATIONAL, k=10)
    path = new_table_path(spark, "wide-csv")
    write_csv(wide, path)
    back = read_csv(spark, path, wide.schema)
    return back.select("GEO_ID", "year", *[F.round(c, 9).alias(c) for c in back.columns if c not in ("GEO_ID", "year")])
