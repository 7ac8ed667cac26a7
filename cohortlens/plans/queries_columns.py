"""Queries on projections, casts, text, filters, joins, counts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import (
    flag,
    leading,
    planar_distance,
    relative_growth,
    safe_ratio,
    strict_sum,
    text_after,
    typed,
    without_first,
    without_last,
    join_key,
)
from cohortlens.operators import dataset, profile, sketches
from cohortlens.operators.cohort import group_percentile
from cohortlens.operators.metrics import positive_class
from cohortlens.operators.neighbor_features import prefixed
from cohortlens.operators.scale import join_group_stats, materialise
from cohortlens.plans.derived_tables import (
    attribute_table,
    count_table,
    document_features,
    scored_documents,
    spend_panel,
    table,
)
from cohortlens.plans.oracles import hash_unit, sql
from cohortlens.plans.registry import query
from cohortlens.plans.study import feature_panel, strip_prefix, with_attributes
from cohortlens.sources.schemas import FEATURES, MEASURES


@query("P01 P03 P06 P07 F01 F02 X01 X05", sql("select * from panel", "panel"))
def feature_panel_rows(spark, sf_dir):
    """Six keys and fourteen ratio features per tract and year, cleaned."""
    return feature_panel(count_table(spark, sf_dir))


@query(
    "P02 P04 P05",
    """select c_custkey as n_c_custkey, c_nationkey as n_state, c_acctbal as n_balance from customer""",
)
def renamed_and_prefixed(spark, sf_dir):
    """Columns dropped, given intuitive names, and prefixed in bulk."""
    customer = table(spark, sf_dir, "customer").drop("c_name", "c_mktsegment")
    named = customer.withColumnsRenamed({"c_nationkey": "state", "c_acctbal": "balance"})
    return prefixed(named, "n")


@query(
    "P06 P07 P09",
    """select l_partkey, a, r, n, case when a is null or r is null or n is null then null else a + r + n end as total,
              a / nullif(n - 40, 0) as share, 1 as one
       from (select l_partkey, sum(l_quantity) filter (l_returnflag = 'A') as a,
                    sum(l_quantity) filter (l_returnflag = 'R') as r,
                    sum(l_quantity) filter (l_returnflag = 'N') as n from lineitem group by l_partkey)""",
)
def strict_sum_and_ratio(spark, sf_dir):
    """Row-wise sums that keep NULLs and ratios that survive zero denominators."""
    lines = table(spark, sf_dir, "lineitem")
    wide = lines.groupBy("l_partkey").agg(*[
        F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f.lower()) for f in "ARN"
    ])
    return wide.withColumns({
        "total": strict_sum(["a", "r", "n"]),
        "share": safe_ratio("a", F.col("n") - 40),
        "one": F.lit(1),
    })


@query(
    "P08",
    """select c_custkey, try_cast(substr(c_name, 10) as integer) as number, try_cast(c_mktsegment as double) as bad,
              cast(c_acctbal as float) as balance from customer""",
)
def numeric_casts(spark, sf_dir):
    """Casts that yield NULL for text that is no number."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        typed(F.expr("substr(c_name, 10)"), "int").alias("number"),
        typed("c_mktsegment", "double").alias("bad"),
        F.col("c_acctbal").cast("float").alias("balance"),
    )


@query(
    "P11 P02",
    sql("select year, " + ", ".join(FEATURES) + " from panel", "panel"),
)
def named_column_slice(spark, sf_dir):
    """The model's columns picked by name out of the wide panel."""
    return feature_panel(count_table(spark, sf_dir)).select("year", *FEATURES)


@query(
    "P12 X11",
    sql("""select id, year, (med - base) / nullif(base, 0) as growth,
                  cast(case when (med - base) / nullif(base, 0) >= 0.2 then 1 else 0 end as integer) as grew
           from (select p.id, p.year, cast(p.med as double) as med, cast(b.med as double) as base
                 from spend p join spend b on b.id = p.id and b.year = p.year - 1)""", "spend"),
)
def yearly_growth(spark, sf_dir):
    """Relative growth over the previous year and whether it reached 20 %."""
    panel = spend_panel(spark, sf_dir).select("id", "year", F.col("med").cast("double").alias("med"))
    before = panel.select("id", (F.col("year") + 1).alias("year"), F.col("med").alias("base"))
    growth = relative_growth("med", "base")
    return panel.join(before, ["id", "year"]).select(
        "id", "year", growth.alias("growth"), flag(growth >= 0.2).alias("grew")
    )


@query(
    "X01 X02 X03 D04",
    """select c_custkey, split_part(c_name, '#', 2) as number, substr(c_name, 1, 2) as code,
              left(c_name, length(c_name) - 1) as shortened, substr(c_name, 6) as tail,
              c_mktsegment || '_' || cast(c_nationkey as varchar) as key,
              case when contains(c_mktsegment, 'US') then split_part(c_mktsegment, 'US', 2) end as after_us
       from customer""",
)
def text_keys(spark, sf_dir):
    """Split, prefix, suffix and concatenation of identifiers."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text_after("c_name", "#").alias("number"),
        leading("c_name", 2).alias("code"),
        without_last("c_name").alias("shortened"),
        without_first("c_name", 5).alias("tail"),
        join_key("c_mktsegment", F.col("c_nationkey").cast("string")).alias("key"),
        text_after("c_mktsegment", "US").alias("after_us"),
    )


@query(
    "X04 A05",
    sql("""select year, round(quantile_cont(cast(med as double), 0.1), 4) as p10,
                  round(quantile_cont(cast(med as double), 0.2), 4) as p20 from spend group by year""", "spend"),
)
def array_items(spark, sf_dir):
    """Percentiles kept in an array and taken out by position."""
    both = group_percentile(spend_panel(spark, sf_dir), ["year"], "med", {"a": 0.1, "b": 0.2})
    packed = both.select("year", F.array("a", "b").alias("p"))
    return packed.select(
        "year",
        F.round(F.col("p")[0], 4).alias("p10"),
        F.round(F.col("p").getItem(1), 4).alias("p20"),
    )


@query(
    "X05 X06 X07 D03",
    """select c_custkey, sqrt((c_acctbal - m) * (c_acctbal - m)
                + (cast(c_nationkey as double) - 12) * (cast(c_nationkey as double) - 12)) as dist,
              round(c_acctbal / 7, 2) as weekly
       from customer join (select c_nationkey as k,
                cast(sum(cast(round(c_acctbal * 100) as bigint)) as double) / count(*) / 100.0::double as m
              from customer group by c_nationkey) on k = c_nationkey""",
)
def distances_and_rounding(spark, sf_dir):
    """Planar distance of each customer to the mean point of its nation, and a rounded share."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    centre = customer.groupBy("c_nationkey").agg((F.sum(cents) / F.count("*") / 100.0).alias("m"))
    joined = join_group_stats(customer, centre, ["c_nationkey"])
    nation = F.col("c_nationkey").cast("double")
    dist = planar_distance(F.col("c_acctbal"), nation, F.col("m"), F.lit(12.0))
    return joined.select(
        "c_custkey", dist.alias("dist"), F.round(F.col("c_acctbal") / 7, 2).alias("weekly")
    )


@query(
    "X08 X09 J10",
    sql("""select doc_id, n.label, n.prediction, n.prediction - n.label as residual,
                  cast(case when n.score > 1 - n.score then 1 else 0 end as integer) as top_class
           from scored n""", "scored"),
)
def residual_rows(spark, sf_dir):
    """Signed residual and top class per document, rows aligned with the labels by key."""
    scored = scored_documents(spark, sf_dir)
    predictions = scored.select(
        "doc_id", "prediction", positive_class(F.array(1 - F.col("score"), "score")).alias("top_class")
    )
    labels = scored.select("doc_id", "label")
    return labels.join(predictions, "doc_id").select(
        "doc_id", "label", "prediction",
        (F.col("prediction") - F.col("label")).alias("residual"), "top_class",
    )


#: Even grids of the published study: 60 rates, 20 numbers of trees, 25 penalties.
_GRIDS = {
    "rate": ("score", [round(0.01 * i, 2) for i in range(1, 61)]),
    "trees": ("n_chars", [float(n) for n in range(100, 2001, 100)]),
    "penalty": ("distinct_share", [round(0.0005 + 0.002 * i, 4) for i in range(25)]),
}


@query(
    "X10 A02",
    sql(" union all ".join(
        f"""select '{name}' as grid, g.cut, count(*) filter ({column} >= g.cut) as rows
            from scored, (select unnest({cuts}::double[]) as cut) g group by g.cut""" for name, (column, cuts) in _GRIDS.items()), "scored"),
)
def threshold_grid(spark, sf_dir):
    """Documents at or above each cut of three even grids (60, 20 and 25 points), all cuts in one pass."""
    counted = scored_documents(spark, sf_dir).agg(F.array(*[
        F.struct(F.lit(name).alias("grid"), F.lit(c).alias("cut"), F.count_if(F.col(column) >= c).alias("rows"))
        for name, (column, cuts) in _GRIDS.items() for c in cuts
    ]).alias("grid"))
    return counted.select(F.inline("grid"))


@query(
    "F01 A07",
    sql("select doc_id, lower_text, share from t where lower_text is not null and share is not null",
        t="""select doc_id, nullif(lang, 'en') as lower_text,
                    case when n_chars <> 100 then 1000.0 / (n_chars - 100) end as share from documents"""),
)
def complete_rows(spark, sf_dir):
    """Rows without NULLs in any column."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.nullif("lang", F.lit("en")).alias("lower_text"),
        safe_ratio(F.lit(1000.0), F.col("n_chars") - 100).alias("share"),
    )
    return dataset.complete_rows(docs)


@query("F02", "select c_custkey, c_acctbal from customer where c_acctbal > 0")
def positive_filter(spark, sf_dir):
    """Rows with a positive value; zero, negatives and NULL go."""
    return dataset.positive_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query(
    "F03 F04 F08 A02",
    """select cast(year(o_orderdate) as integer) as year, count(*) filter (o_orderstatus = 'F') as finished,
              count(*) as rows from orders where year(o_orderdate) <= 1998 group by 1""",
)
def bounded_years(spark, sf_dir):
    """Rows up to a year, with a conditional count of one status."""
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderstatus")
    return orders.filter(F.col("year") <= 1998).groupBy("year").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count("*").alias("rows")
    )


@query(
    "F07 F08",
    sql("""select doc_id, n_chars, distinct_share from docs
           where n_chars > 500 and (distinct_share > 0.5 or lang = 'en') and quality = 1""", "docs"),
)
def compound_filter(spark, sf_dir):
    """AND / OR subset of the positive class."""
    docs = document_features(spark, sf_dir)
    wanted = (F.col("n_chars") > 500) & ((F.col("distinct_share") > 0.5) | (F.col("lang") == "en"))
    return docs.filter(wanted & (F.col("quality") == 1)).select("doc_id", "n_chars", "distinct_share")


@query(
    "F09 J07 A15",
    sql("select count(distinct GEO_ID) as keys, count(distinct GEOID10) as known_keys from panel left join attributes on GEO_ID = GEOID10",
        "panel", "attributes"),
)
def key_coverage(spark, sf_dir):
    """Distinct tracts of the panel and how many the attribute table knows."""
    panel = feature_panel(count_table(spark, sf_dir))
    return profile.key_coverage(panel, "GEO_ID", attribute_table(spark, sf_dir), "GEOID10")


@query(
    "F10 F04",
    "select c_nationkey as state, count(*) as rows, sum(case when c_acctbal < 0 then 1 else 0 end)::bigint as negative from customer group by 1",
)
def per_state_counts(spark, sf_dir):
    """What a loop over states would filter and count, in one grouping."""
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("state")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("c_acctbal") < 0).alias("negative")
    )


@query(
    "J01",
    sql("""select substr(GEO_ID, 10) as GEO_ID, year, B01003_001E, GEOID10, ALAND10
           from raw left join attributes on substr(GEO_ID, 10) = GEOID10""", "raw", "attributes"),
)
def attribute_left_join(spark, sf_dir):
    """Counts with the attributes they have; unknown tracts stay."""
    counts = strip_prefix(count_table(spark, sf_dir)).select("GEO_ID", "year", "B01003_001E")
    joined = with_attributes(counts, attribute_table(spark, sf_dir), "left")
    return joined.select("GEO_ID", "year", "B01003_001E", "GEOID10", "ALAND10")


@query(
    "J02",
    sql("""select substr(GEO_ID, 10) as GEO_ID, year, B01003_001E, INTPTLAT10, INTPTLON10, ALAND10
           from raw join attributes on substr(GEO_ID, 10) = GEOID10""", "raw", "attributes"),
)
def attribute_inner_join(spark, sf_dir):
    """Counts of known tracts with internal point and land area."""
    counts = strip_prefix(count_table(spark, sf_dir)).select("GEO_ID", "year", "B01003_001E")
    return with_attributes(counts, attribute_table(spark, sf_dir)).drop("GEOID10")


@query("J07 F09", "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where year(o_orderdate) = 1995)")
def known_customers(spark, sf_dir):
    """Customers with an order in 1995 (semi join)."""
    orders = table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == 1995)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return profile.known_rows(customer, "c_custkey", orders, "o_custkey")


@query("J07", "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where year(o_orderdate) = 1995)")
def unknown_customers(spark, sf_dir):
    """Customers without an order in 1995 (anti join)."""
    orders = table(spark, sf_dir, "orders").filter(F.year("o_orderdate") == 1995)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return profile.known_rows(customer, "c_custkey", orders, "o_custkey", known=False)


@query("A01 A02", "select count(*) filter (o_orderstatus = 'F') as rows from orders")
def conditional_row_count(spark, sf_dir):
    return profile.row_count(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")


_DESCRIBED = ("med_house_inc", "per_cap_inc", "med_age", "population", "ed_total")


@query(
    "A06",
    sql(" union all ".join(
        f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as stddev,
             cast(min({c}) as double) as min, cast(max({c}) as double) as max,
             round(quantile_cont(cast({c} as double), 0.25), 6) as q25, round(quantile_cont(cast({c} as double), 0.5), 6) as q50,
             round(quantile_cont(cast({c} as double), 0.75), 6) as q75 from panel""" for c in _DESCRIBED), "panel"),
)
def summary_figures(spark, sf_dir):
    """count, mean, deviation, quartiles and range of several columns."""
    d = profile.describe(feature_panel(count_table(spark, sf_dir)), _DESCRIBED)
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "q25", "q50", "q75")})


@query(
    "A07",
    sql("select " + ", ".join(f"count(*) filter ({m} is null) as {m}" for m in MEASURES) + " from raw", "raw"),
)
def null_counts(spark, sf_dir):
    return profile.null_counts(count_table(spark, sf_dir), MEASURES)


@query("A08 T01", "select event_type, count(*) as count from events group by event_type")
def value_counts(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("A09", sql("select lang, avg(quality) as positive_rate from docs group by lang", "docs"))
def positive_rates(spark, sf_dir):
    return profile.positive_rate(document_features(spark, sf_dir), ["lang"], "quality")


@query("A15", "select count(distinct user_id) as distinct_values from events")
def distinct_users(spark, sf_dir):
    return profile.distinct_count(table(spark, sf_dir, "events"), "user_id")


@query(
    "A16 E11 A02",
    """select count(*) filter (quality = 1) as positives, count(*) filter (quality = 0) as negatives,
              count(*) filter (quality = 1) / nullif(cast(count(*) filter (quality = 0) as double), 0) as ratio from labels""",
)
def class_balance(spark, sf_dir):
    return profile.class_ratio(table(spark, sf_dir, "labels"), "quality")


@query("T01 T02", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5")
def preview_rows(spark, sf_dir):
    """The first five rows in an order."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(
        F.desc("o_totalprice"), "o_orderkey"
    ).limit(5)


@query("U02", "select distinct event_type, user_id from events")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", "user_id").dropDuplicates()


@query(
    "U04",
    f"""select o_orderkey, o_custkey, cast(case when {hash_unit('o_orderkey', 'o_custkey')} < 0.8 then 1 else 0 end as integer) as in_train
        from orders""",
)
def hash_split_rows(spark, sf_dir):
    """A reproducible 80/20 split by a hash of the key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    train, test = dataset.hash_split(orders, ["o_orderkey", "o_custkey"], 0.8, 42)
    return train.withColumn("in_train", F.lit(1)).unionByName(test.withColumn("in_train", F.lit(0)))


@query("U04")
def random_split_rows(spark, sf_dir):
    """Spark's own random split, sizes per part."""
    train, test = dataset.random_split(table(spark, sf_dir, "orders"), 0.8, 42)
    parts = {"train": train, "test": test}
    sizes = [profile.row_count(df).withColumn("part", F.lit(name)) for name, df in parts.items()]
    return sizes[0].unionByName(sizes[1])


@query("U04", "select true as complete, true as disjoint, true as near_share")
def random_split_parts(spark, sf_dir):
    """Spark's split puts every order in exactly one part, about four fifths of them in one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    train, test = dataset.random_split(orders, 0.8, 42)
    parts = train.withColumn("p", F.lit(1)).unionByName(test.withColumn("p", F.lit(0)))
    per_key = parts.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max("p").alias("p"))
    seen = per_key.agg(F.count("*").alias("keys"), F.max("n").alias("most"), F.avg("p").alias("share"))
    total = orders.agg(F.count_distinct("o_orderkey").alias("total"))
    return seen.select(
        (F.col("keys") == total.scalar()).alias("complete"), (F.col("most") == 1).alias("disjoint"),
        F.col("share").between(0.75, 0.85).alias("near_share"),
    )


@query("U05", sql("select 1 - quality as rare, case when quality = 0 then count(*) end as kept, true as balanced from docs group by quality", "docs"))
def undersampled_random_balance(spark, sf_dir):
    """The stratified sample keeps the rare class whole and thins the other to about its size."""
    docs = materialise(document_features(spark, sf_dir).select("doc_id", (1 - F.col("quality")).alias("rare")), "docs")
    ratio = profile.class_ratio(docs, "rare").first()["ratio"]
    counts = dataset.undersample_random(docs, "rare", ratio or 1.0, 42).groupBy("rare").agg(F.count("*").alias("rows"))
    rare = docs.agg(F.count_if(F.col("rare") == 1).alias("of_rare"))
    return counts.withColumn("of_rare", rare.scalar()).select(
        "rare", F.when(F.col("rare") == 1, F.col("rows")).alias("kept"),
        (F.abs(F.col("rows") - F.col("of_rare")) <= 4 * F.sqrt("of_rare")).alias("balanced"),
    )


@query(
    "U05 E11",
    sql(f"""select doc_id, quality from docs where quality = 1 and ({hash_unit('doc_id', seed='sample-42')} <
              (select count(*) filter (quality = 0) / cast(count(*) filter (quality = 1) as double) from docs))
            or quality = 0""", "docs"),
)
def undersampled_majority(spark, sf_dir):
    """All of the rare class and a hash sample of the common one of about the same size."""
    docs = document_features(spark, sf_dir).select(
        "doc_id", "quality", (1 - F.col("quality")).alias("rare")
    )
    return dataset.undersample(docs, "rare", ["doc_id"], 42).select("doc_id", "quality")


@query("U05")
def undersampled_random(spark, sf_dir):
    """Spark's stratified sample of the majority class, class counts."""
    docs = document_features(spark, sf_dir).select("doc_id", (1 - F.col("quality")).alias("rare"))
    ratio = profile.class_ratio(docs, "rare").first()["ratio"]
    sampled = dataset.undersample_random(docs, "rare", ratio or 1.0, 42)
    return sampled.groupBy("rare").agg(F.count("*").alias("rows"))


@query(
    "A04 A05 A06",
    sql("""select state, count(*) as rows, round(quantile_disc(cast(med as double), 0.1), 4) as p10,
                  round(quantile_disc(cast(med as double), 0.5), 4) as p50, round(quantile_disc(cast(med as double), 0.9), 4) as p90
           from spend group by state""", "spend"),
)
def sketched_percentiles(spark, sf_dir):
    """Percentiles per state from stored sketches per state and year; exact for groups of this size."""
    stored = sketches.sketch_table(spend_panel(spark, sf_dir), ["state", "year"], "med", "id")
    by_state = sketches.merged(stored, ["state"])
    found = sketches.percentiles(by_state, ["state", "rows"], {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return found.withColumns({c: F.round(c, 4) for c in ("p10", "p50", "p90")})


@query(
    "A15 J07",
    sql("""select s.state, count(distinct s.id) as keys, count(distinct c.c_custkey) as known_keys
           from spend s left join (select c_custkey from customer where c_acctbal > 0) c on s.id = c.c_custkey group by s.state""", "spend"),
)
def sketched_key_coverage(spark, sf_dir):
    """Customers per state over all years, and those of them with a positive balance, by intersecting stored sketches."""
    stored = sketches.sketch_table(spend_panel(spark, sf_dir), ["state", "year"], "med", "id")
    positive = table(spark, sf_dir, "customer").filter("c_acctbal > 0").withColumn("all", F.lit(0))
    reference = sketches.sketch_table(positive, ["all"], "c_acctbal", "c_custkey")
    covered = sketches.common_keys(sketches.merged(stored, ["state"]), "state", reference)
    return covered.select("state", F.col("keys").cast("bigint").alias("keys"), F.col("known_keys").cast("bigint").alias("known_keys"))
