"""Queries on readers, writers and materialised tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions import join_key
from cohortlens.operators.scale import materialise, new_table_path
from cohortlens.plans.derived_tables import attribute_table, count_table, spend_panel, table
from cohortlens.plans.oracles import sql
from cohortlens.plans.registry import query
from cohortlens.plans.queries_panel import SETTINGS
from cohortlens.plans.study import LABEL, feature_panel, labelled_cohort, typed_attributes
from cohortlens.sources import arrivals
from cohortlens.sources import tables as io
from cohortlens.sources.schemas import ATTRIBUTES, COUNT_SCHEMA

_COUNT_CHECK = """
select state, year, count(*) as rows, cast(sum(B19013_001E) as bigint) as income,
       cast(sum(B01003_001E) as bigint) as people, count(B01002_001E) as with_age
from raw group by state, year
"""


def _count_check(counts):
    return counts.groupBy("state", "year").agg(
        F.count("*").alias("rows"),
        F.sum("B19013_001E").alias("income"),
        F.sum("B01003_001E").alias("people"),
        F.count("B01002_001E").alias("with_age"),
    )


@query("S01 S05 S06 F10", sql(_COUNT_CHECK, "raw"))
def csv_count_files(spark, sf_dir):
    """Counts written as one CSV folder per state and year, read back by glob with a schema."""
    path = new_table_path(spark, "counts-csv")
    io.write_csv(count_table(spark, sf_dir), path, ["state", "year"])
    return _count_check(io.read_counts(spark, path))


@query(
    "S01",
    sql("""select state, year, count(*) as rows, round(avg(B01002_001E), 6) as age
           from (select cast(state as integer) as state, year, B01002_001E from raw) group by state, year""", "raw"),
)
def csv_inferred_types(spark, sf_dir):
    """The same files with inferred types: the numeric state code becomes an integer."""
    path = new_table_path(spark, "counts-csv")
    io.write_csv(count_table(spark, sf_dir), path)
    return io.read_csv(spark, path, infer=True).groupBy("state", "year").agg(
        F.count("*").alias("rows"), F.round(F.avg("B01002_001E"), 6).alias("age")
    )


@query("S02 P08", sql("select GEOID10, INTPTLAT10, INTPTLON10, ALAND10 from attributes", "attributes"))
def csv_attribute_files(spark, sf_dir):
    """All-text attribute files, typed after reading."""
    path = new_table_path(spark, "attributes-csv")
    io.write_csv(attribute_table(spark, sf_dir), path)
    return typed_attributes(io.read_attributes(spark, path))


@query(
    "S03 S04",
    """select cast(o_orderkey as bigint) as order_key, cast(o_custkey as bigint) as cust_key,
              o_orderstatus as status, cast(year(o_orderdate) as integer) as year, 2010 as vintage
       from orders""",
)
def json_array_tables(spark, sf_dir):
    """JSON tables (header row first) packed from the orders, written, read and parsed back."""
    orders = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 500).alias("chunk"),
        F.array(
            F.col("o_orderkey").cast("string"),
            F.col("o_custkey").cast("string"),
            F.col("o_orderstatus"),
            F.year("o_orderdate").cast("string"),
        ).alias("row"),
    )
    header = F.array(*[F.lit(c) for c in ("order_key", "cust_key", "status", "year")])
    # Order keys are unique, so a chunk of 500 keys is at most 500 rows.
    packed = orders.groupBy("chunk").agg(F.collect_list("row").alias("rows")).select(
        F.to_json(F.concat(F.array(header), F.col("rows"))).alias("value")
    )
    path = new_table_path(spark, "json")
    packed.write.text(path)
    rows = io.read_json_tables(
        spark, path, ["cust_key", "order_key", "status", "year"], one_per_file=False
    )
    return io.stamp(
        rows.select(
            F.col("order_key").try_cast("bigint").alias("order_key"),
            F.col("cust_key").try_cast("bigint").alias("cust_key"),
            "status",
            F.col("year").try_cast("int").alias("year"),
        ),
        vintage=2010,
    )


@query(
    "S03 S04",
    """select cast(n_nationkey as bigint) as nation, cast(c_custkey as bigint) as customer, c_mktsegment as segment
       from customer join nation on c_nationkey = n_nationkey""",
)
def json_document_files(spark, sf_dir):
    """JSON tables of one document per file (pretty to read whole), one file per nation."""
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_custkey").cast("string").alias("customer"), F.col("c_mktsegment").alias("segment")
    )
    # The line is split over several so that only a reader of whole files can parse it.
    rows = customers.select("nation", F.concat(F.lit(",\n"), F.to_json(F.array("customer", "segment", F.col("nation").cast("string")))).alias("value"))
    ends = customers.select("nation").distinct().select(
        "nation", F.explode(F.array(F.lit('[["customer", "segment", "nation"]'), F.lit("]"))).alias("value")
    )
    ordered = rows.unionByName(ends).repartition(25, "nation").sortWithinPartitions(
        "nation", F.when(F.col("value").startswith("[["), 0).when(F.col("value") == "]", 2).otherwise(1)
    )
    path = new_table_path(spark, "json-files")
    ordered.write.partitionBy("nation").text(path)
    back = io.read_json_tables(spark, f"{path}/nation=*", ["nation", "customer", "segment"])
    return back.select(
        F.col("nation").try_cast("bigint").alias("nation"), F.col("customer").try_cast("bigint").alias("customer"), "segment"
    )


@query("S01", sql("select state, year, count(*) as rows, cast(sum(B01003_001E) as bigint) as people from raw group by state, year", "raw"))
def csv_columns_by_name(spark, sf_dir):
    """Files with the columns in two different orders, read by glob and by name."""
    path = new_table_path(spark, "ordered-csv")
    counts = count_table(spark, sf_dir).select("GEO_ID", "state", "year", "B01003_001E")
    io.write_csv(counts.filter("year % 2 = 0"), f"{path}/census_even")
    io.write_csv(counts.filter("year % 2 = 1").select("B01003_001E", "year", "GEO_ID", "state"), f"{path}/census_odd")
    wanted = "year int, state string, B01003_001E bigint"
    back = io.read_csv_files(spark, [f"{path}/census_e*", f"{path}/census_o*"], wanted)
    return back.groupBy("state", "year").agg(F.count("*").alias("rows"), F.sum("B01003_001E").alias("people"))


@query(
    "S04 X03",
    sql("select state, year, count(*) as rows, cast(sum(B01003_001E) as bigint) as people from raw group by state, year", "raw"),
)
def path_stamped_files(spark, sf_dir):
    """State and year taken from file names of the form census_<state>_<year>."""
    path = new_table_path(spark, "named-csv")
    counts = count_table(spark, sf_dir)
    named = counts.select(
        "B01003_001E", join_key(F.lit("census"), "state", F.col("year").cast("string")).alias("file")
    )
    io.write_csv(named, path, ["file"])
    back = io.read_csv(spark, f"{path}/file=census_*", "B01003_001E bigint")
    return io.stamp_from_path(back).groupBy("state", "year").agg(
        F.count("*").alias("rows"), F.sum("B01003_001E").alias("people")
    )


@query("S05 S06 S08 J04 A12", sql("select * from labelled", "labelled"))
def years_arriving(spark, sf_dir):
    """Labels of the study from files that arrive in three deliveries, each year derived again only if it can change."""
    inbox, store = new_table_path(spark, "inbox"), new_table_path(spark, "store")
    named = materialise(count_table(spark, sf_dir).withColumn("file", join_key(F.lit("census"), "state", F.col("year").cast("string"))), "named")
    deliveries = (F.col("year") < 1995, F.col("year") == 1995, F.col("year") > 1995)
    for number, delivered in enumerate(deliveries):
        io.write_csv(named.where(delivered), f"{inbox}/delivery{number}", ["file"])
        arrivals.take_arrivals(
            spark, [inbox], store, COUNT_SCHEMA, lambda c: feature_panel(c, SETTINGS),
            lambda p: labelled_cohort(materialise(p, "panel"), SETTINGS), "labels", SETTINGS.horizon,
        )
    panel = feature_panel(count_table(spark, sf_dir), SETTINGS).limit(0)
    return arrivals.read_parts(spark, f"{store}/labels", panel.withColumn(LABEL, F.lit(0)))


@query("S05 U01 U03", "select o_orderkey, o_custkey, cast(year(o_orderdate) as integer) as year from orders")
def combined_year_tables(spark, sf_dir):
    """Yearly tables with different column orders appended by name."""
    orders = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    early = orders.filter(F.col("year") < 1998).select("o_orderkey", "o_custkey", "year")
    late = orders.filter(F.col("year") >= 1998).select("year", "o_custkey", "o_orderkey")
    return io.combine([early, late])


@query("S07", sql("select id, state, year, med, pop from spend", "spend"))
def csv_result_sink(spark, sf_dir):
    """A final table written as CSV in parallel and read back."""
    path = new_table_path(spark, "result-csv")
    result = spend_panel(spark, sf_dir).select("id", "state", "year", "med", "pop")
    io.write_csv(result, path, rows_per_file=1_000_000)
    return io.read_csv(spark, path, result.schema)


@query(
    "S08 F10",
    sql("select id, med, pci, pop, state, year from spend where state = 7 and year between 1996 and 1997", "spend"),
)
def partitioned_table_round_trip(spark, sf_dir):
    """A saved panel laid out by state and year; the filter prunes whole folders."""
    path = new_table_path(spark, "panel")
    io.write_table(spend_panel(spark, sf_dir), path, ["state", "year"])
    back = io.read_table(spark, path)
    return back.filter((F.col("state") == 7) & F.col("year").between(1996, 1997)).select(
        "id", "med", "pci", "pop", "state", "year"
    )


@query(
    "S10 A01",
    sql("select year, count(*) as rows, cast(sum(population) as bigint) as people from panel group by year", "panel"),
)
def materialised_panel(spark, sf_dir):
    """The feature panel written once mid-way, then aggregated."""
    panel = materialise(feature_panel(count_table(spark, sf_dir)), "panel")
    return panel.groupBy("year").agg(F.count("*").alias("rows"), F.sum("population").alias("people"))


_ANCHORS = """
select page_id, cast(pos as integer) as pos, list_extract(texts, pos) as text
from (select page_id, texts, unnest(generate_series(1, len(texts))) as pos
      from (select page_id, {texts} as texts from pages))
"""
_ALL = (
    r"list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a\s*>', 1), "
    r"lambda t: regexp_replace(t, '(?s)<[^>]*>', '', 'g'))"
)


@query("S11", _ANCHORS.format(texts=_ALL))
def page_anchor_texts(spark, sf_dir):
    """Every link text of every page with its position."""
    return io.anchors(table(spark, sf_dir, "pages"), "page_id", "html")


@query("S11 X02", f"""
select page_id, pos, text, substr(text, 1, 2) as code from (
{_ANCHORS.format(texts=f"list_slice({_ALL}, 6, 56)")})""")
def page_anchor_slice(spark, sf_dir):
    """The positional slice of the link list (51 links from the sixth on) and its two-letter codes."""
    links = io.anchors(table(spark, sf_dir, "pages"), "page_id", "html", 6, 51)
    return links.withColumn("code", F.substring("text", 1, 2))
