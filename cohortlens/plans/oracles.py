"""Independent SQL building blocks for the result checks: common table expressions by name."""

from __future__ import annotations

from cohortlens.sources.schemas import FEATURES, MEASURES
from cohortlens.plans.study import MODEL_FEATURES, NEIGHBOR_MEANS

_WOMEN = ", ".join(
    f"count(*) filter (l_linestatus = 'O' and l_linenumber = {i}) as B15002_03{i + 1}E" for i in range(1, 5)
)
_MEN = ", ".join(
    f"count(*) filter (l_linestatus = 'F' and l_linenumber = {i}) as B15002_01{i + 4}E" for i in range(1, 5)
)

CTES: dict[str, str] = {}

CTES["lines"] = """
select o_custkey, cast(year(o_orderdate) as integer) as year, l_linenumber, l_returnflag, l_linestatus,
       cast(l_quantity as bigint) as qty, cast(floor(l_extendedprice) as bigint) as price
from lineitem join orders on l_orderkey = o_orderkey
"""

CTES["raw"] = f"""
select case when sum(qty) < 15 then -666666666 else cast(sum(price) as bigint) end as B19013_001E,
       cast(floor(cast(sum(price) as double) / cast(sum(qty) as double)) as bigint) as B19301_001E,
       count(*) filter (l_linestatus = 'O') as B15002_019E, {_WOMEN},
       count(*) filter (l_linestatus = 'F') as B15002_002E, {_MEN},
       count(*) as B08301_001E,
       count(*) filter (l_returnflag = 'N') as B08301_003E,
       count(*) filter (l_returnflag = 'A') as B08301_004E,
       count(*) filter (l_returnflag = 'R' and l_linenumber <= 2) as B08301_010E,
       count(*) filter (l_returnflag = 'R' and l_linenumber between 3 and 4) as B08301_019E,
       count(*) filter (l_returnflag = 'R' and l_linenumber >= 5) as B08301_021E,
       cast(sum(qty) as bigint) as B02001_001E,
       cast(coalesce(sum(qty) filter (l_linestatus = 'O'), 0) as bigint) as B02001_002E,
       cast(coalesce(sum(qty) filter (l_returnflag = 'A'), 0) as bigint) as B02001_003E,
       cast(sum(qty) filter (l_returnflag = 'R') as double)
         / nullif(count(*) filter (l_returnflag = 'R'), 0) as B01002_001E,
       cast(sum(qty) as bigint) as B01003_001E,
       '1400000US' || lpad(cast(o_custkey as varchar), 11, '0') as GEO_ID,
       any_value(c_name) as NAME,
       lpad(cast(any_value(c_nationkey) as varchar), 2, '0') as state,
       lpad(cast(o_custkey % 7 as varchar), 3, '0') as county,
       lpad(cast(o_custkey as varchar), 6, '0') as tract,
       year
from lines join customer on o_custkey = c_custkey
group by o_custkey, year
"""

CTES["attributes"] = """
select lpad(cast(o_custkey as varchar), 11, '0') as GEOID10,
       any_value(c_acctbal) as INTPTLAT10,
       cast(sum(price) as double) / cast(sum(qty) as double) as INTPTLON10,
       cast(sum(price) * 1000 as bigint) as ALAND10
from lines join customer on o_custkey = c_custkey
where c_acctbal > -900
group by o_custkey
"""


def _sum(*names: str) -> str:
    return "(" + " + ".join(names) + ")"


_W = [f"B15002_0{i}E" for i in (32, 33, 34, 35)]
_M = [f"B15002_0{i}E" for i in (15, 16, 17, 18)]


def _div(a: str, b: str) -> str:
    return f"cast({a} as double) / nullif({b}, 0)"


FEATURE_SQL = {
    "ed_total": _div(_sum(*_W, *_M), "(B15002_019E + B15002_002E)"),
    "ed_fem": _div(_sum(*_W), "B15002_019E"),
    "ed_male": _div(_sum(*_M), "B15002_002E"),
    "trans_solo": _div("B08301_003E", "B08301_001E"),
    "trans_pool": _div("B08301_004E", "B08301_001E"),
    "trans_public": _div("B08301_010E", "B08301_001E"),
    "trans_walk": _div("B08301_019E", "B08301_001E"),
    "trans_remote": _div("B08301_021E", "B08301_001E"),
    "race_white": _div("B02001_002E", "B02001_001E"),
    "race_black": _div("B02001_003E", "B02001_001E"),
    "med_house_inc": "B19013_001E",
    "per_cap_inc": "B19301_001E",
    "med_age": "B01002_001E",
    "population": "B01003_001E",
}

CTES["panel"] = (
    "select split_part(GEO_ID, 'US', 2) as GEO_ID, NAME, state, county, tract, year, "
    + ", ".join(f"{FEATURE_SQL[f]} as {f}" for f in FEATURES)
    + " from raw where B19013_001E > 0 and "
    + " and ".join(f"{m} is not null" for m in MEASURES)
)

CTES["p10"] = """
select state, year, quantile_cont(cast(med_house_inc as double), 0.1) as p10
from panel where year <= 1998 group by state, year
"""
CTES["p20"] = """
select state, year, quantile_cont(cast(med_house_inc as double), 0.2) as p20
from panel group by state, year
"""
CTES["cohort"] = "select panel.* from panel join p10 using (state, year) where med_house_inc <= p10"

CTES["labelled"] = """
select c.*, cast(case when coalesce((e.best - c.per_cap_inc) / nullif(c.per_cap_inc, 0) >= 0.2, false)
                     or coalesce(e.reached, false) then 1 else 0 end as integer) as gent
from cohort c left join (
  select b.GEO_ID, b.year, cast(max(f.per_cap_inc) as double) as best, bool_or(f.med_house_inc >= p20) as reached
  from cohort b join panel f on f.GEO_ID = b.GEO_ID and f.year between b.year + 1 and b.year + 3
  join p20 on p20.state = f.state and p20.year = f.year
  group by b.GEO_ID, b.year) e on e.GEO_ID = c.GEO_ID and e.year = c.year
"""

CTES["located"] = "select panel.*, a.* from panel join attributes a on GEO_ID = GEOID10 where " + " and ".join(
    f"{f} is not null" for f in FEATURES
)
CTES["placed"] = "select labelled.*, a.* from labelled join attributes a on GEO_ID = GEOID10 where " + " and ".join(
    f"{f} is not null" for f in FEATURES
)

CTES["near"] = """
select state, year, GEO_ID, nid, dist, rank from (
  select q.state, q.year, q.GEO_ID, c.GEO_ID as nid,
         sqrt((q.INTPTLAT10 - c.INTPTLAT10) * (q.INTPTLAT10 - c.INTPTLAT10)
            + (q.INTPTLON10 - c.INTPTLON10) * (q.INTPTLON10 - c.INTPTLON10)) as dist,
         cast(row_number() over (partition by q.GEO_ID, q.year order by
           sqrt((q.INTPTLAT10 - c.INTPTLAT10) * (q.INTPTLAT10 - c.INTPTLAT10)
              + (q.INTPTLON10 - c.INTPTLON10) * (q.INTPTLON10 - c.INTPTLON10)), c.GEO_ID) as integer) as rank
  from placed q join located c on q.state = c.state and q.year = c.year and q.GEO_ID <> c.GEO_ID)
where rank <= 10
"""

CTES["around"] = (
    "select n.GEO_ID, n.year, "
    + ", ".join(
        f"case when count({f} * population) = count(*) then sum({f} * population) / nullif(sum(population), 0) end as n_{f}"
        for f in NEIGHBOR_MEANS
    )
    + ", cast(sum(population) as bigint) as n_population, cast(sum(ALAND10) as bigint) as n_land_area"
    " from near n join located p on p.GEO_ID = n.nid and p.year = n.year group by n.GEO_ID, n.year"
)

CTES["matrix"] = (
    "select placed.GEO_ID, state, "
    + ", ".join(("placed." if f == "year" else "") + f for f in MODEL_FEATURES)
    + ", gent from placed join around on around.GEO_ID = placed.GEO_ID and around.year = placed.year"
)

CTES["spend"] = """
select id, c_nationkey as state, year, med, cast(med as double) / pop as pci, pop from (
  select o_custkey as id, cast(year(o_orderdate) as integer) as year,
         cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as med, count(*) as pop
  from orders group by all) join customer on id = c_custkey
"""
CTES["spend_p10"] = """
select state, year, quantile_cont(cast(med as double), 0.1) as p10
from spend where year <= 1998 group by state, year
"""
CTES["spend_cohort"] = "select spend.* from spend join spend_p10 using (state, year) where med <= p10"

CTES["points"] = """
select vec_id as id, label as state, cast(embedding[1] as double) as lat, cast(embedding[2] as double) as lon,
       cast(embedding[3] as double) as f1,
       case when embedding[4] > -0.2 then cast(embedding[4] as double) end as f2,
       vec_id % 97 as pop
from embeddings
"""
CTES["point_pairs"] = """
select a.state, a.id, b.id as nid,
       sqrt((a.lat - b.lat) * (a.lat - b.lat) + (a.lon - b.lon) * (a.lon - b.lon)) as dist
from points a join points b on a.state = b.state and a.id <> b.id
"""
CTES["point_near"] = """
select state, id, nid, dist, rank from (
  select *, cast(row_number() over (partition by id order by dist, nid) as integer) as rank from point_pairs)
where rank <= 10
"""

CTES["docs"] = """
select doc_id, lang, cast(n_chars as double) as n_chars, cast(len(words) as double) as n_words,
       cast(len(list_distinct(words)) as double) / len(words) as distinct_share,
       cast(length(text) - length(translate(text, '.,;:!?', '')) as double) as n_punct, quality, toxic
from (select *, string_split(text, ' ') as words from documents) join labels using (doc_id)
"""
CTES["scored"] = """
select doc_id, lang, quality as label, n_chars, n_words, distinct_share, n_punct,
       round(1 / (1 + exp(2 - 4 * distinct_share)), 4) as score,
       cast(case when 1 / (1 + exp(2 - 4 * distinct_share)) > 0.75 then 1 else 0 end as integer) as prediction
from docs
"""

# Which expressions each one reads, so a query lists only what it names.
NEEDS = {
    "raw": ["lines"],
    "attributes": ["lines"],
    "panel": ["raw"],
    "p10": ["panel"],
    "p20": ["panel"],
    "cohort": ["panel", "p10"],
    "labelled": ["cohort", "panel", "p20"],
    "located": ["panel", "attributes"],
    "placed": ["labelled", "attributes"],
    "near": ["placed", "located"],
    "around": ["near", "located"],
    "matrix": ["placed", "around"],
    "spend_p10": ["spend"],
    "spend_cohort": ["spend", "spend_p10"],
    "point_pairs": ["points"],
    "point_near": ["point_pairs"],
    "scored": ["docs"],
}


def sql(body: str, *names: str, **extra: str) -> str:
    """``body`` behind the named expressions and everything they read; ``extra`` adds own ones."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} as materialized ({CTES[n].strip()})" for n in ordered]
    parts += [f"{n} as ({text.strip()})" for n, text in extra.items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def hash_unit(*keys: str, seed: int | str = 42) -> str:
    """SQL of the reproducible number in [0, 1) per key."""
    text = " || '|' || ".join([*[f"cast({k} as varchar)" for k in keys], f"'{seed}'"])
    return f"cast(('0x' || substr(md5({text}), 1, 8)) as bigint) / 4294967296.0::double"
