"""Domain views over the driver's tables, as query texts for both engines.

Keys come from integer arithmetic, so that both engines make the same rows.
``with_views("trees", "faces")`` gives a WITH clause that later queries go on from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parasol.plans.dialect import run


def choose(of: str, values: list[str | None]) -> str:
    """values[of] as a CASE expression."""
    arms = " ".join(f"when {i} then {'null' if v is None else repr(v)}" for i, v in enumerate(values))
    return f"case {of} {arms} end"


CONDITIONS = ["Excellent", "Good", "Fair", "Poor", "Critical", "Unknown", "Dead", ""]
SPECIES = [
    "Quercus bicolor - swamp white oak",
    "Pinus strobus - white pine",
    "Acer rubrum - red maple",
    "Ilex opaca - holly",
    "Tilia cordata - linden",
    "Picea abies - spruce",
    "Platanus x acerifolia - plane",
    "Thuja plicata - cedar",
    "",
    "Gleditsia - honeylocust",
]
PARK_TYPES = ["Neighborhood Park", "Parkway", "Strip", "Buildings/Institutions", "Triangle/Plaza", "Mall", "Lot", "Cemetery"]
SUBTYPES = ["Garden", "Large Park", "Building", None]
HIGHWAYS = ["footway", "path", "steps", "pedestrian", "residential", "cycleway", "service", "primary", None]

VIEWS = {
    "trees": f"""
        select p_partkey as tree_id,
               case when p_partkey % 53 = 0 then null when p_partkey % 59 = 0 then 'x' when p_partkey % 61 = 0 then '-3'
                    else cast(p_size as STRING) end as dbh,
               {choose('p_partkey % 8', CONDITIONS)} as tpcondition,
               {choose('p_partkey % 10', SPECIES)} as genusspecies,
               p_partkey % 101 as face_id,
               (p_partkey % 400) * 3e0 as x,
               (p_partkey DIV 400) * 37e0 + ((p_partkey * 7) % 11) as y
        from @part""",
    "tree_values": """
        select *, case when trim(coalesce(tpcondition, '')) = 'Dead' or not coalesce(try_cast(dbh as double), 0e0) > 0 then null
                  else case trim(coalesce(tpcondition, '')) when 'Excellent' then 1e0 when 'Good' then 0.85e0 when 'Fair' then 0.6e0
                       when 'Poor' then 0.3e0 when 'Critical' then 0.1e0 else 0.5e0 end * least(try_cast(dbh as double), 30e0) / 30e0 end as value,
               split_part(coalesce(genusspecies, ''), ' ', 1) in
                   ('Pinus', 'Picea', 'Abies', 'Tsuga', 'Juniperus', 'Thuja', 'Ilex', 'Magnolia', 'Cedrus', 'Chamaecyparis', 'Cryptomeria', 'Taxus') as is_evergreen
        from trees""",
    "nodes": """
        select c_custkey as k, c_custkey % 40 as col, c_custkey DIV 40 as row_no,
               (c_custkey % 40) * 100e0 as x, (c_custkey DIV 40) * 80e0 as y,
               -74e0 + (c_custkey % 40) * 0.0012e0 as lon, 40.66e0 + (c_custkey DIV 40) * 0.0007e0 as lat
        from @customer""",
    "edges": """
        select 2 * k as edge_id, k as u, k + 1 as v, 'Row ' || cast(row_no as STRING) as name, 100e0 + (k % 7) * 0.5e0 as length_m
        from nodes where k % 40 < 39 and k % 17 <> 0 and k % 97 <> 5 and (k + 1) % 97 <> 5 and k + 1 < (select count(*) from nodes)
        union all
        select 2 * k + 1, k, k + 40, 'Col ' || cast(col as STRING), 80e0 + (k % 7) * 0.5e0
        from nodes where k % 23 <> 0 and row_no % 10 <> 9 and k % 97 <> 5 and (k + 40) % 97 <> 5 and k + 40 < (select count(*) from nodes)""",
    "placed_edges": """
        select e.edge_id, e.name, a.x as ux, a.y as uy, b.x as vx, b.y as vy, 1e0 - e.edge_id % 2 as dx, e.edge_id % 2 * 1e0 as dy, (e.edge_id * 13) % 47 - 3.3e0 as o
        from edges e join nodes a on a.k = e.u join nodes b on b.k = e.v""",
    "streets": """
        select edge_id as street_id, name, ux as ax, uy as ay, (ux + vx) / 2 - 2.3e0 * dy as mx, (uy + vy) / 2 + 2.3e0 * dx as my, vx as zx, vy as zy from placed_edges
        union all
        select -1 - edge_id, 'Lane ' || cast(edge_id % 20 as STRING), ux - 24.4e0 * dy, uy + 24.4e0 * dx, (ux + vx) / 2 - 25.9e0 * dy, (uy + vy) / 2 + 25.9e0 * dx, vx - 24.4e0 * dy, vy + 24.4e0 * dx
        from placed_edges where edge_id % 5 = 0""",
    "side_paths": """
        select edge_id, case when edge_id % 6 = 0 then name when edge_id % 6 = 1 then '' end as name, name as beside,
               case when edge_id % 7 = 1 then 'footway_crossing' else 'footway' end as kind, ux + 4e0 * dx - o * dy as ax, uy + 4e0 * dy + o * dx as ay,
               case when edge_id % 9 = 2 then ux + 5.5e0 * dx - o * dy else (ux + vx) / 2 - (o + 1.7e0) * dy end as mx,
               case when edge_id % 9 = 2 then uy + 5.5e0 * dy + o * dx else (uy + vy) / 2 + (o + 1.7e0) * dx end as my,
               case when edge_id % 9 = 2 then ux + 7e0 * dx - o * dy else vx - 4e0 * dx - (o + case when edge_id % 10 = 3 then 65e0 else 0e0 end) * dy end as zx,
               case when edge_id % 9 = 2 then uy + 7e0 * dy + o * dx else vy - 4e0 * dy + (o + case when edge_id % 10 = 3 then 65e0 else 0e0 end) * dx end as zy
        from placed_edges""",
    "scored_edges": """
        select *, ((edge_id * 7) % 40) / 10e0 as tree_deciduous, ((edge_id * 3) % 10) / 10e0 as tree_evergreen,
               (edge_id * 5) % 9 as tree_count, ((edge_id * 11) % 20) / 20e0 as tree_park_canopy
        from edges""",
    "moments": """
        select event_id, user_id, event_type, ts,
               case when event_id % 11 = 0 then null else 1 + event_id % 12 end as month,
               case when event_id % 7 = 0 then null else 1 + event_id % 31 end as day,
               case when event_id % 13 = 0 then null else event_id % 26 - 1 end as hour,
               case when event_id % 5 = 0 then null else (event_id * 7) % 60 end as minute,
               event_type = 'purchase' as arrive,
               case event_type when 'view' then 'both' when 'click' then 'trees' when 'signup' then 'buildings' when 'error' then 'sky' else 'both' end as layers,
               event_id % 6 as n_weights,
               (event_id % 45) * 1e0 as top_weight
        from @events""",
    "requests": """
        select event_id, user_id, arrive, layers, n_weights, top_weight, hour is null as no_hour,
               cast(coalesce(month, extract(month from ts)) as bigint) as month,
               cast(case when day is not null then day when month is null then extract(day from ts) else 15 end as bigint) as day,
               cast(coalesce(hour, extract(hour from ts)) as bigint) as hour,
               cast(case when minute is not null then minute when hour is null then extract(minute from ts) else 0 end as bigint) as minute
        from moments""",
    "valid_moments": """
        select event_id, layers, month, day, hour, minute from requests
        where month between 1 and 12 and hour between 0 and 23 and layers <> 'sky'
          and day between 1 and case month when 2 then 29 when 4 then 30 when 6 then 30 when 9 then 30 when 11 then 30 else 31 end""",
    "blends": """
        select *, case when day >= 15 then month else (month + 10) % 12 + 1 end as m0,
               case when day >= 15 then month % 12 + 1 else month end as m1,
               case when day >= 15 then (day - 15) / (case month when 2 then 28e0 when 4 then 30e0 when 6 then 30e0 when 9 then 30e0 when 11 then 30e0 else 31e0 end)
                    else ((case (month + 10) % 12 + 1 when 2 then 28e0 when 4 then 30e0 when 6 then 30e0 when 9 then 30e0 when 11 then 30e0 else 31e0 end) - 15 + day)
                         / (case (month + 10) % 12 + 1 when 2 then 28e0 when 4 then 30e0 when 6 then 30e0 when 9 then 30e0 when 11 then 30e0 else 31e0 end) end as g
        from valid_moments""",
    "faces": """
        select s_suppkey as face_id, s_suppkey DIV 2 as segment_id, case when s_suppkey % 2 = 0 then 'L' else 'R' end as side,
               s_name as street, 20 + s_suppkey % 60 as width_ft, 1 + s_nationkey % 5 as boro,
               20e0 * (s_suppkey % 10) as ax, 60e0 * (s_suppkey DIV 10) as ay, 20e0 * (s_suppkey % 10) + 18e0 as bx, 60e0 * (s_suppkey DIV 10) + (s_suppkey % 3) * 2e0 as bby
        from @supplier""",
    "profiles": "select l_orderkey as edge_id, l_suppkey as face_id, sum(l_quantity) as metres from @lineitem group by l_orderkey, l_suppkey",
    "buildings": f"""
        select p_partkey as building_id,
               case when p_partkey % 37 = 0 then null when p_partkey % 41 = 0 then '0' when p_partkey % 43 = 0 then '9999' when p_partkey % 47 = 0 then 'tall'
                    else cast(cast(p_partkey % 900 + 10 as bigint) as STRING) end as height_roof,
               case when p_partkey % 29 = 0 then 'Demolition' else 'Constructed' end as status,
               case when p_partkey % 31 = 0 then '1003' else '2100' end as feature_code,
               (p_partkey % 50) * 30e0 as x0, (p_partkey DIV 50) * 30e0 as y0, 1 + p_partkey % 12 as floors, case when p_partkey % 4 = 0 then p_partkey - p_partkey % 8 else p_partkey end as bbl,
               1990 + p_partkey % 30 as edit_year, case when p_partkey % 3 = 0 then null else 1600 + (p_partkey * 7) % 430 end as year_a, 1600 + (p_partkey * 11) % 425 as year_b
        from @part""",
    "parks": f"""
        select n_nationkey as park_id, {choose('n_nationkey % 8', PARK_TYPES)} as typecategory, {choose('n_nationkey % 4', SUBTYPES)} as subcategory,
               (n_nationkey % 5) * 900e0 as x0, (n_nationkey DIV 5) * 500e0 as y0, (n_nationkey % 5) * 900e0 + 450e0 + n_nationkey * 10e0 as x1, (n_nationkey DIV 5) * 500e0 + 380e0 as y1
        from @nation""",
    "ways": f"""
        select p_partkey as way_id, {choose('p_partkey % 9', HIGHWAYS)} as highway,
               {choose('p_partkey % 5', [None, 'yes', 'no', 'designated', 'private'])} as foot,
               {choose('p_partkey % 7', [None, 'private', 'no', 'yes', 'customers', 'permissive', None])} as access,
               {choose('p_partkey % 11', ['yes', None, 'no', None, None, None, None, None, None, None, None])} as area,
               {choose('p_partkey % 4', ['sidewalk', 'crossing', None, ''])} as footway,
               {choose('p_partkey % 6', [None, 'driveway', 'alley', 'parking_aisle', 'private', None])} as service,
               case when p_partkey % 3 = 0 then null when p_partkey % 10 = 1 then '' else 'Street ' || cast(p_partkey % 40 as STRING) end as name
        from @part""",
    "route_results": """
        select o_orderkey as result_id, o_custkey as request, case substring(o_orderpriority, 1, 1) when '1' then 0e0 when '2' then 5e0 when '3' then 15e0 else 40e0 end as weight,
               case when o_orderkey % 10 = 0 then 0.5e0 else ((o_orderkey * 37) % 1000) / 1000e0 end as shade, 500e0 + (o_orderkey * 13) % 900 as length_m
        from @orders""",
    "way_nodes": """
        select l_orderkey DIV 3 as way_id, l_linenumber + 10 * (l_orderkey % 3) as pos, (l_partkey * 7 + l_linenumber) % (select max(c_custkey) + 1 from @customer) as node_id
        from @lineitem""",
}
_NEEDS = {"tree_values": ["trees"], "edges": ["nodes"], "placed_edges": ["nodes", "edges"], "streets": ["placed_edges"], "side_paths": ["placed_edges"], "scored_edges": ["edges"], "requests": ["moments"], "valid_moments": ["requests"], "blends": ["valid_moments"]}


def with_views(*names: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "with " + ", ".join(f"{n} as ({VIEWS[n]})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run(spark, sf_dir, f"{with_views(name)} select * from {name}")
