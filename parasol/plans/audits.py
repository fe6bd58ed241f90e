"""Distributions, residuals, dedupes, rankings and other audit queries: the oracle's texts."""

from __future__ import annotations

from parasol.plans.adapters import with_views

_ITEMS = "items as (select l_returnflag as grp, l_extendedprice as v, l_quantity as w, l_orderkey, l_linenumber, l_suppkey, l_partkey, l_discount as d from @lineitem)"
_POINT_IN = "x > x0 and x < x1 and y > y0 and y < y1"

QUERIES = {
    # Three conventions of percentiles by index
    "index_percentiles": f"""with {_ITEMS},
        ranked as (select grp, v, row_number() over (partition by grp order by v) - 1 as i, count(*) over (partition by grp) as n from items)
        select grp, max(case when i = least(n - 1, cast(floor(n * 0.9e0) as bigint)) then v end) as p90, max(case when i = n DIV 4 then v end) as q1, max(case when i = (3 * n) DIV 4 then v end) as q3,
               max(case when i = cast(round_even(0.5e0 * (n - 1), 0) as bigint) then v end) as p50 from ranked group by grp""",
    # The first value whose running weight reaches the share
    "weighted_percentile": f"""with {_ITEMS},
        run as (select grp, v, sum(w) over (partition by grp order by v, l_orderkey, l_linenumber, l_partkey rows between unbounded preceding and current row) as acc, sum(w) over (partition by grp) as total from items)
        select grp, min(case when acc >= 0.1e0 * total then v end) as p10, min(case when acc >= 0.5e0 * total then v end) as p50, min(case when acc >= 0.9e0 * total then v end) as p90 from run group by grp""",
    # A13
    "interpolated_percentile": f"with {_ITEMS} select grp, round(PCT(v, 0.25e0), 6) as p25, round(median(v), 6) as p50, round(PCT(v, 0.9e0), 6) as p90 from items group by grp",
    # A14, A15, A16, U1
    "zero_intercept_fit": f"with {_ITEMS} select grp, round(sum(w * v) / sum(w * w), 6) as slope, round(median(v / w), 6) as median_ratio, count(*) as n from items where w > 0 group by grp",
    "binned_median_slope": f"""with {_ITEMS},
        bins as (select grp, least(cast(floor(d * 100e0) as bigint), 9) as bin, median(v) as m, count(*) as n from items group by 1, 2)
        select grp, round(sum((bin + 0.5e0) * m) / sum((bin + 0.5e0) * (bin + 0.5e0)), 6) as slope, count(*) as bins from bins where n >= 50 group by grp""",
    "gap_width_slope": f"with {_ITEMS}, bands as (select grp, l_suppkey % 10 as band, avg(v) as m from items group by 1, 2) select grp, round(regr_slope(m, band), 6) as slope, round(regr_intercept(m, band), 6) as intercept from bands group by grp",
    # Share of tree pixels among valid ones, null below the least number
    "canopy_fraction": f"""with {_ITEMS}, pixels as (select l_suppkey as strip, l_partkey % 8 as class from items)
        select strip, case when count(case when class <> 0 then 1 end) >= 30 then round(avg(case when class = 1 then 1e0 when class <> 0 then 0e0 end), 6) end as fraction, count(case when class <> 0 then 1 end) as valid
        from pixels group by strip""",
    # A18, U10
    "lopsided_share": f"""with {_ITEMS},
        sides as (select l_suppkey as street, sum(case when l_linenumber % 2 = 0 then w else 0e0 end) as l, sum(case when l_linenumber % 2 = 1 then w else 0e0 end) as r from items group by 1),
        shares as (select street, case when street % 60 < 24 then 'narrow' when street % 60 < 40 then 'medium' else 'wide' end as width_class, greatest(l, r) / (l + r) as share, l = 0 or r = 0 as one_sided from sides where l + r > 0)
        select width_class, count(*) as n, round(avg(share), 6) as mean_share, count(case when share >= 0.7e0 then 1 end) as n70, count(case when share >= 0.9e0 then 1 end) as n90, count(case when one_sided then 1 end) as one_sided from shares group by width_class""",
    # A19, U3
    "purity_spill": f"""{with_views('profiles')},
        edge as (select edge_id, max(metres) as best, sum(metres) as total, count(*) as faces from profiles group by edge_id)
        select faces, count(*) as edges, round(avg(best / total), 6) as purity, round(sum(total - best), 6) as spill from edge group by faces""",
    # A20, U22
    "extent_ratio": f"""{with_views('tree_values')},
        boxes as (select face_id, count(*) as n, sum(dbh_n) as total, avg(dbh_n) as mean_len, sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))) as diagonal
                  from (select *, coalesce(try_cast(dbh as double), 1e0) as dbh_n from tree_values) t group by face_id)
        select face_id, n, round(total / (diagonal + mean_len), 6) as ratio, case when total / (diagonal + mean_len) >= 1.8e0 then 'suspect' when total / (diagonal + mean_len) <= 1.2e0 then 'control' else 'between' end as verdict from boxes where diagonal + mean_len > 0""",
    # A21, U9
    "stale_heights": f"""{with_views('buildings')},
        newest as (select *, greatest(case when year_a > 1600 then year_a end, case when year_b > 1600 then year_b end) as newest from buildings)
        select edit_year, count(newest) as known, count(case when newest > edit_year then 1 end) as stale, count(case when newest - edit_year between 1 and 5 then 1 end) as recent, count(case when newest - edit_year > 5 then 1 end) as old from newest group by edit_year""",
    # A22, J17, F21
    "ft_per_floor_bands": f"""{with_views('buildings')},
        single as (select *, count(*) over (partition by bbl) as on_lot, try_cast(height_roof as double) as height from buildings),
        per as (select building_id, height, floors, height / floors as ft from single where on_lot = 1 and height > 0 and height <= 1600)
        select case when ft < 8 then 'under 8' when ft < 20 then '8-20' when ft < 60 then '20-60' else 'over 60' end as band, count(*) as n, round(PCT(ft, 0.1e0), 6) as p10, round(median(ft), 6) as p50, round(PCT(ft, 0.9e0), 6) as p90, round(avg(height / 13), 6) as implied_floors from per group by 1""",
    # A23, U8
    "size_species_residuals": f"""{with_views('tree_values')},
        genus as (select face_id, split_part(genusspecies, ' ', 1) as genus, sum(value) as v, sum(value * try_cast(dbh as double)) as vd from tree_values where value is not null group by 1, 2),
        ranked as (select *, row_number() over (partition by face_id order by v desc, genus) as r, sum(v) over (partition by face_id) as total, sum(vd) over (partition by face_id) as total_vd from genus)
        select face_id, genus as dominant, round(v / total, 6) as share, round(total_vd / total, 6) as mean_dbh, case when total_vd / total < 12 then 'small' when total_vd / total < 24 then 'medium' else 'large' end as size_band from ranked where r = 1""",
    # A25, J21, U19
    "ab_route_delta": f"""{with_views('route_results')},
        a as (select request, weight, min(shade) as shade, min(length_m) as len from route_results where result_id % 2 = 0 group by 1, 2),
        b as (select request, weight, min(shade) as shade, min(length_m) as len from route_results where result_id % 2 = 1 group by 1, 2)
        select a.weight, count(*) as pairs, count(case when b.shade - a.shade > 0.005e0 then 1 end) as gained, count(case when b.shade - a.shade < -0.005e0 then 1 end) as lost, round(median(b.len - a.len), 6) as median_delta
        from a join b on a.request = b.request and a.weight = b.weight group by a.weight""",
    # A26, U13
    "clarity_ratio": f"""with {_ITEMS}, two as (select grp, least(w, l_linenumber * 7e0) as near, greatest(w, l_linenumber * 7e0) as far from items)
        select grp, count(case when near / far <= 0.6e0 then 1 end) as clear, count(case when near / far > 0.6e0 then 1 end) as ambiguous, count(case when near <= 8 then 1 end) as useful from two group by grp""",
    # A28, A5, U23
    "conflation_counts": f"with {_ITEMS} select grp, count(distinct l_suppkey) as faces, count(distinct l_partkey) as bins, count(case when l_linenumber = 1 then 1 end) as conflated, count(case when d = 0 then 1 end) as plain from items group by grp",
    # F17, U27
    "flag_rule": f"""{with_views('route_results')},
        pairs as (select result_id, length_m as ours, 400e0 + (result_id * 29) % 1100 as theirs, 450e0 + (result_id * 31) % 1000 as arbiter from route_results),
        flagged as (select *, case when ours > 1.25e0 * theirs and ours - theirs > 250 then 'longer' when ours < 0.8e0 * theirs and theirs - ours > 200 then 'shorter' else 'ok' end as flag from pairs)
        select result_id, flag, case when flag = 'ok' then 'none' when ours / arbiter between 1 / 1.1e0 and 1.1e0 then 'cleared' else 'stands' end as verdict from flagged""",
    # N4, U16
    "coverage_grid_verdict": f"""{with_views('nodes')},
        ped as (select cast(floor(x / 250) as bigint) as cx, cast(floor(y / 250) as bigint) as cy, count(*) as n, count(case when k % 7 <> 0 then 1 end) as main from nodes where k % 3 <> 0 and k % 11 < 8 and row_no % 6 < 4 group by 1, 2),
        street as (select cast(floor(x / 250) as bigint) as cx, cast(floor(y / 250) as bigint) as cy, count(*) as n from nodes where k % 5 = 0 group by 1, 2)
        select coalesce(p.cx, s.cx) as cx, coalesce(p.cy, s.cy) as cy, case when p.n is null then 'HOLE' when p.main > 0 then 'CONNECTED' else 'ISLAND' end as verdict
        from ped p full outer join street s on p.cx = s.cx and p.cy = s.cy""",
    # The first box that holds a point
    "first_matching_box": f"""{with_views('nodes', 'parks')},
        hits as (select k, park_id, row_number() over (partition by k order by park_id) as r from nodes join parks on x between x0 and x1 and y between y0 and y1)
        select k, park_id from hits where r = 1""",
    # Every borough that holds an end of a line, and a point's first
    "borough_bucketing": f"""{with_views('edges', 'parks')},
        ends as (select edge_id, u as k from edges union all select edge_id, v from edges),
        pairs as (select distinct edge_id, park_id % 5 as borough from ends e join nodes n on n.k = e.k join parks p on {_POINT_IN})
        select borough, count(*) as edges, count(distinct edge_id) as distinct_edges from pairs group by borough""",
    # Membership of any real park, and of each
    "pip_parks": f"""{with_views('nodes', 'parks')}
        select n.k, count(p.park_id) as parks, min(p.park_id) as first_park from nodes n left join parks p on {_POINT_IN} group by n.k""",
    # Ways with any point inside, and those without
    "semi_anti_ways": f"""{with_views('way_nodes', 'nodes', 'parks')},
        inside as (select distinct n.k from nodes n join parks p on {_POINT_IN}),
        touched as (select distinct way_id from way_nodes w where exists (select 1 from inside i where i.k = w.node_id)),
        untouched as (select distinct way_id from way_nodes except select way_id from touched)
        select 'touched' as what, count(*) as n from touched union all select 'untouched', count(*) from untouched""",
    # A street of the same name near by
    "achievable_names": f"""{with_views('edges')},
        mid as (select edge_id, name, n.x, n.y, n.col, n.row_no from edges e join nodes n on n.k = e.u)
        select a.name, count(*) as n from mid a where exists (select 1 from mid b where b.name = a.name and b.edge_id <> a.edge_id and abs(b.x - a.x) <= 100 and abs(b.y - a.y) <= 100) group by a.name""",
    # J16, S14, D5
    "score_lookup": f"""{with_views('scored_edges')},
        graph as (select u, v, 0 as key, edge_id from edges union all select u, v, 1, edge_id from edges where edge_id % 9 = 0)
        select g.key, count(*) as n, count(s.edge_id) as matched, round(sum(coalesce(s.tree_deciduous, 0e0)), 6) as deciduous from graph g left join scored_edges s on s.u = g.u and s.v = g.v and g.key = 0 group by g.key""",
    # J24, J23
    "external_match": f"""{with_views('buildings')},
        items as (select k, x + 3 as px, y + 3 as py, 10e0 + k % 500 as ft from (select k, (k % 50) * 30e0 as x, (k DIV 50) * 30e0 as y from (select c_custkey as k from @customer) c) t),
        hit as (select k, ft, try_cast(height_roof as double) as height from items join buildings on px > x0 and px < x0 + 12 and py > y0 and py < y0 + 12)
        select case when height is null or height <= 0 then 'unknown' when ft / height < 0.8e0 then 'lower' when ft / height > 1.25e0 then 'higher' else 'same' end as band, count(*) as n from hit group by 1""",
    # The n-th edge of an unordered pair; ids compare as strings
    "parallel_edge_key": """with e as (select l_orderkey, l_linenumber, l_partkey, cast(l_suppkey as STRING) as u, cast(l_partkey % 100 as STRING) as v from @lineitem)
        select l_orderkey, l_linenumber, l_partkey, least(u, v) as lo, greatest(u, v) as hi, row_number() over (partition by least(u, v), greatest(u, v) order by l_orderkey, l_linenumber, l_partkey) - 1 as key from e""",
    # W3
    "running_length": f"with {_ITEMS} select l_orderkey, l_linenumber, l_partkey, round(sum(w) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, w, v rows between unbounded preceding and current row), 6) as upto from items",
    # Runs of equal types
    "runs_islands": """with e as (select event_id, user_id, event_type, case when event_type = lag(event_type) over (partition by user_id order by ts, event_id) then 0 else 1 end as starts, ts from @events),
        runs as (select *, sum(starts) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as run from e)
        select user_id, cast(run as bigint) as run, event_type, count(*) as legs, min(event_id) as first_id from runs group by user_id, run, event_type""",
    # Parents by distance, decided by the ratio to the runner-up
    "parent_name_decision": f"""{with_views('edges')},
        near as (select a.edge_id, b.name, min(sqrt((na.x - nb.x) * (na.x - nb.x) + (na.y - nb.y) * (na.y - nb.y)) + 1 + b.edge_id % 29) as d
                 from edges a join nodes na on na.k = a.u join nodes nb on nb.col between na.col - 1 and na.col + 1 and nb.row_no between na.row_no - 1 and na.row_no + 1 join edges b on b.u = nb.k where b.name <> a.name group by 1, 2),
        ranked as (select *, row_number() over (partition by edge_id order by d, name) as r, count(*) over (partition by edge_id) as n from near),
        decided as (select edge_id, max(n) as n, max(case when r = 1 then name end) as first_name, max(case when r = 1 then d end) as d1, max(case when r = 2 then d end) as d2, max(case when r = 2 then name end) as second_name, max(case when r = 3 then name end) as third_name from ranked where r <= 3 group by edge_id)
        select edge_id, case when n = 1 or (d2 > 0 and d1 / d2 <= 0.6e0) then 'derived' else 'ambiguous' end as outcome, case when n = 1 or (d2 > 0 and d1 / d2 <= 0.6e0) then first_name end as name,
               case when n = 1 or (d2 > 0 and d1 / d2 <= 0.6e0) then null else concat_ws('|', first_name, second_name, third_name) end as fold_names from decided""",
    # W11
    "tallest_buildings": f"{with_views('buildings')} select building_id, height from (select building_id, try_cast(height_roof as double) as height from buildings) b where height is not null order by height desc, building_id limit 20",
    # Largest remainders with a floor of two
    "stratified_allocation": f"""{with_views('trees')}, strata as (select face_id % 5 as stratum, count(*) as n from trees group by 1),
        quota as (select stratum, n, 40e0 * n / sum(n) over () as q from strata),
        ranked as (select *, row_number() over (order by q - floor(q) desc, stratum) as r, 40 - sum(cast(floor(q) as bigint)) over () as spare from quota)
        select stratum, n, cast(greatest(2, cast(floor(q) as bigint) + case when r <= spare then 1 else 0 end) as bigint) as picks from ranked""",
    # W14
    "round_robin_pick": f"""{with_views('trees')}, ranked as (select tree_id, face_id, row_number() over (partition by face_id order by (tree_id * 7919) % 1009, tree_id) as r from trees)
        select tree_id, face_id, r from ranked where r <= 2""",
    # Picks per band in the order of a hash-like key
    "banded_sample": f"""{with_views('buildings')}, banded as (select building_id, case when floors < 4 then 'low' when floors < 8 then 'mid' else 'high' end as band, building_id % 5 as borough, row_number() over (partition by building_id % 5, case when floors < 4 then 'low' when floors < 8 then 'mid' else 'high' end order by (building_id * 7919) % 10007, building_id) as r from buildings)
        select building_id, band, borough from banded where r <= 6""",
    # The best copy's attributes at the first copy's place
    "edge_dedupe_best": """with e as (select l_orderkey % 500 as lo, l_suppkey as hi, l_linenumber % 2 as key, l_quantity as decid, l_discount as everg, l_orderkey * 8 + l_linenumber as ord, l_partkey from @lineitem),
        ranked as (select *, row_number() over (partition by lo, hi, key order by decid + everg desc, ord, l_partkey) as r, min(ord) over (partition by lo, hi, key) as place from e)
        select lo, hi, key, decid, everg, place from ranked where r = 1""",
    # Geometry without direction, first wins
    "geometry_dedupe": f"""{with_views('edges')},
        copies as (select edge_id as ord, u, v, cast(u as STRING) || ',' || cast(v as STRING) as fwd, cast(v as STRING) || ',' || cast(u as STRING) as rev from edges
                   union all select edge_id + 1000000, v, u, cast(v as STRING) || ',' || cast(u as STRING), cast(u as STRING) || ',' || cast(v as STRING) from edges where edge_id % 9 = 0),
        ranked as (select *, row_number() over (partition by least(fwd, rev) order by ord) as r from copies)
        select ord, least(fwd, rev) as geometry from ranked where r = 1""",
    # Last wins
    "last_wins": "with e as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from @events) select user_id, event_id, event_type from e where r = 1",
    # Only pairs that both runs have
    "overlap_only": f"""{with_views('route_results')} select request from route_results where weight = 0 intersect select request from route_results where weight = 40""",
    # Junctions are used by two ways, end one, or come back in one
    "junctions": f"""{with_views('way_nodes')},
        uses as (select node_id from way_nodes group by node_id having count(distinct way_id) >= 2),
        bounds as (select way_id, min(pos) as a, max(pos) as b from way_nodes group by way_id),
        tips as (select node_id from way_nodes w join bounds e on e.way_id = w.way_id and (w.pos = e.a or w.pos = e.b)),
        again as (select node_id from way_nodes group by way_id, node_id having count(*) >= 2)
        select node_id from uses union select node_id from tips union select node_id from again""",
    # Ways cut at junctions; a junction ends one chain and begins the next; keys number parallel chains
    "chain_split": f"""{with_views('way_nodes')},
        ordered as (select way_id, node_id, row_number() over (partition by way_id order by pos, node_id) as rn, count(*) over (partition by way_id) as n from way_nodes),
        shared as (select node_id from way_nodes group by node_id having count(distinct way_id) >= 2 union select node_id from way_nodes group by way_id, node_id having count(*) >= 2),
        breaks as (select o.way_id, o.node_id, o.rn from ordered o left join shared s on s.node_id = o.node_id where s.node_id is not null or rn = 1 or rn = n),
        chains as (select way_id, rn as a, node_id as u, lead(rn) over (partition by way_id order by rn) as b, lead(node_id) over (partition by way_id order by rn) as v from breaks)
        select way_id, a, u, v, b - a + 1 as nodes, row_number() over (partition by least(cast(u as STRING), cast(v as STRING)), greatest(cast(u as STRING), cast(v as STRING)) order by way_id, a) - 1 as key from chains where b is not null""",
    # The point half way along a line, by length
    "halfway_point": f"""{with_views('way_nodes')},
        pts as (select way_id, (node_id % 40) * 100e0 as x, (node_id DIV 40) * 80e0 as y, row_number() over (partition by way_id order by pos, node_id) as rn from way_nodes),
        segs as (select way_id, rn, x, y, lead(x) over (partition by way_id order by rn) as x2, lead(y) over (partition by way_id order by rn) as y2 from pts),
        lens as (select *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) as len from segs where x2 is not null),
        run as (select *, sum(len) over (partition by way_id order by rn rows between unbounded preceding and current row) as upto, sum(len) over (partition by way_id) as total from lens),
        mids as (select *, row_number() over (partition by way_id order by rn) as r from run where upto >= total / 2 and len > 0 and total > 0)
        select way_id, round(x + (x2 - x) * (total / 2 - upto + len) / len, 6) as x, round(y + (y2 - y) * (total / 2 - upto + len) / len, 6) as y, round(total, 6) as total from mids where r = 1""",
    # Ends inside edges: over the four pairs of ends, or along the edge they share
    "partial_edge_routes": f"""{with_views('edges')},
        snaps as (select edge_id, u, v, length_m, length_m * ((edge_id * 7) % 10) / 10e0 as a_from_u, length_m * ((edge_id * 3) % 10) / 10e0 as b_from_u from edges),
        pairs as (select a.edge_id as ea, b.edge_id as eb, a.a_from_u, a.length_m - a.a_from_u as a_from_v, b.b_from_u, b.length_m - b.b_from_u as b_from_v, a.u as au, a.v as av, b.u as bu, b.v as bv from snaps a join snaps b on b.edge_id between a.edge_id and a.edge_id + 3),
        ways as (select ea, eb, case when ea = eb then abs(a_from_u - b_from_u) end as direct, case when au = bu then a_from_u + b_from_u end as uu, case when au = bv then a_from_u + b_from_v end as uv, case when av = bu then a_from_v + b_from_u end as vu, case when av = bv then a_from_v + b_from_v end as vv from pairs)
        select ea, eb, round(least(direct, uu, uv, vu, vv), 6) as metres, direct is not null and direct <= coalesce(least(uu, uv, vu, vv), direct) as is_direct from ways where coalesce(direct, uu, uv, vu, vv) is not null""",
    # N3, N14
    "edge_invariants": f"""{with_views('edges')}
        select name like 'Row%' as is_row, count(*) as n, count(case when length_m < sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) * 0.998e0 - 2 then 1 end) as shorter_than_chord, round(max(length_m), 6) as longest
        from edges join nodes a on a.k = u join nodes b on b.k = v group by 1""",
    # Close nodes that are no neighbours
    "crossing_detour_candidates": f"""{with_views('edges')},
        linked as (select u as a, v as b from edges union all select v, u from edges),
        close as (select p.k as a, q.k as b, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as d from nodes p join nodes q on q.col between p.col - 1 and p.col + 1 and q.row_no between p.row_no - 1 and p.row_no + 1 and q.k <> p.k),
        open_pairs as (select c.* from close c left join linked l on l.a = c.a and l.b = c.b where l.a is null),
        ranked as (select *, row_number() over (partition by a order by d, b) as r from open_pairs)
        select a, b, round(d, 6) as d from ranked where r = 1""",
    # Q6: more than the allowance within a minute
    "rate_limit_violations": """with log as (select event_id, user_id, US ts SU as us from @events),
        windows as (select event_id, user_id, us, count(*) over (partition by user_id, us DIV 3600000000 order by us, event_id rows between unbounded preceding and current row) as nth from log)
        select event_id, user_id, nth, greatest(1, cast((3600000000 - us % 3600000000 + 999999) DIV 1000000 as bigint)) as retry_after from windows where nth > 2""",
    # Newest five labels, without regard to case
    "recents_top5": """with labelled as (select event_id, user_id, case when event_id % 2 = 0 then upper(event_type) else event_type end || cast(event_id % 3 as STRING) as label, ts from @events),
        fresh as (select *, row_number() over (partition by user_id, lower(label) order by ts desc, event_id desc) as r from labelled),
        top as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as place from fresh where r = 1)
        select user_id, label, event_id, place from top where place <= 5""",
    # The longest part of each face
    "longest_part": """with parts as (select l_suppkey as face_id, l_linenumber as part, sum(l_quantity) as len from @lineitem group by 1, 2), ranked as (select *, row_number() over (partition by face_id order by len desc, part) as r, sum(len) over (partition by face_id) as total from parts)
        select face_id, part, round(len, 6) as len, round(total, 6) as total from ranked where r = 1""",
}
