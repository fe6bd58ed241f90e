"""Tree values, allocation to edges, time algebra, shade densities and request checks: the oracle's texts."""

from __future__ import annotations

from parasol.plans.adapters import with_views

#: Tree canopy by month, and the density of full cover.
CANOPY = (0.2, 0.2, 0.2, 0.35, 0.75, 1.0, 1.0, 1.0, 0.95, 0.8, 0.45, 0.25)
FULL_DENSITY = 0.033


def canopy(month: str) -> str:
    return f"case {month} " + " ".join(f"when {i + 1} then {c}e0" for i, c in enumerate(CANOPY)) + " end"


def slot(month: str, hour: str) -> str:
    return f"(({month}) - 1) * 24 + ({hour})"


def dark(hour: str) -> str:
    """The stub sun table is night before 6 and after 20."""
    return f"(({hour}) < 6 or ({hour}) > 20)"


def shade_byte(edge: str, month: str, hour: str) -> str:
    """255 at night, else the byte of the edge's row."""
    return f"case when {dark(hour)} then 255 else (({edge}) * 31 + ({slot(month, hour)}) * 17) % 256 end"


_TREE = f"least((tree_evergreen + tree_deciduous * ((1 - g) * ({canopy('m0')}) + g * ({canopy('m1')}))) / greatest(length_m, 0.01e0) / {FULL_DENSITY}e0, 1e0)"
_NEXT = "((hour + 1) % 24)"
_H = "(minute / 60e0)"
#: The four corners of the month and hour blend: month, hour, weight.
CORNERS = [("m0", "hour", f"(1 - g) * (1 - {_H})"), ("m0", _NEXT, f"(1 - g) * {_H}"), ("m1", "hour", f"g * (1 - {_H})"), ("m1", _NEXT, f"g * {_H}")]
_BUILDING = "(" + " + ".join(f"{w} * ({shade_byte('edge_id', m, h)})" for m, h, w in CORNERS) + ") / 255e0"
_DARK = "(" + " + ".join(f"{w} * case when {dark(h)} then 1e0 else 0e0 end" for m, h, w in CORNERS) + ")"
_ALL_DARK = "(" + " and ".join(f"({w} <= 0 or {dark(h)})" for m, h, w in CORNERS) + ")"
#: All moments on all edges: the remainder is by a tenth of the largest edge id, so a moment meets about ten edges at any scale, and an edge the moments of one remainder.
_PAIRS = f"""{with_views('scored_edges', 'blends')}, spread as (select greatest(101, max(edge_id) DIV 10) as m from scored_edges),
    paired as (select b.*, e.* from (select blends.*, event_id % m as moment_part from blends cross join spread) b join (select scored_edges.*, edge_id % m as edge_part from scored_edges cross join spread) e on edge_part = moment_part)"""
_PARTS = f""",
    parts as (select event_id, edge_id, layers, length_m, {_TREE} as tree, {_BUILDING} as building, {_DARK} as dark from paired),
    density as (select *, {FULL_DENSITY}e0 * case layers when 'both' then 1 - (1 - tree) * (1 - building) when 'buildings' then building
                else 1 - (1 - tree) * (1 - dark) end as density,
                {FULL_DENSITY}e0 * case layers when 'buildings' then 0e0 else tree end as density_no_hour from parts)"""
_DENSITY = _PAIRS + _PARTS

QUERIES = {
    # F1-F3, A5
    "tree_value_by_condition": f"""{with_views('tree_values')}
        select trim(coalesce(tpcondition, '')) as condition, is_evergreen, count(*) as n, count(value) as n_counted, round(coalesce(sum(value), 0e0), 6) as total
        from tree_values group by 1, 2""",
    "tree_summary_tally": f"""{with_views('tree_values')},
        labelled as (select case when trim(coalesce(tpcondition, '')) = 'Dead' then 'dead' when value is null then 'no_diameter' when is_evergreen then 'evergreen' else 'deciduous' end as bucket from tree_values)
        select bucket, count(*) as n from labelled group by bucket""",
    # A1, J1
    "face_tree_totals": f"""{with_views('tree_values', 'faces')}
        select f.face_id, f.street, f.side, round(coalesce(sum(case when is_evergreen then value end), 0e0), 6) as evergreen,
               round(coalesce(sum(case when not is_evergreen then value end), 0e0), 6) as deciduous, count(value) as trees
        from faces f left join tree_values t on t.face_id = f.face_id group by 1, 2, 3""",
    # A1, A2, T5
    "face_density_month": f"""{with_views('tree_values', 'profiles')},
        totals as (select face_id, sum(case when is_evergreen then value else 0e0 end) as ev, sum(case when is_evergreen then 0e0 else value end) as de from tree_values where value is not null group by face_id),
        pavement as (select face_id, sum(metres) as metres from profiles group by face_id),
        months as (select GEN 1, 12 END as month)
        select t.face_id, cast(m.month as bigint) as month, round(least((ev + de * ({canopy('m.month')})) / metres / {FULL_DENSITY}e0, 1e0), 6) as density
        from totals t join pavement p on p.face_id = t.face_id cross join months m""",
    # A3: what an edge gets of each face's trees is its share of the face's pavement
    "allocation_shares": f"""{with_views('tree_values', 'profiles')},
        totals as (select face_id, sum(value) as total, count(*) as trees from tree_values where value is not null group by face_id),
        shares as (select edge_id, p.face_id, metres / sum(metres) over (partition by p.face_id) as share from profiles p)
        select edge_id, round(sum(share * coalesce(total, 0e0)), 6) as value, round(sum(share * coalesce(trees, 0)), 6) as tree_count,
               case when count(total) = 0 then 'treeless_face' else 'scored' end as outcome
        from shares s left join totals t on t.face_id = s.face_id group by edge_id""",
    "allocation_conservation": f"""{with_views('tree_values', 'profiles')},
        totals as (select face_id, sum(value) as total from tree_values where value is not null group by face_id),
        shares as (select p.face_id, metres / sum(metres) over (partition by p.face_id) as share from profiles p)
        select s.face_id, round(sum(share * total), 6) as allocated, round(max(total), 6) as total from shares s join totals t on t.face_id = s.face_id group by s.face_id""",
    # A4
    "dominant_face": f"""{with_views('profiles')},
        ranked as (select edge_id, face_id, metres, row_number() over (partition by edge_id order by metres desc, face_id) as r from profiles)
        select edge_id, face_id, round(metres, 6) as metres from ranked where r = 1""",
    # T11
    "request_normalise": f"{with_views('requests')} select event_id, month, day, hour, minute from requests",
    # The first rule that fails
    "request_validate": f"""{with_views('requests')},
        days as (select *, case month when 2 then 29 when 4 then 30 when 6 then 30 when 9 then 30 when 11 then 30 else 31 end as last_day from requests),
        checked as (select event_id, case
            when arrive and no_hour then 'arrive needs an hour'
            when not month between 1 and 12 then 'month must be 1-12'
            when not day between 1 and last_day then 'day must be 1-' || cast(last_day as STRING) || ' for month ' || cast(month as STRING)
            when not hour between 0 and 23 then 'hour must be 0-23'
            when not minute between 0 and 59 then 'minute must be 0-59'
            when layers not in ('trees', 'buildings', 'both') then 'layers must be one of trees, buildings, both'
            when n_weights = 0 then 'tree_weights must include at least one value'
            when n_weights > 4 then 'tree_weights accepts at most 4 values'
            when not top_weight between 0 and 40 then 'tree_weight must be between 0 and 40' end as detail from days)
        select event_id, case when detail is null then 200 else 400 end as status, detail from checked""",
    # T1-T3
    "slot_index": f"{with_views('valid_moments')} select event_id, cast({slot('month', 'hour')} as bigint) as slot from valid_moments",
    "month_blend": f"{with_views('blends')} select event_id, cast(m0 as bigint) as m0, cast(m1 as bigint) as m1, round(g, 6) as g from blends",
    "blend_weights": f"{with_views('blends')}, corners as ("
    + " union all ".join(f"select event_id, {i} as corner, cast({slot(m, h)} as bigint) as slot, {w} as weight from blends" for i, (m, h, w) in enumerate(CORNERS))
    + ") select event_id, corner, slot, round(weight, 6) as weight from corners",
    # T4, T7
    "night_flag": f"{with_views('blends')} select event_id, {_ALL_DARK} as is_night from blends",
    "dark_share": f"{with_views('blends')} select event_id, round({_DARK}, 6) as dark_share from blends",
    # T5-T9, D8
    "tree_fraction": f"{_PAIRS} select event_id, edge_id, round({_TREE}, 6) as tree_fraction from paired",
    "building_fraction": f"{_PAIRS} select event_id, edge_id, round({_BUILDING}, 6) as building_fraction from paired",
    "edge_density_layers": f"{_DENSITY} select event_id, edge_id, layers, round(density + 1e-10, 6) as density, round(density_no_hour + 1e-10, 6) as density_no_hour from density",
    "edge_cost_ladder": f"""{_DENSITY}, weights as (select 0e0 as w union all select 5e0 union all select 15e0 union all select 40e0)
        select event_id, edge_id, w as weight, round(length_m / (1 + w * density), 6) as cost from density cross join weights""",
    # T13, C6's shape: moments in the daylight slots of the stub sun table
    "daylight_slots": f"""{with_views('valid_moments')}
        select event_id, cast({slot('month', 'hour')} as bigint) as slot, hour * 15e0 as azimuth, 60e0 - abs(hour - 13) * 8e0 as elevation from valid_moments where not {dark('hour')}""",
    # W9
    "shade_clamp": f"""{with_views('route_results')},
        placed as (select *, row_number() over (partition by request order by weight, result_id) as place from route_results),
        best as (select *, max(shade) over (partition by request order by place rows between unbounded preceding and current row) as top from placed),
        source as (select *, max(case when shade >= top - 1e-9 then place end) over (partition by request order by place rows between unbounded preceding and current row) as shown from best)
        select b.result_id, b.request, b.weight, t.shade, t.result_id as shown_id, t.length_m from source b
        join placed t on t.request = b.request and t.place = b.shown""",
    # P6, P7
    "usable_buildings_tally": f"""{with_views('buildings')},
        parsed as (select *, try_cast(height_roof as double) as height from buildings),
        labelled as (select height, case when height is null or height <= 0 then 'no_height' when height > 1600 then 'too_tall' when status in ('Demolition') then 'demolished' when feature_code in ('1003') then 'excluded_code' else 'usable' end as outcome from parsed)
        select outcome, count(*) as n, round(coalesce(sum(height), 0e0), 6) as total_height from labelled group by outcome""",
    # P8, C8
    "real_park_filter": f"""{with_views('parks')}
        select park_id, case when coalesce(typecategory, '') in ('Parkway', 'Strip', 'Lot', 'Operations', 'Retired N/A') then false
               when coalesce(typecategory, '') in ('Buildings/Institutions', 'Triangle/Plaza', 'Mall') then coalesce(subcategory, '') in ('Large Park', 'Neighborhood Park', 'Flagship Park', 'Garden', 'Neighborhood Plgd')
               else true end as is_park from parks""",
    # P1, P3, P4, P10
    "pedestrian_predicate": f"""{with_views('ways')}
        select way_id, case when coalesce(area, '') = 'yes' then false when coalesce(foot, '') in ('no', 'private') then false
               when coalesce(access, '') in ('private', 'no') and coalesce(foot, '') not in ('yes', 'designated') then false
               when coalesce(highway, '') = 'cycleway' then coalesce(foot, '') in ('yes', 'designated')
               else coalesce(highway, '') in ('footway', 'path', 'steps', 'pedestrian') end as is_pedestrian,
               coalesce(nullif(highway, ''), '?') || case when coalesce(footway, '') <> '' then '/' || footway else '' end as kind,
               coalesce(name, '') as name, coalesce(footway, '') like '%crossing%' or coalesce(footway, '') like '%traffic_island%' as is_connector
        from ways""",
    # P2, P15
    "named_street_predicate": f"""{with_views('ways')}
        select way_id, coalesce(name, '') <> '' and coalesce(highway, '') in ('primary', 'secondary', 'tertiary', 'residential', 'unclassified', 'living_street', 'trunk', 'service', 'motorway', 'primary_link', 'secondary_link')
               and coalesce(area, '') <> 'yes' and coalesce(service, '') not in ('private', 'driveway', 'parking_aisle') as is_named_street,
               case when way_id % 60 < 24 then 'narrow' when way_id % 60 < 40 then 'medium' else 'wide' end as width_class
        from ways""",
    # Edges with both ends in a box, and exactly their nodes
    "fixture_cut": f"""{with_views('edges')},
        inside as (select k from nodes where x between 300 and 2100 and y between 160 and 1600),
        kept as (select edge_id, u, v from edges where u in (select k from inside) and v in (select k from inside)),
        ends as (select u as k from kept union select v from kept)
        select 'edge' as what, count(*) as n, cast(sum(edge_id) as bigint) as ids from kept union all select 'node', count(*), cast(sum(k) as bigint) from ends""",
    # Canopy credit by outcome
    "canopy_credit": f"""{with_views('scored_edges')},
        measured as (select *, case when edge_id % 13 = 0 then null else (edge_id % 21) / 20e0 end as canopy, case edge_id % 5 when 0 then 'no_face' when 1 then 'treeless_face' else 'scored' end as outcome,
                     (edge_id % 4) / 4e0 as park_share, edge_id % 3 = 0 as is_path from scored_edges),
        credited as (select *, case when canopy is null then 0e0 when is_path or outcome = 'no_face' or (outcome = 'treeless_face' and park_share >= 0.5e0) then {FULL_DENSITY}e0 * canopy * length_m else 0e0 end as credit from measured)
        select edge_id, outcome, round(tree_deciduous + credit, 6) as tree_deciduous, round(credit, 6) as park_canopy from credited""",
}
