"""Labels, wording, link and time texts, and the other string operators: the oracle's texts."""

from __future__ import annotations

from parasol.plans.adapters import with_views

#: Answers of a geocoder, from the nations and customers of the tables.
FEATURES = """features as (select c_custkey as ord, c_custkey % 60 as req, case when c_custkey % 4 = 0 then 'Place ' || cast(c_custkey % 50 as STRING) else '' end as name,
    case when c_custkey % 3 = 0 then null else cast(c_custkey % 90 as STRING) end as housenumber, case when c_custkey % 5 = 0 then '' else 'Street ' || cast(c_custkey % 30 as STRING) end as street,
    'Quarter ' || cast(c_nationkey as STRING) as locality, case when c_custkey % 2 = 0 then 'District ' || cast(c_nationkey % 5 as STRING) end as district,
    case when c_custkey % 9 = 0 then 'Elsewhere' else 'New York' end as city, case when c_custkey % 11 = 0 then 'NJ' else 'New York' end as state, case when c_custkey % 6 = 0 then 'highway' else 'shop' end as osm_key,
    case when c_custkey % 7 = 0 then null else 'Borough ' || cast(c_nationkey % 5 as STRING) end as borough, (c_custkey % 250) / 1000e0 as distance_km from @customer)"""
_ADDRESS = "case when coalesce(housenumber, '') <> '' and coalesce(street, '') <> '' then housenumber || ' ' || street else nullif(street, '') end"
_FAR = "case when v >= 1000 then 'km' else 'm' end"

QUERIES = {
    # Primary, its address or locality, then district or city; parts and labels once
    "geocode_label_dedupe": f"""with {FEATURES},
        parts as (select ord, req, coalesce(nullif(name, ''), {_ADDRESS}) as a, case when name <> '' then coalesce({_ADDRESS}, nullif(locality, '')) end as b, coalesce(nullif(district, ''), nullif(city, '')) as c from features where city = 'New York' and state = 'New York'),
        labelled as (select ord, req, a || case when b is not null and b <> a then ', ' || b else '' end || case when c is not null and c <> a and (b is null or c <> b) then ', ' || c else '' end as label from parts where a is not null),
        ranked as (select *, row_number() over (partition by req, label order by ord) as r from labelled)
        select ord, req, label from ranked where r = 1""",
    # F13
    "reverse_label": f"with {FEATURES} select ord, coalesce({_ADDRESS}, case when osm_key = 'highway' then nullif(name, '') end) as label from features",
    # the backup's answers need a borough, and an address within 100 m on the way back
    "backup_label": f"""with {FEATURES}, parsed as (select *, case when coalesce(housenumber, '') <> '' and street <> '' then housenumber || ' ' || street end as address from features),
        near as (select *, row_number() over (partition by req order by distance_km, ord) as r from parsed where distance_km * 1000 <= 100 and address is not null)
        select p.req, count(case when p.borough is not null and coalesce(p.address, nullif(p.name, '')) is not null then 1 end) as found, max(n.address) as nearest_address from parsed p left join near n on n.req = p.req and n.r = 1 group by p.req""",
    # white space as one space, coordinates to five places, blank queries refused
    "query_normalise": """with q as (select event_id, '  ' || event_type || case when event_id % 3 = 0 then '   ' else ' x ' end as raw, event_id % 4 = 0 as blank from @events)
        select event_id, case when blank then '' else trim(regexp_replace(raw, ' +', ' ')) end as query, case when blank then 422 else 200 end as status from q""",
    # headings and turns
    "turn_actions": """with d as (select event_id, (event_id * 7) % 360 as inbound, (event_id * 53) % 360 as outbound from @events), t as (select *, ((outbound - inbound + 180) % 360 + 360) % 360 - 180 as delta from d)
        select event_id, case when abs(delta) <= 30 then 'continue' when abs(delta) >= 150 then case when delta > 0 then 'sharp_right' else 'sharp_left' end when delta > 0 then 'right' else 'left' end as action,
               case cast(floor(((outbound * 10 + 225) % 3600) / 450) as bigint) when 0 then 'north' when 1 then 'northeast' when 2 then 'east' when 3 then 'southeast' when 4 then 'south' when 5 then 'southwest' when 6 then 'west' else 'northwest' end as heading from t""",
    # When to leave, through midnights and month ends of a leap year
    "leave_time": f"""{with_views('valid_moments')},
        days as (select *, case month when 1 then 0 when 2 then 31 when 3 then 60 when 4 then 91 when 5 then 121 when 6 then 152 when 7 then 182 when 8 then 213 when 9 then 244 when 10 then 274 when 11 then 305 else 335 end as before, cast(floor((event_id % 173) / 2e0 + 0.5e0) as bigint) as walk from valid_moments),
        mins as (select event_id, (((before + day - 1) * 1440 + hour * 60 + minute - walk) % 527040 + 527040) % 527040 as t from days),
        parts as (select event_id, t DIV 1440 as doy, (t % 1440) DIV 60 as hour, t % 60 as minute from mins),
        dated as (select *, case when doy < 31 then 1 when doy < 60 then 2 when doy < 91 then 3 when doy < 121 then 4 when doy < 152 then 5 when doy < 182 then 6 when doy < 213 then 7 when doy < 244 then 8 when doy < 274 then 9 when doy < 305 then 10 when doy < 335 then 11 else 12 end as month from parts)
        select event_id, cast(month as bigint) as month, cast(doy - case month when 1 then 0 when 2 then 31 when 3 then 60 when 4 then 91 when 5 then 121 when 6 then 152 when 7 then 182 when 8 then 213 when 9 then 244 when 10 then 274 when 11 then 305 else 335 end + 1 as bigint) as day, cast(hour as bigint) as hour, cast(minute as bigint) as minute from dated""",
    # the nearest preset, ties upward
    "preset_snap": """with w as (select event_id, (event_id * 3) % 45 * 0.5e0 as w from @events), p as (select 0e0 as v union all select 5e0 union all select 15e0 union all select 40e0),
        r as (select event_id, w, v, row_number() over (partition by event_id order by abs(v - w), v desc) as r from w cross join p) select event_id, w, v as preset from r where r = 1""",
    # warnings, layer names and links
    "link_state": """with l as (select event_id, case when event_id % 5 = 0 then 'x,y' else cast(cast(event_id % 80 as bigint) as STRING) || ',' || cast(cast(event_id % 170 as bigint) as STRING) end as pt, event_type as v, (event_id % 100) / 100e0 as share from @events),
        parsed as (select *, try_cast(split_part(pt, ',', 1) as double) as lat, try_cast(split_part(pt, ',', 2) as double) as lon from l)
        select event_id, lat, lon, lat is not null and lon is not null as has_point, case when v in ('trees', 'buildings') then v else 'both' end as layers, share < 0.15e0 as exposed, share >= 0.25e0 as hides_count from parsed""",
    # Padded box and then distance
    "coverage_test": f"""{with_views('nodes')}, pts as (select event_id, (event_id * 97) % 5200 * 1e0 - 400 as px, (event_id * 31) % 3400 * 1e0 - 300 as py from @events),
        box as (select min(x) - 200 as x0, max(x) + 200 as x1, min(y) - 200 as y0, max(y) + 200 as y1 from nodes),
        near as (select distinct event_id from pts join nodes n on n.col between cast(floor((px - 200) / 100) as bigint) and cast(floor((px + 200) / 100) as bigint) + 1 and n.row_no between cast(floor((py - 200) / 80) as bigint) and cast(floor((py + 200) / 80) as bigint) + 1 where (px - n.x) * (px - n.x) + (py - n.y) * (py - n.y) <= 40000)
        select p.event_id, p.px between x0 and x1 and p.py between y0 and y1 and n.event_id is not null as covered from pts p cross join box left join near n on n.event_id = p.event_id""",
}
