"""Names of paths beside streets, and how often they are right, with the oracle's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parasol.operators import naming, stats
from parasol.operators.skew import shuffled
from parasol.plans.adapters import view, with_views
from parasol.plans.frames import r6
from parasol.session import save_table


def lines(spark, d, name: str, *columns: str) -> DataFrame:
    """A view's lines of three vertices, as a table: they are read several times."""
    return save_table(view(spark, d, name).select(*columns, F.array(F.array("ax", "ay"), F.array("mx", "my"), F.array("zx", "zy")).alias("line")), name)


def street_lines(spark, d) -> DataFrame:
    return lines(spark, d, "streets", "street_id", "name")


def path_names(spark, d):
    """What each path is called, and which streets a nameless one goes along with."""
    return naming.assign_names(lines(spark, d, "side_paths", "edge_id", "name", "kind"), street_lines(spark, d))


def naming_holdout(spark, d):
    """Paths whose street is known, their names withheld: named rightly, wrongly or not, by number and metres, with and without the rule of direction."""
    paths, streets, rows = lines(spark, d, "side_paths", "edge_id", "kind"), street_lines(spark, d), None
    for policy, parallel in (("nearest", False), ("parallel", True)):
        got = naming.assign_names(paths.withColumn("name", F.lit(None).cast("string")), streets, parallel)
        got = got.select("edge_id", "name", F.lit(policy).alias("policy"))
        rows = got if rows is None else rows.unionByName(got)
    truth = view(spark, d, "side_paths").select("edge_id", "beside", (F.hypot(F.col("mx") - F.col("ax"), F.col("my") - F.col("ay")) + F.hypot(F.col("zx") - F.col("mx"), F.col("zy") - F.col("my"))).alias("w"))
    bucket = F.when(F.col("name").isNull(), "none").when(F.col("name") == F.col("beside"), "right").otherwise("wrong")
    out = stats.confusion(rows.join(shuffled(truth), "edge_id").select("policy", bucket.alias("bucket"), "w"), ["policy"], "bucket", "w")
    return out.select("policy", "bucket", "n", r6("length", "length"), r6("share", "share"))


QUERIES = {f.__name__: f for f in (path_names, naming_holdout)}


def _at(s: str, axis: str) -> str:
    """The coordinate at ``s`` metres along a line with lengths l1 and l2."""
    return f"case when {s} <= l1 then a{axis} + (m{axis} - a{axis}) * {s} / l1 else m{axis} + (z{axis} - m{axis}) * ({s} - l1) / l2 end"


def _bearing(s: str) -> str:
    low, high = f"greatest({s} - 2, 0)", f"least({s} + 2, l1 + l2)"
    turn = f"degrees(atan2(({_at(high, 'x')}) - ({_at(low, 'x')}), ({_at(high, 'y')}) - ({_at(low, 'y')})))"
    return f"(({turn} + 360) % 180)"


def _along(a: str, b: str, n: str) -> str:
    return f"greatest(0, least(1, ((px - {a}x) * ({b}x - {a}x) + (py - {a}y) * ({b}y - {a}y)) / ({n} * {n})))"


_L1, _L2 = "sqrt((mx - ax) ** 2 + (my - ay) ** 2) as l1", "sqrt((zx - mx) ** 2 + (zy - my) ** 2) as l2"


def _ctes(named: str, limit: str) -> str:
    """CTEs up to ``done`` (edge_id, outcome, name, fold_names)."""
    return f"""{with_views('streets', 'side_paths')},
    st as (select *, {_L1}, {_L2} from streets),
    pa as (select * replace ({named} as name), {_L1}, {_L2} from side_paths),
    todo as (select *, greatest(3, cast(floor((l1 + l2) / 10) as bigint)) as n from pa where coalesce(name, '') = '' and kind not like '%crossing%'),
    pr as (select edge_id, l1 + l2 as metres, n, unnest(range(n)) as i, (l1 + l2) * unnest(range(n)) / (n - 1) as s, l1, l2, ax, ay, mx, my, zx, zy from todo),
    pb as (select edge_id, metres, n, i, {_at('s', 'x')} as px, {_at('s', 'y')} as py, {_bearing('s')} as own from pr),
    near as (select t.edge_id, s.street_id from todo t join st s on greatest(t.ax, t.mx, t.zx) >= least(s.ax, s.mx, s.zx) - 30 and least(t.ax, t.mx, t.zx) <= greatest(s.ax, s.mx, s.zx) + 30
             and greatest(t.ay, t.my, t.zy) >= least(s.ay, s.my, s.zy) - 30 and least(t.ay, t.my, t.zy) <= greatest(s.ay, s.my, s.zy) + 30),
    joined as (select p.edge_id, p.metres, p.n, p.px, p.py, p.own, s.*, {_along('a', 'm', 'l1')} as t1, {_along('m', 'z', 'l2')} as t2
             from near join pb p using (edge_id) join st s on s.street_id = near.street_id),
    away as (select *, sqrt((px - ax - t1 * (mx - ax)) ** 2 + (py - ay - t1 * (my - ay)) ** 2) as d1, sqrt((px - mx - t2 * (zx - mx)) ** 2 + (py - my - t2 * (zy - my)) ** 2) as d2 from joined),
    put as (select *, least(d1, d2) as d, case when d2 < d1 then l1 + t2 * l2 else t1 * l1 end as s from away),
    turned as (select edge_id, street_id, name, metres, n, d, abs(own - {_bearing('s')}) as turn from put),
    pairs as (select edge_id, street_id, any_value(name) as name, any_value(metres) as metres, list_sort(list(d))[any_value(n) // 2 + 1] as d, list_sort(list(least(turn, 180 - turn)))[any_value(n) // 2 + 1] as turn
              from turned group by edge_id, street_id),
    found as (select edge_id, name, min(round(d, 6)) as d from pairs where d <= 30 and ({limit}) group by edge_id, name),
    placed as (select *, row_number() over (partition by edge_id order by d, name) as r from found),
    top as (select edge_id, count(*) as n, max(case when r = 1 then d end) as d1, max(case when r = 2 then d end) as d2, max(case when r = 1 then name end) as nearest,
            string_agg(name, '|' order by r) filter (where r <= 3) as names from placed group by edge_id),
    judged as (select p.edge_id, p.name, nearest, names, case when coalesce(p.name, '') <> '' then 'own' when p.kind like '%crossing%' then 'connector' when l1 + l2 < 5 then 'too_short'
               when n is null then 'no_parent' when n = 1 or (d2 > 0 and d1 / d2 <= 0.6) then 'derived' else 'ambiguous' end as outcome from pa p left join top using (edge_id)),
    done as (select edge_id, outcome, case outcome when 'own' then name when 'derived' then nearest end as name, case when outcome in ('too_short', 'ambiguous') then names end as fold_names from judged)"""


def _held_out(policy: str, limit: str) -> str:
    return f"""select '{policy}' as policy, bucket, count(*) as n, sum(w) as length from ({_ctes('cast(null as varchar)', limit)}
        select case when done.name is null then 'none' when done.name = beside then 'right' else 'wrong' end as bucket, l1 + l2 as w from done join pa using (edge_id)) group by bucket"""


ORACLE_TEXTS = {
    "path_names": f"{_ctes('name', 'metres < 5 or turn <= 30')} select * from done",
    "naming_holdout": f"select policy, bucket, n, round(length, 6) as length, round(length / sum(length) over (partition by policy), 6) as share from ({_held_out('nearest', 'true')} union all {_held_out('parallel', 'metres < 5 or turn <= 30')}) q",
}
