"""Queries of boosted trees with a custom objective and monotone responses: the nodes of the first tree."""

from __future__ import annotations

from ..operators import boost as B
from . import views as V
from .oracle import sql
from .registry import query

FEATURES = ["hour", "pa", "pb"]
EDGES = {"hour": [5.0, 11.0, 17.0], "pa": [i / 10 for i in range(1, 10)], "pb": [i / 10 for i in range(1, 10)]}


def nodes(spark, model):
    """(node, feature, threshold, gain, value) of the first tree."""
    rows = [(i, f, t, round(g, 5) if f else None, round(v, 7)) for tree, i, f, t, g, v in model.table() if tree == 0]
    return spark.createDataFrame(rows, "node int, feature string, threshold double, gain double, value double")


def first_tree(derivatives: str, weight: str, rising: bool, l2: int) -> str:
    """Two levels of a tree. ``derivatives`` has y, g and h of the margin 0."""
    edges = ", ".join(f"('{f}', {i}, {j + 1}, {e} :: double)" for i, (f, es) in enumerate(EDGES.items()) for j, e in enumerate(es))
    value = f"-g{{0}} / (h{{0}} + {l2})"
    order = "and (i = 0 or wr >= wl)" if rising else ""
    clip = {"l": "case when b.lo is null then {v} else greatest(b.lo, least(b.hi, {v})) end"} if rising else {"l": "{v}"}
    wl, wr = (clip["l"].format(v=value.format(s)) for s in "lr")
    wt = clip["l"].format(v=f"-g / (h + {l2})")
    loss = f"({{0}} * ({{2}}) + ({{1}} + {l2}) * ({{2}}) * ({{2}}) / 2)"
    splits = lambda cells, extra: f"""select *, {wl} as wl, {wr} as wr,
        {loss.format('g', 'h', wt)} - {loss.format('gl', 'hl', wl)} - {loss.format('gr', 'hr', wr)} as gain
      from (select *, g - gl as gr, h - hl as hr from (
        select node, i, feature, bin, sum(g) over run as gl, sum(h) over run as hl, sum(g) over (partition by node, i) as g, sum(h) over (partition by node, i) as h
        from {cells} window run as (partition by node, i order by bin))) {extra}"""  # noqa: E731
    bounds = "left join bounds b using (node)" if rising else ""
    root_bounds = "cross join (select null :: double as lo, null :: double as hi) b" if rising else ""
    return sql("scores", f"""
    , d as ({derivatives}),
    edges as (select * from (values {edges}) v(feature, i, number, edge)),
    long as (select event_id, y, unnest([hour :: double, pa, pb]) as x, unnest(['hour', 'pa', 'pb']) as feature from scores),
    binned as (select event_id, l.y, e.i, l.feature, 1 + count(*) filter (edge < x) as bin from long l join edges e on l.feature = e.feature group by event_id, l.y, e.i, l.feature),
    cells1 as (select 1 as node, i, feature, bin, sum(d.g * {weight}) as g, sum(d.h * {weight}) as h from binned b join d on b.y = d.y group by i, feature, bin),
    splits1 as ({splits('cells1', root_bounds)}),
    root as (select * from splits1 where hl >= 1 and hr >= 1 {order} and gain > 0 order by gain desc, i, bin limit 1),
    bounds as (select 2 as node, case when i in (1, 2) then -1e300 end as lo, case when i in (1, 2) then (wl + wr) / 2 end as hi from root
      union all select 3, case when i in (1, 2) then (wl + wr) / 2 end, case when i in (1, 2) then 1e300 end from root),
    side as (select b.event_id, case when b.bin <= r.bin then 2 else 3 end as node from binned b join root r on b.i = r.i),
    cells2 as (select s.node, i, feature, bin, sum(d.g * {weight}) as g, sum(d.h * {weight}) as h
      from binned b join side s on b.event_id = s.event_id join d on b.y = d.y group by s.node, i, feature, bin),
    splits2 as ({splits('cells2', bounds)}),
    below as (select * from (select *, row_number() over (partition by node order by gain desc, i, bin) as place from splits2
      where hl >= 1 and hr >= 1 {order} and gain > 0) where place = 1),
    found as (select node, feature, i, bin, gain, -g / (h + {l2}) as value from root
      union all select b.node, b.feature, b.i, b.bin, b.gain, case b.node when 2 then r.wl else r.wr end from below b cross join root r
      union all select 2 * node, null, null, null, null, wl from below union all select 2 * node + 1, null, null, null, null, wr from below)
    select node, f.feature, edge as threshold, round(gain, 5) as gain, round(value * 0.05, 7) as value
    from found f left join edges e on f.i = e.i and f.bin = e.number""")


FOCAL = """select y, any_value(g) filter (z = 0) as g, greatest(1e-6, (any_value(g) filter (z > 0) - any_value(g) filter (z < 0)) / 2e-4) as h
  from (select y, z, case when y = 1 then 0.25 * pow(1 - p, 2) * (2 * p * ln(p) - (1 - p)) else 0.75 * pow(p, 2) * (p - 2 * (1 - p) * ln(1 - p)) end as g
        from (select y, z, 1 / (1 + exp(-z)) as p from (values (0), (1)) a(y), (values (0 :: double), (1e-4), (-1e-4)) b(z))) group by y"""
LOGISTIC = "select y, 0.5 - y as g, 0.25 as h from (values (0), (1)) a(y)"
RATIO = "case when b.y = 1 then (select count(*) filter (y = 0) / count(*) filter (y = 1) from scores) else 1 end"


@query("m21_fit_gbt_focal", first_tree(FOCAL, "1", False, 0))
def m21(spark, d):
    return nodes(spark, B.fit_gbt_focal(V.scores(spark, d), FEATURES, "y", trees=2, depth=2, edges=EDGES, l2=0.0))


@query("m22_fit_gbt_mono", first_tree(LOGISTIC, RATIO, True, 1))
def m22(spark, d):
    return nodes(spark, B.fit_gbt_mono(V.scores(spark, d), FEATURES, "y", trees=2, depth=2, rising=["^p[ab]$"], edges=EDGES))
