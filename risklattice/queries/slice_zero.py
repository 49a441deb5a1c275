"""The flagship query: lattice, measures, imputation, shrunken rates, ranking quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import risk_map
from . import views as V
from .oracle import sql
from .registry import query
from .views import LOC, r6


@query("slice_zero", sql("cells", """
    , train as (select pos, hour, dow, sum(label) as s, count(*) as n from cells
                where t < timestamp '2024-01-21' group by all),
    g as (select sum(label) / cast(count(*) as double) as p0 from cells where t < timestamp '2024-01-21'),
    scored as (select c.dir, c.label, round(coalesce((s + 20 * p0) / (n + 20), p0), 9) as score
               from cells c left join train using (pos, hour, dow), g where c.t >= timestamp '2024-01-21'),
    k as (select dir, score, count(*) as n, sum(label) as pos from scored group by all),
    c as (select *, sum(n) over w as cn, sum(pos) over w as cp,
                 sum(n) over (partition by dir) as tn, sum(pos) over (partition by dir) as tp
          from k window w as (partition by dir order by score desc))
    select dir, cast(max(tn) as bigint) as n, cast(max(tp) as bigint) as pos,
           round(sum(pos * cp / cast(cn as double)) / max(tp), 6) as ap,
           round(sum(pos * cp / cast(cn as double)) / max(tp) / (max(tp) / cast(max(tn) as double)), 6) as lift
    from c group by dir"""))
def slice_zero(spark, d):
    out = risk_map.rank_by_history(
        V.lattice(spark, d), V.fact(spark, d), LOC, "t", "label",
        boundary="2024-01-21 00:00:00", m=20.0, by=["dir"], place=["pos"], digits=9)
    return out.select("dir", "n", "pos", r6("ap").alias("ap"), r6("lift").alias("lift"))
