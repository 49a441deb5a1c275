"""Queries of logistic regression by Newton sums; their SQL writes the steps out with closed solutions of two unknowns."""

from __future__ import annotations

from ..operators import models as M
from ..operators.newton import fit_newton
from .aggregates import rounded
from .diagnostics import labelled
from .models import CUT
from .oracle import sql
from .registry import query

STEPS = 12  # written out in SQL, where both fits stand still after some eight
LABEL = "case when pa > 0.15 and pb > 0.3 or y = 1 and hour > 20 then 1 else 0 end"


def plain_steps() -> str:
    """e0 … e12: intercept a and slope b of y on x over table c."""
    out = "e0 as (select 0 :: double as a, 0 :: double as b)"
    for k in range(STEPS):
        out += f""",
        s{k} as materialized (select any_value(a) as a, any_value(b) as b, sum(y - p) as g0, sum((y - p) * x) as g1, sum(p * (1 - p)) as h00,
                     sum(p * (1 - p) * x) as h01, sum(p * (1 - p) * x * x) as h11
              from (select a, b, x, y, 1 / (1 + exp(-(a + b * x))) as p from c, e{k})),
        e{k + 1} as (select a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b from s{k})"""
    return out


def group_steps(ridge: float) -> str:
    """e0 … e12: intercept a, slope b and effect u of each group g of table c, effects penalised by ``ridge``."""
    out = "e0 as (select distinct g, 0 :: double as a, 0 :: double as b, 0 :: double as u from c)"
    for k in range(STEPS):
        out += f""",
        r{k} as materialized (select g, any_value(a) as a, any_value(b) as b, any_value(u) as u, sum(y - p) as q0, sum((y - p) * x) as q1,
                     sum(p * (1 - p)) as h, sum(p * (1 - p) * x) as c, sum(p * (1 - p) * x * x) as s
              from (select c.g, a, b, u, x, y, 1 / (1 + exp(-(a + b * x + u))) as p from c join e{k} e on c.g = e.g) group by g),
        t{k} as (select sum(h - h * h / (h + {ridge})) as h00, sum(c - h * c / (h + {ridge})) as h01, sum(s - c * c / (h + {ridge})) as h11,
                     sum(q0 - h * (q0 - {ridge} * u) / (h + {ridge})) as g0, sum(q1 - c * (q0 - {ridge} * u) / (h + {ridge})) as g1 from r{k}),
        d{k} as materialized (select (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as da, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as db from t{k}),
        e{k + 1} as (select g, a + da as a, b + db as b, u + (q0 - {ridge} * u - h * da - c * db) / (h + {ridge}) as u from r{k}, d{k})"""
    return out


@query("m16_platt", sql("scores", f"""
    , c as materialized (select pb as x, {LABEL} as y from scores where ts < timestamp '{CUT}'),
    {plain_steps()}
    select event_id, round(1 / (1 + exp(-(a + b * pb))), 6) as calibrated from scores, e{STEPS}"""))
def m16(spark, d):
    rows = labelled(spark, d)
    out = M.platt(rows.filter(f"ts < timestamp_ntz'{CUT}'"), "y", "pb")(rows)
    return rounded(out.select("event_id", "calibrated"), "calibrated")


@query("m23_fit_logit_groups", sql("scores", f"""
    , c as materialized (select pos as g, pb as x, {LABEL} as y from scores where ts < timestamp '{CUT}'),
    {group_steps(2.0)},
    one as (select any_value(a) as a, any_value(b) as b from e{STEPS})
    select event_id, round(coalesce(u, 0), 6) as effect, round(1 / (1 + exp(-(one.a + one.b * pb + coalesce(u, 0)))), 6) as prob
    from scores cross join one left join e{STEPS} e on scores.pos = e.g"""))
def m23(spark, d):
    rows = labelled(spark, d)
    fit = fit_newton(rows.filter(f"ts < timestamp_ntz'{CUT}'"), ["pb"], "y", group="pos", group_ridge=2.0)
    out = fit.score(rows).join(fit.effects, "pos", "left").na.fill({"effect": 0.0})
    return rounded(out.select("event_id", "effect", "prob"), "effect", "prob")
