"""Queries of the tables built on evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from . import views as V
from .aggregates import CUT, PROFILE_SQL, profile_forecast, rounded
from .evaluation import COUNTS
from .oracle import CTES, sql
from .registry import query

CTES["arm_quality"] = (("arm_scores",), """
    select key, cast(max(tn) as bigint) as n, cast(max(tp) as bigint) as pos, sum(p * cp / cast(cn as double)) / max(tp) as ap,
           sum(p * (tn - tp - (cn - cp) + (n - p) / cast(2 as double))) / (cast(max(tp) as double) * (max(tn) - max(tp))) as auroc
    from (select *, sum(n) over w as cn, sum(p) over w as cp, sum(n) over (partition by key) as tn, sum(p) over (partition by key) as tp
          from (select key, score, count(*) as n, sum(y) as p from arm_scores group by all) window w as (partition by key order by score desc)) group by key""")


@query("e20_contrast_table", sql("registry arm_quality", f"""
    , m as (select q.*, b.brier, case when tp + fp > 0 then tp / cast(tp + fp as double) else 0 end as precision, case when tp + fn > 0 then tp / cast(tp + fn as double) else 0 end as recall
            from arm_quality q join (select key, avg(power(score - y, 2)) as brier, {COUNTS} from arm_scores group by key) b on q.key = b.key)
    select contrast, r.key, label, case when n is null then 'PENDING' else 'OK' end as status, n, pos, round(ap, 6) as ap, round(auroc, 6) as auroc, round(brier, 6) as brier,
           round(precision, 6) as precision, round(recall, 6) as recall,
           coalesce((max(n) over c - min(n) over c) / cast(max(n) over c as double) > 0.05, false) as mismatch,
           case contrast when 'C1' then 'forecaster' when 'C2' then 'classifier' else 'system' end as panel,
           cast(case when ap is not null then row_number() over (partition by contrast order by ap desc nulls last, r.key) end as integer) as rank
    from registry r left join m on r.key = m.key window c as (partition by contrast)"""))
def e20(spark, d):
    metrics = R.arm_metrics(V.arm_scores(spark, d), "key", "y", "score", "pred")
    return rounded(R.contrast_table(metrics, V.registry(spark, d)), "ap", "auroc", "brier", "precision", "recall")


@query("e21_active_arms", sql("registry", """
    select key, contrast, arch, active_graph from registry r where coalesce(role not in ('excluded', 'data_quantity'), true)
      and not (not active_graph and exists (select 1 from registry o where o.contrast = r.contrast and o.arch = r.arch and o.active_graph))"""))
def e21(spark, d):
    return R.active_arms(V.registry(spark, d)).select("key", "contrast", "arch", "active_graph")


@query("e22_forecast_metrics", sql("traffic vol_factor", PROFILE_SQL + """
    , l as (select dir, 'v' as channel, v as a, v_hat as b from pred union all select dir, 'flow', flow, flow_hat from pred)
    select dir, channel, round(sqrt(avg(power(b - a, 2))), 6) as rmse, round(avg(abs(b - a)), 6) as mae, round(1 - sum(power(b - a, 2)) / (var_pop(a) * count(*)), 6) as r2,
           round(avg(b - a), 6) as bias, round(avg(abs(b - a) / a) filter (a > 0) * 100, 6) as mape_nz, round(stddev_pop(a), 6) as truth_sd, count(*) as n from l group by dir, channel"""))
def e22(spark, d):
    out = R.forecast_metrics(profile_forecast(spark, d), {"v": ("v", "v_hat"), "flow": ("flow", "flow_hat")}, ["dir"])
    return rounded(out, "rmse", "mae", "r2", "bias", "mape_nz", "truth_sd")


@query("e23_segment_map", sql("scores", f"""
    , q as (select pos, dir, sum(p * cp / cast(cn as double)) / nullif(max(tp), 0) as ap, max(tp) as tp1, max(tn) as tn1 from
            (select *, sum(n) over w as cn, sum(p) over w as cp, sum(n) over (partition by pos, dir) as tn, sum(p) over (partition by pos, dir) as tp
             from (select pos, dir, pa, count(*) as n, sum(y) as p from scores group by all) window w as (partition by pos, dir order by pa desc)) group by pos, dir),
    c as (select pos, dir, count(*) as n, cast(sum(y) as bigint) as positives, {COUNTS} from (select *, case when pb >= 0.7 then 1 else 0 end as pred from scores) group by pos, dir)
    select c.pos, c.dir, n, positives, tp, fp, tp + fp as flagged, round(tp / cast(nullif(positives, 0) as double), 6) as recall, round(tp / cast(nullif(tp + fp, 0) as double), 6) as precision,
           round(case when positives between 1 and n - 1 then ap end, 6) as ap, round(case when positives between 1 and n - 1 then ap / (positives / cast(n as double)) end, 6) as lift
    from c join q on c.pos = q.pos and c.dir = q.dir"""))
def e23(spark, d):
    pred = V.scores(spark, d).withColumn("pred", (F.col("pb") >= 0.7).cast("int"))
    return rounded(R.segment_map(pred, ["pos", "dir"], "y", "pa", "pred"), "recall", "precision", "ap", "lift")


CTES["weekly"] = (("long_scores",), """
    select model, week, max(tn) as n, max(tp) as pos, max(tp) / cast(max(tn) as double) as base, sum(p * cp / cast(cn as double)) / max(tp) as ap,
           sum(p * (tn - tp - (cn - cp) + (n - p) / cast(2 as double))) / (cast(max(tp) as double) * (max(tn) - max(tp))) as auroc
    from (select *, sum(n) over w as cn, sum(p) over w as cp, sum(n) over (partition by model, week) as tn, sum(p) over (partition by model, week) as tp
          from (select model, (day(ts) - 1) // 7 as week, score, count(*) as n, sum(y) as p from long_scores group by all)
          window w as (partition by model, week order by score desc)) group by model, week""")


def weekly(spark, d):
    rows = V.long_scores(spark, d).withColumn("week", F.expr("cast((day(ts) - 1) div 7 as int)"))
    from ..operators.evaluate import ranking_metrics
    return ranking_metrics(rows, "y", "score", ["model", "week"])


@query("e24_rolling_origin", """
    with s as (select strftime(l_shipdate, '%Y-%m') as fold, l_extendedprice as score, count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end) as p from lineitem group by all),
    c as (select *, sum(n) over w as cn, sum(p) over w as cp, sum(n) over (partition by fold) as tn, sum(p) over (partition by fold) as tp from s window w as (partition by fold order by score desc)),
    q as (select fold, cast(max(tn) as bigint) as n, cast(max(tp) as bigint) as pos, max(tp) / cast(max(tn) as double) as base, sum(p * cp / cast(cn as double)) / max(tp) as ap from c group by fold having max(tp) > 0),
    f as (select distinct strftime(o_orderdate, '%Y-%m') as fold from orders)
    select f.fold, n, pos, round(base, 6) as base, round(ap, 6) as ap, round(ap / base, 6) as lift, case when ap is null then 'PENDING' else 'OK' end as status
    from f left join q on f.fold = q.fold""")
def e24(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        "l_shipdate", (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_extendedprice")
    folds = V.table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("fold")).distinct()
    return rounded(R.rolling_origin(rows, folds, "l_shipdate", "y", "l_extendedprice"), "base", "ap", "lift")


@query("e25_month_panel", sql("weekly", "select model, " + ", ".join(
    f'round(max(ap) filter (week = {w}), 4) as "{w}_ap", round(max(ap / base) filter (week = {w}), 1) as "{w}_lift"' for w in range(5)) + " from weekly group by model"))
def e25(spark, d):
    return R.month_panel(weekly(spark, d), "model", "week", [0, 1, 2, 3, 4])


SLICES = [("first", "2024-01-01", "2024-01-08"), ("second", "2024-01-08", "2024-01-15"), ("gap", "2023-01-01", "2023-02-01"), ("last", "2024-01-22", "2024-01-29")]


@query("e26_season_slices", sql("long_scores", f"""
    , s as (select case when ts < timestamp '2024-01-08' then 'first' when ts < timestamp '2024-01-15' then 'second' when ts >= timestamp '2024-01-22' and ts < timestamp '2024-01-29' then 'last' end as slice,
                   y, score, case when score >= 0.1 then 1 else 0 end as pred from long_scores where model = 'pa'),
    k as (select slice, {COUNTS} from s where slice is not null group by slice),
    g as (select slice, score, count(*) as n, sum(y) as p from s where slice is not null group by all),
    c as (select *, sum(n) over w as cn, sum(p) over w as cp from g window w as (partition by slice order by score desc))
    select c.slice, round(sum(p * cp / cast(cn as double)) / sum(p), 6) as ap, round(sum(p) / cast(sum(n) as double), 6) as base,
           round(sum(p * cp / cast(cn as double)) / sum(p) / (sum(p) / cast(sum(n) as double)), 6) as lift,
           round(max(tp) / cast(greatest(max(tp + fp), 1) as double), 6) as precision, round(max(tp) / cast(greatest(max(tp + fn), 1) as double), 6) as recall
    from c join k on c.slice = k.slice group by c.slice"""))
def e26(spark, d):
    rows = V.long_scores(spark, d).filter("model = 'pa'")
    return rounded(R.season_slices(rows, SLICES, "ts", "y", "score", 0.1), "ap", "base", "lift", "precision", "recall")


@query("e27_lead_sweep", sql("weekly", """
    select cast(week as integer) as week, round(base, 6) as base, round(ap, 6) as ap, round(ap / base, 6) as lift, round(auroc, 6) as auroc from weekly where model = 'pb'"""))
def e27(spark, d):
    rows = V.long_scores(spark, d).filter("model = 'pb'").withColumn("week", F.expr("cast((day(ts) - 1) div 7 as int)"))
    return rounded(R.lead_sweep(rows, "week", "y", "score"), "base", "ap", "lift", "auroc")


@query("e28_day_matrix", sql("scores", """
    , b as (select day from scores group by day order by sum(y) desc, day limit 1)
    select 'asked' as kind, pos, day, round(hour(ts) + minute(ts) / cast(60 as double), 6) as clock, round(max(pa), 6) as score, max(y) as y from scores where day = date '2024-01-17' group by all
    union all select 'busiest', pos, day, round(hour(ts) + minute(ts) / cast(60 as double), 6), round(max(pa), 6), max(y) from scores where day = (select day from b) group by all"""))
def e28(spark, d):
    s = V.scores(spark, d)
    asked = R.day_matrix(s, "ts", "pos", "y", "pa", "2024-01-17").withColumn("kind", F.lit("asked"))
    other = R.day_matrix(s, "ts", "pos", "y", "pa", "2030-01-01").withColumn("kind", F.lit("busiest"))
    return rounded(asked.unionByName(other), "clock", "score")


@query("e29_stage_summary", sql("scores", f"""
    , s as (select 'one' as stage, y, pa as score, case when pa >= 0.06 then 1 else 0 end as pred from scores
            union all select 'two', y, case when pa >= 0.06 then pb else 0 end, case when pa >= 0.06 and pb >= 0.5 then 1 else 0 end from scores),
    k as (select stage, {COUNTS} from s group by stage),
    g as (select stage, score, count(*) as n, sum(y) as p from s group by all),
    a as (select stage, sum(p * cp / cast(cn as double)) / sum(p) as ap from (select *, sum(n) over w as cn, sum(p) over w as cp from g window w as (partition by stage order by score desc)) group by stage)
    select k.stage, tp, fp, fn, tn, round(tp / cast(tp + fp as double), 6) as precision, round(tp / cast(tp + fn as double), 6) as recall, round(ap, 6) as ap,
           fp - (select fp from k where stage = 'one') as fp_change from k join a on k.stage = a.stage"""))
def e29(spark, d):
    from ..operators.evaluate import gate
    s = gate(V.scores(spark, d), "pa", "pb", 0.06, "s2").withColumn("a1", F.col("pa") >= 0.06)
    s = s.withColumn("a2", F.col("a1") & (F.col("pb") >= 0.5))
    out = R.stage_summary(s, "y", {"one": ("pa", "a1"), "two": ("s2", "a2")})
    return rounded(out.select("stage", "tp", "fp", "fn", "tn", "precision", "recall", "ap", "fp_change"), "precision", "recall", "ap")


@query("e30_metric_drift", sql("arm_quality", """
    , r as (select key, ap, round(ap, 6) + case when cast(substr(key, 2) as bigint) % 4 = 0 then 0.002 else 0.0001 end as stored from arm_quality where cast(substr(key, 2) as bigint) % 5 <> 1)
    select q.key, round(r.stored, 6) as stored, round(q.ap, 6) as recomputed, coalesce(abs(r.stored - q.ap) >= 0.0005, false) as drift,
           round(case when abs(r.stored - q.ap) >= 0.0005 then r.stored else q.ap end, 6) as shown from arm_quality q left join r on q.key = r.key"""))
def e30(spark, d):
    metrics = R.arm_metrics(V.arm_scores(spark, d), "key", "y", "score", "pred").select("key", "ap")
    number = "cast(substr(key, 2) as bigint)"
    stored = metrics.filter(f"{number} % 5 <> 1").withColumn(
        "ap", F.expr(f"round(ap, 6) + case when {number} % 4 = 0 then 0.002D else 0.0001D end"))
    return rounded(R.metric_drift(stored, metrics, "key", "ap"), "stored", "recomputed", "shown")
