"""Queries of the evaluation family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from . import views as V
from .aggregates import rounded
from .oracle import CTES, sql
from .registry import query
from .views import r6

GRID = [round(0.05 * i, 4) for i in range(1, 20)]
G1 = [round(0.02 + 0.02 * i, 4) for i in range(12)]
G2 = [round(0.10 + 0.05 * i, 4) for i in range(17)]


def curve(spark, d):
    return E.pr_curve(V.long_scores(spark, d), "y", "score", ["model"])


def arr(values):
    return "[" + ", ".join(f"cast({v} as double)" for v in values) + "]"


PRF = """round(case when tp + fp > 0 then tp / cast(tp + fp as double) else 0 end, 6) as precision,
    round(case when tp + fn > 0 then tp / cast(tp + fn as double) else 0 end, 6) as recall,
    round(case when tp > 0 then 2 * tp / cast(2 * tp + fp + fn as double) else 0 end, 6) as f1,
    round(case when tp > 0 then 5 * tp / cast(5 * tp + fp + 4 * fn as double) else 0 end, 6) as f2,
    round(case when tp + fp > 0 then fp / cast(tp + fp as double) else 0 end, 6) as far,
    round(case when fp + tn > 0 then fp / cast(fp + tn as double) else 0 end, 6) as fpr"""
COUNTS = """count(*) filter (y = 1 and pred = 1) as tp, count(*) filter (y = 0 and pred = 1) as fp,
    count(*) filter (y = 1 and pred = 0) as fn, count(*) filter (y = 0 and pred = 0) as tn"""


@query("e01_confusion", sql("pairs", f"select {COUNTS} from pairs"))
def e01(spark, d):
    return E.confusion(V.pairs(spark, d), "y", "pred")


@query("e02_prf", sql("arm_scores", f"select key, tp, fp, fn, tn, {PRF} from (select key, {COUNTS} from arm_scores group by key)"))
def e02(spark, d):
    out = E.prf(E.confusion(V.arm_scores(spark, d), "y", "pred", ["key"]))
    return rounded(out, "precision", "recall", "f1", "f2", "far", "fpr")


@query("e03_pr_curve", sql("pr", "select model, round(score, 9) as threshold, round(precision, 6) as precision, round(recall, 6) as recall from pr"))
def e03(spark, d):
    return curve(spark, d).select("model", F.round("score", 9).alias("threshold"), r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("e04_decimate", sql("pr", """
    , i as (select *, row_number() over (partition by model order by score) - 1 as idx, count(*) over (partition by model) as k from pr)
    select model, 'even' as form, round(score, 9) as score from i where idx in (select cast(floor(j * (k - 1) / 149.0::double) as bigint) from range(150) r(j)) or k <= 150
    union all select model, 'kth', round(score, 9) from i where idx % greatest(1, k // 200) = 0"""))
def e04(spark, d):
    c = curve(spark, d)
    even = E.decimate(c, 150, ["model"]).select("model", F.lit("even").alias("form"), "score")
    kth = E.every_kth(c, 200, ["model"]).select("model", F.lit("kth").alias("form"), "score")
    return rounded(even.unionByName(kth), "score", digits=9)


CTES["quality"] = (("curve",), """
    select model, cast(max(tot_n) as bigint) as n, cast(max(tot_pos) as bigint) as pos, max(tot_pos) / cast(max(tot_n) as double) as base,
           sum(pos * cum_pos / cast(cum_n as double)) / max(tot_pos) as ap,
           sum(pos * (tot_n - tot_pos - (cum_n - cum_pos) + (n - pos) / cast(2 as double))) / (cast(max(tot_pos) as double) * (max(tot_n) - max(tot_pos))) as auroc
    from curve group by model""")


@query("e05_average_precision", sql("quality", "select model, n, pos, round(ap, 6) as ap from quality"))
def e05(spark, d):
    return rounded(E.average_precision(V.long_scores(spark, d), "y", "score", ["model"]), "ap")


@query("e06_auroc", sql("long_scores", """
    select model, round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / cast(2 as double))
             / (cast(count(*) filter (y = 1) as double) * count(*) filter (y = 0)), 6) as auroc
    from (select model, y, rank() over (partition by model order by score) + (count(*) over (partition by model, score) - 1) / cast(2 as double) as r from long_scores)
    group by model"""))
def e06(spark, d):
    return rounded(E.auroc(V.long_scores(spark, d), "y", "score", ["model"]), "auroc")


@query("e07_brier", sql("long_scores", """
    select model, round(avg(power(least(greatest(score * 1.2 - 0.05, 0), 1) - y, 2)), 6) as brier, round(min(score * 1.2 - 0.05), 6) as score_min,
           round(max(score * 1.2 - 0.05), 6) as score_max, count(*) filter (score * 1.2 - 0.05 < 0 or score * 1.2 - 0.05 > 1) as outside from long_scores group by model"""))
def e07(spark, d):
    rows = V.long_scores(spark, d).withColumn("score", F.expr("score * 1.2D - 0.05D"))
    return rounded(E.brier(rows, "y", "score", ["model"]), "brier", "score_min", "score_max")


def _point_sql(floor):
    return f"""select model, {floor} as floor, round(score, 9) as threshold, round(precision, 6) as precision, round(recall, 6) as recall, cast(cum_pos as bigint) as tp,
        cast(cum_n - cum_pos as bigint) as fp, cast(tot_pos - cum_pos as bigint) as fn from (select *, row_number() over (partition by model
        order by case when recall >= {floor} then 0 else 1 end, case when recall >= {floor} then precision else recall end desc, score) as rn from pr) where rn = 1"""


@query("e08_operating_point", sql("pr", "select model, cast(floor as integer) as floor, threshold, precision, recall, tp, fp, fn from ("
       + _point_sql(0.4).replace("0.4 as floor", "40 as floor") + " union all " + _point_sql(1.1).replace("1.1 as floor", "110 as floor") + ")"))
def e08(spark, d):
    c = curve(spark, d)
    out = None
    for floor in (40, 110):
        part = E.operating_point(c, floor / 100, ["model"]).drop("feasible").withColumn("floor", F.lit(floor))
        out = part if out is None else out.unionByName(part)
    return rounded(rounded(out, "precision", "recall"), "threshold", digits=9)


@query("e09_sweep_threshold", sql("long_scores", f"""
    , g as (select model, thr, count(*) filter (score >= thr and y = 1) as tp, count(*) filter (score >= thr and y = 0) as fp,
                   count(*) filter (score < thr and y = 1) as fn from long_scores, (select unnest({arr(GRID)}) as thr) group by all),
    r as (select *, tp / cast(tp + fp as double) as p, tp / cast(greatest(tp + fn, 1) as double) as rc from g where tp + fp > 0),
    f as (select *, 5 * p * rc / greatest(4 * p + rc, 1e-12) as f2 from r),
    k as (select *, rc >= 0.3 and p >= 0.205 as ok, row_number() over (partition by model order by rc >= 0.3 and p >= 0.205 desc, f2 desc, thr) as rn from f)
    select model, thr as threshold, tp, fp, fn, round(p, 6) as precision, round(rc, 6) as recall, round(f2, 6) as f2, ok as feasible from k where rn = 1"""))
def e09(spark, d):
    out = E.sweep_threshold(V.long_scores(spark, d), "y", "score", GRID, "f2", 0.3, 0.205, ["model"]).drop("f1")
    return rounded(out, "precision", "recall", "f2")


@query("e10_sweep_two_stage", sql("scores", f"""
    , g as (select a, b, count(*) filter (pa >= a and pb >= b and y = 1) as tp, count(*) filter (pa >= a and pb >= b and y = 0) as fp,
                   count(*) filter (y = 1) as pos from scores, (select unnest({arr(G1)}) as a), (select unnest({arr(G2)}) as b) group by all),
    r as (select *, tp / cast(greatest(tp + fp, 1) as double) as p, tp / cast(pos as double) as rc, fp / cast(greatest(tp + fp, 1) as double) as far from g),
    f as (select *, 2 * p * rc / greatest(p + rc, 1e-12) as f1 from r),
    k as (select *, rc >= 0.2 and far <= 0.799 as ok, row_number() over (order by rc >= 0.2 and far <= 0.799 desc, f1 desc, a, b) as rn from f)
    select a as s1, b as s2, tp, fp, round(p, 6) as precision, round(rc, 6) as recall, round(f1, 6) as f1, ok as feasible from k where rn = 1"""))
def e10(spark, d):
    out = E.sweep_two_stage(V.scores(spark, d), "y", "pa", "pb", G1, G2, "f1", 0.2, 0.799)
    return rounded(out.select("s1", "s2", "tp", "fp", "precision", "recall", "f1", "feasible"), "precision", "recall", "f1")


@query("e11_gate", sql("scores", """
    select event_id, round(case when pa >= 0.06 then pb else 0 end, 6) as cascade, round(case when pa >= 0.06 then pb else pa end, 6) as kept from scores"""))
def e11(spark, d):
    out = E.gate(V.scores(spark, d), "pa", "pb", 0.06, "cascade")
    out = E.gate(out, "pa", "pb", 0.06, "kept", keep_screener=True)
    return rounded(out.select("event_id", "cascade", "kept"), "cascade", "kept")


def _tier_sql(tier, order, fallback="false"):
    return f"""select model, '{tier}' as tier, score, not ({fallback}) as attained, cum_pos, cum_n, tot_n, tot_pos from
        (select *, row_number() over (partition by model order by {order}) as rn from c) where rn = 1"""


@query("e12_tiers", sql("pr", """
    , c as (select *, 2 * precision * recall / (precision + recall + 1e-12) as f1,
                   bool_or(precision >= 0.95) over (partition by model) as s_ok, bool_or(precision >= 0.8) over (partition by model) as d_ok from pr),
    t as (""" + " union all ".join([
        _tier_sql("strict", "case when s_ok and precision >= 0.95 then recall when not s_ok then precision else -1 end desc, score", "not s_ok"),
        _tier_sql("dispatch", "case when d_ok and precision >= 0.8 then recall when not d_ok then precision else -1 end desc, score", "not d_ok"),
        _tier_sql("balanced", "case when precision + recall > 0 then f1 else 0 end desc, score"),
        _tier_sql("advisory", "case when recall >= 0.5 then precision else -1 end desc, score"),
    ]) + """)
    select model, tier, attained, round(score, 9) as threshold, round(cum_pos / cast(cum_n as double), 6) as precision, round(cum_pos / cast(tot_pos as double), 6) as recall,
           cast(cum_pos as bigint) as tp, cast(cum_n - cum_pos as bigint) as fp, cast(cum_n as bigint) as flagged, round((cum_n - cum_pos) / cast(tot_n - tot_pos as double), 6) as fpr,
           round(cum_n * (5 / cast(60 as double)), 6) as exposure, round(100 * cum_n / cast(tot_n as double), 6) as flagged_pct from t"""))
def e12(spark, d):
    out = E.tiers(curve(spark, d), ["model"]).drop("f1")
    return rounded(rounded(out, "precision", "recall", "fpr", "exposure", "flagged_pct"), "threshold", digits=9)


@query("e13_exposure_curve", sql("curve", "select model, round(score, 9) as score, round(cum_n * (5 / cast(60 as double)), 6) as exposure from curve"))
def e13(spark, d):
    out = E.exposure_curve(curve(spark, d)).select("model", "score", "exposure")
    return rounded(rounded(out, "exposure"), "score", digits=9)


@query("e14_calibration", sql("long_scores", """
    select model, cast(b as integer) as bin, round(avg(score), 6) as mean_score, round(avg(y), 6) as observed, count(*) as n
    from (select *, (select count(*) from range(10) e(i) where i * cast(0.1 as double) <= score) - 1 as b from long_scores where score >= 0 and score < 1) group by model, b"""))
def e14(spark, d):
    return rounded(E.calibration(V.long_scores(spark, d), "y", "score", by=["model"]), "mean_score", "observed")


@query("e15_lift", sql("quality", "select model, round(base, 6) as base, round(ap, 6) as ap, round(ap / base, 6) as lift from quality"))
def e15(spark, d):
    return rounded(E.lift(V.long_scores(spark, d), "y", "score", ["model"]), "base", "ap", "lift")


REPS, SEED = 1000, 12345
CTES["boot"] = (("long_scores",), f"""
    select model, rep, sum(p * cp / cast(cn as double)) / sum(p) as ap,
           sum(p * (tn - tp - (cn - cp) + (n - p) / cast(2 as double))) / (cast(sum(p) as double) * (max(tn) - max(tp))) as auroc
    from (select *, sum(n) over w as cn, sum(p) over w as cp, sum(n) over (partition by model, rep) as tn, sum(p) over (partition by model, rep) as tp
          from (select h.model, w.rep, h.score, sum(h.n * w.m) as n, sum(h.p * w.m) as p from
                  (select model, day, score, count(*) as n, sum(y) as p from long_scores group by all) h
                  join (select day, row_number() over (order by day) - 1 as d from (select distinct day from long_scores)) x on h.day = x.day
                  join (select rep, d, count(*) as m from (select r as rep, (((r * 7919 + j * 104729 + {SEED} * 31) % 1000003 * 1103515245 + 12345) % 2147483648) // 65536
                           % (select count(distinct day) from long_scores) as d from range({REPS}) a(r), range(400) b(j)
                           where j < (select count(distinct day) from long_scores)) group by all) w on w.d = x.d group by all)
          window w as (partition by model, rep order by score desc)) group by model, rep""")


def boot(spark, d):
    return E.bootstrap_days(V.long_scores(spark, d), "y", "score", "day", ["model"], REPS, SEED)


@query("e16_bootstrap_days", sql("boot", "select model, cast(rep as integer) as rep, round(ap, 6) as ap, round(auroc, 6) as auroc from boot"))
def e16(spark, d):
    return rounded(boot(spark, d), "ap", "auroc")


@query("e17_bootstrap_ci", sql("boot", """
    select model, round(quantile_cont(ap, 0.025), 6) as ap_lo, round(quantile_cont(ap, 0.975), 6) as ap_hi,
           round(quantile_cont(auroc, 0.025), 6) as auroc_lo, round(quantile_cont(auroc, 0.975), 6) as auroc_hi from boot group by model"""))
def e17(spark, d):
    return rounded(E.bootstrap_ci(boot(spark, d), ["model"]), "ap_lo", "ap_hi", "auroc_lo", "auroc_hi")


@query("e18_paired_significance", sql("boot", """
    select b.model, round(avg(r.ap - b.ap), 6) as d_ap, round(avg(case when r.ap - b.ap <= 0 then 1 else 0 end), 6) as p_ap,
           round(avg(case when r.auroc - b.auroc <= 0 then 1 else 0 end), 6) as p_auroc,
           case when avg(case when r.ap - b.ap <= 0 then 1 else 0 end) < 0.01 then '**' when avg(case when r.ap - b.ap <= 0 then 1 else 0 end) < 0.05 then '*' else '' end as stars
    from boot b join boot r on r.model = 'pa' and r.rep = b.rep where b.model <> 'pa' group by b.model"""))
def e18(spark, d):
    return rounded(E.paired_significance(boot(spark, d), "model", "pa"), "d_ap", "p_ap", "p_auroc")


@query("e19_common_days", sql("arm_scores registry", """
    select contrast, day from (select r.contrast, a.day, count(distinct a.key) as k from arm_scores a join registry r on a.key = r.key group by all)
    join (select r.contrast, count(distinct a.key) as m from arm_scores a join registry r on a.key = r.key group by all) using (contrast) where k * 4 >= m and k = m
    union all select 'hours', day from (select cast(ts as date) as day, count(distinct user_id % 5) as k from events group by 1) where k = 5"""))
def e19(spark, d):
    arms = V.arm_scores(spark, d).join(V.registry(spark, d).select("key", "contrast"), "key")
    by_contrast = E.common_days(arms, ["contrast"], "key", "day")
    rows = V.table(spark, d, "events").select((F.col("user_id") % 5).alias("m"), F.to_date("ts").alias("day"))
    return by_contrast.unionByName(E.common_days(rows, [], "m", "day").select(F.lit("hours").alias("contrast"), "day"))


@query("e31_weighted_f1", """
    with c as (select l_returnflag as t, case when l_quantity > 34 then 'R' when l_quantity > 17 then 'A' else 'N' end as p from lineitem),
    k as (select x.c, count(*) filter (t = x.c) as support, count(*) filter (p = x.c) as said, count(*) filter (t = x.c and p = x.c) as hit
          from c, (select distinct t as c from c) x group by x.c)
    select cast(sum(support) as bigint) as n, round(sum(hit) / cast(sum(support) as double), 6) as accuracy,
           round(sum(2 * hit / cast(support + said as double) * support) / sum(support), 6) as weighted_f1 from k""")
def e31(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("t"), F.expr("case when l_quantity > 34 then 'R' when l_quantity > 17 then 'A' else 'N' end").alias("p"))
    return rounded(E.weighted_f1(rows, "t", "p"), "accuracy", "weighted_f1")
