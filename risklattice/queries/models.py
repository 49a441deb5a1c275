"""Queries of sampling and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..session import scratch_path
from . import views as V
from .aggregates import rounded
from .diagnostics import FEATURES, labelled
from .oracle import sql
from .registry import query
from .views import LOC

SMALL = dict(trees=3, depth=3)
CUT = "2024-01-21 00:00:00"


def issued(scorer, df):
    return rounded(scorer(df).select("event_id", "prob"), "prob")


@query("m01_balanced_subset", sql("scores", """
    select y, count(*) as n, count(distinct event_id) as ids from (select * from scores where y = 1
      union all (select * from scores where y = 0 order by event_id limit 3 * (select sum(y) from scores))) group by y"""))
def m01(spark, d):
    out = M.balanced_subset(V.scores(spark, d), "y", "event_id", 3.0, 11)
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("m02_subsample_negatives", sql("scores", """
    select y, count(*) as n, count(distinct event_id) as ids from (select * from scores where y = 1
      union all (select * from scores where y = 0 order by event_id limit 3 * (select sum(y) from scores))) group by y"""))
def m02(spark, d):
    rows = V.scores(spark, d)
    total = rows.select(F.sum("y") * 4).scalar()
    out = M.subsample_negatives(rows, "y", "event_id", total, 5)
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("m03_smote", sql("scores", """
    select y, count(*) as n, count(*) filter (key) as originals from (select y, true as key from scores
      union all select 1, false from range((select count(*) filter (y = 0) - count(*) filter (y = 1) from scores))) group by y"""))
def m03(spark, d):
    out = M.smote(V.scores(spark, d), ["pa", "pb", "hour"], "y", "event_id")
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("synthetic") == 0, 1)).alias("originals"))


@query("m04_fit_logit")
def m04(spark, d):
    rows = labelled(spark, d)
    return issued(M.fit_logit(rows, FEATURES, "y", "ts", grid=(0.01, 1), max_iter=8, folds=2), rows)


@query("m05_fit_logit_fixed")
def m05(spark, d):
    rows = labelled(spark, d)
    return issued(M.fit_logit_fixed(rows, ["hour", "pa", "pb"], "y", "pos", max_iter=20), rows)


@query("m06_fit_forest")
def m06(spark, d):
    rows = labelled(spark, d)
    choices = ({"maxDepth": 3}, {"maxDepth": 5})
    return issued(M.fit_forest(rows, FEATURES, "y", "ts", grid=choices, trees=5, folds=2), rows)


@query("m07_fit_gbt")
def m07(spark, d):
    rows = labelled(spark, d)
    return issued(M.fit_gbt(rows, FEATURES, "y", **SMALL), rows)


@query("m08_fit_gbt_two_stage")
def m08(spark, d):
    rows = labelled(spark, d)
    return issued(M.fit_gbt_two_stage(rows, FEATURES, "y", **SMALL), rows)


@query("m09_fit_bagging")
def m09(spark, d):
    rows = labelled(spark, d)
    return issued(M.fit_bagging(rows, FEATURES, "y", "event_id", members=2, ratio=3.0, **SMALL), rows)


@query("m10_oof_scores")
def m10(spark, d):
    rows = labelled(spark, d)
    oof = M.oof_scores(rows, FEATURES, "y", "event_id", folds=3, members=1, **SMALL)
    return rounded(M.supervisor_pool(oof, 0.5).select("event_id", "y", "s1_score"), "s1_score")


@query("m11_fit_gbt_weighted")
def m11(spark, d):
    rows = labelled(spark, d)
    return issued(M.fit_gbt_weighted(rows, FEATURES, "y", LOC, "ts", gap_minutes=24 * 60, **SMALL), rows)


@query("m12_fit_gbt_residual")
def m12(spark, d):
    rows = labelled(spark, d).withColumn("how", F.col("dow") * 24 + F.col("hour"))
    return issued(M.fit_gbt_residual(rows, FEATURES, "y", ["pa"], ["pos", "how"], **SMALL), rows)


@query("m13_fit_gbt_blocks")
def m13(spark, d):
    rows = labelled(spark, d)
    return issued(M.fit_gbt_blocks(rows, FEATURES, "y", "pos", "ts", members=2, trees=6, depth=3), rows)


@query("m14_fit_eb", sql("scores", f"""
    , tr as (select * from scores where ts < timestamp '{CUT}'), g as (select sum(y) / cast(count(*) as double) as p0 from tr),
    k as (select pos, hour, (sum(y) + 50 * p0) / (count(*) + 50) as rate from tr, g group by pos, hour, p0)
    select event_id, round(coalesce(rate, p0), 6) as prob from scores s left join k on s.pos = k.pos and s.hour = k.hour, g where ts >= timestamp '{CUT}'"""))
def m14(spark, d):
    s = V.scores(spark, d)
    past, later = s.filter(f"ts < timestamp_ntz'{CUT}'"), s.filter(f"ts >= timestamp_ntz'{CUT}'")
    return issued(M.fit_eb(past, ["pos", "hour"], "y", 50.0), later)


@query("m15_fit_profile", sql("traffic vol_factor", f"""
    , fine as (select dir, pos, dow, hour, avg(v) as v, avg(flow) as flow, avg(heavy) as heavy from traffic where t < timestamp '{CUT}' group by all)
    select c.pos, c.dir, c.t, round(f.v, 6) as v_hat, round(f.flow * vol_factor, 6) as flow_hat, round(f.heavy * vol_factor, 6) as heavy_hat
    from traffic c join fine f using (dir, pos, dow, hour) join vol_factor x on c.dir = x.dir and c.pos = x.pos where c.t >= timestamp '{CUT}'"""))
def m15(spark, d):
    cells = V.traffic(spark, d)
    prior, recent = cells.filter(f"t < timestamp_ntz'{CUT}'"), cells.filter(f"t >= timestamp_ntz'{CUT}'")
    model = M.fit_profile(prior, recent, LOC, ["dow", "hour"], ["v", "flow", "heavy"], ["flow", "heavy"], "flow")
    out = model.predict(recent).select("pos", "dir", "t", "v_hat", "flow_hat", "heavy_hat")
    return rounded(out, "v_hat", "flow_hat", "heavy_hat")


@query("m17_score_window", sql("scores", """
    , s as (select *, 1 / (1 + exp(-(-2 + 1.5 * pa + 2.5 * pb - 0.05 * hour))) as p from scores where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20')
    select event_id, round(p, 6) as accident_probability, cast(p >= 0.4 as integer) as accident_pred_binary, y as "ACCIDENT_real", 'forecast' as mode from s"""))
def m17(spark, d):
    scorer = M.linear_scorer({"pa": 1.5, "pb": 2.5, "hour": -0.05}, -2.0)
    out = M.score_window(scorer, V.scores(spark, d), "ts", "2024-01-10", "2024-01-20", ["event_id"], "y", 0.4)
    return rounded(out, "accident_probability")


@query("m17_score_saved")
def m17_saved(spark, d):
    rows = labelled(spark, d)
    path = scratch_path(spark, "model")
    M.fit_logit(rows, FEATURES, "y", max_iter=20).model.save(path)
    out = M.score_window(M.load_scorer(path, FEATURES), rows, "ts", "2024-01-10", "2024-01-20", ["event_id"], "y", 0.5)
    return rounded(out, "accident_probability")


@query("m18_selection_score", sql("quality pr long_scores", """
    select model, 'ap' as metric, round(ap, 6) as value from quality
    union all select model, 'precision_at_recall', round(max(precision) filter (recall >= 0.4), 6) from pr group by model
    union all select model, 'f2', round(5 * tp / cast(5 * tp + fp + 4 * fn as double), 6) from (select model, count(*) filter (score >= 0.5 and y = 1) as tp,
       count(*) filter (score >= 0.5 and y = 0) as fp, count(*) filter (score < 0.5 and y = 1) as fn from long_scores group by model)"""))
def m18(spark, d):
    rows, out = V.long_scores(spark, d), None
    for metric in ("ap", "precision_at_recall", "f2"):
        part = M.selection_score(rows, "y", "score", metric, 0.4, ["model"]).withColumn("metric", F.lit(metric))
        out = part if out is None else out.unionByName(part)
    return rounded(out, "value")


@query("m19_choose")
def m19(spark, d):
    rows = labelled(spark, d)
    candidates = {
        f"depth{o['depth']}": (lambda train, o=o: M.fit_gbt(train, FEATURES, "y", trees=3, **o)) for o in M.grid(depth=[2, 3])}
    candidates["logit"] = lambda train: M.fit_logit(train, FEATURES, "y", max_iter=20)
    name, _, scorer = M.choose(rows, "ts", "y", candidates, "logit")
    return issued(scorer, rows).withColumn("chosen", F.lit(name))


@query("m20_fit_severity")
def m20(spark, d):
    rows = V.scores(spark, d).withColumn("level", F.expr("cast(least(5, pa * 20) as int)"))
    scorer = M.fit_severity(rows, ["pa", "pb", "hour"], "level", "ts", ({"maxDepth": 3}, {"maxDepth": 4}), trees=5, folds=2)
    return scorer(rows).select("event_id", "level", "level_hat")
