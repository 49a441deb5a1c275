"""Queries of the diagnostics family."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import diagnose as X
from . import views as V
from .aggregates import rounded
from .oracle import CTES, sql
from .registry import query

NUMBERS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def lines(spark, d):
    return V.table(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


CTES["lines"] = ((), "select *, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem")


@query("x01_feature_audit", sql("lines", " union all ".join(f"""
    select '{c}' as feature, round(stddev_samp({c}), 6) as std, round(count(*) filter ({c} = 0) / cast(count(*) as double), 6) as zero_rate,
           round(count(*) filter ({c} is null) / cast(count(*) as double), 6) as null_rate, count(distinct {c}) as n_unique, round(avg({c}) filter (y = 1), 6) as mean_pos,
           round(avg({c}) filter (y = 0), 6) as mean_neg, round(abs(avg({c}) filter (y = 1) - avg({c}) filter (y = 0)), 6) as mean_gap,
           stddev_samp({c}) < 0.01 or count(*) filter ({c} = 0) / cast(count(*) as double) > 0.95 as low_variance from lines""" for c in NUMBERS)))
def x01(spark, d):
    out = X.feature_audit(lines(spark, d), NUMBERS, "y")
    return rounded(out, "std", "zero_rate", "null_rate", "mean_pos", "mean_neg", "mean_gap")


RANKED = ["pa", "pb", "hour", "pos"]


@query("x02_spearman", sql("scores", "select * from (" + " union all ".join(
    f"""select '{a}' as a, '{b}' as b, round(corr({a}_r, {b}_r), 6) as r, abs(corr({a}_r, {b}_r)) > 0.7 as high from r"""
    for i, a in enumerate(RANKED) for b in RANKED[i + 1:]) + ")",
    r="select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / cast(2 as double) as {c}_r" for c in RANKED) + " from scores"))
def x02(spark, d):
    return rounded(X.spearman(V.scores(spark, d), RANKED), "r")


@query("x03_cohens_d", sql("lines", " union all ".join(f"""
    select 'absolute' as kind, '{c}' as feature, round(abs(avg({c}) filter (y = 1) - avg({c}) filter (y = 0)) /
           (sqrt((var_pop({c}) filter (y = 1) + var_pop({c}) filter (y = 0)) / 2) + 1e-9), 6) as d from lines
    union all select 'pooled', '{c}', round((avg({c}) filter (y = 1) - avg({c}) filter (y = 0)) / sqrt(((count(*) filter (y = 1) - 1) * var_samp({c}) filter (y = 1)
           + (count(*) filter (y = 0) - 1) * var_samp({c}) filter (y = 0)) / (count(*) - 2)), 6) from lines""" for c in NUMBERS)))
def x03(spark, d):
    rows, a, b = lines(spark, d), F.col("y") == 1, F.col("y") == 0
    out = X.cohens_d(rows, NUMBERS, a, b).select(F.lit("absolute").alias("kind"), "feature", "d").unionByName(
        X.cohens_d(rows, NUMBERS, a, b, "pooled").select(F.lit("pooled").alias("kind"), "feature", "d"))
    return rounded(out, "d")


@query("x04_ks_stat", sql("lines", " union all ".join(f"""
    select '{c}' as feature, round(max(abs(a - b)), 6) as ks from (select sum(count(*) filter (y = 1)) over (order by {c}) / cast(sum(count(*) filter (y = 1)) over () as double) as a,
           sum(count(*) filter (y = 0)) over (order by {c}) / cast(sum(count(*) filter (y = 0)) over () as double) as b from lines group by {c})""" for c in NUMBERS)))
def x04(spark, d):
    return rounded(X.ks_stat(lines(spark, d), NUMBERS, F.col("y") == 1, F.col("y") == 0), "ks")


@query("x05_outcome_means", sql("scores", """
    select case when pb >= 0.6 and y = 1 then 'TP' when pb >= 0.6 then 'FP' when y = 1 then 'FN' else 'TN' end as outcome, count(*) as n, round(avg(pa), 6) as pa,
           round(avg(hour), 6) as hour, round(avg(pos), 6) as pos from scores group by 1"""))
def x05(spark, d):
    out = X.outcome_means(X.outcome_class(V.scores(spark, d), "y", "pb", 0.6), ["pa", "hour", "pos"])
    return rounded(out, "pa", "hour", "pos")


@query("x06_clipped_hist", sql("lines", """
    , q as (select quantile_cont(l_extendedprice, 0.01) as lo, quantile_cont(l_extendedprice, 0.99) as hi from lines)
    select y, cast(least(floor((least(greatest(l_extendedprice, lo), hi) - lo) / ((hi - lo) / 30)), 29) as integer) as bin, count(*) as n from lines, q group by all"""))
def x06(spark, d):
    return X.clipped_hist(lines(spark, d), "l_extendedprice", 30, by=["y"])


CTES["std_vectors"] = (("vectors",), """
    select vec_id, max(y) as y, list((x - m) / s order by i) as vec from (
      select vec_id, y, i, x, avg(x) over (partition by i) as m, stddev_pop(x) over (partition by i) as s
      from (select vec_id, y, unnest(range(1, len(embedding) + 1)) as i, unnest(cast(embedding as double[])) as x from vectors)) group by vec_id""")
CTES["nn"] = (("std_vectors",), """
    select 'pos_to_neg' as kind, vec_id, distance, rank from (select a.vec_id, list_distance(a.vec, b.vec) as distance,
       row_number() over (partition by a.vec_id order by list_distance(a.vec, b.vec), b.vec_id) as rank from std_vectors a, std_vectors b where a.y = 1 and b.y = 0) where rank <= 5
    union all select 'neg_to_pos', a.vec_id, min(list_distance(a.vec, b.vec)), 1 from std_vectors a, std_vectors b where a.y = 0 and b.y = 1 group by a.vec_id
    union all select 'neg_to_neg', a.vec_id, min(list_distance(a.vec, b.vec)), 1 from std_vectors a, std_vectors b where a.y = 0 and b.y = 0 and a.vec_id <> b.vec_id group by a.vec_id""")


def distances(spark, d):
    return X.nn_distance(X.standardise_vectors(V.vectors(spark, d), "vec"), "vec_id", "vec", "y")


@query("x07_nn_distance", sql("nn", "select kind, vec_id, round(distance, 6) as distance, cast(rank as integer) as rank from nn"))
def x07(spark, d):
    return rounded(distances(spark, d), "distance")


@query("x08_overlap_curve", sql("nn", """
    select distinct round(distance, 5) as distance, round(100 * count(*) over (order by round(distance, 5)) / cast(count(*) over () as double), 6) as pct from nn where kind = 'neg_to_pos'"""))
def x08(spark, d):
    std = X.standardise_vectors(V.vectors(spark, d), "vec")
    near = X.nearest(std.filter("y = 0"), std.filter("y = 1"), "vec_id", "vec", 1)
    return rounded(X.overlap_curve(near.withColumn("distance", F.round("distance", 5)), "distance"), "pct")


FEATURES = ["hour", "dow", "pos", "dir", "pa", "pb"]


def labelled(spark, d):
    """Scores with a label that depends on the features."""
    return V.scores(spark, d).withColumn("y", F.expr("cast(pa > 0.15 and pb > 0.3 or y = 1 and hour > 20 as int)"))


def assembled(df):
    return VectorAssembler(inputCols=FEATURES, outputCol="x").transform(df)


def small_gbt(df, iterations=5):
    return GBTClassifier(featuresCol="x", labelCol="y", maxIter=iterations, maxDepth=3, seed=7).fit(assembled(df))


@query("x09_pca_partitions")
def x09(spark, d):
    marked = X.outcome_class(V.scores(spark, d), "y", "pb", 0.6)
    return rounded(X.pca_partitions(marked, FEATURES, "event_id"), "pc1", "pc2")


@query("x10_mean_importance")
def x10(spark, d):
    train = assembled(labelled(spark, d))
    models = [RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=5, maxDepth=4, seed=s).fit(train) for s in (1, 2)]
    return rounded(X.mean_importance(train, models, FEATURES), "importance")


def _scorer(model):
    def score(df):
        return model.transform(assembled(df)).withColumn("prob", F.get(vector_to_array("probability"), F.lit(1)))

    return score


@query("x11_permutation_importance")
def x11(spark, d):
    rows = labelled(spark, d).select("event_id", "y", *FEATURES)
    out = X.permutation_importance(_scorer(small_gbt(rows)), rows, ["pa", "pb", "hour"], "event_id", "y", 3)
    return rounded(out, "ap_drop", "sd")


@query("x12_partial_dependence")
def x12(spark, d):
    rows = labelled(spark, d).select("event_id", "y", *FEATURES)
    return rounded(X.partial_dependence(_scorer(small_gbt(rows)), rows, "pa", "event_id"), "grid", "mean_score")


@query("x13_leaf_support")
def x13(spark, d):
    rows = assembled(labelled(spark, d))
    train, test = rows.filter("day < date'2024-01-21'"), rows.filter("day >= date'2024-01-21'")
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=7).fit(train)
    return rounded(X.leaf_support(model, train, test, "event_id"), "support_mean", "uncertainty")
