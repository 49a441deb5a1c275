"""From stored scores to the table of contrasts with intervals and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, reports
from ..session import materialise


def harvest(scores: DataFrame, registry: DataFrame, reps: int = 1000, seed: int = 12345) -> DataFrame:
    """One row per registry entry: metrics, 95 % intervals, test against the proposed.

    ``scores`` holds key, day, y, score and pred. Resamples are drawn once per
    contrast from the days all its models share. The replicates are stored,
    since the intervals and the paired test both read them.
    """
    metrics = reports.arm_metrics(scores, "key", "y", "score", "pred")
    table = reports.contrast_table(metrics, registry.select("key", "contrast", "label"))
    arms = scores.join(registry.select("key", "contrast"), "key")
    shared = evaluate.common_days(arms, ["contrast"], "key", "day")
    common = arms.join(shared, ["contrast", "day"], "left_semi")
    drawn = materialise(
        evaluate.bootstrap_days(common, "y", "score", "day", ["contrast", "key"], reps, seed, ["contrast"]), "replicates"
    )
    limits = evaluate.bootstrap_ci(drawn, ["key"])
    lead = registry.filter("not is_proposed").select("key", "proposed_key")
    ref = drawn.select(F.col("key").alias("proposed_key"), "rep", F.col("ap").alias("_ap"), F.col("auroc").alias("_auc"))
    gap, gap2 = F.col("_ap") - F.col("ap"), F.col("_auc") - F.col("auroc")
    tests = drawn.join(lead, "key").join(ref, ["proposed_key", "rep"]).groupBy("key").agg(
        F.avg(gap).alias("d_ap"), F.avg((gap <= 0).cast("int")).alias("p_ap"), F.avg((gap2 <= 0).cast("int")).alias("p_auroc")
    )
    return table.join(limits, "key", "left").join(tests, "key", "left")
