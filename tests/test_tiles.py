"""Features from tiles and windows equal plain windows and joined tables, and wide rows are shuffled twice."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from risklattice.functions.ordered import exact_quantiles, over_tiles
from risklattice.functions.timeparts import band, day_chunk
from risklattice.operators.windows import FeatureConfig, baseline_columns, build_features, regime_expr

CFG = FeatureConfig(loc=("sen", "pk"), curve=None)
CUT = "2024-01-20 00:00:00"


@pytest.fixture(scope="module")
def cells(spark):
    """Posts in far bands, silences over whole blocks, null posts, hours and special days."""
    random.seed(3)
    start, rows = datetime.datetime(2024, 1, 1), []
    for pk in (0, 1, 255, 256, 900, None):
        for sen in (0, 1):
            for i in range(0, 40 * 24, 6):
                if random.random() < (0.97 if 8 * 24 <= i < 22 * 24 else 0.4):
                    continue
                t = start + datetime.timedelta(hours=i)
                hour = None if random.random() < 0.05 else t.hour
                rows.append((pk, sen, t, hour, t.weekday() // 3, 1, random.choice((None, random.random() * 90)), random.randrange(50), random.randrange(5), int(random.random() < 0.2), random.choice((0, 1, None)), len(rows)))
    schema = "pk int, sen int, dat timestamp_ntz, hor int, diaSem int, mes int, mean_speed double, intTot int, intP int, ACCIDENT int, mob_esp int, payload int"
    return spark.createDataFrame(rows, schema).repartition(3)


def rows(df, *columns):
    return sorted(map(repr, ([None if x is None else round(x, 6) for x in r] for r in df.select("payload", *columns).collect())))


def test_tiles_equal_plain_windows(cells):
    def along(w):
        return {"l1": F.lag("mean_speed", 1).over(w), "l4": F.lag("intTot", 4).over(w), "m": F.sum("intTot").over(w.rowsBetween(-3, 0))}

    def across(w):
        return {"up": F.lag("intTot").over(w), "down": F.lead("intTot").over(w)}

    got = over_tiles(cells, ["sen", "pk"], "pk", "dat", day_chunk("dat", 7), band("pk", 256), along, across, 4, ["mean_speed", "intTot"])
    assert got.columns == [*cells.columns, "l1", "l4", "m", "up", "down"]
    plain = along(Window.partitionBy("sen", "pk").orderBy("dat")) | across(Window.partitionBy("dat", "sen").orderBy("pk"))
    want = cells.select("*", *[c.alias(n) for n, c in plain.items()])
    assert rows(got, *plain) == rows(want, *plain)


def test_baselines_equal_joined_tables(cells):
    past, keys = cells.filter(F.col("dat") < F.lit(CUT).cast("timestamp_ntz")), ["pk", "hor", "diaSem"]
    share = F.sum("ACCIDENT") / F.count(F.lit(1))
    base = past.groupBy(*keys).agg(F.avg("mean_speed").alias("m"), F.stddev_samp("mean_speed").alias("s"), share.alias("r"))
    special = past.groupBy(*keys, "mob_esp").agg(share.alias("rm"))
    free, median = exact_quantiles(past, ["pk"], "mean_speed", {"ff": 0.85}), exact_quantiles(past, [], "mean_speed", {"m": 0.5}).scalar()
    want = cells.join(base, keys, "left").join(special, [*keys, "mob_esp"], "left").join(free, "pk", "left").select(
        "payload", ((F.col("mean_speed") - F.col("m")) / F.greatest(F.coalesce("s", F.lit(1e-3)), F.lit(1e-3))).alias("speed_zscore"),
        F.coalesce("r", F.lit(0.0)).alias("pk_crash_rate"), F.coalesce("rm", F.lit(0.0)).alias("pk_crash_rate_mob"),
        regime_expr("mean_speed", F.coalesce("ff", median)).alias("flow_regime"))
    names = ["speed_zscore", "pk_crash_rate", "pk_crash_rate_mob", "flow_regime"]
    assert rows(baseline_columns(cells, CFG, CUT), *names) == rows(want, *names)


def test_wide_rows_are_shuffled_twice(spark, cells, capsys):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of baselines beyond it
    try:
        build_features(cells, CFG, CUT).explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    inputs = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out, re.M)
    # the first is of the table made here
    assert len([x for x in inputs if "payload#" in x]) == 3
