"""The fit of the training plan gets its rows in tasks of a bounded number."""

from __future__ import annotations

import datetime
import inspect

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from risklattice.functions.ordered import dealt_by_rows
from risklattice.operators.windows import FeatureConfig
from risklattice.plans import train
from risklattice.queries import plans
from risklattice.session import CLEANUP, setting


def cells(spark, posts=4, hours=200):
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for p in range(posts):
        for s in (0, 1):
            for i in range(hours):
                t = start + datetime.timedelta(hours=i)
                v = float((p * 37 + i * 11 + s * 5) % 97)
                rows.append((None if p == posts - 1 else p, s, t, t.hour, t.weekday(), 1, v, (i * 7 + p) % 13, i % 3, int(i % 9 == p), i % 2))
    return spark.createDataFrame(rows, "pk int, sen int, dat timestamp_ntz, hor int, diaSem int, mes int, mean_speed double, intTot int, intP int, ACCIDENT int, mob_esp int")


CFG = FeatureConfig(loc=("sen", "pk"), curve=None)
CUT = "2024-01-08 00:00:00"


def test_fit_gets_rows_by_number(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id", "id % 5 as g").coalesce(1)
    assert dealt_by_rows(df, ["id"], 1000) is df
    few = dealt_by_rows(df, ["id"], 100)
    assert few.rdd.getNumPartitions() == 10
    assert max(few.rdd.glom().map(len).collect()) < 200
    assert sorted(r.id for r in few.collect()) == list(range(1000))
    monkeypatch.setattr(train, "dealt_by_rows", lambda rows, keys: dealt_by_rows(rows, keys, 100))
    parts = []

    def fit(rows):
        parts.append((rows.rdd.getNumPartitions(), rows.count()))
        return lambda d: d.selectExpr("*", "0.5 as prob")

    _, manifest = train.train_classifier(cells(spark).dropna(), CFG, CUT, ["speed_lag1", "pk_crash_rate"], fit)
    assert parts == [(-(-parts[0][1] // 100), parts[0][1])] and parts[0][0] > 5
    assert manifest.count() == 1


def test_query_fits_the_whole_model(spark, monkeypatch, tmp_path):
    """The registered query leaves the number of trees and their depth to the operator."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(hours=(i * 7) % 720), i % 6, ("error", "purchase", "view")[i % 3], float(i % 50)) for i in range(900)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    known, fitted = plans.M.fit_gbt, []

    class Stop(Exception):
        pass

    def fit_gbt(df, features, y, **options):
        given = inspect.signature(known).bind(df, features, y, **options)
        given.apply_defaults()
        fitted.append({k: given.arguments[k] for k in ("trees", "depth", "step", "subsample")})
        raise Stop

    monkeypatch.setattr(plans.M, "fit_gbt", fit_gbt)
    with pytest.raises(Stop):
        plans.train_classifier(spark, str(tmp_path))
    whole = {k: p.default for k, p in inspect.signature(known).parameters.items() if k in ("trees", "depth", "step", "subsample")}
    assert fitted == [whole] and whole["trees"] >= 100 and whole["depth"] >= 5


def test_shuffled_rows_do_not_pile_up(spark, monkeypatch):
    """Stored tables leave no shuffle files, and the fit shuffles its rows once, not once more to number their parts."""
    adaptive, seen, whole = "spark.sql.adaptive.enabled", [], DataFrameWriter.parquet
    before = [spark.conf.get(k, None) for k in (CLEANUP, adaptive)]

    def parquet(self, *args, **how):
        seen.append(spark.conf.get(CLEANUP, None))
        return whole(self, *args, **how)

    def fit(rows):
        seen.append((spark.conf.get(CLEANUP, None) != "true", spark.conf.get(adaptive)))
        return lambda d: d.selectExpr("*", "0.5 as prob")

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    train.train_classifier(cells(spark).dropna(), CFG, CUT, ["speed_lag1"], fit)
    assert seen == ["true", (True, "false")]
    assert [spark.conf.get(k, None) for k in (CLEANUP, adaptive)] == before


def test_setting_ends_with_an_error(spark):
    with pytest.raises(ZeroDivisionError), setting(spark, CLEANUP, "true"):
        1 / 0
    assert spark.conf.get(CLEANUP, None) != "true"
