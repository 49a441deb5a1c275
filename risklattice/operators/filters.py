"""Filters, time windows and train/test splits.

Splits follow time. Positions along time are read from running counts per
instant, so rows of one instant stay on one side and nothing is sorted globally.
A split is a comparison with one or a few cut instants found by a subquery: the
rows themselves are neither joined nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordered import exact_quantiles, minute_bin, mix, ordered_prefix, running
from ..functions.timeparts import day_chunk, epoch_seconds


def _ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a timezone-free timestamp."""
    fraction = F.expr(f"cast((extract(second from {ts}) - second({ts})) * 1000000 as bigint)")
    return epoch_seconds(ts) * 1_000_000 + fraction


def between_dates(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Rows in [start, end)."""
    return df.filter((F.col(ts) >= _ts(start)) & (F.col(ts) < _ts(end)))


def between_pos(df: DataFrame, pos: str, low: float, high: float) -> DataFrame:
    """Rows in [low, high]."""
    return df.filter(F.col(pos).between(low, high))


def filter_windows(
    df: DataFrame, ts: str, windows: Sequence[tuple[str, str]], tag: str | None = None, repeat: bool = False
) -> DataFrame:
    """Rows inside any of a few half-open windows, optionally tagged.

    A row of several windows is kept once with the first of them, or with
    ``repeat`` once per window.
    """
    t = F.col(ts)
    inside = [(t >= _ts(a)) & (t < _ts(b)) for a, b in windows]
    if repeat:
        ids = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(inside)]))
        out = df.withColumn(tag or "window_id", F.explode(ids))
        return out if tag else out.drop("window_id")
    keep, which = F.lit(False), F.lit(None).cast("int")
    for i in range(len(inside) - 1, -1, -1):
        keep, which = keep | inside[i], F.when(inside[i], F.lit(i)).otherwise(which)
    kept = df.filter(keep)
    return kept.withColumn(tag, which) if tag else kept


def drop_warmup(df: DataFrame, loc: Sequence[str], ts: str, rows: int, forecast: str | None = None) -> DataFrame:
    """Without the first ``rows`` rows of each location, short locations, and
    rows whose forecast is null.

    Only the earliest rows per location are ranked (a group limit applied
    map-side); the rest are compared against the last of them.
    """
    first = df.select(*loc, ts).withColumn("_rn", F.row_number().over(Window.partitionBy(*loc).orderBy(ts)))
    last = first.filter(F.col("_rn") <= rows).groupBy(*loc).agg(
        F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_c")
    ).filter(F.col("_c") == rows)
    out = df.join(last, list(loc)).filter(F.col(ts) > F.col("_last")).select(*df.columns)
    return out.filter(F.col(forecast).isNotNull()) if forecast else out


def resolve_boundary(windows: DataFrame, start: str, end: str, frac: float = 0.8, override: str | None = None) -> DataFrame:
    """Midnight of the day at which ``frac`` of the windows' total length has passed.

    ``windows`` is a small table of training periods; one row comes back.
    """
    if override is not None:
        return windows.sparkSession.range(1).select(F.to_date(F.lit(override)).cast("timestamp_ntz").alias("boundary"))
    w = windows.select(epoch_seconds(start).alias("a"), epoch_seconds(end).alias("b"))
    w = w.withColumn("_len", F.col("b") - F.col("a"))
    order = Window.orderBy("a", "b")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("_cum", F.sum("_len").over(upto))
    target = w.select(F.sum("_len")).scalar() * frac
    at = F.col("a") + target - F.col("_cum") + F.col("_len")
    hit = w.filter(F.col("_cum") >= target).agg(F.min_by(at, "_cum").alias("s"), F.max("b").alias("b"))
    end_all = w.select(F.max("b")).scalar()
    day = F.date_from_unix_date(F.floor(F.coalesce("s", end_all) / 86_400).cast("int"))
    return hit.select(day.cast("timestamp_ntz").alias("boundary"))


def split_by_time(df: DataFrame, ts: str, boundary: str | Column, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows before the boundary and from it on. ``check`` runs an action and fails
    on an empty side."""
    cut = _ts(boundary) if isinstance(boundary, str) else boundary
    train, test = df.filter(F.col(ts) < cut), df.filter(F.col(ts) >= cut)
    if check and (train.isEmpty() or test.isEmpty()):
        raise ValueError("the boundary leaves one side of the split empty")
    return train, test


def _position(df: DataFrame, ts: str) -> DataFrame:
    """Per instant: rows at earlier instants (``_before``) and in all (``_total``)."""
    rows = df.select(epoch_micros(ts).alias("_t"), F.lit(1).cast("long").alias("_n"))
    steps = ordered_prefix(rows, [], "_t", ["_n"], bin_of=minute_bin)
    return steps.select("_t", (F.col("cum__n") - F.col("_n")).alias("_before"), F.col("tot__n").alias("_total"))


def _first_instant(df: DataFrame, ts: str, reached: Column) -> Column:
    """Scalar: first instant whose (``_before``, ``_total``) meets a condition."""
    return _position(df, ts).filter(reached).agg(F.min("_t").alias("t")).scalar()


def split_tail_days(df: DataFrame, ts: str, frac: float = 0.2, out: str = "held", rule: str = "rule") -> DataFrame:
    """1 on the latest whole days until they hold ``frac`` of the rows.

    With fewer than three days, or when every day would be held, the last
    ``frac`` of the instants by row position. Column ``rule`` says which it was:
    ``days`` or ``rows``.
    """
    per_day = df.groupBy(F.to_date(ts).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    later = Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    n = per_day.select(F.sum("_n")).scalar()
    marked = per_day.select("_day", (F.coalesce(F.sum("_n").over(later), F.lit(0)) < n * frac).alias("_held"))
    usable = marked.select((F.count(F.lit(1)) >= 3) & ~F.bool_and("_held")).scalar()
    from_day = marked.filter("_held").select(F.min("_day")).scalar()
    cut = _first_instant(df, ts, F.col("_before") >= F.bround(F.col("_total") * (1 - frac)))
    held = F.when(usable, F.to_date(ts) >= from_day).otherwise(F.coalesce(epoch_micros(ts) >= cut, F.lit(False)))
    return df.withColumn(out, held.cast("int")).withColumn(rule, F.when(usable, "days").otherwise("rows"))


def split_per_location(df: DataFrame, keys: Sequence[str], ts: str, frac: float = 0.8, out: str = "train") -> DataFrame:
    """1 on the first ``frac`` of the rows of each location (or location and window)."""
    ranked = running(df, keys, [ts], day_chunk(ts, 7), {"_rn": F.lit(1)}, totals=True)
    train = F.col("_rn") <= F.floor(F.col("tot__rn") * frac)
    return ranked.select(*df.columns, train.cast("int").alias(out))


def time_folds(df: DataFrame, ts: str, k: int = 3, out: str = "fold") -> DataFrame:
    """Block number 0…k of each row along time; fold i trains on blocks < i, tests on i."""
    bounds = fold_bounds(df, ts, k).agg(F.collect_list(F.struct("start", "fold")).alias("b")).scalar()
    passed = F.filter(F.col("_b"), lambda b: b["start"] <= F.col("_t"))
    placed = df.withColumn("_b", bounds).withColumn("_t", epoch_micros(ts))
    return placed.select(*df.columns, F.array_max(F.transform(passed, lambda b: b["fold"])).alias(out))


def fold_bounds(df: DataFrame, ts: str, k: int = 3) -> DataFrame:
    """First instant (epoch microseconds) of each of the ``k + 1`` blocks of ``time_folds``.

    With the bounds at hand a fold is a plain range filter on the input.
    """
    fold = F.least(F.floor(F.col("_before") * (k + 1) / F.col("_total")), F.lit(k)).cast("int")
    return _position(df, ts).groupBy(fold.alias("fold")).agg(F.min("_t").alias("start"))


def split_quantile(df: DataFrame, ts: str, q: float = 0.8, out: str = "train") -> DataFrame:
    """1 on rows up to the quantile of their instants."""
    micros = df.select(epoch_micros(ts).alias("_t"))
    cut = exact_quantiles(micros, [], "_t", {"q": q}, minute_bin).scalar()
    return df.withColumn(out, (epoch_micros(ts) <= cut).cast("int"))


def split_three(df: DataFrame, ts: str, fracs: tuple[float, float] = (0.7, 0.1), out: str = "part") -> DataFrame:
    """train, calibration and test along time by share of rows."""
    share = F.col("_before") / F.col("_total")
    t, never = epoch_micros(ts), F.lit((1 << 63) - 1)
    first = F.coalesce(_first_instant(df, ts, share >= fracs[0]), never)
    second = F.coalesce(_first_instant(df, ts, share >= fracs[0] + fracs[1]), never)
    part = F.when(t < first, "train").when(t < second, "calibration").otherwise("test")
    return df.withColumn(out, part)


def split_tail_or_stratified(
    df: DataFrame, ts: str, key: str, y: str, frac: float = 0.2, min_pos: int = 2, seed: int = 42, out: str = "held",
    rule: str = "rule",
) -> DataFrame:
    """The last ``frac`` of the rows by time, if both sides hold ``min_pos`` positives.

    Otherwise a seeded hash of the key holds out the same share of each class.
    Column ``rule`` says which it was: ``tail`` or ``class``.
    """
    tail = epoch_micros(ts) >= _first_instant(df, ts, F.col("_before") >= F.floor(F.col("_total") * (1 - frac)))
    marked = df.withColumn("_tail", tail)
    both = marked.select(
        (F.count(F.when(F.col("_tail") & (F.col(y) == 1), 1)) >= min_pos)
        & (F.count(F.when(~F.col("_tail") & (F.col(y) == 1), 1)) >= min_pos)
    ).scalar()
    hashed = df.select(F.col(y).cast("int").alias("_y"), mix(key, seed).alias("_h"), F.lit(1).cast("long").alias("_n"))
    ranks = ordered_prefix(hashed, ["_y"], "_h", ["_n"])
    last = ranks.filter(F.col("cum__n") <= F.bround(F.col("tot__n") * frac)).groupBy("_y").agg(F.max("_h").alias("_m"))
    limits = last.agg(F.map_from_entries(F.collect_list(F.struct("_y", "_m"))).alias("m")).scalar()
    pick = F.coalesce(mix(key, seed) <= F.try_element_at(limits, F.col(y).cast("int")), F.lit(False))
    held = F.when(both, F.col("_tail")).otherwise(pick)
    return marked.withColumn(out, held.cast("int")).withColumn(rule, F.when(both, "tail").otherwise("class")).drop("_tail")
