"""Row-wise projections, encoders and column selection."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.ordered import ordered_prefix, row_lag
from ..functions.timeparts import day_chunk


def encode(df: DataFrame, column: str, mapping: dict, default) -> DataFrame:
    """Replace codes through a map; unknown and null become ``default``."""
    value = F.lit(default)
    for source, code in reversed(list(mapping.items())):
        value = F.when(F.col(column) == F.lit(source), F.lit(code)).otherwise(value)
    return df.withColumn(column, value)


def make_dat(df: DataFrame, year: str, month: str, day: str, hour: str, minute: str, out: str = "dat") -> DataFrame:
    """Timezone-free timestamp from its parts."""
    return df.withColumn(
        out,
        F.make_timestamp_ntz(*[F.col(c).cast("int") for c in (year, month, day, hour, minute)], F.lit(0)),
    )


def calendar_parts(df: DataFrame, ts: str, step: int = 5) -> DataFrame:
    """anyo, mes, dia, diaSem (0 = Monday), hor and the minute floored to ``step``."""
    return df.select(
        "*", F.year(ts).alias("anyo"), F.month(ts).alias("mes"), F.day(ts).alias("dia"),
        F.weekday(ts).alias("diaSem"), F.hour(ts).alias("hor"),
        (F.floor(F.minute(ts) / step) * step).cast("int").alias(f"{step}min"),
    )


def slot_to_minute(df: DataFrame, column: str, unit: str) -> DataFrame:
    """Minutes of a column in ``unit``: twelve slots per hour (``slot``) → minutes; ``minute`` → floor to five.

    ``guess``, which must be asked for, takes slots if no value of the whole column exceeds 11.
    """
    x = F.try_to_number(F.col(column), F.lit("99999")) if isinstance(df.schema[column].dataType, T.StringType) else F.col(column)
    number = df.withColumn(column, x.cast("double"))
    if unit not in ("slot", "minute", "guess"):
        raise ValueError(f"unknown unit {unit}")
    slots = F.lit(unit == "slot") if unit != "guess" else number.select(F.max(column)).scalar() <= 11
    minute = F.when(slots, F.col(column) * 5).otherwise(F.floor(F.col(column) / 5) * 5)
    return number.withColumn(column, minute.cast("int"))


def standardise_types(df: DataFrame, integers: Sequence[str] = (), rounded: dict[str, int] | None = None) -> DataFrame:
    """Truncate to whole numbers, round the others to their number of places."""
    out = df
    for c in integers:
        out = out.withColumn(c, F.col(c).cast("int"))
    for c, places in (rounded or {}).items():
        out = out.withColumn(c, F.bround(F.col(c), places))
    return out


def trunc_pos(c: str) -> Column:
    """Whole part of a position."""
    return F.col(c).cast("int")


def first_decimal(c: str) -> Column:
    """First decimal digit, guarded against binary fractions."""
    return (F.floor(F.round(F.col(c) * 10, 4)) % 10).cast("int")


def feature_matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Features in fixed order as numbers: unparsable, null and absent become 0."""
    have = set(df.columns)
    cols = [
        F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c)
        for c in features
    ]
    return df.select(*keep, *cols)


def severity(df: DataFrame, duration: str, length: str, out: str = "F_RETENCIO") -> DataFrame:
    """Duration × length; 0 where either column is absent from the table."""
    known = duration in df.columns and length in df.columns
    return df.withColumn(out, F.col(duration) * F.col(length) if known else F.lit(0.0))


def light_share(df: DataFrame, total: str, heavy: str, eps: float = 1e-3) -> DataFrame:
    """Light flow, and its share of the total guarded against small totals."""
    light = F.col(total) - F.col(heavy)
    return df.withColumn("light", light).withColumn(
        "light_share", light / F.greatest(F.abs(F.col(total)), F.lit(eps))
    )


def select_features(
    features: Sequence[str],
    drop: Iterable[str] = (),
    whitelist: Iterable[str] | None = None,
    extra: Iterable[str] = (),
    keep_only: Iterable[str] | None = None,
    prefixes: Iterable[str] = (),
) -> list[str]:
    """Resolve a feature list: drop, then whitelist, then keep-list or admitted prefix.

    ``extra`` (an upstream score) is always admitted at the end.
    """
    dropped = set(drop)
    out = [f for f in features if f not in dropped]
    if whitelist is not None:
        allowed = set(whitelist)
        out = [f for f in out if f in allowed]
    if keep_only is not None:
        allowed, starts = set(keep_only), tuple(prefixes)
        out = [f for f in out if f in allowed or (starts and f.startswith(starts))]
    return list(dict.fromkeys([*out, *extra]))


# Column-name patterns of the feature blocks, first match wins.
BLOCK_PATTERNS = {
    "site": r"crash_rate",
    "geometry": r"curv|pend|slope|geom",
    "calendar": r"^(anyo|mes|dia|diaSem|hor|5min)$|peak|festiu|mob_esp|_sin$|_cos$",
    "traffic": r"speed|vel|int|vol|car|flow|accel|delta|density|regime|occ|hv_",
}


def split_blocks(features: Sequence[str]) -> dict[str, list[str]]:
    """Each feature in the first block whose pattern it contains, else ``other``."""
    blocks: dict[str, list[str]] = {}
    for f in features:
        name = next((b for b, p in BLOCK_PATTERNS.items() if re.search(p, f)), "other")
        blocks.setdefault(name, []).append(f)
    return blocks


def strata(pos: str, hour: str, lowest: Column) -> Column:
    """Code of the 5-km band and 3-hour band of a cell."""
    band = F.greatest(F.col(pos) - lowest, F.lit(0))
    return (F.floor(band / 5) * 8 + F.floor(F.col(hour) / 3)).cast("long")


def load_scores(
    df: DataFrame, ts: str, y: str, score: str, pred: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Day, 0/1 label, score and 0/1 prediction of rows with a label and a score."""
    out = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
    day = F.to_date(ts)
    if start is not None:
        out = out.filter((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))
    flag = F.coalesce((F.col(pred).cast("double") > 0.5).cast("int"), F.lit(0))
    return out.select(
        *[c for c in df.columns if c not in (ts, y, score, pred)],
        day.alias("day"), (F.col(y).cast("double") > 0.5).cast("int").alias("y_true"),
        F.col(score).cast("double").alias("y_score"), flag.alias("y_pred"),
    )


def one_hot(df: DataFrame, values: dict[str, Sequence], keep: Sequence[str]) -> DataFrame:
    """0/1 column per listed category, repeated rows removed."""
    cols = [
        F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c, vs in values.items() for v in vs
    ]
    return df.select(*keep, *cols).distinct()


def one_hot_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The ones of :func:`one_hot` as rows (keep, feature, value), for columns with any number of values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")
    return long.filter(F.col("value").isNotNull()).distinct()


def categories(df: DataFrame, column: str) -> list:
    """Sorted distinct values of a column, to become columns of :func:`one_hot`. Runs one action.

    The driver holds them as it holds the schema they become; ``one_hot_long`` needs no such list.
    """
    return sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().collect())


def substitute_channels(
    df: DataFrame,
    channels: Sequence[str],
    mode: str,
    loc: Sequence[str] = (),
    ts: str = "dat",
    lag: int = 864,
    suffix: str = "_in",
    hat: str = "_hat",
) -> DataFrame:
    """Traffic columns the classifier reads, by mode.

    observed: the channel itself. lagged: its value ``lag`` rows earlier at the
    same location, rows without one dropped. forecast: the forecast column.
    union: observed, plus ``<c>_diff`` = forecast − observed.
    """
    if mode == "observed":
        return df.select("*", *[F.col(c).alias(f"{c}{suffix}") for c in channels])
    if mode == "forecast":
        return df.select("*", *[F.col(f"{c}{hat}").alias(f"{c}{suffix}") for c in channels])
    if mode == "union":
        return df.select(
            "*", *[F.col(c).alias(f"{c}{suffix}") for c in channels],
            *[(F.col(f"{c}{hat}") - F.col(c)).alias(f"{c}_diff") for c in channels],
        )
    if mode == "lagged":
        out = row_lag(df, loc, [ts], day_chunk(ts, 30), {c: f"{c}{suffix}" for c in channels}, lag)
        return out.dropna(subset=[f"{c}{suffix}" for c in channels])
    raise ValueError(f"unknown mode {mode}")


def issue_risk(
    df: DataFrame, keys: Sequence[str], score: str, y: str, threshold: float, mode: str
) -> DataFrame:
    """Keys with probability, binary alarm, label and the mode that produced them."""
    return df.select(
        *keys, F.col(score).alias("accident_probability"),
        (F.col(score) >= threshold).cast("int").alias("accident_pred_binary"),
        F.col(y).cast("int").alias("ACCIDENT_real"), F.lit(mode).alias("mode"),
    )


def day_key(year: str, month: str, day: str) -> Column:
    """yyyymmdd as a number; unparsable parts count as 0."""
    part = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long"))
    return part(year) * 10_000 + part(month) * 100 + part(day)


def instant_key(year: str, month: str, day: str, hour: str, minute: str | None = None) -> Column:
    """yyyymmddHHMM as a number."""
    part = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0).cast("long"))
    tail = part(minute) if minute else F.lit(0)
    return day_key(year, month, day) * 10_000 + part(hour) * 100 + tail


def dense_ids(frames: Sequence[DataFrame], column: str, out: str) -> DataFrame:
    """0-based position of each distinct value over all frames, in sorted order."""
    values = frames[0].select(column)
    for f in frames[1:]:
        values = values.unionByName(f.select(column))
    distinct = values.filter(F.col(column).isNotNull()).distinct()
    if isinstance(distinct.schema[column].dataType, T.NumericType):
        steps = ordered_prefix(distinct.withColumn("_one", F.lit(1).cast("long")), [], column, ["_one"])
        return steps.select(column, (F.col("cum__one") - 1).alias(out))
    # names of categories: a dimension, not data
    return distinct.withColumn(out, (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
