"""Order-dependent building blocks that never put one group into one task.

A plain window over a location, a model or the whole table hands each group to
a single task. The helpers here split a group along its ordering column into
blocks, work inside (group, block) and carry a small per-block summary across
the blocks, so the result is that of the plain window:

``ordered_prefix``   running totals along the distinct values of a column
``running``          running sums along a key ordering
``row_lag``          values a fixed number of rows earlier, by row number
``over_blocks``      bounded frames (lags, rolling, history) with carried rows
``over_tiles``       bounded frames along time and neighbours across posts, with one dealing of the wide rows
``dealt``            rows dealt by keys to many small tasks, of a grid to as many as its rows need
``dealt_by_rows``    rows dealt by keys to tasks of a bounded number of rows
``exact_quantiles``  exact interpolated quantiles from counts per value bin
``sample_rank``      exact seeded samples through a hash threshold
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .timeparts import col


def value_bin(value: str | Column, per_octave: int = 4096) -> Column:
    """A bin number that never decreases as ``value`` grows.

    Bins are spaced by ratio, so small scores spread as well as large ones, and
    depend on the value alone: recomputing a lost block gives the same bins.
    """
    x = col(value).cast("double")
    size = F.log2(F.lit(1.0) + F.abs(x) * F.lit(float(1 << 20)))
    return F.floor(F.signum(x) * size * F.lit(per_octave)).cast("long")


def minute_bin(micros: str | Column) -> Column:
    """A bin for instants in epoch microseconds: ratios to the epoch would put a month into a few bins."""
    return F.floor(col(micros) / F.lit(60_000_000)).cast("long")


GRID_ROWS = "grid_rows"  # in the metadata of a grid's instants: its number of rows, which selects, joins and stored copies keep


def grid_rows(df: DataFrame) -> int:
    """The number of rows of the grid whose instants ``df`` has, 0 where they are of no grid."""
    return max((int(f.metadata.get(GRID_ROWS, 0)) for f in df.schema.fields), default=0)


def dealt(df: DataFrame, keys: Sequence[str], per_core: int = 8, part_rows: int = 3 << 17) -> DataFrame:
    """``df`` dealt by ``keys`` to so many tasks that sorts of one of them stay small.

    Spark joins small shuffled partitions until few more than the cores are left, by their compressed size. Rows of a
    regular grid compress to a few bytes and take a hundred in a sort, so a task's memory would be that of a core's share
    of the table. A number given by the caller stays. Windows, groups and joins by the same keys need no other shuffle.
    A grid tells its rows, and a task gets some ``part_rows`` of them at most, however few the cores are.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core * spark.sparkContext.defaultParallelism)
    return df.repartition(max(tasks, -(-grid_rows(df) // part_rows)), *keys)


def dealt_by_rows(df: DataFrame, keys: Sequence[str], part_rows: int = 1 << 18) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks of some ``part_rows`` rows; at most that many rows stay as they lie.

    Stored tables are read by their compressed size, so a task may get many millions of rows. Keys should be nearly unique.
    """
    rows = df.count()
    return df if rows <= part_rows else df.repartition(-(-rows // part_rows), *keys)


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys))


def ordered_prefix(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    measures: Sequence[str],
    descending: bool = False,
    per_octave: int = 4096,
    bin_of: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Running totals of ``measures`` along the distinct values of ``value``.

    One row per (by, value) with each measure summed, ``cum_<m>`` up to and
    including that value, and ``tot_<m>`` over the whole group. Repeated values
    are combined map-side first; only bin totals meet in one task per group.
    ``bin_of`` replaces the bins: any function that never decreases will do.
    """
    by = list(by)
    grouped = df.groupBy(*by, value).agg(*[F.sum(m).alias(m) for m in measures])
    grouped = grouped.withColumn("_bin", bin_of(value) if bin_of else value_bin(value, per_octave))
    totals = grouped.groupBy(*by, "_bin").agg(*[F.sum(m).alias(m) for m in measures])
    direction = F.col("_bin").desc() if descending else F.col("_bin").asc()
    group = Window.partitionBy(*by)
    before = group.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "_bin",
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_off_{m}") for m in measures],
        *[F.sum(m).over(group).alias(f"tot_{m}") for m in measures],
    )
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (
        Window.partitionBy(*by, "_bin").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = _join(grouped, offsets, [*by, "_bin"])
    return joined.select(
        *by,
        value,
        *measures,
        *[(F.sum(m).over(inside) + F.col(f"_off_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"tot_{m}" for m in measures],
    )


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float], bin_of: Callable[[str], Column] | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles, one output column per entry.

    Nulls and NaN are ignored. Rows are first counted per value bin, with map-side
    combining; the counts tell which few bins hold the wanted ranks, and only
    the rows of those bins are counted by value and ordered. Neither a group nor
    its distinct values are ever held in one buffer, as ``percentile`` does.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *by, value, (bin_of or value_bin)(value).alias("_bin"))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    bins = bins.select(
        *by, "_bin", (F.sum("_c").over(upto) - F.col("_c")).alias("_before"), "_c", F.sum("_c").over(group).alias("_total")
    )

    def ranks(q: float) -> tuple[Column, Column, Column]:
        at = F.lit(float(q)) * (F.col("_total") - 1)
        return F.floor(at), F.ceil(at), at - F.floor(at)

    wanted = F.lit(False)
    for q in quantiles.values():
        for rank in ranks(q)[:2]:
            wanted = wanted | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c")))
    near = _join(rows, bins.filter(wanted).drop("_c"), [*by, "_bin"])
    counted = near.groupBy(*by, "_bin", "_before", "_total", value).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    steps = counted.withColumn("_cum", F.col("_before") + F.sum("_n").over(inside))
    picks, finals = [], []
    for name, q in quantiles.items():
        low, high, part = ranks(q)

        def holds(rank: Column) -> Column:
            return (F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum"))

        x = F.col(value).cast("double")
        picks += [
            F.max(F.when(holds(low), x)).alias(f"_lo_{name}"),
            F.max(F.when(holds(high), x)).alias(f"_hi_{name}"),
            F.max(part).alias(f"_fr_{name}"),
        ]
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        finals.append((lo + (hi - lo) * F.col(f"_fr_{name}")).alias(name))
    picked = steps.groupBy(*by).agg(*picks) if by else steps.agg(*picks)
    return picked.select(*by, *finals)


def carried(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block: str, count: int, ahead: bool) -> DataFrame:
    """For each (keys, ``block``) copies of the ``count`` rows just ahead of it, or behind it, wherever those lie.

    ``block`` is that which gets the copies. The rows taken from a block are limited first, so the result is small.
    """
    row = F.struct(*order, *[c for c in rows.columns if c not in (*keys, *order, block)])
    toward = [F.col(o).desc() if ahead else F.col(o).asc() for o in order]
    edge = Window.partitionBy(*keys, block).orderBy(*toward)
    kept = rows.withColumn("_rn", F.row_number().over(edge)).filter(F.col("_rn") <= count)
    per_block = kept.groupBy(*keys, block).agg(F.sort_array(F.collect_list(row)).alias("_r"))
    per_block = dealt(per_block, keys) if grid_rows(rows) else per_block
    blocks = Window.partitionBy(*keys).orderBy(block)
    span = blocks.rowsBetween(-count, -1) if ahead else blocks.rowsBetween(1, count)
    near = per_block.select(*keys, block, F.flatten(F.collect_list("_r").over(span)).alias("_r"))
    if ahead:
        cut = F.slice("_r", F.greatest(F.size("_r") - F.lit(count - 1), F.lit(1)), F.lit(count))
    else:
        cut = F.slice("_r", 1, count)
    return near.select(*keys, block, F.explode(cut).alias("_row")).select(*keys, block, "_row.*")


def with_overlap(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    before: int = 0,
    after: int = 0,
    uses: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``_block`` and copies of the rows just outside each block.

    Every (keys, block) receives the last ``before`` rows ahead of it and the
    first ``after`` rows behind it, wherever those lie; copies carry
    ``_own = false``. The rows taken from a block are limited map-side (a group
    limit on ``row_number``), so the carried table is small. With ``uses`` the
    copies hold only these columns and null elsewhere, so that their scan reads
    no others.
    """
    keys, order = list(keys), list(order)
    base = df.withColumn("_block", block)
    names = [c for c in df.columns if c not in keys and (uses is None or c in uses or c in order)]
    types = {f.name: f.dataType for f in df.schema.fields}

    def carried_column(c: str) -> Column:
        return F.col(c) if c in keys or c in names else F.lit(None).cast(types[c]).alias(c)

    slim = base.select(*keys, "_block", *names)
    if grid_rows(df):  # its rows lie scattered, so a limit ahead of the shuffle would sort them for little
        slim = dealt(slim, [*keys, "_block"])
    parts = [base.withColumn("_own", F.lit(True))]
    for count, ahead in ((before, True), (after, False)):
        if count > 0:
            moved = carried(slim, keys, order, "_block", count, ahead)
            parts.append(moved.select(*[carried_column(c) for c in df.columns], "_block", F.lit(False).alias("_own")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return dealt(out, [*keys, "_block"])


def over_blocks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    exprs: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    uses: Sequence[str] | None = None,
) -> DataFrame:
    """Window expressions whose frame reaches at most ``before``/``after`` rows.

    ``exprs`` receives the ordered window of one block. The result equals the
    window over ``keys`` alone. ``uses`` names the columns the expressions read,
    if not all.
    """
    wide = with_overlap(df, keys, order, block, before, after, uses)
    window = Window.partitionBy(*keys, "_block").orderBy(*order)
    columns = exprs(window)
    kept = [c for c in df.columns if c not in columns]
    return (
        wide.select(*kept, "_own", *[c.alias(name) for name, c in columns.items()])
        .filter("_own")
        .drop("_own")
    )


def over_tiles(
    df: DataFrame,
    loc: Sequence[str],
    pos: str,
    ts: str,
    block: Column,
    strip: Column,
    along: Callable[[WindowSpec], dict[str, Column]],
    across: Callable[[WindowSpec], dict[str, Column]],
    before: int,
    uses: Sequence[str],
    source: DataFrame | None = None,
) -> DataFrame:
    """Windows along the time of a location and across the posts of an instant, from one dealing of the rows.

    A tile holds the rows of a block of instants and a strip of posts (``pos``, one of ``loc``). It gets copies of the last
    ``before`` rows ahead of it at each location, and of the next post on either side at each instant, so the results are
    those of ``over_blocks`` along ``loc`` and across (ts, the rest of ``loc``), but wide rows are shuffled once. Copies hold
    ``uses``, the columns that both kinds of expressions read; they all come from one shuffle of these. They may be read from
    ``source``, which has the same rows and is cheaper to make.
    """
    source = df if source is None else source
    near = [c for c in loc if c != pos]
    tile = [*near, "_strip", "_block"]
    base = df.withColumn("_strip", strip).withColumn("_block", block)
    slim = source.select(*loc, ts, strip.alias("_strip"), block.alias("_block"), *uses)
    if grid_rows(source):
        slim = dealt(slim, tile)
    own, ahead, beside = 0, 1, 2
    out = base.sortWithinPartitions(ts).withColumn("_kind", F.lit(own))  # rows of an instant are alike, so they compress
    copies = [carried(slim, [*loc, "_strip"], [ts], "_block", before, True).withColumn("_kind", F.lit(ahead))]
    for side in (True, False):
        copies.append(carried(slim, [ts, *near, "_block"], [pos], "_strip", 1, side).withColumn("_kind", F.lit(beside)))
    for part in copies:
        out = out.unionByName(part, allowMissingColumns=True)
    out = dealt(out, tile)
    columns = along(Window.partitionBy(*loc, "_strip", "_block", F.col("_kind") == beside).orderBy(ts))
    columns |= across(Window.partitionBy(ts, *near, "_strip", "_block", F.col("_kind") == ahead).orderBy(pos))
    kept = [c for c in df.columns if c not in columns]
    out = out.select(*kept, "_kind", *[c.alias(name) for name, c in columns.items()])
    return out.filter(F.col("_kind") == own).drop("_kind")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    sums: dict[str, Column],
    totals: bool = False,
) -> DataFrame:
    """Running sums over ``keys`` along ``order``, inclusive of the current row.

    ``totals`` adds ``tot_<name>`` over the whole group. Block sums are built
    with map-side combining and carried forward.
    """
    keys = list(keys)
    base = df.withColumn("_block", block)
    for name, expr in sums.items():
        base = base.withColumn(f"_m_{name}", expr.cast("long"))
    per_block = base.groupBy(*keys, "_block").agg(
        *[F.sum(f"_m_{n}").alias(f"_s_{n}") for n in sums]
    )
    blocks = Window.partitionBy(*keys)
    prior = blocks.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_s_{n}").over(prior), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *([F.sum(f"_s_{n}").over(blocks).alias(f"tot_{n}") for n in sums] if totals else []),
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = _join(base, offsets, [*keys, "_block"])
    return joined.select(
        *[c for c in df.columns if c not in sums],
        *[(F.sum(f"_m_{n}").over(inside) + F.col(f"_o_{n}")).alias(n) for n in sums],
        *([f"tot_{n}" for n in sums] if totals else []),
    )


def row_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, columns: dict[str, str], count: int
) -> DataFrame:
    """The rows that have one ``count`` rows earlier in their group, with its values: ``columns`` maps column to output.

    Rows are numbered once per group and meet by number, so work and memory do
    not grow with ``count``. Rows must be unique per (keys, order), keys not null.
    """
    numbered = running(df, keys, order, block, {"_at": F.lit(1)})
    earlier = numbered.select(*keys, (F.col("_at") + count).alias("_at"), *[F.col(c).alias(out) for c, out in columns.items()])
    return numbered.join(earlier, [*keys, "_at"]).select(*df.columns, *columns.values())


def scatter(key: str | Column, seed: int) -> Column:
    """Seeded hash of any key in [0, 2**32); other seeds give unrelated orders."""
    return F.pmod(F.xxhash64(col(key), F.lit(int(seed))), F.lit(1 << 32))


def mix(key: str | Column, seed: int) -> Column:
    """Seeded arithmetic rank of an integer key in [0, 2**32), the same in any engine.

    Seeds rotate one order; use ``scatter`` where several seeds must differ.
    """
    low32 = F.pmod(col(key).cast("long"), F.lit(1 << 32))
    high, low = F.floor(low32 / F.lit(65536)).cast("long"), F.pmod(low32, F.lit(65536))
    product = F.pmod(high * F.lit(2654435761), F.lit(65536)) * F.lit(65536) + low * F.lit(2654435761)
    return F.pmod(product + F.lit(int(seed) * 40503), F.lit(1 << 32))


def sample_rank(df: DataFrame, rank: str, key: str, n: Column, bins: int = 4096) -> DataFrame:
    """The ``n`` rows with the smallest (rank, key); ``key`` must be unique.

    Rank values are counted in equal bins over [0, 2**32); the bin where the
    count passes ``n`` is ranked alone to find the last admitted row, and the
    input is then filtered against that row. No global sort, no global limit.
    ``n`` is a literal or a scalar subquery.
    """
    width = F.lit(4294967296 // bins)
    binned = df.withColumn("_bin", F.floor(F.col(rank) / width).cast("long"))
    counts = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    marks = counts.withColumn("_cum", F.sum("_c").over(upto)).withColumn("_n", n)
    edge = marks.filter((F.col("_cum") - F.col("_c") < F.col("_n")) & (F.col("_n") <= F.col("_cum")))
    edge = edge.select("_bin", (F.col("_n") - F.col("_cum") + F.col("_c")).alias("_need"))
    at = Window.partitionBy("_bin").orderBy(rank, key)
    last = (
        _join(binned.select("_bin", rank, key), edge, ["_bin"])
        .withColumn("_rn", F.row_number().over(at))
        .filter(F.col("_rn") == F.col("_need"))
        .agg(F.max(F.struct(F.col(rank).alias("r"), F.col(key).alias("k"))).alias("m"))
    )
    total = counts.agg(F.sum("_c").alias("c"))
    here = F.struct(F.col(rank).alias("r"), F.col(key).alias("k"))
    return (
        df.withColumn("_last", last.scalar())
        .withColumn("_all", F.coalesce(total.scalar() <= n, F.lit(True)))
        .filter(F.col("_all") | (F.coalesce(here <= F.col("_last"), F.lit(False)) & (n > 0)))
        .drop("_last", "_all")
    )
