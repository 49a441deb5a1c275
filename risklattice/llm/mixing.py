"""Mixing sources to target weights: every block of a source has a release time and a deadline, and the earliest deadline goes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import code, fresh, let, row_id, running_total


def weights_by_size(docs: DataFrame, power: float = 0.5, resolution: int = 1000) -> DataFrame:
    """(source, weight): whole-number weights, in sum near ``resolution``, in proportion to each source's rows to ``power``.

    Power 1 keeps the sources' own shares, 0 makes all equal. No weight is below 1. A null source is a source.
    """
    sizes = docs.groupBy("source").agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("share"))
    total = F.sum("share").over(Window.partitionBy())  # one row for each source
    return sizes.select("source", F.greatest(F.lit(1), F.round(F.col("share") * resolution / total)).cast("int").alias("weight"))


def cycle(weights: DataFrame) -> DataFrame:
    """(source, weight, cycle, slots): a cycle has as many slots as all weights together, and slots[j] is that of block j.

    Block j of a source of weight w may run from floor(j * cycle / w) on and must run before ceil((j + 1) * cycle / w). In
    each slot the released block with the earliest deadline runs, the first source of equals. As the shares add up to one,
    every slot is used and every deadline kept, so at any time each source is less than one block away from its target. The
    next cycle repeats this one. The fold over the slots works on one row that holds the weights, not on data.
    """
    whole = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("source"), F.col("weight").cast("long").alias("weight")))).alias("w"))
    whole = whole.filter(F.size("w") > 0).withColumn("cycle", F.aggregate("w", F.lit(0).cast("long"), lambda acc, x: acc + x["weight"]))
    none = F.transform("w", lambda x: F.lit(0).cast("long"))

    def step(state: Column, t: Column) -> Column:
        ready = F.transform(F.col("w"), lambda x, i: let(F.get(state["done"], i), lambda j: F.when(
            (j < x["weight"]) & (j * F.col("cycle") < (t + 1) * x["weight"]),
            F.struct(F.ceil((j + 1) * F.col("cycle") / x["weight"]).alias("deadline"), i.alias("source")))))
        pick = F.array_min(ready)["source"]
        return let(pick, lambda p: F.struct(
            F.transform(state["done"], lambda n, i: n + F.when(i == p, 1).otherwise(0)).alias("done"),
            F.concat(state["picks"], F.array(p)).alias("picks")))

    start = F.struct(none.alias("done"), F.array().cast("array<int>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("cycle") - 1), start, step)["picks"]
    one = whole.withColumn("picks", picks).select("w", "cycle", "picks", F.posexplode("w").alias("i", "x"))
    slots = F.filter(F.transform("picks", lambda p, t: F.when(p == F.col("i"), t)), lambda t: t.isNotNull())
    return one.select(F.col("x.source").alias("source"), F.col("x.weight").alias("weight"), "cycle", slots.alias("slots"))


def mix(docs: DataFrame, weights: DataFrame, block: int = 64, seed: int = 11, buckets: int = 4096) -> DataFrame:
    """(doc_id, source, place, block, slot, release, deadline, position) for every row of ``docs`` (doc_id, source).

    Each source's rows are put in the order of a hash and cut into blocks. A block's slot is the schedule's; times are
    slots. A source without further blocks leaves its slots empty, and the others go on in their proportions, so every row
    has a position (gapless from 0). Sources that ``weights`` does not name come last, block by
    block, with null times. Rows are numbered inside ranges of the hash or of slots, and equal rows (doc_id and source) are one
    row with a count until then, so no source is sorted in one task. Null ids and sources are values. Other columns are not
    carried.
    """
    rows = docs.groupBy("doc_id", "source").agg(F.count("*").alias("copies"))
    hashed = rows.withColumn("order", code(F.lit(seed), F.col("doc_id"), F.col("source"))).withColumn("bucket", F.col("order") % buckets)
    placed = running_total(hashed, ["source"], "bucket", ["order", "doc_id"], "copies", "first")
    rows = placed.select("doc_id", "source", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("place"))
    plan = cycle(weights).withColumnRenamed("source", "source__")
    timed = rows.withColumn("block", F.floor(F.col("place") / block)).join(plan, F.col("source").eqNullSafe(F.col("source__")), "left")
    turn, k = F.floor(F.col("block") / F.col("weight")), (F.col("block") % F.col("weight")).cast("int")
    timed = timed.select(
        "doc_id", "source", "place", "block", (turn * F.col("cycle") + F.get("slots", k)).alias("slot"),
        F.floor(F.col("block") * F.col("cycle") / F.col("weight")).alias("release"),
        F.ceil((F.col("block") + 1) * F.col("cycle") / F.col("weight")).alias("deadline"))
    unnamed = F.lit(1 << 50) + F.col("block")
    ordered = timed.withColumn("time__", F.coalesce("slot", unnamed)).withColumn("range__", F.floor(F.col("time__") / 16)).withColumn("one__", F.lit(1))
    return running_total(ordered, [], "range__", ["time__", "source", "place"], "one__", "position").drop("time__", "range__", "one__")


def in_order(docs: DataFrame, weights: DataFrame, block: int = 64, seed: int = 11) -> DataFrame:
    """All rows of ``docs`` with their columns, in the order of the mix: files written from it follow each other in it.

    Rows that agree in all columns take one place after the other.
    """
    row, planned_row, position = (fresh(docs, name) for name in ("row__", "planned__", "position__"))
    tagged = docs.withColumn(row, row_id(docs))
    planned = mix(tagged.select(F.col(row).alias("doc_id"), "source"), weights, block, seed)
    first = planned.groupBy(F.col("doc_id").alias(planned_row)).agg(F.min("position").alias(position))
    placed = tagged.join(first, F.col(row) == F.col(planned_row))
    return placed.repartitionByRange(position).sortWithinPartitions(position).select(*docs.columns)
