"""Benchmark decontamination: spaced seeds of benchmark items are looked up in the documents, and overlaps around hits checked.

A seed is a hash of the tokens that a fixed mask selects; the tokens between them may differ. The two default masks leave no
window of 13 tokens with up to two substitutions without a common seed (``tests/llm``). An item shorter than that is cut into
one piece more than it may have substitutions, of which one is whole: the pieces are its seeds.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, let, row_id

MASKS = ("1111011", "111010011")
WINDOW, SHARE = 13, 0.8


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(h: Column, mask: str, number: int) -> Column:
    """(pos, seed) of each place where the whole mask fits."""
    picked = [i for i, c in enumerate(mask) if c == "1"]
    last = F.size(h) - len(mask)
    found = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("pos"), F.xxhash64(F.lit(number), *[F.get(h, i + p if p else i) for p in picked]).alias("seed")))
    return F.when(last >= 0, found).otherwise(F.array().cast("array<struct<pos:int,seed:bigint>>"))


def _all_seeds(h: Column, masks: Sequence[str]) -> Column:
    return F.concat(*[_seeds(h, m, i) for i, m in enumerate(masks)])


def pieces(n: int, share: float) -> list[tuple[int, int]]:
    """(start, length) of the parts of an item of n tokens, one of which a passage with ``share`` of its tokens has whole."""
    parts = n - ceil(share * n - 1e-9) + 1
    ends = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def _best(doc: Column, item: Column, shift: Column, window: int) -> Column:
    """(matched, start, length) of the window of the item with the most tokens that agree where the document is laid under it.

    ``shift`` is the place in the document of the item's first token, which may lie before the document's start.
    """
    agree = F.transform(item, lambda t, k: F.when(shift + k >= 0, F.coalesce(F.get(doc, F.greatest(shift + k, F.lit(0))) == t, F.lit(False))).otherwise(False).cast("int"))
    size = F.least(F.size(item), F.lit(window))

    def of(a: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.size(item) - size), lambda s: F.struct(
            F.aggregate(F.slice(a, s + 1, size), F.lit(0), lambda x, y: x + y).alias("matched"), (-s).alias("start"), size.alias("length")))
        return F.array_max(sums)

    return let(agree, of)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, masks: Sequence[str] = MASKS, window: int = WINDOW, share: float = SHARE, broadcast_seeds: int = 200_000,
) -> DataFrame:
    """(doc_id, item_id, n_matched, n_window, item_start, doc_start) for each document and item that share a passage.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; other columns are not carried. A passage is a window of
    ``window`` of the item's tokens, or all of a shorter item, of which ``share`` stand in the document in the same places;
    the best one is reported, the first of equals. Rows that agree in doc_id, or items in item_id, are reported as one; null
    ids are ids. Texts without tokens match nothing. Items shorter than ``window`` are looked up by their ``pieces``.

    Up to ``broadcast_seeds`` seeds of the benchmark, which are counted first, go to every task and documents stay where they
    are. Beyond, seeds of both sides meet in a shuffle, and documents meet the few places found in them once more.
    """
    items = benchmark.select("item_id", tokens(F.col("text")).alias("item")).filter(F.size("item") > 0)
    short = sorted(r[0] for r in items.filter(F.size("item") < window).select(F.size("item")).distinct().collect())  # fewer than ``window``
    lengths = sorted({length for n in short for _, length in pieces(n, share)})
    every = [*masks, *["1" * n for n in lengths]]
    seeds = _all_seeds(F.col("item"), masks)
    for n in short:
        own = [F.struct(F.lit(start).alias("pos"), F.xxhash64(F.lit(len(masks) + lengths.index(length)), *[F.get("item", start + k) for k in range(length)]).alias("seed"))
               for start, length in pieces(n, share)]
        seeds = F.when(F.size("item") == n, F.array(*own)).otherwise(seeds)
    wanted = items.select("item_id", F.explode(seeds).alias("s"))
    wanted = wanted.select("item_id", F.col("s.pos").alias("item_pos"), F.col("s.seed").alias("item_seed")).distinct()
    hashed = docs.select("doc_id", "text", tokens(F.col("text")).alias("h"))
    if wanted.count() <= broadcast_seeds:
        at = hashed.select("doc_id", "h", F.explode(_all_seeds(F.col("h"), every)).alias("s"))
        hits = at.join(F.broadcast(wanted), F.col("s.seed") == F.col("item_seed")).withColumn("shift", F.col("s.pos") - F.col("item_pos"))
        sizes = items.select(F.col("item_id").alias("id__"), F.size("item").alias("n__")).groupBy("id__").agg(F.max("n__").alias("n__"))
        hits = hits.join(F.broadcast(sizes), F.col("item_id").eqNullSafe(F.col("id__")))
        # Only the stretch under the item goes on.
        laid = hits.select("doc_id", "item_id", "shift", F.least(F.col("shift"), F.lit(0)).alias("lead"), F.slice(
            "h", F.greatest(F.col("shift"), F.lit(0)) + 1, F.col("n__")).alias("h")).distinct()
    else:
        keyed = hashed.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
        at = keyed.select("doc_id", "key", F.explode(_all_seeds(F.col("h"), every)).alias("s"))
        hits = at.join(wanted, F.col("s.seed") == F.col("item_seed")).select(
            F.col("doc_id").alias("d__"), F.col("key").alias("k__"), "item_id", (F.col("s.pos") - F.col("item_pos")).alias("shift")).distinct()
        laid = hits.join(keyed, F.col("d__").eqNullSafe(F.col("doc_id")) & (F.col("k__") == F.col("key"))).select(
            "doc_id", "item_id", "shift", F.col("shift").alias("lead"), "h")
    named = items.select(F.col("item_id").alias("id__"), "item")
    checked = laid.join(named, F.col("item_id").eqNullSafe(F.col("id__"))).withColumn("best", _best(F.col("h"), F.col("item"), F.col("lead"), window))
    enough = F.col("best.matched") >= F.ceil(F.lit(share) * F.col("best.length") - F.lit(1e-9))
    found = checked.filter(enough).groupBy("doc_id", "item_id").agg(F.max(F.struct(
        F.col("best.matched").alias("matched"), F.col("best.start").alias("start"), (-F.col("shift")).alias("place"), F.col("best.length").alias("length"))).alias("top"))
    return found.select(
        "doc_id", "item_id", F.col("top.matched").alias("n_matched"), F.col("top.length").alias("n_window"),
        (-F.col("top.start")).alias("item_start"), (-F.col("top.place") - F.col("top.start")).alias("doc_start"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` that share no passage with any item, with all their columns."""
    row, hit = fresh(docs, "row__"), fresh(docs, "found__")
    tagged = docs.withColumn(row, row_id(docs))
    found = overlaps(tagged.select(F.col(row).alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias(hit)).distinct()
    return tagged.join(found, F.col(row) == F.col(hit), "left_anti").select(*docs.columns)
