"""Jaccard join of documents by their word n-grams: a sparse product of the incidence matrix with itself, made in blocks.

Rows of the matrix are the distinct sets of shingles, columns the shingles. A product of all columns would be quadratic in
the common ones, and most of its pairs would share next to nothing. So the columns are taken in one order for all rows, rare
ones first, and sizes bound what the product can still reach:

* Two sets with a similarity of s share s of the larger one at least, so a pair that shares none of the first columns of its
  rows (all but s of them, and one more) can't reach that. Pairs are made from those columns only.
* Overlaps are added up over those first columns; sizes, sums and places rule out pairs that the rest can't lift to their bound.
* For the others overlaps are added up block by block of columns, until a pair is sure to stay below its bound or is done.

Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from risklattice.session import materialise

from .components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = 8  # of columns, by the upper bits of their hashes
_EDGES = (np.arange(1, BLOCKS, dtype=np.uint64) << np.uint64(61)).astype(np.uint64)


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of fewer words, of all of them; of none, nothing.

    A-Z are lower-cased, and words are what ASCII white space leaves.
    """
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    run = min(width, len(words))
    out = np.full(len(words) - run + 1, run, np.uint64)
    for i in range(run):
        out = (out ^ each[i : i + len(out)]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def least_overlap(n: int, percent: int) -> int:
    """How many elements a set of n shares with any that is ``percent`` similar."""
    return -(-percent * n // 100)


def common_shingles(texts: DataFrame, width: int, share: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, and counts, of the commonest shingles among one in ``share`` distinct texts: ``most`` at most.

    They only decide in which order columns are taken; any order gives the same links.
    """
    sample = texts.filter(F.pmod(F.xxhash64("text", F.lit(1)), F.lit(share)) == 0).dropDuplicates(["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found = [shingle_hashes(text.as_py(), width) for text in batch.column(0).slice(at, 512)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["key"])

    counts = sample.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "key").limit(most).toArrow()
    keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def incidence(docs: DataFrame, width: int, percent: int, share: int = 16, least: int = 4, most: int = 1 << 18, crowded: int = 64) -> DataFrame:
    """(doc_id, text_hash, n, set_id, columns, n_crowded) for each row of ``docs`` (doc_id, text): the start of its matrix row.

    ``columns`` are the first of its n columns, enough of them for every pair with a similarity of ``percent`` to share one;
    the last ``n_crowded`` of them are in very many rows. Texts without words have no set_id. The order of columns comes from
    a sample of one text in ``share``, of which the ``most`` commonest shingles are kept.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    hot, counts = common_shingles(docs.select(text.alias("text")), width, share, least, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, ids, columns, late = [], [], [], []
                for value in part.column(2):
                    found = shingle_hashes(value.as_py(), width)
                    n.append(len(found))
                    ids.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                    first = len(found) - least_overlap(len(found), percent) + 1 if len(found) else 0
                    count = np.zeros(len(found), np.int64)
                    if len(hot) and len(found):
                        place = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
                        count = np.where(hot[place] == found, counts[place], 0)
                    order = np.argsort(count, kind="stable")[:first]
                    columns.append(found[order].view(np.int64))
                    late.append(int((count[order] >= crowded).sum()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(ids, pa.int64()), pa.array(columns, pa.list_(pa.int64())), pa.array(late, pa.int32())],
                    names=["doc_id", "text_hash", "n", "set_id", "columns", "n_crowded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n int, set_id long, columns array<long>, n_crowded int")


def shared_columns(rows: DataFrame, percent: int = 80, part_rows: int = 1 << 14) -> DataFrame:
    """(key, part, set_id, n, pos): entries of ``rows`` (``incidence``) whose column a set of a similar enough size shares.

    In order of size, the next set on either side is the nearest in size, so these two tell. A column in very many rows is cut into parts by the upper bits of set_id, of some ``part_rows`` rows if all rows have it,
    so no task sorts it whole.
    """
    bits = max(0, (rows.count() // part_rows).bit_length())
    sets = rows.filter("set_id is not null").groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("n", "columns", "n_crowded")])
    entries = sets.select("set_id", "n", (F.size("columns") - F.col("n_crowded")).alias("plain"), F.posexplode("columns").alias("pos", "key"))
    crowded = F.col("pos") >= F.col("plain")
    part = F.when(crowded, F.shiftrightunsigned("set_id", 64 - bits)).otherwise(F.lit(0)) if bits else F.lit(0)
    inside = Window.partitionBy("key", "part").orderBy("n", "set_id")
    smaller, larger = F.lag("n").over(inside), F.lead("n").over(inside)
    shared = crowded | F.coalesce(100 * smaller.cast("long") >= percent * F.col("n"), F.lit(False))
    shared |= F.coalesce(100 * F.col("n").cast("long") >= percent * larger, F.lit(False))
    return entries.withColumn("part", part).select("key", "part", "set_id", "n", "pos", shared.alias("shared")).filter("shared").drop("shared")


def _summed(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, c, needed, rest) of ``pairs`` (a, n, b, m), a row for each of the first columns that two sets share.

    c is the overlap in those columns. What two sets share beyond lies in the rest of the one whose first columns end
    earlier, and they are similar only if the whole overlap reaches percent * (n + m) / (100 + percent).
    """
    n, m = F.col("n"), F.col("m")
    near = pairs.filter(100 * F.least(n, m) >= percent * F.greatest(n, m)).groupBy("a", "b", "n", "m").agg(F.count("*").alias("c"))
    needed = F.ceil(percent * (n + m) / (100 + percent) - 1e-9).alias("needed")
    rest = F.ceil(percent * F.greatest(n, m) / 100 - 1e-9) - 1
    return near.select("a", "b", "c", needed, rest.alias("rest"))


def apart(shared: DataFrame, reached: DataFrame | None) -> DataFrame:
    """``shared`` with the component of each set by ``reached`` (node, component), where a column's sets are in several."""
    if reached is None:
        return shared.withColumn("comp", F.col("set_id"))
    known = reached.select(F.col("node").alias("node__"), "component")
    tagged = shared.drop("comp").join(known, F.col("set_id") == F.col("node__"), "left")
    tagged = materialise(tagged.withColumn("comp", F.coalesce("component", "set_id")).drop("node__", "component"), "tagged")
    several = tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select(F.col("key").alias("key__"))
    return materialise(tagged.join(several, F.col("key") == F.col("key__")).drop("key__"), "apart")


def neighbour_pairs(met: DataFrame, percent: int, salt: int = 0, most: int = 3) -> DataFrame:
    """Pairs (a, b): for each set the ``most`` sets of other components with which it shares most of ``met``'s columns.

    Only sets that are next to each other in an order (one for all columns, by ``salt``) are looked at. This is no search: it
    joins large groups by few links, so that little remains for ``remaining_pairs``. As neighbours are not next to each other
    in all their columns, a quarter of the sum that a link needs is enough.
    """
    order = Window.partitionBy("key", "part").orderBy(F.xxhash64("set_id", F.lit(salt)), "set_id")
    following = F.array_compact(F.array(*[F.lead(F.struct("set_id", "n", "comp"), i).over(order) for i in range(1, most + 2)]))
    pairs = met.select(F.col("set_id").alias("a"), "n", "comp", following.alias("others")).select("a", "n", "comp", F.explode("others").alias("other"))
    pairs = pairs.filter("comp <> other.comp").select("a", "n", F.col("other.set_id").alias("b"), F.col("other.n").alias("m"))
    best = Window.partitionBy("a").orderBy(F.desc("c"), "b")
    found = _summed(pairs, percent).filter(4 * F.col("c") + F.col("rest") >= F.col("needed"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).select("a", "b")


def remaining_pairs(met: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of ``met`` that may have a similarity of ``percent`` and are in different components.

    All such pairs meet under the first column that they share; what their rows have before it they don't share, so its
    places, and the sizes, rule out pairs. Nothing is capped.
    """
    one, two = (met.select(*[F.col(c).alias(f"{c}{i}") for c in ("key", "set_id", "n", "pos", "comp")]) for i in (1, 2))
    n, m = F.col("n1"), F.col("n2")
    enough = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    # overlap o of sizes n and m is similar enough from o * (100 + percent) >= percent * (n + m) on
    enough &= F.least(n - F.col("pos1"), m - F.col("pos2")) * (100 + percent) >= percent * (n + m)
    both = one.join(two, (F.col("key1") == F.col("key2")) & (F.col("set_id1") < F.col("set_id2")) & (F.col("comp1") != F.col("comp2")) & enough)
    return both.select(F.col("set_id1").alias("a"), F.col("set_id2").alias("b")).distinct()


def delegates(met: DataFrame, salt: int = 0, most: int = 32) -> DataFrame:
    """Rows of ``met``: of each component, under each column, the ``most`` sets that are first in an order (one for all columns).

    A set that neighbours have not joined to a large group is near some share of its sets, so a few of them join most such
    sets, and ``remaining_pairs`` need not pair each of them with the whole group.
    """
    order = Window.partitionBy("key", "comp").orderBy(F.xxhash64("set_id", F.lit(salt)), "set_id")
    return met.withColumn("rank__", F.row_number().over(order)).filter(F.col("rank__") <= most).drop("rank__")


def ends(pairs: DataFrame) -> DataFrame:
    """(set_id) of ``pairs`` (a, b), each once."""
    return pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()


def likely(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``rows`` whose ``key``, a 64-bit hash, is in ``wanted`` (one column of hashes), and a few others.

    It spares the shuffle before a join what the join would drop. Hashes are marked in a table of at most 2^27 bits (16 MB)
    that all tasks get; beyond some 10^7 hashes more rows pass. A key passes once a task, so copies don't pile up in the join.
    """
    block = 1 << 16
    size = min(1 << 27, max(block, 1 << (16 * wanted.count()).bit_length()))
    slot = F.pmod(F.col(wanted.columns[0]), F.lit(size))
    slots = wanted.select(F.floor(slot / block).cast("int").alias("block"), (slot % block).cast("int").alias("bit")).distinct()

    def pack(part: pa.Table) -> pa.Table:
        marks = np.zeros(block, bool)
        marks[part["bit"].to_numpy()] = True
        return pa.table({"block": part["block"][:1], "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    bits = np.zeros(size // 8, np.uint8)
    for row in slots.groupBy("block").applyInArrow(pack, "block int, bits binary").toArrow().to_pylist():
        bits[row["block"] * (block // 8) : (row["block"] + 1) * (block // 8)] = np.frombuffer(row["bits"], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            at = keys.astype(np.int64) & (size - 1)
            marked = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1)
            fresh = []
            for i, k in zip(marked.tolist(), keys[marked].tolist()):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            yield batch.take(pa.array(fresh, pa.int64()))

    return rows.filter(F.col(key).isNotNull()).mapInArrow(run, rows.schema)


def within_reach(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose first columns, in ``rows`` (``incidence``), share enough for the rest to make up.

    What two sets share beyond their first columns lies in the rest of the one whose first columns end earlier.
    """
    kept = likely(rows.select("set_id", "n", "columns"), "set_id", ends(pairs))
    sets = materialise(kept.groupBy("set_id").agg(F.first("n").alias("n"), F.first("columns").alias("columns")), "columns")
    one, two = (sets.select(*[F.col(c).alias(f"{c}_{x}") for c in ("set_id", "n", "columns")]) for x in "ab")
    both = pairs.join(two, F.col("b") == F.col("set_id_b")).join(one, F.col("a") == F.col("set_id_a"))
    n, m = F.col("n_a"), F.col("n_b")
    needed = F.ceil(percent * (n + m) / (100 + percent) - 1e-9)
    rest = F.ceil(percent * F.greatest(n, m) / 100 - 1e-9) - 1
    return both.filter(F.size(F.array_intersect("columns_a", "columns_b")) + rest >= needed).select("a", "b")


def overlap_reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are ``percent`` similar. Blocks of columns are added up while the rest can still make it."""
    needed = -(-percent * (len(x) + len(y)) // (100 + percent))
    i, j = np.concatenate(([0], np.searchsorted(x, _EDGES), [len(x)])), np.concatenate(([0], np.searchsorted(y, _EDGES), [len(y)]))
    could = np.minimum(np.diff(i), np.diff(j)).tolist()
    rest, total = sum(could), 0
    for b in range(BLOCKS):
        if total + rest < needed:
            return False
        if total >= needed:
            return True
        rest -= could[b]
        if could[b]:
            left, right = x[i[b] : i[b + 1]], y[j[b] : j[b + 1]]
            place = np.minimum(np.searchsorted(right, left), len(right) - 1)
            total += int((right[place] == left).sum())
    return total >= needed


def similar_pairs(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``texts`` (set_id, text) are ``percent`` similar; overlaps are added up in blocks."""
    left = texts.select(F.col("set_id").alias("a__"), F.col("text").alias("ta"))
    right = texts.select(F.col("set_id").alias("b__"), F.col("text").alias("tb"))
    # Rows come out in order of a, so its row of the matrix is made once for all its pairs.
    both = pairs.join(right, F.col("b") == F.col("b__")).join(left, F.col("a") == F.col("a__")).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, np.zeros(0, np.uint64)
        for batch in batches:
            near = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, x = a, shingle_hashes(ta.as_py(), width)
                near.append(overlap_reaches(x, shingle_hashes(tb.as_py(), width), percent))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def texts_of(docs: DataFrame, rows: DataFrame, shared: DataFrame) -> DataFrame:
    """(set_id, text) for each set of ``shared``: one of the texts of ``docs`` that have it."""
    wanted = shared.select(F.col("set_id").alias("want__")).distinct()
    chosen = rows.groupBy("set_id").agg(F.min("text_hash").alias("hash__")).join(wanted, F.col("set_id") == F.col("want__"), "left_semi")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    found = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).join(chosen, F.col("text_hash") == F.col("hash__"))
    return found.dropDuplicates(["set_id"]).select("set_id", "text")


def texts_at(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, text) for each set of ``wanted`` (set_id): one of the texts of ``docs`` that have it. Few other texts are shuffled."""
    chosen = rows.filter("set_id is not null").groupBy("set_id").agg(F.min("text_hash").alias("hash__"))
    chosen = materialise(chosen.join(wanted.select(F.col("set_id").alias("want__")), F.col("set_id") == F.col("want__"), "left_semi"), "chosen")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    found = likely(docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")), "text_hash", chosen.select("hash__"))
    return found.join(chosen, F.col("text_hash") == F.col("hash__")).dropDuplicates(["set_id"]).select("set_id", "text")


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, rounds: int = 3, **order) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) for each row of ``docs`` (doc_id, text); other columns are not carried.

    Rows are linked if their sets of ``width``-word shingles have a Jaccard similarity of ``percent`` hundredths or more;
    component_id is the smallest doc_id that links reach, the row's own included. Equal sets are one node from the start, so
    copies cost nothing; set_id names the set. Null, empty and blank texts have no set and are linked with nothing: their
    component_id is their doc_id. Null ids are passed over for component_id (null only if the whole component has null ids).
    Repeated rows are kept, an empty table gives an empty one. ``rounds``, and ``order``, which goes to ``incidence``, change no result.
    """
    rows = materialise(incidence(docs, width, percent, **order), "incidence")
    shared = materialise(shared_columns(rows, percent), "shared")
    return with_components(rows, joined_sets(rows, shared, lambda sets: texts_at(docs, rows, sets), width, percent, rounds=rounds))


def joined_sets(rows: DataFrame, shared: DataFrame, texts: DataFrame | Callable[[DataFrame], DataFrame], width: int, percent: int, links: DataFrame | None = None, rounds: int = 3) -> DataFrame:
    """(node, component) of the sets of ``rows`` that links join, from their shared columns and texts, and ``links`` known already.

    ``texts`` is (set_id, text), or gives it for wanted sets (set_id). A few rounds of neighbours join most of what is linked,
    and the last of several rounds a few sets of each component; then all pairs that are still apart are looked at. Rounds of
    neighbours end early once fewer than a tenth of their pairs are links. A pair is looked at once.
    """
    reached = components(links) if links is not None else None
    tried, turn, few = None, 0, max(1, rounds - 1)  # rounds of neighbours, if any
    while turn <= rounds:
        shared, near_by = apart(shared, reached), turn < min(few, rounds)
        met = delegates(shared) if turn < rounds else shared
        pairs = neighbour_pairs(shared, percent, turn) if near_by else remaining_pairs(met, percent)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        near = pairs if near_by else materialise(within_reach(pairs, rows, percent), "within_reach")
        found = materialise(similar_pairs(near, materialise(texts(ends(near)), "texts") if callable(texts) else texts, width, percent), "found")
        turn = few if near_by and 10 * found.count() < pairs.count() else turn + 1
        if reached is not None:
            found = found.union(reached.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        reached = components(found)
    return reached


def with_components(rows: DataFrame, reached: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) of ``rows`` (doc_id, n, set_id), by ``reached`` (node, component) of sets."""
    least = rows.filter("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least_id"))
    known = reached.select(F.col("node").alias("node__"), "component")
    member = least.join(known, F.col("set_id") == F.col("node__"), "left").withColumn("component", F.coalesce("component", "set_id"))
    named = member.groupBy("component").agg(F.min("least_id").alias("component_id")).withColumnRenamed("component", "comp__")
    placed = member.join(named, F.col("component") == F.col("comp__")).select(F.col("set_id").alias("set__"), "component_id")
    own = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return rows.join(placed, F.col("set_id") == F.col("set__"), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set_id", own)
