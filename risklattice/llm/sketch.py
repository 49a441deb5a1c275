"""Document fingerprints: the k smallest shingle hashes, mergeable, with estimates of likeness, containment and count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from risklattice.session import materialise

from .shared import let

SIZE, SHINGLE = 128, 5
_SPAN = float(1 << 64)


def word_hashes(text: Column) -> Column:
    """A hash for each word of the lower-cased text; null and empty texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, width: int = SHINGLE) -> Column:
    """A hash for each run of ``width`` words. Fewer words make one shingle, none make none."""

    def of(h: Column) -> Column:
        last = F.size(h) - width
        runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        whole = F.array(F.xxhash64(F.array_join(h.cast("array<string>"), " ")))
        return F.when(last >= 0, runs).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<long>"))

    return let(hashes, of)


def sketch(hashes: Column, size: int = SIZE) -> Column:
    """The ``size`` smallest distinct hashes in ascending order (signed order, which is as random as any other)."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of the union of both texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def merge_parts(parts: DataFrame, by: str, sketch_column: str = "sketch", size: int = SIZE) -> DataFrame:
    """One sketch for each value of ``by`` from its parts' sketches.

    Parts are first merged under a salt, by rank: a hash outside the smallest ``size`` of its salted group is dropped before
    the groups meet, so a value with a third of all parts costs ``size`` rows per salt.
    """
    hashes = parts.select(by, F.explode_outer(sketch_column).alias("hash")).distinct().withColumn("salt", F.pmod("hash", F.lit(64)))
    first = hashes.withColumn("rank", F.row_number().over(Window.partitionBy(by, "salt").orderBy("hash"))).filter(F.col("rank") <= size)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("hash").asc_nulls_last()))).filter(F.col("rank") <= size)
    return best.groupBy(by).agg(F.sort_array(F.collect_list("hash")).alias(sketch_column))


def likeness(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity: of the smallest ``size`` hashes of the union, the share that both have.

    Two empty texts are alike (1); an empty one and another are not (0).
    """
    both = F.array_intersect(a, b)
    return let(merge(a, b, size), lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(both, union)) / F.size(union)))


def distinct_count(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below ``size``."""
    share = (F.element_at(a, -1).cast("double") + F.lit(_SPAN / 2)) / F.lit(_SPAN)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the first text's shingles that the second has; 1 for an empty first text."""
    union = distinct_count(merge(a, b, size), size)
    shared = likeness(a, b, size) * union
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, size)))


def spelled(a: Column) -> Column:
    """The sketch in hexadecimal digits, 16 for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows with one key agree in doc_id and text."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|"), F.coalesce(text, F.lit(""))))


def successors(docs: DataFrame) -> DataFrame:
    """(key, next_key, half) for each distinct (doc_id, text): whose text follows in order of doc_id, and half the length.

    Rows are sorted by ranges of doc_id and numbered inside each range; the first row of the next range, from a table with
    one row for each range, follows the last of a range. After the last comes the first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = docs.select("doc_id", F.floor(F.length(text) / 2).cast("int").alias("half"), row_key(F.col("doc_id"), text).alias("key"))
    ranged = ids.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key").withColumn("range", F.spark_partition_id())
    ids = materialise(ranged, "ids").distinct()
    inside = Window.partitionBy("range").orderBy("doc_id", "key")
    heads = ids.groupBy("range").agg(F.min_by("key", F.struct("doc_id", "key")).alias("head"))
    across = Window.orderBy("range")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.col("range").alias("at"), F.coalesce(F.lead("head").over(across), F.first("head").over(whole)).alias("following"))
    led = ids.withColumn("next", F.lead("key").over(inside)).join(heads, F.col("range") == F.col("at"))
    return led.select("key", F.coalesce("next", "following").alias("next_key"), "half")


def edited_fingerprints(docs: DataFrame, size: int = SIZE, shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of every row of ``docs`` (doc_id, text), of its text with the second half taken from the next document,
    and how alike they are.

    The next document follows in order of doc_id, null first; rows that agree in doc_id come in the order of their text's
    hash, and rows that agree in both are one document with one next, though each is returned. Null text is empty. Each
    document's text is shuffled once and its beginning once more, to the document before it. Other columns are not carried.
    """
    make = lambda text: sketch(shingle_hashes(word_hashes(text), shingle), size)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), row_key(F.col("doc_id"), text).alias("key"))
    asked = successors(docs).select(F.col("next_key").alias("key"), F.col("key").alias("asker"), "half")
    answers = keyed.join(asked, "key").select(
        "asker", F.col("doc_id").alias("next_id"), F.expr("substring(text, 1, half)").alias("tail"), make(F.col("text")).alias("next_sketch"))
    # next_id also keeps both uses of ``keyed`` alike, so that texts are shuffled once for both.
    answers = answers.groupBy("asker").agg(F.first(F.struct("next_id", "tail", "next_sketch")).alias("answer"))
    told = keyed.join(answers, F.col("key") == F.col("asker"))
    n = F.length("text")
    edited = told.select(
        "doc_id", n.cast("long").alias("n_chars"), "text", F.col("answer.next_id").alias("next_id"), F.col("answer.next_sketch").alias("next_sketch"),
        F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.col("answer.tail")).alias("edited"))
    marked = edited.withColumn("own", make(F.col("text"))).withColumn("changed", make(F.col("edited")))
    return marked.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), spelled(F.col("own")).alias("fingerprint"),
        spelled(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed"), size).alias("near_edited"),
        likeness(F.col("own"), F.col("next_sketch"), size).alias("near_next"),
        containment(F.col("own"), F.col("changed"), size).alias("contained_in_edited"), distinct_count(F.col("own"), size).alias("n_shingles"), "next_id")
