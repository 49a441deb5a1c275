"""Periodic runs of words: squares that branch in an enhanced suffix array, rotated and merged into runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

BLOCK = 1 << 17  # words whose suffixes are sorted together; a longer text is a block of its own

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def refined_ranks(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their first 1, 2, 4, … codes; the last list is the inverse suffix array.

    Equal stretches share a rank, that of their bucket's first place. Only buckets with several places are sorted again. The
    last code must be unique, and so must be the code after any two equal stretches that end before others begin.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(heads, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, sizes)
    levels, step = [rank], 1
    live = order[np.repeat(sizes > 1, sizes)]
    while len(live):
        # live holds whole buckets, so a place's new rank is its bucket's, and how many of the bucket are smaller
        key = rank[live] * n + rank[live + step]
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        here = rank[live]
        index = np.arange(len(live))
        begin = np.maximum.accumulate(np.where(np.concatenate(([True], here[1:] != here[:-1])), index, 0))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.maximum.accumulate(np.where(new, index, 0))
        rank = rank.copy()
        rank[live] = here + first - begin
        levels.append(rank)
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(live)))
        live = live[np.repeat(sizes > 1, sizes)]
        step *= 2
    return levels


def common_lengths(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many codes agree from each pair of different places on."""
    out = np.zeros(len(left), np.int64)
    for m in range(len(levels) - 1, -1, -1):
        rank = levels[m]
        out += (rank[left + out] == rank[right + out]).astype(np.int64) << m
    return out


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(boundary, first, last) for each boundary with a common prefix: the places of the widest interval that shares it.

    Minima over 1, 2, 4, … neighbours let each boundary step over all that share as much.
    """
    at = np.flatnonzero(lcp > 0)
    depth = lcp[at]
    least, n = [lcp], len(lcp)
    while True:
        step, last = 1 << (len(least) - 1), least[-1]
        if len(last) <= step or not last.any():
            break
        least.append(np.minimum(last[:-step], last[step:]))
    first, after = at.copy(), at + 1
    for k in range(len(least) - 1, -1, -1):
        step, table = 1 << k, least[k]
        back = first - step
        first = np.where((back >= 0) & (table[np.maximum(back, 0)] >= depth), back, first)
        fits = after + step <= n
        after = np.where(fits & (table[np.where(fits, after, 0)] >= depth), after + step, after)
    return at, first - 1, after - 1


def branching_squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of each square whose two halves are followed by different codes.

    The suffixes of an LCP interval of depth d start with the same d codes, those of its children with more. A square of
    period d that branches has its halves in two children. So each suffix outside the largest child asks the inverse suffix
    array whether the suffix d places before or after it lies in the interval as well: each place is asked for at most as
    often as the logarithm of the text's length.
    """
    inverse = levels[-1]
    n = len(inverse)
    suffixes = np.empty(n, np.int64)
    suffixes[inverse] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = common_lengths(levels, suffixes[:-1], suffixes[1:])
    at, first, last = lcp_intervals(lcp)
    if not len(at):
        return at, at
    order = np.lexsort((at, last, first))  # the boundaries of an interval, which part its children
    at, first, last = at[order], first[order], last[order]
    new = np.concatenate(([True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])))
    heads = np.flatnonzero(new)
    # children: one before each boundary, and one after an interval's last boundary
    ends = np.append(heads[1:], len(at)) - 1
    left = np.concatenate((np.where(new, first, np.concatenate(([0], at[:-1]))), at[ends]))
    right = np.concatenate((at - 1, last[ends]))
    group = np.concatenate((np.cumsum(new) - 1, np.arange(len(heads))))
    size = right - left + 1
    order = np.lexsort((-size, group))  # the largest child of each interval comes first, and is passed over
    group = group[order]
    rest = order[np.concatenate(([False], group[1:] == group[:-1]))]
    group = np.concatenate((np.cumsum(new) - 1, np.arange(len(heads))))[rest]
    begin, size = left[rest], size[rest]
    asked = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    low, high, depth = (np.repeat(x[heads][group], size) for x in (first, last, lcp[at]))
    place = suffixes[asked]
    found = []
    for start, other in ((place, place + depth), (place - depth, place - depth)):
        inside = (other >= 0) & (other < n)
        there = inverse[np.where(inside, other, 0)]
        inside &= (there >= low) & (there <= high)
        start, period = start[inside], depth[inside]
        codes = levels[0]
        branches = codes[start + period] != codes[start + 2 * period]
        found.append((start[branches], period[branches]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def runs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all stretches with a smallest period that they hold twice or more and that can't grow.

    A branching square ends where its run ends. Turned to the left as long as it stays a square it reaches the run's start.
    Squares of a multiple of the period end in the same run, of which the smallest period stays.
    """
    if not len(codes):
        none = np.zeros(0, np.int64)
        return none, none, none
    levels = refined_ranks(codes)
    start, period = branching_squares(levels)
    end = start + 2 * period
    for m in range(len(levels) - 1, -1, -1):
        rank, back = levels[m], start - (1 << m)
        turns = (back >= 0) & (rank[np.maximum(back, 0)] == rank[np.maximum(back, 0) + period])
        start = np.where(turns, back, start)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    least = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))[: len(start)]
    return start[least], end[least], period[least]


def _block(texts: list[list[bytes]], least_length: int, least_exponent: int) -> tuple[list[list[dict]], list[bytes]]:
    """Runs and collapsed text of each list of words. No suffix is compared beyond its text."""
    known: dict[bytes, int] = {}
    for words in texts:
        for word in set(words):
            known.setdefault(word, len(known) + 1)
    sizes = np.array([len(w) + 1 for w in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    codes = np.zeros(int(sizes.sum()), np.int64)  # 0 ends a text
    for begin, words in zip(begins.tolist(), texts):
        codes[begin : begin + len(words)] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    codes += np.repeat(np.arange(len(texts)), sizes) * (len(known) + 1)
    start, end, period = runs_of(codes)
    length = end - start
    kept = length >= np.maximum(least_length, least_exponent * period)
    start, end, period, length = start[kept], end[kept], period[kept], length[kept]
    owner = np.searchsorted(begins, start, side="right") - 1
    edges = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, end, -1)
    stays = np.cumsum(edges[:-1]) == 0
    runs: list[list[dict]] = [[] for _ in texts]
    for text, s, n, p in zip(owner.tolist(), (start - begins[owner]).tolist(), length.tolist(), period.tolist()):
        runs[text].append({"start": s, "length": n, "period": p})
    collapsed = []
    for found, begin, words in zip(runs, begins.tolist(), texts):
        if found:
            words = [words[i] for i in np.flatnonzero(stays[begin : begin + len(words)]).tolist()]
        collapsed.append(b" ".join(words))
    return runs, collapsed


def periodic_runs(docs: DataFrame, least_length: int = 6, least_exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs`` (doc_id, text); other columns are not carried. No shuffle.

    Words are what ASCII white space leaves, numbered from 0. ``runs`` are all stretches (start, length, period) of words
    that are equal to those their smallest period on, at least ``least_length`` words and ``least_exponent`` periods long, and
    can't be extended; by start, then period. ``collapsed`` keeps the words that are not in a run after its first period,
    joined by single blanks. Null and empty texts have no words and no run; repeated rows are kept; an empty table gives an
    empty one. A text is sorted in one task, with some 400 bytes a word at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, begin = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                value = text.as_py()
                texts.append((value or "").encode("utf-8", "surrogatepass").split())
                total += len(texts[-1]) + 1
                if total >= BLOCK or i == batch.num_rows - 1:
                    runs, collapsed = _block(texts, least_length, least_exponent)
                    columns = [batch.column(0).slice(begin, len(texts)), pa.array([len(w) for w in texts], pa.int64()), pa.array(runs, _RUNS)]
                    columns.append(pa.array(collapsed, pa.binary()).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])
                    texts, total, begin = [], 0, i + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def with_repeats(text: Column, doc_id: Column) -> Column:
    """The text, or for one id in ten by its CRC-32 its words with all from some place on turned into repeats of the first few.

    h is the id's CRC-32 and g = floor(h / 10). From a = g mod n on, words repeat with p = 1 + floor((n - a) / (3 + g mod 8)).
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")

    def edited(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise("")

    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, edited)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """A row of numbers and checksums for each row of ``periodic_runs``."""
    higher = lambda x, best: x["length"] * best["period"] > best["length"] * x["period"]  # noqa: E731  exact, and the first of equals stays
    best = F.aggregate("runs", F.get("runs", 0), lambda best, x: F.when(higher(x, best), x).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    every = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(every.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
