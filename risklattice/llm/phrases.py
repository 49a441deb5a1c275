"""Phrase collocations, grown best first: rare first words promise the highest scores and are extended before others.

A phrase with a occurrences is cut in two parts with l and r occurrences, and scores 1000 * a * n / (l * r) at its lowest cut.
The cut after its first word gives at most 1000 * n / f(first word), since the rest is as frequent as the phrase at least.
So the count of a prefix bounds all that grows from it. Words are taken by ascending count, in waves, until no language has a
word left whose bound reaches the last score that counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from risklattice.session import materialise

_BREAK = b"\xff"  # is in no text
_FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLOCK = 1 << 16  # bits
_GRAMS = "lang string, phrase string, words int, n long, before long, after long"


def pieces(text: bytes | None) -> list[bytes]:
    """Lower-cased words, with a break after each piece."""
    return ((text or b"").translate(_FOLD) + _BREAK).replace(_BREAK, b" \xff ").split()


class Filter:
    """A set of hashes in at most 2^27 bits: all of its members pass, and a few others, more as it fills."""

    def __init__(self, phrases: DataFrame):
        """Of ``phrases`` (lang, phrase)."""
        self.size = min(1 << 27, max(_BLOCK, 1 << (16 * phrases.count()).bit_length()))
        slot = F.pmod(F.xxhash64("lang", "phrase"), F.lit(self.size))
        slots = phrases.select(F.floor(slot / _BLOCK).cast("int").alias("block"), (slot % _BLOCK).cast("int").alias("bit")).distinct()

        def pack(block: pa.Table) -> pa.Table:
            bits = np.zeros(_BLOCK, bool)
            bits[block["bit"].to_numpy()] = True
            return pa.table({"block": block["block"][:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        self.bits = np.zeros(self.size // 8, np.uint8)
        for row in slots.groupBy("block").applyInArrow(pack, "block int, bits binary").toArrow().to_pylist():
            self.bits[row["block"] * (_BLOCK // 8) : (row["block"] + 1) * (_BLOCK // 8)] = np.frombuffer(row["bits"], np.uint8)

    def has(self, lang: str, phrases: Sequence[bytes]) -> np.ndarray:
        seed = xxhash.xxh64_intdigest(lang.encode(), 42)
        slot = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in phrases), np.uint64, len(phrases)) & np.uint64(self.size - 1)
        return (self.bits[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1 == 1


def _by_language(batch: pa.RecordBatch) -> dict[str, list[list[bytes]]]:
    out: dict[str, list[list[bytes]]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        out.setdefault(lang, []).append(pieces(text.as_py()))
    return out


class _Codes(dict):
    """Numbers words as they come; 0 is the break. Keeps what the filters say of each."""

    def __init__(self, lang: str, first: Filter, frequent: Filter):
        super().__init__({_BREAK: 0})
        self.names, self.filters, self.lang = [_BREAK], (first, frequent), lang
        self.starts, self.follows, self.marks = np.zeros(1, bool), np.zeros(1, bool), np.zeros(1, np.int64)

    def __missing__(self, word: bytes) -> int:
        self.names.append(word)
        self[word] = number = len(self)
        return number

    def encode(self, texts: list[list[bytes]]) -> np.ndarray:
        code = np.concatenate([np.fromiter(map(self.__getitem__, words), np.int64, len(words)) for words in texts])
        new = self.names[len(self.starts) :]
        first, frequent = (f.has(self.lang, new) for f in self.filters)
        self.starts, self.follows = np.concatenate((self.starts, first)), np.concatenate((self.follows, frequent))
        self.marks = np.concatenate((self.marks, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new)).view(np.int64)))
        return code


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, n) for each word of ``docs`` (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                for lang, texts in _by_language(batch.slice(at, 4096)).items():
                    counts: Counter = Counter()
                    for words in texts:
                        counts.update(words)
                    del counts[_BREAK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())],
                        names=["lang", "phrase", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def count_phrases(docs: DataFrame, first: Filter, frequent: Filter, known: Filter | None, known_up_to: int, lengths: range) -> DataFrame:
    """(lang, phrase, words, n, before, after) of phrases of so many words, n times in ``docs`` (lang, text), none across pieces.

    First words are in ``first``, all words in ``frequent``, and each start of two to ``known_up_to`` words in ``known``.
    ``before`` and ``after`` are the hash of the word that stands before, or after, all occurrences, and else 0.
    """

    def grams(codes: _Codes, texts: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        code = np.concatenate((codes.encode(texts), np.zeros(lengths[-1] + 1, np.int64)))
        lang, names, size, follows, marks = codes.lang, codes.names, len(codes.names), codes.follows, codes.marks
        at = np.flatnonzero(codes.starts[code] & follows[code])
        group = code[at]
        spelled = names
        for words in range(2, lengths[-1] + 1):
            more = follows[code[at + words - 1]]
            at, group = at[more], group[more]
            if not len(at):
                return
            last = code[at + words - 1]
            keys, group, n = np.unique(group * size + last, return_inverse=True, return_counts=True)
            spelled = [spelled[p] + b" " + names[w] for p, w in zip((keys // size).tolist(), (keys % size).tolist())]
            if known is not None and words <= known_up_to:
                kept = known.has(lang, spelled)
                at, group = at[kept[group]], (np.cumsum(kept) - 1)[group[kept[group]]]
                spelled, n = [s for s, k in zip(spelled, kept.tolist()) if k], n[kept]
                if not len(at):
                    return
            if words not in lengths:
                continue
            order = np.argsort(group, kind="stable")
            heads = np.cumsum(n) - n
            sides = []
            for beside in (np.where(at > 0, code[at - 1], 0), code[at + words]):
                beside = beside[order]
                least, most = np.minimum.reduceat(beside, heads), np.maximum.reduceat(beside, heads)
                sides.append(marks[np.where(least == most, least, 0)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n), pa.string()), pa.array(spelled, pa.binary()).cast(pa.string()), pa.array(np.full(len(n), words, np.int32)),
                 pa.array(n.astype(np.int64)), pa.array(sides[0]), pa.array(sides[1])], names=["lang", "phrase", "words", "n", "before", "after"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_codes: dict[str, _Codes] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                for lang, texts in _by_language(batch.slice(at, 2048)).items():
                    if sum(map(len, known_codes.values())) > 1 << 20:
                        known_codes.clear()
                    if lang not in known_codes:
                        known_codes[lang] = _Codes(lang, first, frequent)
                    yield from grams(known_codes[lang], texts)

    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.lit(0)).alias(c)
    return docs.select("lang", "text").mapInArrow(run, _GRAMS).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"), one("before"), one("after"))


def _slice(begin, size):
    return F.array_join(F.slice("w", begin, size), " ")


def cuts(phrases: DataFrame) -> DataFrame:
    """``phrases`` (lang, phrase, words, n) with each of their cuts: k, left and right."""
    cut = phrases.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    return cut.select("lang", "phrase", "n", "k", _slice(F.lit(1), F.col("k")).alias("left"), _slice(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))


def scored(phrases: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) at the lowest cut; ``counts`` (lang, phrase, n), ``totals`` (lang, total).

    Products are decimals of 38 digits: exact up to 10^16 words a language. Of equal cuts the first counts.
    """
    big = lambda c: F.col(c).cast("decimal(19,0)")
    of = lambda side, out: counts.select(F.col("lang").alias(f"lang_{out}"), F.col("phrase").alias(f"{side}_"), F.col("n").alias(out))
    both = cuts(phrases).join(of("left", "l"), (F.col("lang") == F.col("lang_l")) & (F.col("left") == F.col("left_")))
    both = both.join(of("right", "r"), (F.col("lang") == F.col("lang_r")) & (F.col("right") == F.col("right_")))
    both = both.join(totals.withColumnRenamed("lang", "lang_n"), F.col("lang") == F.col("lang_n"))
    both = both.withColumn("up", (F.lit(1000).cast("decimal(4,0)") * F.col("total").cast("decimal(15,0)")) * big("n")).withColumn("down", big("l") * big("r"))
    both = both.withColumn("score", F.expr("up div down"))
    low = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", F.col("n").alias("a"), "l", "r", "total")).alias("x"))
    return low.select("lang", "phrase", "x.a", "x.l", "x.r", F.col("x.total").alias("n"), "x.score")


def best(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank. Parts of a language are cut to as many first, so no task sorts it whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = 2000, least: int = 100, longest: int = 5, first_wave: int = 8, step: int = 4096) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language of ``docs`` (lang, text) by their score.

    A-Z are lower-cased; phrases have two to ``longest`` words, occur ``least`` times or more, and don't cross ``.,;:!?`` or
    line breaks. Those that occur inside one longer phrase only are left out; that is so if one word stands before or after
    all their occurrences. Score and order are those of ``scored`` and ``best``. Null languages are ``und``; null and empty
    texts have no words; copies of rows count; an empty table, or one without such phrases, gives no rows.

    Words up to ``first_wave * least`` occurrences are extended first. While a language has too few phrases, the next wave
    goes ``step`` times as far; then it takes what can still reach the last score that counts, ties included. Each wave reads
    the texts three times. Neighbouring words are told apart by 64-bit hashes.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    every = materialise(word_counts(docs), "words")
    totals = materialise(every.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    words = materialise(every.filter(F.col("n") >= least), "frequent")
    frequent = Filter(words)
    state = words.groupBy("lang").agg(F.max("n").alias("most")).withColumns({"low": F.lit(0).cast("long"), "high": F.lit(first_wave * least).cast("long")})
    state = materialise(state, "state")
    grown = parts = None
    found = docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long, rank long")
    while not state.isEmpty():
        bounds = state.select(F.col("lang").alias("lang__"), "low", "high")
        wave = materialise(words.join(bounds, (F.col("lang") == F.col("lang__")) & (F.col("n") > F.col("low")) & (F.col("n") <= F.col("high")), "left_semi"), "wave")
        if not wave.isEmpty():
            first = Filter(wave)
            open_docs = docs.join(F.broadcast(bounds), F.col("lang") == F.col("lang__"), "left_semi") if state.count() < 10_000 else docs
            pairs = materialise(count_phrases(open_docs, first, frequent, None, 0, range(2, 3)).filter(F.col("n") >= least), "pairs")
            longer = count_phrases(open_docs, first, frequent, Filter(pairs), 2, range(3, longest + 1)).filter(F.col("n") >= least) if longest > 2 else pairs.limit(0)
            # a word that a filter lets through by chance may be extended again in its own wave, with the same counts
            now = pairs.union(longer)
            grown = materialise((now if grown is None else grown.union(now)).dropDuplicates(["lang", "phrase"]), "grown")
            stay = grown.filter((F.col("words") == longest) | ((F.col("before") == 0) & (F.col("after") == 0)))
            have = grown.select("lang", "phrase", "n") if parts is None else grown.select("lang", "phrase", "n").union(parts)
            rest = cuts(stay).filter(F.instr("right", " ") > 0).select("lang", F.col("right").alias("phrase")).distinct()
            rest = materialise(rest.join(have, ["lang", "phrase"], "left_anti"), "rest")
            if not rest.isEmpty():
                w = F.split("phrase", " ")
                starts = rest.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.size(w)), lambda k: F.array_join(F.slice(w, F.lit(1), k), " "))).alias("phrase")).distinct()
                starts = materialise(starts, "starts")
                more = count_phrases(open_docs, Filter(starts.filter(F.instr("phrase", " ") == 0)), frequent, Filter(starts), longest - 1, range(2, longest))
                more = more.select("lang", "phrase", "n").join(rest, ["lang", "phrase"], "left_semi")
                parts = materialise(more if parts is None else parts.union(more), "parts")
            counts = grown.select("lang", "phrase", "n").union(words)
            counts = (counts if parts is None else counts.union(parts)).dropDuplicates(["lang", "phrase"])
            found = materialise(best(scored(stay, counts, totals), top), "best")
        reached = found.groupBy("lang").agg(F.count("*").alias("have"), F.min("score").alias("last")).join(totals, "lang")
        reached = reached.select(F.col("lang").alias("lang__"), F.when(F.col("have") >= top, F.expr("cast(1000 as decimal(4,0)) * cast(total as decimal(15,0)) div greatest(last, 1)")).alias("needed"))
        further = state.join(reached, F.col("lang") == F.col("lang__"), "left").withColumn("needed", F.coalesce("needed", F.col("high") * step))
        further = further.filter("high < most and high < needed").select("lang", "most", F.col("high").alias("low"), F.col("needed").cast("long").alias("high"))
        state = materialise(further, "state")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
