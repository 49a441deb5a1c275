"""Language identification: TF-IDF character n-grams against several centroids of each language, nearest by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
KNOTS = np.arange(0, 20.5, 0.5)  # base-2 logarithms of numbers of different n-grams
_LETTERS: np.ndarray | None = None


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` is shared out over the languages, one row each at least, so the model is fitted on max(sample_rows,
    languages) labelled rows at most; the broadcast ids and the driver's rows have the same bound.

    A text is rejected below ``slack`` times the ``quantile`` of the cosines that sampled texts of its nearest language have
    at its length, or below ``middle`` times their median where that is more: a few odd rows do not lower it.
    """

    dimensions: int = 4096
    longest: int = 3
    clusters: int = 4
    sample_rows: int = 1600
    rounds: int = 20
    slack: float = 0.7
    quantile: float = 0.05
    middle: float = 0.45
    cuts: tuple[int, ...] = (12, 25, 50, 100, 200, 400, 800, 1600)  # characters
    seed: int = 17


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # cosine below which a text is rejected: of each centroid, at each of KNOTS
    settings: Settings


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def ngram_counts(text: str | None, settings: Settings) -> np.ndarray | None:
    """Counts of hashed n-grams of lower-cased letters, words set off by blanks; None for a text without letters."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    before = np.concatenate(([False], letter[:-1]))
    points = np.where(letter, points, 32)[letter | before]
    points = np.concatenate((points, [32])).astype(np.uint32) if letter[-1] else points
    shift = np.uint32(32 - int(settings.dimensions).bit_length() + 1)
    counts = np.zeros(settings.dimensions, np.float32)
    rolling = np.zeros(len(points), np.uint32)
    for n in range(1, settings.longest + 1):
        if len(points) < n:
            break
        rolling = rolling[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
        counts += np.bincount((rolling * np.uint32(0x9E3779B1)) >> shift, minlength=settings.dimensions)
    return counts


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of (1 + log count) x idf with length 1."""
    weighted = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)


def cluster(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of unit length. They start at the row nearest to the mean, then at rows far from those chosen so far."""
    mean = rows.mean(0)
    chosen = [int(np.argmax(rows @ mean))]
    for _ in range(min(k, len(rows)) - 1):
        chosen.append(int(np.argmin((rows @ rows[chosen].T).max(1))))
    centroids = rows[chosen]
    for _ in range(rounds):
        nearest = np.argmax(rows @ centroids.T, axis=1)
        sums = np.stack([rows[nearest == c].sum(0) if (nearest == c).any() else centroids[c] for c in range(len(centroids))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        if np.allclose(new, centroids, atol=1e-6):
            break
        centroids = new
    return centroids


def _least(own: np.ndarray, sizes: np.ndarray, heads: list[str], centroids: np.ndarray, idf: np.ndarray, settings: Settings) -> np.ndarray:
    """The least accepted cosine at each of KNOTS, from a language's sampled texts and the starts of those long enough.

    Short texts lie farther from any centroid, and samples hold few of them, so the sample is cut to each length as well.
    A length is a number of different n-grams, so a text that repeats itself is a short one.
    Between lengths the bound is interpolated and never falls; below the shortest it shrinks with the root of the length.
    """
    groups = [(sizes, (own @ centroids.T).max(1))]
    longest = settings.cuts[-1]
    if (long := np.array([len(h) >= longest for h in heads])).any():
        groups = [(sizes[long], groups[0][1][long])]
    for cut in settings.cuts:
        made = [ngram_counts(h[:cut], settings) for h in heads if len(h) >= cut]
        made = [m for m in made if m is not None]
        if made:
            counts = np.stack(made)
            groups.append(((counts > 0).sum(1), (vectors(counts, idf) @ centroids.T).max(1)))
    at = [float(np.log2(max(1.0, np.median(n)))) for n, _ in groups]
    bound = [max(settings.slack * np.quantile(c, settings.quantile), settings.middle * np.median(c)) for _, c in groups]
    order = np.argsort(at, kind="stable")
    x, y = np.array(at)[order], np.maximum.accumulate(np.array(bound)[order])
    return np.interp(KNOTS, x, y) * np.minimum(1, np.exp2((KNOTS - x[0]) / 2))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def _sample(docs: DataFrame, settings: Settings) -> DataFrame:
    """(lang, text): up to an equal number of labelled rows of each language, chosen by a hash.

    Ids are chosen first, under a salt and then over the salts, so no task sorts a language; their texts are read by a
    semi-join, and a last limit keeps the bound where ids repeat.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    languages = max(1, labelled.select("lang").distinct().count())
    most = max(1, settings.sample_rows // languages)
    order = F.xxhash64(F.lit(settings.seed), F.col("doc_id"))
    ids = labelled.select("doc_id", "lang", order.alias("order")).withColumn("salt", F.pmod("order", F.lit(64)))
    for group in (["lang", "salt"], ["lang"]):
        ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("order", "doc_id"))).filter(F.col("rank") <= most)
    chosen = F.broadcast(ids.select("doc_id", "lang"))  # max(sample_rows, languages) rows at most
    texts = labelled.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi")
    last = Window.partitionBy("lang").orderBy(order, F.xxhash64("text"))
    return texts.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= most).select("lang", "text")


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """A model of ``docs`` (doc_id, text, lang), of rows with a lang that are not held out.

    Tasks turn the sampled texts into count vectors; the driver gets max(sample_rows, languages) of them at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [ngram_counts(t, settings) for t in batch.column(1).to_pylist()]
            kept = [i for i, m in enumerate(made) if m is not None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array([made[i].tobytes() for i in kept], pa.binary()),
                 pa.array([batch.column(1)[i].as_py()[: settings.cuts[-1]].encode("utf-8", "surrogatepass") for i in kept], pa.binary())], names=["lang", "counts", "head"])

    sampled = _sample(docs, settings).mapInArrow(run, "lang string, counts binary, head binary").collect()
    rows = sorted((r.lang, bytes(r.counts), bytes(r.head)) for r in sampled)
    d = settings.dimensions
    counts = np.stack([np.frombuffer(c, np.float32) for _, c, _ in rows]) if rows else np.zeros((0, d), np.float32)
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    unit, langs = vectors(counts, idf), np.array([lang for lang, _, _ in rows], object)
    names, centroids, least = [], [], []
    for lang in sorted(set(langs)):
        own = unit[langs == lang]
        found = cluster(own, settings.clusters, settings.rounds)
        names += [lang] * len(found)
        centroids += list(found)
        heads = [h.decode("utf-8", "surrogatepass") for name, _, h in rows if name == lang]
        least += [_least(own, (counts[langs == lang] > 0).sum(1), heads, found, idf, settings)] * len(found)
    return Model(tuple(names), np.stack(centroids) if centroids else np.zeros((0, d), np.float32), idf, np.array(least).reshape(-1, len(KNOTS)), settings)


def _nearest(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid (-1: none), its cosine and whether that is near enough for each text, in blocks of bounded size."""
    n = len(texts)
    nearest, cosine, accepted = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n, bool)
    for first in range(0, n if len(model.centroids) else 0, 256):
        made = [ngram_counts(t, model.settings) for t in texts[first : first + 256].to_pylist()]
        at = np.array([first + i for i, m in enumerate(made) if m is not None], np.int64)
        if len(at):
            counts = np.stack([m for m in made if m is not None])
            cosines = vectors(counts, model.idf) @ model.centroids.T
            nearest[at], cosine[at] = cosines.argmax(1), cosines.max(1)
            sizes = np.log2(np.maximum((counts > 0).sum(1), 1))
            accepted[at] = [c >= np.interp(x, KNOTS, model.least[i]) for c, x, i in zip(cosine[at], sizes, nearest[at])]
    return nearest, cosine, accepted


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected, cluster) for every row of ``docs`` (doc_id, text), from whole texts, without a shuffle.

    score is the cosine with the nearest centroid. A text farther from it than nearly all of the fit's members are at its
    length, with slack, is rejected, and keeps its prediction. Null texts and texts without letters are ``und`` with score 0, and rejected; so is every text
    if nothing was learnt. Other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, cosine, accepted = _nearest(batch.column(1), model)
            lang = np.array([*model.languages, UNKNOWN], object)[nearest]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(np.clip(cosine, 0, 1)),
                 pa.array(~accepted), pa.array(nearest)],
                names=["doc_id", "lang_pred", "score", "rejected", "cluster"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean, cluster int")


def keep_accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` whose text is not rejected, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_nearest(batch.column(at), model)[2]))

    return docs.mapInArrow(run, docs.schema)
