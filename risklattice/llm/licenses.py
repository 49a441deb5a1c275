"""Fuzzy search for short license notices: exact seeds from a pigeonhole split find places, bounded-error matching checks them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Phrases whose exact places count, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Further notices that the search labels.
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "bsd 2 clause license": "bsd-2",
    "bsd 3 clause license": "bsd-3",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "released into the public domain": "public-domain",
}
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_LOWER = {b: b + 32 for b in range(65, 91)}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPANS = "array<struct<label:string,phrase:string,first_word:bigint,last_word:bigint,start:bigint,end:bigint,edits:int,matched:string>>"


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int


def notices(per_edit: int = 10) -> tuple[Notice, ...]:
    """All phrases with the edits they allow: one for each ``per_edit`` characters, so the shortest must be exact."""
    return tuple(Notice(p, label, len(p) // per_edit) for p, label in {**NOTICES, **BASE}.items())


def seeds(phrase: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces with their offsets: so many edits leave one of them untouched."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=8)
def _search(library: tuple[Notice, ...]):
    pieces: dict[str, list[tuple[int, int]]] = {}
    for n, notice in enumerate(library):
        for offset, piece in seeds(notice.phrase, notice.edits):
            pieces.setdefault(piece, []).append((n, offset))
    machine = ahocorasick.Automaton()
    for piece, owners in pieces.items():
        machine.add_word(piece, (len(piece), owners))
    machine.make_automaton()
    patterns = [regex.compile(f"(?e)(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}") for n in library]
    return machine, patterns


def _windows(joined: str, library: tuple[Notice, ...], machine) -> dict[int, list[tuple[int, int]]]:
    """For each notice, the stretches of the text that its seeds point to, in order, joined where they overlap."""
    found: dict[int, list[tuple[int, int]]] = {}
    for end, (length, owners) in machine.iter(joined):
        for n, offset in owners:
            size, edits = len(library[n].phrase), library[n].edits
            start = end + 1 - length - offset
            low, high = max(0, start - edits), min(len(joined), start + size + edits)
            spans = found.setdefault(n, [])
            if spans and low <= spans[-1][1]:
                spans[-1] = (min(low, spans[-1][0]), max(high, spans[-1][1]))
            else:
                spans.append((low, high))
    return found


def scan(text: str | None, library: tuple[Notice, ...]) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, score, spans) of one text.

    A-Z are lower-cased and words joined by blanks. Matches are found in that form and widened to whole words; spans give
    words and characters of the text itself. Digits must agree, so that no edit turns one version into another.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
    joined = b" ".join(words).decode("utf-8", "surrogatepass")
    machine, patterns = _search(library)
    hits: list[tuple[int, int, int, int]] = []
    starts: list[tuple[int, str]] = []
    for n, spans in _windows(joined, library, machine).items():
        for low, high in spans:
            for match in patterns[n].finditer(joined, low, high, overlapped=library[n].edits == 0):
                if re.findall(r"\d+", match.group()) != re.findall(r"\d+", library[n].phrase):
                    continue
                hits.append((n, match.start(), match.end(), sum(match.fuzzy_counts)))
    padded = f" {joined} "
    for phrase in BASE:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            starts.append((padded.count(" ", 0, at + 1) - 1, BASE[phrase]))
            at = padded.find(f" {phrase} ", at + 1)
    places = sorted(w for w, _ in starts)
    base = {label for _, label in starts}
    spans, score = [], 1.0 if base else 0.0
    if hits:
        in_text = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
        for n, low, high, edits in sorted(set(hits)):
            matched = joined[low:high]
            low, high = low + len(matched) - len(matched.lstrip(" ")), high - len(matched) + len(matched.rstrip(" "))
            first, last = joined.count(" ", 0, low), joined.count(" ", 0, high)
            start, end = in_text[first][0], in_text[last][1]
            spans.append((library[n].label, library[n].phrase, first, last, start, end, edits, text[start:end]))
            score = max(score, 1.0 - edits / len(library[n].phrase))
    labels = base | {s[0] for s in spans}
    return (len(words), len(places), places[0] if places else None, places[-1] if places else None,
            ",".join(sorted(base)), ",".join(sorted(labels)), score, spans)


def scan_documents(docs: DataFrame, per_edit: int = 10) -> DataFrame:
    """License notices in every row of ``docs`` (doc_id, text); other columns are not carried, and nothing is shuffled.

    n_base counts all places of the base phrases as consecutive whole words, first_word and last_word bound their starts.
    ``labels`` adds what is found with up to one edit for each ``per_edit`` characters of a notice; ``spans`` reports each
    match. Null and empty texts have no words, no labels and score 0. Rows repeat as they come; a row's work is bounded by
    its own text.
    """
    library = notices(per_edit)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    fields = ["label", "phrase", "first_word", "last_word", "start", "end", "edits", "matched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([(f, pa.string() if f in ("label", "phrase", "matched") else pa.int32() if f == "edits" else pa.int64()) for f in fields]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span]
        for batch in batches:
            rows = [scan(t, library) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(kinds)
            columns = [*columns[:-1], [[dict(zip(fields, s)) for s in spans] for spans in columns[-1]]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
