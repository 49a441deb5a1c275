"""Whole texts to token ids with the tokenizers library, calling it once for each distinct piece of a word."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

_SIMPLE = "".join(chr(c) for c in range(0x250) if c not in (0x85, 0xA0, 0x130))  # single, composed, and no white space but ASCII
_LETTER = "".join(re.escape(c) for c in _SIMPLE if c.isalpha())
_NUMBER = "0-9²³¹¼½¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
_ODD = re.compile(r"[\u0085 İɐ-\U0010ffff]|<\|")

_PROBES = ["Words, and more words: it's 1234 of them.", "  Two  blanks\n\tand lines ", "ÉTÉ naïve Straße", "x=1;y_2 (a+b)*c", "<|a|> \u65e5\u672c İ", ""]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, … start + size - 1 of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class WordEncoder:
    """Encodes texts with a tokenizer that lower-cases, drops white space, and marks each piece's last token with ``</w>``.

    Its pieces never span white space, so a text's ids are those of its words in order, and a word's are those of its pieces.
    Words of composed letters below U+0250 are cut here as the tokenizer's own pattern cuts them, and only pieces not yet
    known go to the library. All other words go to it whole. The ids are those of ``encode`` on the whole text
    (``tests/llm``). At most ``most`` pieces are remembered; beyond, memory is cleared. A tokenizer that gives other ids than that
    on a few probes is called for whole texts.
    """

    def __init__(self, path: str, most: int = 600_000):
        self.full = Tokenizer.from_file(path)
        # The same model without the steps that change nothing in a lower-case composed piece.
        self.plain = Tokenizer(self.full.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.full.get_vocab_size(), bool)
        for token, i in self.full.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.most = most
        self._forget()
        # Any other tokenizer gets whole texts.
        self.pieced = True
        probe = pa.array(_PROBES)
        self.pieced = np.array_equal(self.encode(probe)[0], self._whole(probe)[0])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        """Pieces as they are between blanks; a key that starts with a blank is a word for the full tokenizer."""
        whole = [p for p in pieces if p[0] == " "]
        pieces = [p for p in pieces if p[0] != " "]
        lists = []
        for first in range(0, len(pieces), 200):
            block = pieces[first : first + 200]
            ids = np.array(self.plain.encode(" ".join(block), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(block):
                lists += np.split(ids, ends[:-1])
            else:
                lists += [np.array(self.full.encode(p, add_special_tokens=False).ids, np.uint32) for p in block]
        lists += [np.array(e.ids, np.uint32) for e in self.full.encode_batch_fast([p[1:] for p in whole], add_special_tokens=False)]
        self.known.update(zip([*pieces, *whole], range(len(self.known), len(self.known) + len(lists))))
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.ids = np.concatenate((self.ids, *lists))

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = [np.array(e.ids, np.uint32) for e in self.full.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *lists]), np.array([len(x) for x in lists], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text). Null is the empty text."""
        if not self.pieced:
            return self._whole(texts)
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        cut = [[] if not w else [" " + w] if _ODD.search(w) else [w.lower()] if w.isalpha() else _PIECES.findall(w.lower()) for w in words]
        new = {p for pieces in cut for p in pieces} - self.known.keys()
        if len(self.known) + len(new) > self.most:
            self._forget()
            new = {p for pieces in cut for p in pieces}
        if new:
            self._learn(sorted(new))
        parts = np.fromiter((self.known[p] for pieces in cut for p in pieces), np.int64)
        n_parts = np.fromiter(map(len, cut), np.int64, len(cut))
        first_part = np.cumsum(n_parts) - n_parts
        # ids of each distinct word, one after the other
        word_ids = self.ids[spread(self.starts[parts], self.sizes[parts])]
        until = np.concatenate(([0], np.cumsum(self.sizes[parts])))
        word_start = until[first_part] if len(parts) else np.zeros(len(cut), np.int64)
        word_size = until[first_part + n_parts] - word_start if len(parts) else np.zeros(len(cut), np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        sizes = word_size[codes] if len(codes) else np.zeros(0, np.int64)
        ids = word_ids[spread(word_start[codes], sizes)] if len(codes) else np.zeros(0, np.uint32)
        until = np.concatenate(([0], np.cumsum(sizes)))
        bounds = lists.offsets.to_numpy()
        return ids, np.diff(until[bounds - bounds[0]])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker, so that tasks of one worker share what they have learnt."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
