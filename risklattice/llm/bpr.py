"""Bucket-pointer refinement on bytes, and the sampled positions by which equal stretches of different texts meet."""

from __future__ import annotations

import numpy as np
import xxhash

_RNG = np.random.default_rng(20)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, 1 << 20), base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(data: np.ndarray, q: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of q bytes."""
    n = len(data)
    if n < q:
        return np.zeros(0, np.uint64)
    values = _VALUE if not salt else _mix(_VALUE + np.uint64(salt))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[data] * _power(_INVERSE, n), dtype=np.uint64)))
    return _mix((sums[q:] - sums[:-q]) * _power(_MULTIPLIER, n - q + 1))


def _leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of the first of its smallest."""
    least, place, size = h, np.arange(len(h), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        left, right = least[:-step], least[step:]
        first = left <= right
        least, place, size = np.where(first, left, right), np.where(first, place[:-step], place[step:]), size + step
    return place


def stretches(data: np.ndarray, starts: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, key, content) for each run of neighbouring windows with one anchor.

    ``starts`` are the ascending starts of windows of ``length`` bytes. A window's anchor is the q-gram in it with the
    smallest hash, the first of equals, so equal windows have equal anchors at equal places. ``key`` is the anchor's hash,
    ``content`` a hash of all bytes from the first window's start to the last one's end, and of the anchor's place.
    """
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    low, high = int(starts[0]), int(starts[-1]) + length
    h = gram_hashes(data[low:high], q)
    anchor = _leftmost_least(h, length - q + 1)[starts - low].astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, last = starts[new], starts[np.concatenate((new[1:], [len(starts)])) - 1]
    anchor = anchor[new]
    view = memoryview(np.ascontiguousarray(data)).cast("B")
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter(
        (digest(view[a:b], s) for a, b, s in zip(first.tolist(), (last + length).tolist(), (anchor + low - first).tolist())), np.uint64, len(first))
    return first, last, h[anchor], content


def _rank(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Bucket identifiers of sorted places: the rank of each bucket's first place."""
    heads = np.flatnonzero(new)
    return np.repeat(heads, np.diff(np.append(heads, len(order))))


def classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each window data[start : start + length], equal for equal windows only.

    Places are first put into buckets by their 8-gram. A bucket is then refined by sorting its places on the bucket
    identifiers at a later offset, which the rounds before have refined already: 8, 16, 32 bytes on and so forth. Buckets of
    one place are left as they are. A last round takes the offset that completes ``length``.
    """
    pad = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    gram = pad.astype(np.uint64)
    for size in (1, 2, 4):
        gram = (gram[:-size] << np.uint64(8 * size)) | gram[size:]
    n = len(data)
    order = np.argsort(gram[:n], kind="stable")
    ordered = gram[order]
    identifier = np.zeros(n + length, np.int64)
    identifier[order] = _rank(order, np.concatenate(([True], ordered[1:] != ordered[:-1])) if n else np.zeros(0, bool))
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        sizes = np.bincount(identifier[:n], minlength=n)
        # In the last round only the windows' own places count.
        places = starts if depth + step == length else np.arange(n)
        live = places[sizes[identifier[places]] > 1]
        here, later = identifier[live], identifier[live + step]
        order = np.lexsort((later, here))
        live, here, later = live[order], here[order], later[order]
        new = np.concatenate(([True], (here[1:] != here[:-1]) | (later[1:] != later[:-1]))) if len(live) else np.zeros(0, bool)
        head = np.concatenate(([True], here[1:] != here[:-1])) if len(live) else np.zeros(0, bool)
        begin = np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))
        refined = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))
        # A bucket's parts are numbered from its own identifier on, by ranks inside it, so buckets stay apart.
        identifier[live] = here + (refined - begin)
        depth += step
    return identifier[starts]


def first_of(classes_: np.ndarray, text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its class, by text and then place."""
    order = np.lexsort((place, text, classes_))
    sorted_classes = classes_[order]
    first = np.zeros(len(order), bool)
    if len(order):
        first[order[np.concatenate(([True], sorted_classes[1:] != sorted_classes[:-1]))]] = True
    return first


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of neighbouring numbers in an ascending list."""
    if not len(values):
        return values, values
    cut = np.flatnonzero(values[1:] != values[:-1] + 1)
    return values[np.concatenate(([0], cut + 1))], values[np.concatenate((cut, [len(values) - 1]))]
