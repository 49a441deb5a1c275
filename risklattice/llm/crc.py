"""CRC-32C of many byte strings at once, and the mask that record files use."""

from __future__ import annotations

import numpy as np

_CHUNK = 64  # bytes that one column step works on, for all chunks together


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The step by two bytes, and by _CHUNK zero bytes for each byte of the register. Polynomial 0x1EDC6F41, reflected."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1)
    both = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        both = one[both & 0xFF] ^ (both >> 8)
    far = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])
    for _ in range(_CHUNK):
        far = one[far & 0xFF] ^ (far >> 8)
    return both, far


_TWO, _FAR = _tables()


def crc32c(data: bytes | np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The checksum of each data[start : start + size]. Sizes are at least 4.

    Zeros in front change nothing once the register's start value has been put on the first four bytes, so each string is
    filled up in front to whole chunks. All chunks are worked on side by side, and then joined, string by string.
    """
    flat = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    sizes = np.asarray(sizes, np.int64)
    chunks = -(-sizes // _CHUNK)
    first = np.cumsum(chunks) - chunks
    padded = np.zeros(int(chunks.sum()) * _CHUNK, np.uint8)
    put = (first + chunks) * _CHUNK - sizes
    total = int(sizes.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[np.repeat(put, sizes) + inside] = flat[np.repeat(np.asarray(starts, np.int64), sizes) + inside]
    for b in range(4):
        padded[put + b] ^= 0xFF
    words = np.ascontiguousarray(padded.view("<u2").reshape(-1, _CHUNK // 2).T)
    register = np.zeros(words.shape[1], np.uint32)
    for column in words:
        register = _TWO[(register ^ column) & 0xFFFF] ^ (register >> 16)
    out = np.zeros(len(sizes), np.uint32)
    order = np.argsort(-chunks, kind="stable")
    longest = chunks[order]
    for step in range(int(chunks.max()) if len(chunks) else 0):
        live = order[: np.searchsorted(-longest, -step, side="left")]  # strings with more chunks than ``step``
        r = out[live]
        moved = _FAR[0][r & 0xFF] ^ _FAR[1][(r >> 8) & 0xFF] ^ _FAR[2][(r >> 16) & 0xFF] ^ _FAR[3][r >> 24]
        out[live] = moved ^ register[first[live] + step]
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    """A checksum of data that holds checksums is weak, so files keep it turned and moved."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
