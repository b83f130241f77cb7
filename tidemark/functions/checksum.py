"""CRC-32C of many byte strings at once.

Without its initial value a CRC is linear, and zeros before the data change nothing.  So every string is cut into
chunks of CHUNK bytes, the first one filled up with zeros in front; all chunks of all strings advance together, and
each string's chunks are then folded with the linear map that CHUNK zero bytes make of a state.
"""

from __future__ import annotations

import numpy as np

CHUNK = 64
#: Reflected Castagnoli polynomial (fixed value).
CRC32C = 0x82F63B78


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(CRC32C), table >> 1)
    return table.astype(np.uint32)


_STEP = _table()


def _advance(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _STEP[(state ^ byte) & 0xFF] ^ (state >> np.uint32(8))


def _over_zeros(n: int) -> np.ndarray:
    """For each byte of a state and each of its values, what n zero bytes make of it."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
    for _ in range(n):
        state = _advance(state, 0)
    return state


_SKIP = _over_zeros(CHUNK)


def crc32c_of(data: list[bytes]) -> np.ndarray:
    """CRC-32C of each string."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    chunks = -(-np.maximum(sizes, 1) // CHUNK)
    ends = np.cumsum(chunks)
    flat = np.zeros(int(ends[-1]) * CHUNK if len(data) else 0, np.uint8)
    joined = np.frombuffer(b"".join(data), np.uint8)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(len(joined)) + np.repeat(ends * CHUNK - sizes - starts, sizes)
    flat[at] = joined
    # The initial value is the same as inverting the first four bytes; shorter strings are done by themselves.
    long = np.flatnonzero(sizes >= 4)
    flat[((ends * CHUNK - sizes)[long][:, None] + np.arange(4)).ravel()] ^= 0xFF
    cells = flat.reshape(-1, CHUNK)
    state = np.zeros(len(cells), np.uint32)
    for i in range(CHUNK):
        state = _advance(state, cells[:, i])
    out = np.zeros(len(data), np.uint32)
    order = np.argsort(-chunks, kind="stable")
    first, falling, alive = (ends - chunks)[order], chunks[order], len(data)
    for i in range(int(chunks.max(initial=0))):
        while alive and falling[alive - 1] <= i:
            alive -= 1
        s = out[order[:alive]]
        s = _SKIP[0][s & 0xFF] ^ _SKIP[1][(s >> 8) & 0xFF] ^ _SKIP[2][(s >> 16) & 0xFF] ^ _SKIP[3][s >> 24]
        out[order[:alive]] = s ^ state[first[:alive] + i]
    out = out ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes < 4):
        s = np.uint32(0xFFFFFFFF)
        for b in data[i]:
            s = _STEP[(s ^ np.uint32(b)) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
        out[i] = s ^ np.uint32(0xFFFFFFFF)
    return out
