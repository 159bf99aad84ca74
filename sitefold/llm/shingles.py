"""Word shingles as 64-bit hashes, formed over many texts at once.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return, after A-Z are lower-cased. A text's
set holds the distinct runs of `width` words; with fewer words the whole sequence is its one shingle; without words it is empty."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from sitefold.llm.common import mix64

AT_ONCE = 1 << 18  # bytes of text hashed together; a byte takes about sixty while that lasts
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n + 1, _R), np.full(n + 1, _R_INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word in bytes."""
    inside = np.concatenate([[False], ~((data == 32) | ((data >= 9) & (data <= 13))), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of data[begin:end] that depends on nothing else: differences of a running polynomial modulo 2**64."""
    size = 1 << max(10, int(len(data)).bit_length())
    up, down = _powers(size)
    running = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)])])
    return mix64((running[end] - running[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _folded(w: list[np.ndarray]) -> np.ndarray:
    out = np.full(len(w[0]), np.uint64(len(w)))
    for x in w:
        out = mix64(out + x)
    return out


def sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size + len(texts[at]) <= AT_ONCE):
            part.append(texts[at].lower())
            size += len(part[-1]) + 1
            at += 1
        data = np.frombuffer(b" ".join(part), np.uint8)
        begin, end = words(data)
        w = span_hashes(data, begin, end)
        edges = np.searchsorted(begin, np.cumsum([0] + [len(p) + 1 for p in part]))
        runs = _folded([w[i:len(w) - width + 1 + i] for i in range(width)]) if len(w) >= width else w[:0]
        for a, z in zip(edges[:-1], edges[1:]):
            if z - a >= width:
                out.append(np.unique(runs[a:z - width + 1]))
            else:
                out.append(_folded([w[i:i + 1] for i in range(a, z)]) if z > a else w[:0])
    return out


class MinHash:
    """Signatures of `size` minwise hashes."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 64, size, np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 64, size, np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """The least hash by each function, as signed 32-bit integers. The set must not be empty."""
        out = np.full(len(self.a), np.uint64(0xFFFFFFFF))
        for i in range(0, len(shingles), 2048):
            np.minimum(out, ((shingles[None, i:i + 2048] * self.a[:, None] + self.b[:, None]) >> np.uint64(32)).min(1), out=out)
        return out.astype(np.uint32).view(np.int32)
