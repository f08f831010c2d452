"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy. Used inside tasks, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Fixed odd numbers that hash words and mix shingles.
BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
#: Bytes handled at once; longer single texts make longer batches.
BYTES = 500_000
#: Bytes whose sums are made at once: what caches hold.
BLOCK = 16_384
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    if not _powers or len(_powers["p"]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        size = max(n + n // 4, 2 * BYTES)
        for name, base in (("p", BASE), ("q", inverse)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["p"][:n], _powers["q"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def batches(texts: list[str | None], most: int = BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 bytes of some texts) with about ``most`` bytes each; null is empty."""
    at, size, part = 0, 0, []
    for i, t in enumerate(texts):
        raw = b"" if t is None else str(t).encode("utf-8", "replace")
        if part and size + len(raw) > most:
            yield at, part
            at, size, part = i, 0, []
        part.append(raw)
        size += len(raw)
    if part:
        yield at, part


def words(raws: list[bytes], fold: bool = False, places: bool = False) -> tuple[np.ndarray, ...]:
    """(hash of each word, text of each word, the joined bytes); texts are joined by line ends, so no word spans two.

    With ``places`` also where each word begins in the joined bytes, and its bytes."""
    text = b"\n".join(raws) + b"\n"
    joined = np.frombuffer(text, np.uint8)
    flat = np.frombuffer(text.lower(), np.uint8) if fold else joined
    inside = np.zeros(len(flat) + 1, bool)
    inside[1:] = (flat != 32) & (flat - np.uint8(9) > 4)
    edge = np.flatnonzero(inside[1:] != inside[:-1])  # words begin and end by turns; the last byte is a line end
    begin, end = edge[::2], edge[1::2]
    p, q = powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    for i in range(0, len(flat), BLOCK):
        part = sums[i + 1 : i + 1 + BLOCK]
        np.multiply(flat[i : i + BLOCK], p[i : min(i + BLOCK, len(flat))], out=part)
        part[:1] += sums[i : i + 1]
        np.cumsum(part, out=part)
    hashes = mixed((sums[end] - sums[begin]) * q[begin] + (end - begin).astype(np.uint64) * _MIX[2])
    bounds = np.cumsum([len(r) + 1 for r in raws])
    owner = np.repeat(np.arange(len(raws)), np.diff(np.searchsorted(begin, bounds), prepend=0))
    out = hashes, owner, joined
    return (*out, begin, end - begin) if places else out


def windows(hashes: np.ndarray, owner: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every k words of one text in a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mult = mixed(np.arange(1, k + 1, dtype=np.uint64) * _MIX[3]) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * mult[j]
    first = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return mixed(out[first]), first


def shingle_sets(raws: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted set of its k-word shingles, lower-cased; with fewer words the whole sequence is one."""
    hashes, owner, _ = words(raws, fold=True)
    made, first = windows(hashes, owner, k)
    own = owner[first]
    counts = np.bincount(owner, minlength=len(raws))
    bounds = np.searchsorted(own, np.arange(len(raws) + 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = []
    for i in range(len(raws)):
        if counts[i] >= k:
            out.append(np.unique(made[bounds[i] : bounds[i + 1]]))
        elif counts[i]:
            part = hashes[starts[i] : starts[i + 1]]
            out.append(mixed((part * mixed(np.arange(11, 11 + len(part), dtype=np.uint64))).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(part))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
