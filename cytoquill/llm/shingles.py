"""Shingle sets and MinHash signatures of texts, by whole-batch array operations."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

_RNG = np.random.default_rng(20240611)
#: A random odd number for each byte, and odd multipliers; white space counts as 0.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACES] = 0
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_ODD = _RNG.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _windows(h: np.ndarray, owner: np.ndarray, width: int, owners: int) -> list[np.ndarray]:
    """Distinct hashes of each owner's runs of ``width`` units, sorted; with fewer units, of its whole sequence."""
    count = np.bincount(owner, minlength=owners)
    n = len(h) - width + 1
    if n > 0:
        s = np.zeros(n, np.uint64)
        for k in range(width):
            s += h[k : k + n] * _ODD[k]
        s = _mixed(s + np.uint64(width))
        inside = owner[:n] == owner[width - 1 :]
        s, at = s[inside], owner[:n][inside]
    else:
        s, at = np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.bincount(at, minlength=owners).cumsum()
    firsts = count.cumsum() - count
    out, a = [], 0
    for i, b in enumerate(ends.tolist()):
        if b > a:
            u = np.sort(s[a:b])
            out.append(u[np.concatenate([[True], u[1:] != u[:-1]])])
        elif c := int(count[i]):
            own = h[firsts[i] : firsts[i] + c]
            out.append(_mixed((own * _ODD[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            out.append(np.empty(0, np.uint64))
        a = b
    return out


def word_shingles(texts: Sequence[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of ``width`` words.

    Words are what stands between bytes 0x20 and 0x09-0x0D, A-Z in lower case. A text with fewer
    words has one shingle, its whole sequence; one without words, and a null text, has none.
    """
    raws = [(t or "").encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(raws), np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    space = _SPACES[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(raws)
    lengths = np.diff(np.append(starts, len(data)))  # up to the next word; white space counts as 0
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), 0xD1342543DE82EF95, np.uint64))
    h = np.add.reduceat(_BYTE[data[starts[0] :]] * powers[place], starts - starts[0])
    return _windows(_mixed(h), np.searchsorted(ends, starts, "right"), width, len(raws))


def char_shingles(texts: Sequence[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's runs of ``width`` characters; of the whole text if it is shorter."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return _windows(_mixed(codes + np.uint64(1)), np.repeat(np.arange(len(texts)), sizes), width, len(texts))


@lru_cache(maxsize=4)
def _lines(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(77)
    return rng.integers(1, 1 << 32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, dtype=np.uint32)


def signatures(sets: Sequence[np.ndarray], k: int, block: int = 16_384) -> np.ndarray:
    """A row of ``k`` minima for each set, as unsigned 32-bit integers; empty sets have zeros."""
    a, b = _lines(k)
    out = np.zeros((len(sets), k), np.uint32)
    held: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            x = (np.concatenate([sets[i] for i in held]) >> np.uint64(32)).astype(np.uint32)
            cuts = np.cumsum([0] + [len(sets[i]) for i in held[:-1]])
            for at in range(0, k, 16):  # so that a block stays in the cache
                out[held, at : at + 16] = np.minimum.reduceat((x[:, None] ^ b[None, at : at + 16]) * a[None, at : at + 16], cuts, axis=0)
        held.clear()
        size = 0

    for i, s in enumerate(sets):
        if len(s):
            held.append(i)
            size += len(s)
            if size >= block:
                flush()
    flush()
    return out


#: Sets of fewer elements than HASHED have signatures of the one kind, sets of BINNED and more those of the other: all pairs of a similarity of 0.8 or more have one in common.
BINNED, HASHED = 40, 50
#: Bins that an empty bin looks at, in turn, for a coordinate.
_TRIES = 128


@lru_cache(maxsize=4)
def _donors(k: int) -> np.ndarray:
    return np.random.default_rng(78).integers(0, k, (_TRIES, k))


def line_signatures(texts: Sequence[str], width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of k coordinates of each text's runs of ``width`` characters: (columns, binned, columns, hashed), a column for each text.

    Sets of ``BINNED`` runs or more are binned: each run falls into one of k bins by hash, where the
    smallest counts, so a character costs one hash, whatever k is. An empty bin takes the coordinate of the first
    filled one of a random row of bins, which is the same for all texts; a coordinate of two
    sets is still equal with a chance of their similarity. Sets of fewer than ``HASHED`` runs are hashed k times. Those
    in between have both kinds. Texts of fewer than ``width`` characters have one run, all of them.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = sizes.cumsum()
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass") + bytes(4 * (width - 1)), np.uint32)
    n = len(codes) - width + 1
    odd = _ODD.astype(np.uint32)
    s = codes[:n] * odd[0]
    for i in range(1, width):
        s += codes[i : i + n] * odd[i]
    s = _mixed32(s)
    runs = np.maximum(sizes - (width - 1), 0)
    for i in np.flatnonzero(sizes < width):
        if sizes[i]:
            s[ends[i] - sizes[i]] = _mixed32(np.array([hash_text(texts[i])], np.uint32))[0]
            runs[i] = 1
    long = np.flatnonzero(runs >= BINNED)
    # Bins lie together, so that filling is done for all texts at once; what isn't binned goes to a bin behind all others.
    binned = np.full(k * len(texts) + 1, 0xFFFFFFFF, np.uint32)
    at = ((s >> np.uint32(16)) * np.uint32(k) >> np.uint32(16)).astype(np.int64) * len(texts)
    at += np.repeat(np.arange(len(texts)), sizes)
    past = ends[:, None] - np.arange(1, width)
    at[past[past >= 0]] = k * len(texts)
    np.minimum.at(binned, at, s * np.uint32(0x9E3779B1) >> np.uint32(4))
    binned = binned[:-1].reshape(k, len(texts))
    if len(long) < len(texts):
        binned = np.take(binned, long, axis=1)
    hashed_too = runs < BINNED
    # Where few bins are filled, the runs may repeat: then the distinct ones are counted.
    if len(few := np.flatnonzero(np.count_nonzero(binned != 0xFFFFFFFF, axis=0) < HASHED)):
        number = np.array([len(np.unique(s[ends[i] - sizes[i] :][: runs[i]])) for i in long[few]])
        hashed_too[long[few]] = number < HASHED
        stays = np.ones(len(long), bool)
        stays[few] = number >= BINNED
        long, binned = long[stays], np.compress(stays, binned, axis=1)
    short = np.flatnonzero(hashed_too & (runs > 0))
    return long, _filled(binned), short, _hashed(s, ends - sizes, runs, short, k)


def _filled(binned: np.ndarray) -> np.ndarray:
    """Columns of bins of 28 bits, the empty ones filled from the others of their column."""
    out, other, donors = binned.copy(), np.empty_like(binned), _donors(len(binned))
    for i, row in enumerate(donors[:14], 1):  # in four more bits stands which bin it was, so the minimum is of the first
        np.take(binned, row, axis=0, out=other, mode="clip")
        other |= np.uint32(i << 28)
        np.minimum(out, other, out=out)
    some = np.flatnonzero(out.max(0, initial=0) == 0xFFFFFFFF)  # few are left
    bins, column = np.nonzero(out[:, some] == 0xFFFFFFFF)
    column = some[column]
    for row in donors[14:]:
        if not len(bins):
            break
        got = binned[row[bins], column]
        out[bins, column] = got
        left = got == 0xFFFFFFFF
        bins, column = bins[left], column[left]
    return out


def _hashed(s: np.ndarray, starts: np.ndarray, runs: np.ndarray, short: np.ndarray, k: int) -> np.ndarray:
    """Minima of k hashes of the runs of the texts ``short``."""
    hashed = np.zeros((k, len(short)), np.uint32)
    a, b = _lines(k)
    count = runs[short]
    ends = count.cumsum()
    low = 0
    while low < len(short):  # blocks that stay in the cache
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 8192)))
        own = count[low:high]
        first = own.cumsum() - own
        part = s[np.arange(own.sum()) + np.repeat(starts[short[low:high]] - first, own)]
        for c in range(0, k, 16):
            hashed[c : c + 16, low:high] = np.minimum.reduceat((part[:, None] ^ b[None, c : c + 16]) * a[None, c : c + 16], first, axis=0).T
        low = high
    return hashed


def hash_text(text: str) -> int:
    return int((np.array([ord(c) for c in text], np.uint64) * _ODD[: len(text)]).sum(dtype=np.uint64)) & 0xFFFFFFFF


def _mixed32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(15))
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(12)
    x *= np.uint32(0x297A2D39)
    return x ^ (x >> np.uint32(15))


def match_threshold(k: int, similarity: float, miss: float = 1e-6) -> int:
    """The largest number of equal coordinates, of k, that a pair of at least this similarity falls short of with a chance of ``miss`` at most."""
    below = 0.0
    for t in range(k + 1):
        below += math.comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return max(1, t)
    return k
