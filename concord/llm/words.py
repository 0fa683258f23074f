"""Words of a text as 64-bit hashes, computed over whole arrays.

A word is a run of characters other than ASCII white space; A-Z are lowered on request.
Equal words have equal hashes. Every eight bytes are mixed in turn, not summed as a polynomial, so unequal
words collide no more often than random 64-bit values, whatever they repeat.
"""

from __future__ import annotations

import numpy as np
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2 to the 64."""
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 2 * len(_powers)), _BASE, dtype=np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers[:n]


_inverses = np.ones(1, dtype=np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    """Their inverses, modulo 2 to the 64."""
    global _inverses
    if len(_inverses) < n:
        out = np.full(max(n, 2 * len(_inverses)), np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
        out[0] = 1
        _inverses = np.multiply.accumulate(out)
    return _inverses[:n]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes of a word that are hashed for all words at once; longer words are hashed one by one.
_LANES = 64


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64), starts
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))  # the eight bytes from each place on
    n = ends - starts
    h = mix64((eight[starts] & _MASKS[np.minimum(n, 8)]) ^ (n.astype(np.uint64) * _BASE))
    more = np.flatnonzero((n > 8) & (n <= _LANES))
    for k in range(8, _LANES, 8):
        if not len(more):
            break
        h[more] = mix64(h[more] * _BASE + (eight[starts[more] + k] & _MASKS[np.minimum(n[more] - k, 8)]))
        more = more[n[more] > k + 8]
    for i in np.flatnonzero(n > _LANES).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h, starts


def words(text: str | None, lower: bool = True) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(hashes, byte positions of the words' starts, the bytes) of the whole text, slice by slice."""
    raw = (text or "").encode()
    if lower:
        raw = raw.translate(_LOWER)
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(len(raw), at + _SLICE)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end = min([x for x in (raw.find(c, end) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if x >= 0], default=len(raw))
        h, s = _hash_words(np.frombuffer(raw, dtype=np.uint8, count=end - at, offset=at))
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), raw
    return np.concatenate(hashes), np.concatenate(starts), raw


def words_of(texts: list[str | None], lower: bool = True) -> list[np.ndarray]:
    """The hashes of each text's words; the texts are hashed together."""
    sizes = np.array([len((t or "").encode()) + 1 for t in texts], dtype=np.int64)
    h, starts, _ = words("\n".join(t or "" for t in texts), lower)
    return np.split(h, np.searchsorted(starts, np.cumsum(sizes)[:-1])) if len(texts) else []


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text, ascending; with fewer words the whole sequence is one; none without words."""
    w, _, _ = words(text)
    if not len(w):
        return w
    k = min(n, len(w))
    acc = w[: len(w) - k + 1]
    for j in range(1, k):
        acc = mix64(acc * _BASE + w[j : len(w) - k + 1 + j])
    return np.unique(mix64(acc + np.uint64(k)))
