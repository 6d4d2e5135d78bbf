"""Words, shingles and their 64-bit hashes, vectorised over the bytes of a text.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. A word's hash is a
multilinear hash of its bytes with a multiplier for each position, then mixed.
"""

from __future__ import annotations

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_WORDLIKE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in _LOWER)
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_SLICE = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_at = mix(np.arange(1, 65, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def _multipliers(n: int) -> np.ndarray:
    global _at
    if n > len(_at):
        _at = mix(np.arange(1, 2 * n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    return _at


def lowered(text: str | None, marks: bool = True) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER if marks else _WORDLIKE)


def _hash_slice(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    inside = ~_GAP[a]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, _U)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(first, append=len(at))
    position = np.arange(len(at)) - np.repeat(first, lengths)
    terms = (a[at].astype(_U) + _U(1)) * _multipliers(int(lengths.max()))[position]
    return mix(np.add.reduceat(terms, first) + lengths.astype(_U) * _U(0x9E3779B97F4A7C15))


def word_hashes(texts: list[str | None], marks: bool = True) -> list[np.ndarray]:
    """The hashes of each text's words, in order; without marks, ASCII punctuation divides words as white space does."""
    out, batch, size = [], [], 0

    def flush() -> None:
        nonlocal batch, size
        if batch:
            hashes = _hash_slice(b"\n".join(batch))
            counts = [len(x.split()) for x in batch]
            out.extend(np.split(hashes, np.cumsum(counts)[:-1]))
            batch, size = [], 0

    for text in texts:
        data = lowered(text, marks)
        if len(data) > _SLICE:
            flush()
            out.append(_hash_long(data))
        else:
            batch.append(data)
            size += len(data)
            if size > _SLICE:
                flush()
    flush()
    return out


def _hash_long(data: bytes) -> np.ndarray:
    parts, start = [], 0
    while start < len(data):
        end = min(len(data), start + _SLICE)
        while end < len(data) and not _GAP[data[end]]:
            end += 1
        parts.append(_hash_slice(data[start:end]))
        start = end
    return np.concatenate(parts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words: of the whole sequence; no word: none."""
    n = len(words)
    if n == 0:
        return np.empty(0, _U)
    width = min(k, n)
    h = np.full(n - width + 1, _U(width))
    for i in range(width):
        h = mix(h * _U(0x9E3779B97F4A7C15) + words[i : n - width + 1 + i])
    return np.unique(h)
