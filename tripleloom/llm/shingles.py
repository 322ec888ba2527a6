"""Character streams and rolling hashes of whole Arrow batches in NumPy."""

from __future__ import annotations

import unicodedata

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = "\x00"


def _alnum_table() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for o in range(0x110000):
        if chr(o).isalnum():
            table[o] = True
    return table


_ALNUM: list[np.ndarray] = []


def alnum_table() -> np.ndarray:
    if not _ALNUM:
        _ALNUM.append(_alnum_table())
    return _ALNUM[0]


def folded(text: str | None) -> str:
    """``text`` in NFKC and lower case."""
    if not text:
        return ""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return text.lower()


def stream(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the offset at which each text begins (one more at the end).

    With ``keep``, a table over code points, only kept ones are in the stream.
    """
    joined = _SEPARATOR.join(folded(t).replace(_SEPARATOR, " ") for t in texts) + _SEPARATOR
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 0)
    mask = np.ones(len(codes), bool) if keep is None else keep[codes]
    mask[ends] = False
    before = np.concatenate(([0], np.cumsum(mask)))
    return codes[mask], np.concatenate(([0], before[ends]))


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every run of ``width`` codes, by its first position.

    Runs may cross from one text into the next; ``inside`` tells which don't.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    out = wide[:n].copy()
    for i in range(1, width):
        out *= _BASE
        out += wide[i : i + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def inside(offsets: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of runs of each text, and the index of the first."""
    size = np.maximum(np.diff(offsets) - width + 1, 0)
    return size, np.minimum(offsets[:-1], n)
