"""Words of whole Arrow text columns as NumPy arrays: where they are and 64-bit hashes of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
CHUNK = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = _mixed(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_LETTER[_SPACE] = 0
_BASE = _U(0x5851F42D4C957F2D)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them), about ``size`` bytes at a time; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, data[offsets[first]: offsets[end]], offsets[first: end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and one past the last) of the words in a chunk."""
    inside = ~_SPACE[data]
    begin, fin = inside.copy(), inside.copy()
    if len(data):
        begin[1:] &= ~inside[:-1]
        fin[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        begin[edge] = inside[edge]
        fin[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(fin) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; white space between words adds nothing."""
    if not len(starts):
        return np.zeros(0, _U)
    data = data[starts[0]: ends[-1]]
    begin = starts - starts[0]
    lengths = np.diff(np.append(begin, len(data)))
    place = np.arange(len(data)) - np.repeat(begin, lengths)
    return _mixed(np.add.reduceat(_LETTER[data] * _powers(int(lengths.max()))[place], begin))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one array of word hashes; runs over the ends of rows are the caller's to skip."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    factor = _U(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            out += words[k: k + n] * factor
            factor = _U((int(factor) * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
    return _mixed(out)
