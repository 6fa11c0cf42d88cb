"""Words, n-gram hashes and ragged arrays over Arrow batches, all in numpy.

A batch of texts is one byte array with offsets.  Hashes are polynomials modulo
the prime 2**61 - 1 at random points: two different spans of n symbols collide for
at most n of the points, whatever the texts hold.  A final mix spreads the bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PRIME = 2**61 - 1
_P, _LOW, _HALF = U64(PRIME), U64(2**31 - 1), U64(2**30 - 1)
_STEP = np.random.default_rng(20250101)
#: Points: two for bytes, one for words.
_POINTS = [int(x) for x in _STEP.integers(2**60, PRIME, 3)]
_WORDS = 2
#: Bytes of a symbol, and symbols that are worked on at once.
_BYTES = 7
_SLICE = 1 << 18
_MASK = np.array([256**k - 1 for k in range(_BYTES + 1)], U64)
_TOP = np.array([256**k for k in range(_BYTES + 1)], U64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Every bit of the input reaches every bit of the output; one to one."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _mod(x: np.ndarray) -> np.ndarray:
    """Any 64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> U64(61))
    # Below the prime the difference wraps around and is the larger one.
    return np.minimum(x, x - _P)


def _times(x: np.ndarray, factor: int) -> np.ndarray:
    """Residues times a number below the prime, modulo the prime."""
    return _times_each(x, U64(factor & (2**31 - 1)), U64(factor >> 31))


def _times_each(x: np.ndarray, f0, f1) -> np.ndarray:
    """The same with factors given as their low 31 bits and the rest."""
    x1, x0 = x >> U64(31), x & _LOW
    middle = x1 * f0 + x0 * f1
    # 2**61 is 1 modulo the prime.
    return _mod(((x1 * f1) << U64(1)) + (middle >> U64(30)) + ((middle & _HALF) << U64(31)) + x0 * f0)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """``low + high * 2**31`` of any 64-bit numbers, modulo the prime."""
    high = _mod(high)
    return _mod(_mod(low) + (high >> U64(30)) + ((high & _HALF) << U64(31)))


@functools.lru_cache(maxsize=8)
def _powers(point: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a point from 0 on, as their low 31 bits and the rest."""
    out = np.ones(size, U64)
    have = 1
    while have < size:
        step = pow(_POINTS[point], have, PRIME)
        out[have : 2 * have] = _times(out[: min(have, size - have)], step)
        have *= 2
    return out & _LOW, out >> U64(31)


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, point: int = 0) -> np.ndarray:
    """Hash of every span of bytes; ``point`` 0 or 1 for independent ones.

    Symbols are seven bytes each, the last one as many as are left, with a bit on top that
    tells how many these are.
    """
    out = np.zeros(len(start), U64)
    padded = np.append(data, np.zeros(8, np.uint8))
    # The eight bytes from every place on, as one number.
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    symbols = (end - start + _BYTES - 1) // _BYTES
    reach = np.cumsum(symbols)
    low, high = _powers(point, 1 << int(symbols.max(initial=1)).bit_length())
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _SLICE, side="right")))
        n = symbols[at:to]
        place = ranges(np.zeros(len(n), np.int64), n)
        begin = np.repeat(start[at:to], n) + _BYTES * place
        held = np.minimum(np.repeat(end[at:to], n) - begin, _BYTES)
        value = (eight[begin] & _MASK[held]) | _TOP[held]
        more = np.flatnonzero(place)
        if len(more):
            value[more] = _times_each(value[more], low[place[more]], high[place[more]])
        some = np.flatnonzero(n)
        if len(some) == len(value):  # one symbol each, as most words are
            out[at:to][some] = value
        elif len(some):
            first = (np.cumsum(n) - n)[some]
            out[at:to][some] = _joined(
                np.add.reduceat(value & _LOW, first), np.add.reduceat(value >> U64(31), first)
            )
        at = to
    return mix(out)


def sequence_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from ``start`` to ``end``, a few each; the same as ``ngrams`` gives."""
    x, out = _mod(hashes), np.zeros(len(start), U64)
    for k in range(int((end - start).max(initial=0))):
        some = np.flatnonzero(start + k < end)
        out[some] = _mod(out[some] + _times(x[start[some] + k], pow(_POINTS[_WORDS], k, PRIME)))
    return mix(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins (one more than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - offsets[0]


def pieces(column: pa.Array, limit: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a column in slices of about ``limit`` bytes, one row at least."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield slice(at, to), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False, spans: bool = False
) -> tuple[np.ndarray, ...]:
    """First word of each text (one more than texts) and the hash of every word.

    Words are runs of bytes other than ASCII white space; ``lower`` hashes A-Z
    as a-z; ``spans`` adds where words start and end.
    """
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    hashes = byte_hashes(LOWER[data] if lower else data, start, end)
    return (first, hashes, start, end) if spans else (first, hashes)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Texts cut before each run of ASCII white space: text starts, hash, start, end.

    ``first`` says which segment each text begins with.
    """
    n = len(data)
    space = SPACE[data]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(begins)
    end = np.append(start[1:], n) if len(start) else start
    return np.searchsorted(start, offsets), byte_hashes(data, start, end), start, end


def ngrams(first: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether its text has so many left."""
    n = len(hashes)
    last = np.repeat(first[1:], np.diff(first))
    whole = np.arange(n) + k <= last
    out = np.zeros(n, U64)
    if n < k:
        return out, whole
    # Sequences of one, two, four, ... words, and those of k put together from them.
    base, size = _mod(hashes), 1
    found, length, rest = None, 0, k
    while rest:
        if rest & 1:
            if found is None:
                found = base
            else:
                m = min(len(found), len(base) - length)
                found = _mod(found[:m] + _times(base[length : length + m], pow(_POINTS[_WORDS], length, PRIME)))
            length += size
        rest >>= 1
        if rest:
            base = _mod(base[:-size] + _times(base[size:], pow(_POINTS[_WORDS], size, PRIME)))
            size *= 2
    out[: n - k + 1] = mix(found[: n - k + 1])
    return out, whole


def text_of_word(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0]+1, ... for ``length[0]``, then the next range."""
    length = np.asarray(length, np.int64)
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(np.asarray(start, np.int64) - before, length)


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket 0 to ``buckets`` - 1 of hashed keys, by their high bits."""
    return ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Least (or ``best``) of the ``width`` values from each place on; short ends are cut off."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = best(out[: len(out) - have], out[have:]), have * 2
    rest = width - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out
