"""Token ids of many texts from the ids of their distinct segments.

A byte-level tokenizer whose split pattern begins every piece that holds white
space with that white space gives the same ids if texts are cut before each run
of white space.  Each distinct segment of a batch is then tokenised once, and
texts are put together from the ids by array operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

from leadloom.llm.arrays import SPACE, ranges, segments

# White space beyond ASCII (Unicode White_Space) could join a run that is cut
# at ASCII white space alone; texts that hold any of it are not cut.
_WIDE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
)
#: Bytes that are compared at once.
_COMPARED = 1 << 20
#: Bytes of segments that are compared eight bytes at once, and masks of their last bytes.
_SHORT = 64
_MASK = np.array([256**k - 1 for k in range(9)], np.uint64)
#: Numbers that are put together at once.
_GATHERED = 1 << 18
#: Segments that are encoded as one text.
_JOINED = 1000
_BLANK = np.flatnonzero(SPACE).astype(np.uint8).tobytes()
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _equal(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> bool:
    """Whether every segment holds the same bytes as the ``other`` one named for it."""
    length = end - start
    if (length != length[other]).any():
        return False
    twin = start[other]
    # Short ones by eight bytes at once, long ones byte by byte.
    some = np.flatnonzero((start != twin) & (length <= _SHORT))
    eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    for at in range(0, _SHORT, 8):
        some = some[length[some] > at]
        differ = eight[start[some] + at] ^ eight[twin[some] + at]
        if (differ & _MASK[np.minimum(length[some] - at, 8)]).any():
            return False
    some = np.flatnonzero((start != twin) & (length > _SHORT))
    start, twin, length = start[some], twin[some], length[some]
    reach = np.cumsum(length)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + _COMPARED, side="right")))
        n = length[at:to]
        if (data[ranges(start[at:to], n)] != data[ranges(twin[at:to], n)]).any():
            return False
        at = to
    return True


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Distinct segments of the texts.

    Returns which segment each text begins with, the distinct segment of every
    segment, and the distinct segments as strings.
    """
    first, which, names = cut_bytes(data, offsets)
    return first, which, [name.decode() for name in names]


def cut_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The same with the distinct segments as UTF-8."""
    first, hashes, start, end = segments(data, offsets)
    maybe = np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(_LEAD[data]), offsets)) > 0)
    whole = [
        i for i in maybe.tolist()
        if offsets[i] < offsets[i + 1] and _WIDE.search(data[offsets[i] : offsets[i + 1]].tobytes())
    ]
    if whole:
        keep = np.ones(len(start), bool)
        for i in whole:
            keep[first[i] + 1 : first[i + 1]] = False
            end[first[i]] = offsets[i + 1]
            hashes[first[i]] = np.uint64(hash(data[offsets[i] : offsets[i + 1]].tobytes()) % 2**64)
        first = np.append(0, np.cumsum(keep))[first]
        hashes, start, end = hashes[keep], start[keep], end[keep]
    raw = data.tobytes()
    which = pa.array(hashes).dictionary_encode().indices.to_numpy().astype(np.int64)
    at = np.empty(int(which.max(initial=-1)) + 1, np.int64)
    at[which[::-1]] = np.arange(len(which))[::-1]
    if not _equal(data, start, end, at[which]):
        # Two segments share a hash: tell them apart by themselves.
        known: dict[bytes, int] = {}
        which = np.array(
            [known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist())], np.int64
        )
        return first, which, list(known)
    names = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
    return first, which, names


def flatten(parts: list[bytes], kind=np.int32) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some byte strings of them, and how many each holds."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), lengths


def gather(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the lists ``which``, and where each begins in it (one more than lists)."""
    own = lengths[which]
    begin, edge = (np.cumsum(lengths) - lengths)[which], np.append(0, np.cumsum(own))
    out = np.empty(int(edge[-1]), flat.dtype)
    at = 0
    while at < len(which):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + _GATHERED, side="right")) - 1)
        out[edge[at] : edge[to]] = flat[ranges(begin[at:to], own[at:to])]
        at = to
    return out, edge


class Known:
    """Lists of numbers that belong to strings, made once for a worker as long as there is room.

    Strings may be given as their UTF-8 throughout; ``make`` gets them as they are given.
    It gives the lists of some strings, for each of ``kinds`` as all numbers and how many
    each string has.  ``lists`` holds them so.  Once there are more than ``entries`` strings, or
    more than ``size`` bytes of strings and numbers, all go before the next call.
    """

    def __init__(
        self, make: Callable[[list], list[tuple[np.ndarray, np.ndarray]]], kinds: tuple = (np.int32,),
        entries: int = 800_000, size: int = 128 << 20,
    ):
        self.make, self.kinds, self.entries, self.size = make, kinds, entries, size
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str | bytes, int] = {}
        self.characters = 0
        self.lists = [(np.zeros(0, kind), np.zeros(0, np.int64)) for kind in self.kinds]

    def __call__(self, names: list[str] | list[bytes]) -> np.ndarray:
        """Which of ``lists`` belongs to each string."""
        if len(self.place) > self.entries or self.characters + sum(x.nbytes for x, _ in self.lists) > self.size:
            self._forget()
        at = np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            n = len(self.place)
            added = [names[i] for i in new.tolist()]
            self.lists = [
                (np.concatenate([flat, more]), np.concatenate([lengths, own]))
                for (flat, lengths), (more, own) in zip(self.lists, self.make(added), strict=True)
            ]
            self.place.update(zip(added, range(n, n + len(added))))
            self.characters += sum(map(len, added))
            at[new] = np.arange(n, n + len(added))
        return at


def tokenize(data: np.ndarray, offsets: np.ndarray, known: Known) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text begins; ``known`` holds 32-bit ids."""
    first, which, names = cut_bytes(data, offsets)
    at = known(names)[which]
    ids, begin = gather(*known.lists[0], at)
    return ids, begin[first]


def joined(
    encode: Callable[[list[str]], list[list[int]]], size: np.ndarray
) -> Callable[[list], list[tuple[np.ndarray, np.ndarray]]]:
    """Ids of distinct segments, given as strings or their UTF-8, by an ``encode`` for texts that costs much for each text.

    Segments that begin with white space and go on after it may stand behind each other, as they
    do in texts, and are encoded together.  ``size`` tells the bytes of every id, and so
    which ids are whose.  Where ids do not end with the segments, as some special tokens or
    normalising would have it, every segment is encoded by itself.
    """

    def make(names: list) -> list[tuple[np.ndarray, np.ndarray]]:
        raw = [name if isinstance(name, bytes) else name.encode() for name in names]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        some = [i for i, name in enumerate(raw) if name[0] in _BLANK and not name.isspace()]
        groups = [some[i : i + _JOINED] for i in range(0, len(some), _JOINED)]
        texts = [b"".join([raw[i] for i in g]) for g in groups]
        narrow = [i for i, text in enumerate(texts) if not _WIDE.search(text)]
        groups, texts = [groups[i] for i in narrow], [texts[i].decode() for i in narrow]
        order, ids, counts = [], [], []
        for group, found in zip(groups, encode(texts)):
            found = np.array(found, np.int32)
            ends, want = np.cumsum(size[found]), np.cumsum(length[group])
            last = np.searchsorted(ends, want)
            if len(ends) and ends[-1] == want[-1] and (ends[last] == want).all():
                order += group
                ids.append(found)
                counts.append(np.diff(last, prepend=-1))
        rest = np.ones(len(names), bool)
        rest[order] = False
        alone = np.flatnonzero(rest).tolist()
        for found in encode([raw[i].decode() for i in alone]):
            ids.append(np.array(found, np.int32))
            counts.append([len(found)])
        place = np.empty(len(names), np.int64)
        place[order + alone] = np.arange(len(names))
        counts = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
        return [(gather(np.concatenate([*ids, np.zeros(0, np.int32)]), counts, place)[0], counts[place])]

    return make
