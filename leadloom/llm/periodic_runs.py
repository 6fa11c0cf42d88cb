"""Runs of repeated words: maximal periodic stretches of a text, found and collapsed.

A run of period q is a maximal stretch of words in which words q apart are equal.
For every order of the alphabet and its reverse, each run holds a Lyndon root: the
longest Lyndon word at some place, which ends where the next smaller (or greater)
suffix begins.  A suffix tree of the words gives the order of all suffixes and, by
lowest common ancestors, how far two places read alike; a tree of the reversal
gives the same backwards.  So two candidates per word, extended in both directions
in constant time each, find all runs.

Trees are built only for regions where runs of the wanted length can lie.  In a
run of period q every word, and every sequence of eight words if q is larger, comes
at most q places after its last occurrence; stretches where that holds for long
enough, for some power of two, cover all runs.  This drops no run, and ordinary
prose has next to no region.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.arrays import mix, pieces

#: Sequences of so many words are looked at for longer periods.
GRAM = 8

#: Bytes of text that a task looks at together; one text at least.
SLICE = 4 << 20
_NEVER = np.iinfo(np.int64).max // 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


# -- suffix trees --------------------------------------------------------------


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of symbols; an end symbol, smaller than all, is added.

    ``rank`` is the place of every suffix in lexicographic order; ``lce`` answers how long two
    suffixes read alike.
    """

    def __init__(self, symbols: Sequence[int]):
        self._text = [*symbols, -1]
        self._build()
        self._tour()

    def _build(self) -> None:
        text = self._text
        n = len(text)
        # Edges belong to the node they lead to: text[start:end] lies above it.
        start, end, link, children = [0], [0], [0], [{}]
        node, edge, length, pending = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            pending += 1
            above = 0
            while pending:
                if not length:
                    edge = i
                below = children[node].get(text[edge])
                if below is None:
                    children[node][symbol] = len(start)
                    start.append(i), end.append(n), link.append(0), children.append(None)
                    if above:
                        link[above] = node
                    above = node
                else:
                    first = start[below]
                    span = min(end[below], i + 1) - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if text[first + length] == symbol:
                        length += 1
                        if above:
                            link[above] = node
                        break
                    split = len(start)
                    start.append(first), end.append(first + length), link.append(0)
                    children.append({text[first + length]: below, symbol: split + 1})
                    children[node][text[edge]] = split
                    start.append(i), end.append(n), link.append(0), children.append(None)
                    start[below] = first + length
                    if above:
                        link[above] = split
                    above = split
                pending -= 1
                if not node and length:
                    length -= 1
                    edge = i - pending + 1
                elif node:
                    node = link[node]
        self._start, self._end, self._children = start, end, children

    def _tour(self) -> None:
        """Leaves in order, and the depth of their lowest common ancestors.

        An Euler tour passes exactly one node between two of its children on the way from a leaf
        to the next: their lowest common ancestor.  Only these turning points are kept; the least
        depth between two leaves is that of their own ancestor, found from minima over powers of two.
        """
        n, start, end, children = len(self._text), self._start, self._end, self._children
        order, turning = [], []
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            if node < 0:
                turning.append(depth)
                continue
            below = children[node]
            if below is None:
                order.append(n - depth)
                continue
            for k, child in enumerate(sorted(below.items(), reverse=True)):
                if k:
                    stack.append((-1, depth))
                child = child[1]
                stack.append((child, depth + end[child] - start[child]))
        del self._start, self._end, self._children
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self._least = [np.array(turning, np.int32)]
        while 2 ** len(self._least) <= len(turning):
            done, half = self._least[-1], 2 ** (len(self._least) - 1)
            self._least.append(np.minimum(done[:-half], done[half:]))

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and at ``b`` (never the same) begin with in common."""
        low, high = self.rank[a], self.rank[b]
        low, high = np.minimum(low, high), np.maximum(low, high)
        out = np.empty(len(low), np.int64)
        level = np.frexp(high - low)[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            least = self._least[k]
            out[at] = np.minimum(least[low[at]], least[high[at] - 2**k])
        return out


def _next(rank: list[int], sign: int) -> np.ndarray:
    """Next place with a smaller (``sign`` 1) or greater (-1) rank, or -1."""
    out, stack = [-1] * len(rank), []
    for i, r in enumerate(rank):
        r *= sign
        while stack and stack[-1][0] > r:
            out[stack.pop()[1]] = i
        stack.append((r, i))
    return np.array(out)


def runs_of(symbols: Sequence[int], least_words: int, least_exponent: int) -> np.ndarray:
    """All runs of at least so many words and periods, as rows ``(start, period, length)``."""
    n = len(symbols)
    ahead, back = SuffixTree(symbols), SuffixTree(symbols[::-1])
    rank = ahead.rank.tolist()
    found = []
    for sign in (1, -1):
        until = _next(rank, sign)[:n]
        i = np.flatnonzero((until >= 0) & (until <= n))
        if sign < 0:
            i = i[until[i] < n]
        period = until[i] - i
        start = i - back.lce(n - i, n - i - period)
        length = i + period + ahead.lce(i, i + period) - start
        whole = length >= np.maximum(least_words, least_exponent * period)
        found.append(np.column_stack([start, period, length])[whole])
    return np.unique(np.concatenate(found), axis=0)


# -- regions -------------------------------------------------------------------


def _since_last(keys: np.ndarray) -> np.ndarray:
    """How many places ago the same key was there."""
    order = np.argsort(keys, kind="stable")
    again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    out = np.full(len(keys), _NEVER)
    out[order[again + 1]] = order[again + 1] - order[again]
    return out


def _regions(words: np.ndarray, first: np.ndarray, least_words: int, least_exponent: int) -> np.ndarray:
    """Disjoint ``(from, to)`` that hold every wanted run; ``first`` says where texts begin."""
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin = np.repeat(first[:-1], np.diff(first))
    keys = mix(text.astype(np.uint64) * _STEP + words.astype(np.uint64))
    since, gram = _since_last(keys), 1
    longest = int(np.diff(first).max(initial=0))
    found = []
    scale = 1
    while (scale // 2 + 1) * least_exponent <= longest:
        if scale == 2 * GRAM:
            # Equal sequences have equal keys; the reverse is not needed here.
            sums = np.zeros(max(n - GRAM + 1, 0), np.uint64)
            for k in range(GRAM):
                sums = sums * _STEP + keys[k : len(sums) + k]
            since, gram = _since_last(mix(sums)), GRAM
            since[text[: len(since)] != text[GRAM - 1 :]] = _NEVER
        periods = np.arange(scale // 2 + 1, scale + 1)
        least = int((np.maximum(least_words, least_exponent * periods) - periods).min()) - gram + 1
        near = np.flatnonzero(since <= scale)
        if len(near):
            cut = np.flatnonzero(np.diff(near) > 1) + 1
            lo, hi = near[np.append(0, cut)], near[np.append(cut - 1, len(near) - 1)]
            long = hi - lo + 1 >= max(least, 1)
            lo, hi = lo[long], hi[long]
            found.append(np.column_stack([np.maximum(lo - scale, begin[lo]), hi + gram]))
        scale *= 2
    if not found:
        return np.zeros((0, 2), np.int64)
    spans = np.concatenate(found)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.append(True, spans[1:, 0] >= reach[:-1])) if len(spans) else np.zeros(0, int)
    return np.column_stack([spans[new, 0], reach[np.append(new[1:] - 1, len(spans) - 1)]]) if len(new) else spans


def _runs_of_texts(
    split: list[list[bytes]], least_words: int, least_exponent: int
) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(text, start, period, length)`` of all runs, sorted, and where texts begin in words."""
    first = np.cumsum([0, *map(len, split)])
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, int(first[-1]))
    rows = [np.zeros((0, 4), np.int64)]
    for lo, hi in _regions(ids, first, least_words, least_exponent).tolist():
        runs = runs_of(ids[lo:hi].tolist(), least_words, least_exponent)
        at = int(np.searchsorted(first, lo, side="right")) - 1
        runs[:, 0] += lo - first[at]
        rows.append(np.column_stack([np.full(len(runs), at), runs]))
    return np.concatenate(rows), first


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run covers after its first period, joined by a space."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 1], 1)
    np.add.at(change, runs[:, 0] + runs[:, 2], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


# -- operator ------------------------------------------------------------------


def find_runs(
    docs: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    least_words: int = 6,
    least_exponent: int = 4,
) -> DataFrame:
    """``keep`` with ``n_words``, ``runs`` and ``collapsed`` of every text.

    Words are separated by ASCII white space.  ``runs`` are ``(start, length, period)`` in
    words, by start, then period: all runs of ``least_words`` words and ``least_exponent`` (2 or
    more) periods at least.  ``collapsed`` is the text's words joined by one space, of each run
    only the first period.  Null and empty texts have no words; repeated rows are looked at each;
    other columns are not read; an empty table gives an empty one.  Texts of any length are whole:
    a task holds one text and the trees of one region, about 700 bytes a word of the region.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    # Kept columns may be called like ours, so they travel under numbers.
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in (*keep, text)]
    rows = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(quoted[:-1])), quoted[-1].alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in pieces(batch.column(batch.num_columns - 1), SLICE):
                raw, at = data.tobytes(), offsets.tolist()
                split = [raw[a:b].split() for a, b in zip(at, at[1:])]
                runs, _ = _runs_of_texts(split, least_words, least_exponent)
                bounds = np.searchsorted(runs[:, 0], np.arange(len(split) + 1))
                shorter = [
                    _collapsed(words, runs[a:b, 1:]) if a < b else b" ".join(words)
                    for words, a, b in zip(split, bounds.tolist(), bounds[1:].tolist())
                ]
                listed = pa.ListArray.from_arrays(
                    pa.array(bounds, pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(runs[:, k]) for k in (1, 3, 2)], ["start", "length", "period"]
                    ),
                )
                kept = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns[:-1], pa.array(list(map(len, split)), pa.int64()), listed,
                     pa.array(shorter, pa.binary()).cast(pa.string())],
                    [*kept.schema.names[:-1], "n_words", "runs", "collapsed"],
                )

    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    found = rows.mapInArrow(search, f"{fields}n_words bigint, runs {_RUN}, collapsed string")
    return found.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_words", "runs", "collapsed"
    )
