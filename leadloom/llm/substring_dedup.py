"""Repeated passages removed by a join of all windows of ``WINDOW`` words on their hashes.

A word is a repeat if it lies in a window that a document with a smaller id has too.
This takes the place of a greedy relative Lempel-Ziv parse, which is not built: what is
removed needs to know whether a smaller document has a window, not which one has
the longest match, and the join keeps one id per window where a parse needs all
documents that have it.  Runs of windows are not longest matches: each window refers to
the smallest document that has it, and neighbours with the same one are one run.

Windows meet by blocks that the content chooses: of every ``WINDOW`` consecutive words, the
block of ``BLOCK`` words with the least hash.  Equal windows choose equal blocks, so
everything that may match meets in the bucket of its block, and the windows around a
block travel as one run.  In its bucket every window finds the smallest document that has
it; a document's runs are put together in the end, where those that go on in the next
bucket join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.arrays import (
    bucket_of,
    group_starts,
    ngrams,
    pieces,
    ranges,
    sliding,
    text_of_word,
    words,
)
from leadloom.llm.tables import bounded_batches, parts_for

WINDOW = 50
#: Words of a reference block; every window holds WINDOW - BLOCK + 1 of them.
BLOCK = 26
#: Bytes of text whose windows meet in one bucket, on average.
BUCKET_BYTES = 3 << 20
_PIECE = 1 << 20
#: Windows of a bucket that are sorted at once.
_WINDOWS = 1 << 19
_NO_ID = np.iinfo(np.int64).max

_PACKED = (
    "bucket int, ids binary, twins binary, starts binary, sizes binary, hashes binary, refs binary"
)
_RUN = "id bigint, twin int, start bigint, size bigint, ref bigint"


def blocks_of_windows(first: np.ndarray, hashes: np.ndarray, window: int, block: int):
    """Hash of the window from each word on, the block it chooses, and whether it is whole."""
    wide, whole = ngrams(first, hashes, window)
    narrow, _ = ngrams(first, hashes, block)
    chosen = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= window:
        least = sliding(narrow, window - block + 1)
        chosen[: len(least)] = least
    return wide, chosen, whole


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of runs, given whether each place begins a new one."""
    start = np.flatnonzero(breaks)
    return start, np.diff(np.append(start, len(breaks)))


def _pack_batch(batch: pa.RecordBatch, buckets: int, window: int, block: int) -> Iterator[dict]:
    """Runs of windows by bucket.  Of windows that a batch repeats, only the smallest id's go on."""
    ids = batch.column("id").to_numpy()
    twins = batch.column("twin").to_numpy()
    parts = []
    for rows, data, offsets in pieces(batch.column("text"), _PIECE):
        first, hashes = words(data, offsets)
        wide, chosen, whole = blocks_of_windows(first, hashes, window, block)
        at = np.flatnonzero(whole)
        row = text_of_word(first)[at]
        parts.append(
            ((row + rows.start).astype(np.int32), (at - first[row]).astype(np.int32), wide[at], chosen[at])
        )
    if not parts or not sum(len(p[0]) for p in parts):
        return
    row, start, wide, chosen = (np.concatenate(x) for x in zip(*parts))
    del parts
    least = ids[row]
    order = np.argsort(wide, kind="stable")
    opens = group_starts(wide[order])
    size = np.diff(np.append(opens, len(order)))
    # Only windows that occur twice or more in the batch need a comparison.
    many = size > 1
    place = order[ranges(opens[many], size[many])]
    if len(place):
        head = np.cumsum(size[many]) - size[many]
        least[place] = np.repeat(np.minimum.reduceat(ids[row[place]], head), size[many])
    known = least < ids[row]

    def breaks(mask, *same):
        """Whether each masked place begins a run of one text and of equal values."""
        r, s = row[mask], start[mask]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)
        for x in same:
            new[1:] |= x[mask][1:] != x[mask][:-1]
        return new

    # Resolved here: runs that stand in a document of the same batch.
    done = np.flatnonzero(known)
    if len(done):
        a, n = _runs(breaks(done, least))
        yield {
            "bucket": int(wide[0] % np.uint64(buckets)),
            "ids": ids[row[done[a]]], "twins": twins[row[done[a]]],
            "starts": start[done[a]], "sizes": n, "hashes": np.zeros(0, np.uint64),
            "refs": least[done[a]],
        }
    rest = np.flatnonzero(~known)
    if not len(rest):
        return
    a, n = _runs(breaks(rest, chosen))
    to = bucket_of(chosen[rest[a]], buckets)
    order = np.argsort(to, kind="stable")
    edge = np.append(group_starts(to[order]), len(order))
    for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
        some = order[low:high]
        yield {
            "bucket": int(to[some[0]]),
            "ids": ids[row[rest[a[some]]]], "twins": twins[row[rest[a[some]]]],
            "starts": start[rest[a[some]]], "sizes": n[some],
            "hashes": wide[rest[ranges(a[some], n[some])]], "refs": np.zeros(0, np.int64),
        }


_TYPES = {
    "ids": np.int64, "twins": np.int32, "starts": np.int32, "sizes": np.int32,
    "hashes": np.uint64, "refs": np.int64,
}


def _numbers(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all packed rows, one behind the other, and how many each row has."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4)
    size = np.dtype(kind).itemsize
    n = int(at[-1] - at[0]) // size
    # A copy, since the batch goes.
    return (np.frombuffer(data, kind, n, int(at[0])).copy() if n else np.zeros(0, kind)), np.diff(at) // size


def _repeated(ids: np.ndarray, run: np.ndarray, hashes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows that a smaller id has too, in order, and the smallest id that has each.

    Windows are compared a range of hashes at a time, about ``most`` of them, so that a bucket
    which many windows chose takes no more memory to sort than others.
    """
    places, refs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    parts = -(-len(hashes) // most)
    for p in range(parts):
        low, high = (p << 64) // parts, ((p + 1) << 64) // parts - 1
        some = np.flatnonzero((hashes >= np.uint64(low)) & (hashes <= np.uint64(high)))
        if not len(some):
            continue
        some = some[np.argsort(hashes[some], kind="stable")]
        opens = group_starts(hashes[some])
        mine = ids[run[some]]
        least = np.repeat(np.minimum.reduceat(mine, opens), np.diff(np.append(opens, len(some))))
        known = least < mine
        places.append(some[known])
        refs.append(least[known])
    place, ref = np.concatenate(places), np.concatenate(refs)
    order = np.argsort(place, kind="stable")
    return place[order], ref[order]


def _matched(batches: Iterator[pa.RecordBatch], most: int = _WINDOWS) -> Iterator[pa.RecordBatch]:
    """Repeats of one bucket: runs of windows with the same smaller reference."""
    held: dict[str, list] = {name: [np.zeros(0, t)] for name, t in _TYPES.items()}
    for batch in batches:
        got = {name: _numbers(batch.column(name), t) for name, t in _TYPES.items()}
        runs = got["ids"][1]
        done = np.repeat(got["refs"][1] > 0, runs)
        if done.any():
            # Resolved where it was packed.
            yield _run_batch(*(got[k][0][done] for k in ("ids", "twins", "starts", "sizes")), got["refs"][0])
        for name in ("ids", "twins", "starts", "sizes"):
            held[name].append(got[name][0][~done])
        held["hashes"].append(got["hashes"][0])
        del batch, got
    ids, twins, starts, sizes, hashes = (np.concatenate(held.pop(k)) for k in ("ids", "twins", "starts", "sizes", "hashes"))
    sizes = sizes.astype(np.int64)
    run = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place, ref = _repeated(ids, run, hashes, most)
    del hashes
    own = run[place]
    new = np.ones(len(place), bool)
    new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1) | (ref[1:] != ref[:-1])
    a, n = _runs(new)
    r = own[a]
    yield _run_batch(ids[r], twins[r], starts[r] + (place[a] - (np.cumsum(sizes) - sizes)[r]), n, ref[a])


def _run_batch(*columns: np.ndarray) -> pa.RecordBatch:
    types = (np.int64, np.int32, np.int64, np.int64, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(c.astype(t)) for c, t in zip(columns, types)], ["id", "twin", "start", "size", "ref"]
    )


def repeated_runs(
    docs: DataFrame, window: int = WINDOW, block: int = BLOCK, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of runs: ``size`` windows from word ``start`` on stand in document ``ref``, the smallest.

    Rows are ``id, twin, start, size, ref``; ``twin`` hashes the text, for rows that
    share an id.  A null id is the largest of all, so such rows refer to others but
    not to each other.
    """
    bounded_batches(docs.sparkSession)
    buckets = parts_for(docs, text, BUCKET_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _pack_batch(batch, buckets, window, block):
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array([row["bucket"]], pa.int32())}
                    | {k: pa.array([row[k].astype(t).tobytes()], pa.binary()) for k, t in _TYPES.items()}
                )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A bucket comes in batches of bounded size, so it is never held as Arrow and numpy at once.
        yield from _matched(batches)

    return (
        _keyed(docs, id_column, text)
        .mapInArrow(pack, _PACKED)
        .groupBy("bucket")
        .applyInArrow(match, _RUN)
    )


def _keyed(docs: DataFrame, id_column: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(int(_NO_ID))).alias("id"),
        F.hash(body).alias("twin"), body.alias("text"),
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
    )


def join_runs(n_words: int, found: list[dict], window: int = WINDOW) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """A document's runs ``(start, words, ref)`` in order, and which words they cover.

    Pieces that follow each other with the same reference are one run; runs of different references may overlap.
    """
    joined: list[list[int]] = []
    covered = np.zeros(n_words + 1, np.int64)
    for piece in sorted(found, key=lambda p: p["start"]):
        start, size, ref = piece["start"], piece["size"], piece["ref"]
        if joined and joined[-1][2] == ref and joined[-1][0] + joined[-1][1] == start:
            joined[-1][1] += size
        else:
            joined.append([start, size, ref])
    for start, size, _ in joined:
        covered[start] += 1
        covered[start + size + window - 1] -= 1
    return [(s, n + window - 1, r) for s, n, r in joined], np.cumsum(covered[:-1]) > 0


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    block: int = BLOCK,
    id_column: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
    texts: bool = True,
) -> DataFrame:
    """Every document without the words that its repeated runs cover.

    Returns ``id_column, n_words, n_removed, kept_sha256`` (of the kept words joined by one space) and
    ``keep``; with ``texts`` also ``kept`` (these joined words, or the text as it is if none
    goes) and ``factors`` (start, words, ref).  These are no Lempel-Ziv factors, whatever the name: runs
    of windows with the same smallest document, no longest matches, and they may overlap.  A word goes if it lies in ``window`` consecutive words that also start in a document
    with a smaller id; windows are judged on the input.  A null or empty text has no words.
    Rows of equal ids leave each other alone; null ids are the largest.  An
    empty table gives an empty one.
    """
    found = (
        repeated_runs(docs, window, block, id_column, text)
        .groupBy("id", "twin")
        .agg(F.collect_list(F.struct("start", "size", "ref")).alias("found"))
    )
    rows = _keyed(docs, id_column, text, (id_column, *keep)).join(found, ["id", "twin"], "left")
    rows = rows.select("text", "found", *(f"k{i}" for i in range(len(keep) + 1)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept", "factors")}
            for body, pieces_ in zip(batch.column("text"), batch.column("found").to_pylist()):
                own = body.as_py().encode().split()
                parsed, n = [], len(own)
                if pieces_:
                    parsed, covered = join_runs(n, pieces_, window)
                    own = [own[i] for i in np.flatnonzero(~covered)]
                left = b" ".join(own)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(own))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                if texts:
                    out["kept"].append(left.decode() if n > len(own) else body.as_py())
                    out["factors"].append([{"start": s, "words": w, "ref": r} for s, w, r in parsed])
            names = [*batch.schema.names[2:], "n_words", "n_removed", "kept_sha256"]
            arrays = [
                *batch.columns[2:], pa.array(out["n_words"], pa.int64()),
                pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()),
            ]
            if texts:
                names += ["kept", "factors"]
                item = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref", pa.int64())])
                arrays += [pa.array(out["kept"], pa.string()), pa.array(out["factors"], pa.list_(item))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[2:])
    fields += ", n_words bigint, n_removed bigint, kept_sha256 string"
    if texts:
        fields += ", kept string, factors array<struct<start: bigint, words: bigint, ref: bigint>>"
    made = rows.mapInArrow(cut, fields)
    extra = ("kept", "factors") if texts else ()
    return made.select(
        F.col("k0").alias(id_column), "n_words", "n_removed", "kept_sha256",
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep, 1)], *extra,
    )
