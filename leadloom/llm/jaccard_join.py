"""Near-duplicate documents: an exact Jaccard self-join of their shingle sets.

Sets of similar size form a band.  For a band the universe of shingles is cut by
a hash into m segments.  Two sets whose Jaccard similarity reaches the threshold
differ in at most H shingles, so if a set spends more than H units on its segments,
one unit on "equal" and two on "equal up to one deletion", at least one of
the segments keeps what was paid for (pigeonhole).  Signatures are hashes of a
segment's subset, for some segments also of each subset with one element deleted.

Allocation follows cost.  How many segments a band has, and how many get deletions, is chosen
by expected signatures and empty segments.  Which units a set spends is chosen by
what the index shows: signatures that many sets share (passages that stand in
many documents) are left out as long as its other units suffice.  Groups that have to
be used nevertheless are groups of near copies.  For components they are linked through one
member first, and only members that stay unconnected are compared pairwise; ``links``
compares all their members, in blocks.

Every set has a parity bitmap: of each place that shingles hash to, whether an odd number did.  Two sets
differ in at least as many shingles as their bitmaps do in places, so bitmaps rule pairs out without
loss, at a thirtieth of the sets' bytes.  What is left is verified on the whole sets, so links
are exact up to collisions of 64-bit hashes.  Equal sets are one set throughout.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leadloom.llm.arrays import (
    U64,
    bucket_of,
    group_starts,
    mix,
    ngrams,
    pieces,
    ranges,
    sequence_hashes,
    text_of_word,
    words,
)
from leadloom.llm.components import components, extended
from leadloom.llm.tables import bounded_batches, parts_for
from leadloom.sources.scratch import materialize

SHINGLE = 5
PERCENT = 80
#: Groups of a signature up to this size give all their pairs.
SMALL_GROUP = 8
#: What an empty segment costs, in signatures.
EMPTY_COST = 64
#: Rounds in which groups of near copies are linked through one member.
STAR_ROUNDS = 3
#: Members and shingles that a block of a large group holds, on average at most.
BLOCK_SETS = 128
BLOCK_SHINGLES = 1 << 19
#: The same for blocks that compare bitmaps only.
MAP_SETS = 1024
MAP_SHINGLES = 1 << 23
BUCKET_BYTES = 8 << 20
_PIECE = 1 << 20
_NO_ID = np.iinfo(np.int64).max
_SEED = [U64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


@functools.lru_cache(maxsize=1)
def _edges() -> np.ndarray:
    """Least size of each band; sizes grow by half."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return np.array(edges, np.int64)


def band_of(size):
    return np.searchsorted(_edges(), size, side="right") - 1


def units_needed(size, high, percent: int):
    """More units than shingles that a set and a linked one (no larger, at most ``high``) differ in."""
    return (np.minimum(size, high) + size) * (100 - percent) // (100 + percent) + 1


@functools.lru_cache(maxsize=1024)
def allocation(band: int, percent: int) -> tuple[int, int]:
    """Segments of a band, and how many of them also get deletions; 0 where only equal sets link."""
    low, high = int(_edges()[band]), int(_edges()[band + 1]) - 1
    largest = high * 100 // percent
    need = int(units_needed(largest, high, percent))
    if need == 1:
        return 0, 0
    best = None
    for units in range(need, need + max(2, need // 10) + 1):
        for wide in range(0, min(units // 2, max(4, units // 16)) + 1):
            m = units - wide
            empty = m * math.exp(-largest / m)
            cost = m + wide * (low + high) / 2 / m
            cost += EMPTY_COST * max(0.0, empty + 3 * math.sqrt(empty) - (units - need))
            if best is None or cost < best[0]:
                best = cost, m, wide
    return best[1], best[2]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Text and hash of every distinct shingle, sorted by both; sizes and keys of the sets."""
    first, hashes = words(data, offsets, lower=True)
    grams, whole = ngrams(first, hashes, k)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < k))
    text = np.concatenate([text_of_word(first)[whole], short])
    gram = np.concatenate([grams[whole], sequence_hashes(hashes, first[short], first[short + 1])])
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    text, gram = text[new], gram[new]
    size = np.bincount(text, minlength=len(count))
    key = np.zeros(len(count), U64)
    some = np.flatnonzero(size)
    if len(some):
        key[some] = np.add.reduceat(mix(gram ^ _SEED[0]), group_starts(text))
    return text, gram, size, mix(key + size.astype(U64) * _SEED[1])


def signatures(text, gram, size, percent: int, with_empty: frozenset[int]):
    """Per band that a set takes part in: its records, and signatures with their record.

    Yields ``(texts, band, own, units, need, signature, record)``.  The lowest bit of a
    signature tells that its segment gets deletions.  Empty subsets are signatures
    only in the bands ``with_empty``; elsewhere they count no units.
    """
    some = np.flatnonzero(size)
    own = band_of(size[some])
    lowest = band_of(-(-size[some] * percent // 100))
    plan = np.array([allocation(b, percent) for b in range(int(own.max(initial=0)) + 1)], np.int64)
    filled = np.array([b in with_empty for b in range(len(plan))], bool)
    segment_hash, value = mix(gram + _SEED[1]), mix(gram ^ _SEED[2])
    for step in range(int((own - lowest).max(initial=-1)) + 1):
        takes = (own - step >= lowest) & (plan[own - step, 0] > 0)
        texts, band = some[takes], own[takes] - step
        if not len(texts):
            continue
        m, wide = plan[band].T
        record_of = np.full(len(size), -1)
        record_of[texts] = np.arange(len(texts))
        mine = record_of[text] >= 0
        record, v = record_of[text[mine]], value[mine]
        base = np.cumsum(m) - m
        segment = bucket_of(segment_hash[mine], m[record].astype(U64))
        at = base[record] + segment
        content = np.zeros(int(m.sum()), U64)
        np.add.at(content, at, v)
        count = np.bincount(at, minlength=len(content))
        owner = np.repeat(np.arange(len(texts)), m)
        number = np.arange(len(content)) - base[owner]
        tag = band[owner].astype(U64) * _SEED[0] + number.astype(U64) * _SEED[1]
        is_wide = number < wide[owner]
        full = filled[band[owner]]
        units = np.where(is_wide & ((count > 1) | full), 2, 1) * ((count > 0) | full)
        one, bit = U64(1), is_wide.astype(U64)
        exact = (mix(content + tag) & ~one) | bit
        emitted = (count > 0) | full
        dropped = is_wide[at] & ((count[at] > 1) | full[at])
        gone = at[dropped]
        deletion = mix(content[gone] - v[dropped] + tag[gone]) | one
        yield (
            texts, band, np.full(len(texts), step == 0),
            np.bincount(owner, units, len(texts)).astype(np.int64),
            units_needed(size[texts], _edges()[band + 1] - 1, percent),
            np.concatenate([exact[emitted], deletion]),
            np.concatenate([owner[emitted], owner[gone]]),
        )


def parity_maps(text: np.ndarray, gram: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Bitmap of each set, a power of two of places: 64 or, for larger sets, 2 to 4 a shingle."""
    places = _places(size)
    opens = np.cumsum(places) - places
    at = opens[text] + (mix(gram ^ _SEED[2]) & (places[text] - 1).astype(U64)).astype(np.int64)
    odd = np.zeros(int(places.sum()), np.uint8)
    np.bitwise_xor.at(odd, at, np.uint8(1))
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[x >> 3 : x + n >> 3] for x, n in zip(opens.tolist(), places.tolist())]


def _places(size: np.ndarray) -> np.ndarray:
    return np.int64(1) << np.maximum(6, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) + 1)


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps, one a row, with as many 64-bit words as told: places equal modulo the new number meet."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def _differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of places in which bitmaps differ; rows of ``y`` may be one."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def _near(differences: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` with that many shingles in one of them only may link."""
    return differences * (100 + percent) <= (a + b) * (100 - percent)


def _by_words(maps: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Bitmaps by number of words: which ones, and as rows."""
    words = np.array([len(m) >> 3 for m in maps], np.int64)
    return {
        w: (which, np.frombuffer(b"".join([maps[i] for i in which.tolist()]), U64).reshape(-1, w))
        for w in np.unique(words).tolist()
        for which in [np.flatnonzero(words == w)]
    }


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_column).cast("bigint"), F.lit(int(_NO_ID))).alias("id"),
        F.hash(body).alias("twin"), body.alias("text"),
    )


def _set_table(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``id, twin, n, key, map`` of every row, and bands where a set lacks units without empty segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch.column("text"), _PIECE):
                text, gram, size, key = shingle_sets(data, offsets, k)
                lacking: list[list[int]] = [[] for _ in size]
                for texts, band, _, units, need, _, _ in signatures(text, gram, size, percent, frozenset()):
                    for i in np.flatnonzero(units < need):
                        lacking[texts[i]].append(int(band[i]))
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part.column("id"), "twin": part.column("twin"),
                        "n": size.astype(np.int64), "key": key.view(np.int64),
                        "map": pa.array(parity_maps(text, gram, size), pa.binary()),
                        "lacking": pa.array(lacking, pa.list_(pa.int32())),
                    }
                )

    return docs.mapInArrow(run, "id bigint, twin int, n bigint, key bigint, map binary, lacking array<int>")


_RECORD = {"keys": np.int64, "sizes": np.int64, "bands": np.int32, "own": np.bool_, "spare": np.int64, "counts": np.int32}


def _index(docs: DataFrame, k: int, percent: int, with_empty: frozenset[int], buckets: int) -> DataFrame:
    """Signatures with their sets, packed by bucket; a batch sends a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            parts: list[tuple] = []
            for _, data, offsets in pieces(batch.column("text"), _PIECE):
                text, gram, size, key = shingle_sets(data, offsets, k)
                fresh = np.zeros(len(size), bool)
                for i in np.flatnonzero(size).tolist():
                    if (name := int(key[i])) not in seen:
                        seen.add(name)
                        fresh[i] = True
                keep = fresh[text]
                size = size * fresh
                for texts, band, own, units, need, sig, record in signatures(
                    text[keep], gram[keep], size, percent, with_empty
                ):
                    parts.append((key[texts].view(np.int64), size[texts], band, own, units - need, sig, record))
            if not parts:
                continue
            before = np.cumsum([0] + [len(p[0]) for p in parts])
            record = np.concatenate([p[6] + b for p, b in zip(parts, before)])
            sig = np.concatenate([p[5] for p in parts])
            fields = [np.concatenate([p[i] for p in parts]) for i in range(5)]
            del parts
            to = bucket_of(sig, buckets)
            order = np.lexsort((record, to))
            edge = np.append(group_starts(to[order]), len(order))
            for low, high in zip(edge[:-1].tolist(), edge[1:].tolist()):
                some = order[low:high]
                opens = group_starts(record[some])
                own_records = record[some][opens]
                values = [f[own_records] for f in fields] + [np.diff(np.append(opens, len(some)))]
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array([int(to[some[0]])], pa.int32()), "sigs": pa.array([sig[some].tobytes()], pa.binary())}
                    | {
                        name: pa.array([v.astype(t).tobytes()], pa.binary())
                        for (name, t), v in zip(_RECORD.items(), values)
                    }
                )

    fields = "bucket int, sigs binary, " + ", ".join(f"{name} binary" for name in _RECORD)
    return docs.select("text").mapInArrow(run, fields)


def _linkable(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _candidates(table: pa.Table, percent: int) -> pa.Table:
    """Of one bucket: pairs of small groups (``hot`` false), members of larger ones."""
    rows = table.select(["sigs", *_RECORD]).to_pylist()
    sig = np.concatenate([np.frombuffer(r["sigs"], U64) for r in rows])
    key, size, band, own, spare, count = (
        np.concatenate([np.frombuffer(r[name], t) for r in rows]) for name, t in _RECORD.items()
    )
    del rows
    record = np.repeat(np.arange(len(key)), count)
    order = np.lexsort((key[record], sig))
    sig, record = sig[order], record[order]
    # Batches with the same set have both sent it.
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (key[record[1:]] != key[record[:-1]])
    sig, record = sig[new], record[new]
    opens = group_starts(sig)
    group = np.diff(np.append(opens, len(sig)))
    owned = np.add.reduceat(own[record], opens, dtype=np.int64) > 0 if len(opens) else np.zeros(0, bool)
    found_a, found_b = [], []
    for g in range(2, SMALL_GROUP + 1):
        member = record[opens[(group == g) & owned][:, None] + np.arange(g)]
        left, right = np.triu_indices(g, 1)
        a, b = member[:, left].ravel(), member[:, right].ravel()
        fits = (own[a] | own[b]) & _linkable(size[a], size[b], percent)
        found_a.append(key[a[fits]])
        found_b.append(key[b[fits]])
    pair = np.column_stack([np.concatenate(found_a), np.concatenate(found_b)])
    pair = np.unique(np.sort(pair, axis=1), axis=0)
    big = (group > SMALL_GROUP) & owned
    hot = ranges(opens[big], group[big])
    of = record[hot]
    n, h = len(pair), len(hot)
    return pa.Table.from_pydict(
        {
            "hot": pa.array(np.arange(n + h) >= n),
            "a": np.concatenate([pair[:, 0], key[of]]),
            "b": np.concatenate([pair[:, 1], sig[hot].view(np.int64)]),
            "n": np.concatenate([np.zeros(n, np.int64), size[of]]),
            "band": np.concatenate([np.zeros(n, np.int32), band[of]]).astype(np.int32),
            "own": np.concatenate([np.ones(n, bool), own[of]]),
            "spare": np.concatenate([np.zeros(n, np.int64), spare[of]]),
            "members": np.concatenate([np.zeros(n, np.int64), np.repeat(group[big], group[big])]),
        }
    )


_FOUND = "hot boolean, a bigint, b bigint, n bigint, band int, own boolean, spare bigint, members bigint"


def _groups_to_use(hot: DataFrame) -> DataFrame:
    """Members ``(sig, key, n, own)`` of the large groups that some set cannot do without.

    A set whose other units do not suffice takes its smallest groups until they do.  Groups
    of a segment with deletions come last and count nothing, since a segment's
    units hold only if all its signatures are used.
    """
    wide = F.col("b").bitwiseAND(F.lit(1)) == 1
    each = Window.partitionBy("a", "band")
    by_size = each.orderBy("wide", "members", "b").rowsBetween(Window.unboundedPreceding, -1)
    lost = F.sum(F.when(F.col("wide"), 2).otherwise(1)).over(each)
    got = F.coalesce(F.sum(F.when(F.col("wide"), 0).otherwise(1)).over(by_size), F.lit(0))
    chosen = (
        hot.withColumn("wide", wide)
        .withColumn("lacks", lost - F.col("spare"))
        .withColumn("got", got)
        .where("lacks > got")
        .select("b").distinct()
    )
    members = hot.join(chosen, "b", "left_semi")
    return members.select(F.col("b").alias("sig"), F.col("a").alias("key"), "n", "own")


def _texts(keys: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """``key, text`` of a row that has the set, for each ``key`` that is wanted."""
    first = sets.join(keys, "key", "left_semi").groupBy("key").agg(F.min(F.struct("id", "twin")).alias("row"))
    # Landed, so that Spark knows its size: joined unlanded, all texts would be shuffled for a few.
    wanted = materialize(first.select("key", "row.id", "row.twin"), "wanted")
    # Rows that share id and text are the same set, so either may stand for it.
    return docs.join(wanted, ["id", "twin"]).select("key", "text")


def _grams(keys: DataFrame, docs: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """``key, grams`` of the sets whose ``key`` is wanted, once each."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in pieces(batch.column("text"), _PIECE):
                text, gram, size, _ = shingle_sets(data, offsets, k)
                edge = np.append(0, np.cumsum(size)).tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": batch.column("key").slice(rows.start, rows.stop - rows.start),
                        "grams": pa.array(
                            [gram[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:])], pa.binary()
                        ),
                    }
                )

    # Few texts come from every part of the documents; each part would write a file of its own.
    texts = _texts(keys, docs, sets).hint("rebalance")
    return materialize(texts.mapInArrow(collect, "key bigint, grams binary"), "grams").dropDuplicates(["key"])


def _maps(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """``key, n, map`` of the sets whose ``key`` is wanted, once each."""
    return sets.join(keys, "key", "left_semi").select("key", "n", "map").dropDuplicates(["key"])


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of keys that bitmaps do not rule out."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    maps = materialize(_maps(materialize(keys, "pair_keys"), sets), "maps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keep = np.zeros(n, bool)
            a, b = (batch.column(c).to_numpy() for c in ("na", "nb"))
            by_words = _by_words(batch.column("ma").to_pylist() + batch.column("mb").to_pylist())
            row, kind = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
            for w, (which, _) in by_words.items():
                row[which], kind[which] = np.arange(len(which)), w
            for x_words, y_words in itertools.product(by_words, repeat=2):
                some = np.flatnonzero((kind[:n] == x_words) & (kind[n:] == y_words))
                if len(some):
                    w = min(x_words, y_words)
                    x = _folded(by_words[x_words][1][row[some]], w)
                    y = _folded(by_words[y_words][1][row[some + n]], w)
                    keep[some] = _near(_differences(x, y), a[some], b[some], percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def end(name: str) -> DataFrame:
        return maps.select(F.col("key").alias(name), F.col("n").alias("n" + name), F.col("map").alias("m" + name))

    return (
        pairs.join(end("a"), "a").join(end("b"), "b")
        .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        .select("a", "b", "na", "nb", "ma", "mb")
        .mapInArrow(compare, "a bigint, b bigint")
    )


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of keys whose sets reach the threshold."""
    pairs = materialize(_possible(pairs, sets, percent), "possible")
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ga"), batch.column("gb")):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    grams = _grams(keys, docs, sets, k)
    return (
        pairs.join(grams.select(F.col("key").alias("a"), F.col("grams").alias("ga")), "a")
        .join(grams.select(F.col("key").alias("b"), F.col("grams").alias("gb")), "b")
        .select("a", "b", "ga", "gb")
        .mapInArrow(compare, "a bigint, b bigint")
    )


def _open_groups(members: DataFrame, label: DataFrame) -> DataFrame:
    """Groups that are not connected yet, with their members' labels; of groups with the same members, one."""
    labelled = members.join(
        label.select(F.col("node").alias("key"), "label"), "key", "left"
    ).withColumn("label", F.coalesce("label", "key"))
    same = [F.bit_xor(F.xxhash64(F.lit(seed), "key", "own")).alias(f"h{seed}") for seed in (1, 2)]
    split = labelled.groupBy("sig").agg(
        F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c"), *same
    ).where("x <> y")
    one = split.groupBy("c", "h1", "h2").agg(F.min("sig").alias("sig"))
    return materialize(labelled.join(one.select("sig"), "sig", "left_semi"), "open_groups")


def _through_one(open_: DataFrame, nth: int, percent: int) -> DataFrame:
    """Pairs of one member of an open group, another for each ``nth``, and those not connected with it yet."""
    centre = F.min(F.struct(F.xxhash64(F.lit(nth), "key").alias("h"), "key", "n", "own", "label"))
    other = open_.groupBy("sig").agg(centre.alias("c")).select("sig", "c.key", "c.n", "c.own", "c.label")
    x, y = open_.alias("x"), other.alias("y")
    fits = (F.col("x.own") | F.col("y.own")) & (
        100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    )
    return (
        x.join(y, F.col("x.sig") == F.col("y.sig"))
        .where((F.col("x.label") != F.col("y.label")) & (F.col("x.key") != F.col("y.key")) & fits)
        .select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
        .distinct()
    )


def _map_cell(table: pa.Table, percent: int) -> pa.Table:
    """Pairs between two blocks of a large group, or within one, that may link and are not connected yet."""
    i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
    key, n, label, own, block = (
        table.column(c).to_numpy() for c in ("key", "n", "label", "own", "block")
    )
    by_words = _by_words(table.column("map").to_pylist())
    left, right = [], []
    for w, (small, its) in by_words.items():
        # A pair is compared at the lesser number of words, here w.
        more = [(which, _folded(maps, w)) for v, (which, maps) in by_words.items() if v > w]
        of = np.concatenate([small, *(which for which, _ in more)])
        rows = np.concatenate([its, *(maps for _, maps in more)])
        for at, x in enumerate(small.tolist()):
            y = of[at + 1 :]
            fits = (label[y] != label[x]) & (own[y] | own[x]) & _linkable(n[y], n[x], percent)
            if i != j:
                fits &= block[y] != block[x]
            some = np.flatnonzero(fits)
            y = y[some]
            y = y[_near(_differences(rows[at + 1 :][some], rows[at]), n[y], n[x], percent)]
            left.append(np.minimum(key[x], key[y]))
            right.append(np.maximum(key[x], key[y]))
    none = np.zeros(0, np.int64)
    return pa.table({"a": np.concatenate([none, *left]), "b": np.concatenate([none, *right])})


def _dealt(members: DataFrame, sets: int, shingles: int) -> DataFrame:
    """Members with ``block`` and, once for each pair ``i <= j`` of blocks of their group that is theirs, that pair.

    A group is dealt into blocks by a hash of its members.
    """
    counts = members.groupBy("sig").agg(
        F.greatest(
            F.ceil(F.count("*") / F.lit(sets)), F.ceil(F.sum("n") / F.lit(shingles))
        ).cast("int").alias("blocks")
    )
    return (
        members.join(counts, "sig")
        .withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .drop("blocks", "other")
    )


def _across(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of an open group that are not connected yet and that bitmaps do not rule out.

    Every two blocks of a group meet in a task's group of their own, with bitmaps only.
    """
    keys = materialize(open_.select("key").distinct(), "open_keys")
    maps = materialize(_maps(keys, sets).drop("n"), "maps")
    cells = _dealt(open_, MAP_SETS, MAP_SHINGLES).join(maps, "key")
    return cells.groupBy("sig", "i", "j").applyInArrow(
        lambda table: _map_cell(table, percent), "a bigint, b bigint"
    ).distinct()


def _cell(table: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks of a large group, or within one.

    Sets that share several groups are compared in that with the least signature only.
    """
    row, col, sig = (table.column(c)[0].as_py() for c in ("i", "j", "sig"))
    key = table.column("key").to_numpy()
    block = table.column("block").to_numpy()
    parts = [np.frombuffer(x.as_py(), U64) for x in table.column("grams")]
    n = np.array([len(p) for p in parts], np.int64)
    opens = np.cumsum(n) - n
    _, gram = np.unique(np.concatenate(parts), return_inverse=True)
    groups = [np.frombuffer(x.as_py(), np.int64) for x in table.column("sigs")]
    g = np.array([len(x) for x in groups], np.int64)
    heads = np.cumsum(g) - g
    names, group = np.unique(np.concatenate(groups), return_inverse=True)
    here = int(np.searchsorted(names, sig))
    has, shares = np.zeros(int(gram.max()) + 1, bool), np.zeros(len(names), bool)
    left, right = [], []
    for x in np.flatnonzero(block == row):
        mine, its = gram[opens[x] : opens[x] + n[x]], group[heads[x] : heads[x] + g[x]]
        has[mine], shares[its] = True, True
        both = np.add.reduceat(has[gram], opens, dtype=np.int64)
        least = np.minimum.reduceat(np.where(shares[group], group, len(names)), heads)
        has[mine], shares[its] = False, False
        other = (block == col) & (least == here) & (100 * both >= percent * (n[x] + n - both))
        if row == col:
            other &= key > key[x]
        y = key[other]
        left.append(np.minimum(key[x], y))
        right.append(np.maximum(key[x], y))
    none = np.zeros(0, np.int64)
    return pa.table({"a": np.concatenate([none, *left]), "b": np.concatenate([none, *right])})


def _hot_links(members: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """All linked pairs ``(a, b)`` of members of the large groups.

    A group is dealt into blocks by a hash of its members, and every two blocks meet in
    a task's group of their own.
    """
    members = members.groupBy("sig", "key").agg(F.max("n").alias("n"))
    # Signatures in order, as bytes; a set has a bounded number of units.
    packed = F.array_sort(F.collect_list("sig"))
    groups = members.groupBy("key").agg(packed.alias("sigs"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [np.array(x, np.int64).tobytes() for x in batch.column("sigs").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sigs, pa.binary())], ["key", "sigs"])

    groups = groups.mapInArrow(pack, "key bigint, sigs binary")
    whole = materialize(groups.join(_grams(members.select("key").distinct(), docs, sets, k), "key"), "hot_sets")
    dealt = _dealt(members, BLOCK_SETS, BLOCK_SHINGLES).drop("n")
    return dealt.join(whole, "key").groupBy("sig", "i", "j").applyInArrow(
        lambda table: _cell(table, percent), "a bigint, b bigint"
    )


def _joined(docs: DataFrame, k: int, percent: int, id_column: str, text: str):
    """Rows, their sets, links of small groups, and members of the large groups to use."""
    bounded_batches(docs.sparkSession)
    rows = _keyed(docs, id_column, text)
    buckets = parts_for(docs, text, BUCKET_BYTES)
    sets = materialize(_set_table(rows, k, percent), "shingle_sets")
    # At most one number per band.
    lacking = sets.select(F.explode("lacking").alias("band")).distinct().collect()
    with_empty = frozenset(r["band"] for r in lacking)
    sets = sets.drop("lacking")

    found = materialize(
        _index(rows, k, percent, with_empty, buckets)
        .groupBy("bucket")
        .applyInArrow(lambda table: _candidates(table, percent), _FOUND),
        "candidates",
    )
    links = materialize(
        _verified(found.where("not hot").select("a", "b").distinct(), rows, sets, k, percent), "links"
    )
    return rows, sets, links, materialize(_groups_to_use(found.where("hot")), "hot_groups")


def _classes(docs: DataFrame, k: int, percent: int, id_column: str, text: str) -> DataFrame:
    """``id, twin, n, part`` of every row: equal parts are connected; no part without shingles."""
    rows, sets, links, members = _joined(docs, k, percent, id_column, text)
    label = components(links)
    for nth in (*range(STAR_ROUNDS), None):
        # Groups that are connected need no more pairs, neither now nor later.
        open_ = _open_groups(members, label)
        if open_.isEmpty():
            break
        members = open_.drop("label")
        few = _across(open_, sets, percent) if nth is None else _through_one(open_, nth, percent)
        pairs = materialize(few, "hot_pairs")
        more = materialize(_verified(pairs, rows, sets, k, percent), "hot_links")
        if not more.isEmpty():
            label = extended(label, more)
    labelled = sets.join(label.select(F.col("node").alias("key"), "label"), "key", "left")
    return labelled.select(
        "id", "twin", "n", F.when(F.col("n") > 0, F.coalesce("label", "key")).alias("part")
    )


def links(
    docs: DataFrame,
    k: int = SHINGLE,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """All links of the join: pairs of distinct sets, and which rows have which set.

    The pairs are ``a, b`` with ``a < b``, each once; ``100 * common >= percent * united`` holds for them
    and for no others.  The members are ``id_column, n_shingles, set`` of every row, ``set`` is null
    without shingles.  Rows link if their sets are equal or a pair.  Sets link as in ``near_duplicates``.
    """
    rows, sets, found, members = _joined(docs, k, percent, id_column, text)
    pairs = found.select("a", "b").union(_hot_links(members, rows, sets, k, percent)).distinct()
    return materialize(pairs, "all_links"), sets.select(
        F.when(F.col("id") != F.lit(int(_NO_ID)), F.col("id")).alias(id_column),
        F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("set"),
    )


def near_duplicates(
    docs: DataFrame,
    k: int = SHINGLE,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: ``id_column, n_shingles, component_id`` (least id it is linked with, directly or not).

    Sets hold the distinct ``k``-word shingles of the lower-cased (A-Z) text; a text with fewer
    words is one shingle.  Two rows link if ``100 * common >= percent * united``.
    Null or empty texts, or ones without words, have no shingles and link with nothing.
    Repeated rows link with each other.  A null id counts as none: it takes the least id
    of its component, null if there is none.  An empty table gives an empty one.
    """
    classes = _classes(docs, k, percent, id_column, text)
    real = F.when(F.col("id") != F.lit(int(_NO_ID)), F.col("id"))
    some = classes.where("part is not null")
    least = some.groupBy("part").agg(F.min(real).alias("component_id"))
    grouped = some.join(least, "part").select("id", "n", "component_id")
    alone = classes.where("part is null").select("id", "n", real.alias("component_id"))
    return grouped.union(alone).select(
        real.alias(id_column), F.col("n").alias("n_shingles"), "component_id"
    )


def survivors(
    docs: DataFrame,
    k: int = SHINGLE,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component.

    It is the row with the least id (null is the largest); of rows that repeat an id and
    its text, any one.  Rows without words stay, each of them.  Columns may have any names.
    """
    classes = _classes(docs, k, percent, id_column, text)
    winners = (
        classes.where("part is not null")
        .groupBy("part").agg(F.min(F.struct("id", "twin")).alias("row"))
        .select(F.col("row.id").alias("id"), F.col("row.twin").alias("twin"))
    )
    # Names of our own: the columns may be called like those added here.
    own = [f"c{i}" for i in range(len(docs.columns))]
    number, body = (F.col(own[docs.columns.index(c)]) for c in (id_column, text))
    body = F.coalesce(body, F.lit(""))
    rows = docs.toDF(*own).withColumns(
        {"id": F.coalesce(number.cast("bigint"), F.lit(int(_NO_ID))), "twin": F.hash(body)}
    )
    has_words = body.rlike(r"[^\x20\x09-\x0D]")
    kept = rows.where(has_words).join(winners, ["id", "twin"], "left_semi")
    kept = kept.dropDuplicates(["id", "twin"]).select(*own)
    return kept.union(rows.where(~has_words).select(*own)).toDF(*docs.columns)
