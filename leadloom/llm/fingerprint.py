"""Fingerprints that add up over paragraphs.

A paragraph hashes to a wide vector, a text to the sum of its paragraphs'
vectors modulo powers of two.  Order does not matter, and a paragraph is added
or taken out by adding or subtracting its vector.  The vector has two parts:

* ``LANES`` lanes modulo 2**64 from the whole paragraph.  They tell whether
  two texts have the same paragraphs, each equally often.
* ``SKETCH`` lanes modulo 2**32, a signed count sketch of the paragraph's
  word triples.  Their angle tells how much two texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.arrays import (
    U64,
    byte_hashes,
    group_starts,
    mix,
    ngrams,
    text_of_word,
    words,
)
from leadloom.llm.tables import bounded_batches, parts_for

LANES = 8
SKETCH = 128
WORDS = 3
#: Bytes of text that arrays are built over at a time, and that a part holds.
PIECE_BYTES = 1 << 20
PART_BYTES = 24 << 20

_ODD = np.random.default_rng(7).integers(0, 2**63, LANES, dtype=U64) * U64(2) + U64(1)


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the fingerprints of some texts, a row each."""
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) if n else b"", np.uint8)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    # Paragraphs end at line feeds and at the ends of texts; there may be empty ones.
    cuts = np.flatnonzero(data == 10)
    start, end = np.append(0, cuts + 1), np.append(cuts, len(data))
    owner = np.searchsorted(begin, start, side="right") - 1
    one, two = (byte_hashes(data, start, end, point) for point in (0, 1))
    lanes = np.zeros((n, LANES), U64)
    if n:
        firsts = group_starts(owner)
        for j in range(LANES):
            lanes[:, j] = np.add.reduceat(mix(one * _ODD[j] + two + _ODD[j]), firsts)
    sketch = np.zeros(n * SKETCH)
    if n:
        first, hashes = words(data, np.append(start, len(data)))
        grams, whole = ngrams(first, hashes, WORDS)
        paragraph = text_of_word(first)
        short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < WORDS))
        feature = np.concatenate([grams[whole], mix(one[short])])
        text = owner[np.concatenate([paragraph[whole], short])]
        slot = text * SKETCH + (feature % U64(SKETCH)).astype(np.int64)
        sign = 1.0 - 2.0 * (feature >> U64(63)).astype(np.float64)
        sketch = np.bincount(slot, sign, n * SKETCH)
    return lanes, sketch.reshape(n, SKETCH).astype(np.int64).astype(np.uint32)


def add(a: str, b: str, sign: int = 1) -> str:
    """Fingerprint of the paragraphs of both; with ``sign`` -1, of those of ``a`` without ``b``'s."""
    (la, sa), (lb, sb) = _parse(a), _parse(b)
    times = U64(sign % 2**64)
    return _print((la + lb * times)[None], (sa + sb * np.uint32(sign % 2**32))[None])[0]


def _print(lanes: np.ndarray, sketch: np.ndarray) -> list[str]:
    raw = np.concatenate([lanes.astype("<u8").view(np.uint8), sketch.astype("<u4").view(np.uint8)], axis=1)
    return [row.tobytes().hex() for row in raw]


def _parse(printed: str) -> tuple[np.ndarray, np.ndarray]:
    raw = bytes.fromhex(printed)
    return np.frombuffer(raw, "<u8", LANES), np.frombuffer(raw, "<u4", SKETCH, 8 * LANES)


def _likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Cosine of the sketches of each row, from 0; 1 where the whole vectors are equal."""
    x, y = (v[1].astype(np.int32).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.clip((x * y).sum(axis=1) / np.where(norm > 0, norm, 1), 0, 1)
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    return np.where(same, 1.0, np.minimum(cosine, 1 - 1e-9))


def likeness(a: str, b: str) -> float:
    """How much two printed fingerprints share, 0 to 1; 1 only for equal ones."""
    x, y = _parse(a), _parse(b)
    return float(_likeness((x[0][None], x[1][None]), (y[0][None], y[1][None]))[0])


def _vectors_bounded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE_BYTES):
            size += len(texts[to])
            to += 1
        parts.append(vectors(texts[at:to]))
        at = to
    if not parts:
        return vectors([])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the ``fingerprint`` of every whole text; null counts as empty.

    Repeated rows stay; an empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text")
    )
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(_print(*_vectors_bounded(texts)), pa.string())],
                [*kept, "fingerprint"],
            )

    fields = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in kept)
    made = rows.mapInArrow(run, f"{fields}fingerprint string")
    return made.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], "fingerprint")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _neighbours(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Rows in descending order of id, dealt out in runs that end with the next run's first row.

    Runs are ranges of ids.  A run's last row needs the first text of the next
    run; that text is sent along as an extra row (``carry``), so texts are shuffled once.
    """
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    parts = parts_for(rows, "text", PART_BYTES)
    shares = [i / parts for i in range(1, parts)]
    # One number per part.
    bounds = sorted(set(rows.approxQuantile("id", shares, 0.2 / parts) if shares else []), reverse=True)
    edges = F.array(*[F.lit(int(b)) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    run = F.when(F.col("id").isNull(), len(bounds) + 1).otherwise(
        F.size(F.filter(edges, lambda b: b > F.col("id")))
    )
    rows = rows.withColumn("run", run)
    top = rows.groupBy("run").agg(F.max("id").alias("top")).collect()  # one row per run
    if not top:
        return rows.withColumn("carry", F.lit(False))
    order = sorted(row["run"] for row in top)
    before = dict(zip(order[1:] + order[:1], order))
    ids = [row["top"] for row in top if row["top"] is not None]
    firsts = (
        rows.where(F.col("id").isin(ids) | F.col("id").isNull())
        .groupBy("run", "id").agg(F.min("text").alias("text"))
    )
    goes = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    carried = firsts.select("id", "text", F.element_at(goes, F.col("run")).alias("run"))
    both = rows.withColumn("carry", F.lit(False)).union(carried.withColumn("carry", F.lit(True)))
    return both.repartitionById(len(bounds) + 2, F.col("run")).sortWithinPartitions(
        "run", "carry", F.desc_nulls_last("id"), "text"
    )


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and how alike they and the next text are.

    The next text is that of the next smaller id, the largest id's after the last; equal ids
    are ordered by text, null ids come last.  A single row is its own next one.
    Returns ``id_column, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, whose next one has not come yet
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            carry = batch.column("carry").to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE_BYTES):
                    size += len(texts[to])
                    to += 1
                lanes, sketch = vectors([t.encode() for t in texts[at:to]])
                rows = list(zip(ids[at:to], texts[at:to], carry[at:to]))
                if held is not None:
                    rows.insert(0, held[0])
                    lanes, sketch = np.vstack([held[1], lanes]), np.vstack([held[2], sketch])
                held = (rows[-1], lanes[-1:], sketch[-1:])
                yield from _compared(rows, lanes, sketch)
                at = to

    def _compared(rows, lanes, sketch) -> Iterator[pa.RecordBatch]:
        mine = np.array([i for i in range(len(rows) - 1) if not rows[i][2]], np.int64)
        if not len(mine):
            return
        texts = [rows[i][1] for i in mine]
        changed = [edited(rows[i][1], rows[i + 1][1]).encode() for i in mine]
        own, other = (lanes[mine], sketch[mine]), vectors(changed)
        yield pa.RecordBatch.from_pydict(
            {
                "id": pa.array([rows[i][0] for i in mine], pa.int64()),
                "n_chars": pa.array(list(map(len, texts)), pa.int64()),
                "edited_sha256": [hashlib.sha256(t).hexdigest() for t in changed],
                "fingerprint": _print(*own),
                "edited_fingerprint": _print(*other),
                "near_edited": _likeness(own, other),
                "near_next": _likeness(own, (lanes[mine + 1], sketch[mine + 1])),
            }
        )

    fields = (
        "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return (
        _neighbours(docs, id_column, text)
        .select("id", "text", "carry")
        .mapInArrow(run, fields)
        .withColumnRenamed("id", id_column)
    )
