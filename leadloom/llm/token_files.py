"""Token ids in binary files: frequency-ranked ids, byte-aligned, control bytes apart.

A file holds blocks in ascending document order.  A block numbers its distinct
ids by frequency, so common ids become small, and stores each number in one to
four bytes.  The lengths stand apart in a stream of control bytes, two bits per
number: a reader looks four lengths up per control byte and finds every number
by a running sum, without branches.

Blocks carry their own numbering and need no pass over the corpus before
they are written.  The container is Parquet, so Spark's committer decides
which attempt of a task counts, and any store that Spark writes will do.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from leadloom.llm.arrays import pieces, ranges
from leadloom.llm.segments import Known, joined, tokenize
from leadloom.llm.tables import bounded_batches

#: Bytes of text in a block, unless one text alone is longer.
BLOCK_BYTES = 8 << 20
END_ID = 0

_BLOCK = (
    "part int, block bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, "
    "ranked binary, control binary, data binary"
)
#: Bytes of a number.
_PLACE = np.arange(4, dtype=np.uint8)
#: Lengths of the four numbers that a control byte describes.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Ranked ids (four bytes each), control bytes and data bytes of some ids."""
    if len(ids) and ids.max() <= 4 * len(ids):
        # Dense enough to count without a sort.
        found = np.bincount(ids)
        distinct, number = np.flatnonzero(found), ids
        count = found[distinct]
        rank = np.empty(len(found), np.uint32)
    else:
        distinct, number, count = np.unique(ids, return_inverse=True, return_counts=True)
        rank = np.empty(len(distinct), np.uint32)
    by = np.lexsort((distinct, -count))
    rank[distinct[by] if number is ids else by] = np.arange(len(by))
    value = rank[number].astype("<u4")
    code = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    for least in (1 << 8, 1 << 16, 1 << 24):
        if len(distinct) > least:
            code[: len(ids)] += value >= least
    length = code[: len(ids)] + np.uint8(1)
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    # Little end first: a number's bytes are the first ones of its four.
    data = value.view(np.uint8).reshape(-1, 4)[_PLACE < length[:, None]]
    return distinct[by].astype("<u4").tobytes(), control.tobytes(), data.tobytes()


def unpack(n: int, ranked: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The ids that ``pack`` was given."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, np.uint8)
    four = np.zeros((n, 4), np.uint8)
    four[_PLACE < length[:, None]] = raw
    value = four.view("<u4").ravel()
    return np.frombuffer(ranked, "<u4")[value]


@functools.lru_cache(maxsize=2)
def _encoder(content: str) -> Known:
    """Ids of segments; a worker keeps those it has met."""
    import os

    # A task has one core; the library would start a thread for each it sees.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(content)

    # A character of a byte-level token stands for a byte.
    vocabulary = model.get_vocab(with_added_tokens=True)
    size = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
    size[list(vocabulary.values())] = [len(token) for token in vocabulary]
    for number, token in model.get_added_tokens_decoder().items():
        size[number] = len(token.content.encode())

    def encode(names: list[str]) -> list[list[int]]:
        return [e.ids for e in model.encode_batch_fast(names, add_special_tokens=False)]

    return Known(joined(encode, size))


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text: str = "text"
) -> None:
    """Tokenise whole texts by the tokenizer file and write them in order of their ids.

    Every document ends with id 0.  Null and empty texts hold that id alone;
    null ids come first; repeated rows and equal ids stay, ordered by text.
    An empty table writes no block.  Other columns are not read.
    """
    bounded_batches(docs.sparkSession, BLOCK_BYTES)
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _encoder(content)
        part, block = TaskContext.get().partitionId(), 0

        for batch in batches:
            for rows, data, offsets in pieces(batch.column("text"), BLOCK_BYTES):
                ids, begin = tokenize(data, offsets, known)
                # Room for an end id behind each document.
                lengths = np.diff(begin) + 1
                whole = np.full(int(lengths.sum()), END_ID, np.int32)
                whole[ranges(np.cumsum(lengths) - lengths, lengths - 1)] = ids
                ranked, control, packed = pack(whole)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part], pa.int32()),
                        "block": [block],
                        "n_tokens": [len(whole)],
                        "doc_ids": pa.array(
                            [batch.column("id").slice(rows.start, rows.stop - rows.start).to_pylist()],
                            pa.list_(pa.int64()),
                        ),
                        "lengths": pa.array([lengths], pa.list_(pa.int64())),
                        "ranked": pa.array([ranked], pa.binary()),
                        "control": pa.array([control], pa.binary()),
                        "data": pa.array([packed], pa.binary()),
                    }
                )
                block += 1

    (
        docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", "text")
        .mapInArrow(encode, _BLOCK)
        .write.parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Documents as the files hold them: ``doc_id, start, n_tokens, ids_crc32`` and the ``ids``.

    ``start`` counts the ids of all documents before.  ``ids_crc32`` is over the ids
    as little-endian unsigned 32-bit integers.
    """
    files = spark.read.schema(_BLOCK).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                tokens = unpack(
                    one["n_tokens"].as_py(), one["ranked"].as_py(), one["control"].as_py(),
                    one["data"].as_py(),
                )
                lengths = one["lengths"].values.to_numpy()
                end = np.cumsum(lengths)
                n = len(lengths)
                columns = [
                    pa.repeat(one["part"], n), pa.repeat(one["block"], n), one["doc_ids"].values,
                    pa.array(end - lengths), pa.array(lengths),
                    pa.array(
                        [zlib.crc32(tokens[a:b]) for a, b in zip((end - lengths).tolist(), end.tolist())],
                        pa.int64(),
                    ),
                ]
                if ids:
                    columns.append(
                        pa.ListArray.from_arrays(
                            pa.array(np.append(0, end), pa.int32()), pa.array(tokens.astype(np.int32))
                        )
                    )
                yield pa.RecordBatch.from_arrays(
                    columns, [f.split()[0] for f in decoded.split(", ")]
                )

    decoded = "part int, block bigint, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    decoded += ", ids array<int>" if ids else ""
    docs = files.mapInArrow(decode, decoded)
    # One row per file, then one per block of a file: the running sums are over these.
    by_part = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = by_part.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part")
    )
    inside = Window.partitionBy("part").orderBy("block")
    blocks = files.select(
        "part", "block", (F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("before_block")
    )
    return docs.join(blocks.join(parts, "part"), ["part", "block"]).select(
        "doc_id", (F.col("before_part") + F.col("before_block") + F.col("inside")).alias("start"),
        "n_tokens", "ids_crc32", *["ids"] * ids,
    )
