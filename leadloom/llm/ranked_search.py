"""Ranked lexical search over bit-sliced Bloom signatures.

The index is a table of blocks.  A block holds documents with about equally many
distinct terms.  Row ``r`` of its bitmap has a bit for every document that holds a
term hashed to ``r``; a term has several rows, and a term that occurs twice, four or
eight times has further rows of its own for each of these levels.  The conjunction of
a term's rows thus has a bit for every document with the term so often, and for a
few others.

A query term adds its weight to every document with its bit: weighted sums over the
slices, level by level, are upper bounds of scores.  A document is scored exactly, from
its counts in the block, unless its bound is below the last place found so far.  Every
task keeps the best of its blocks; a window over these few rows ranks them.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from leadloom.llm.arrays import bucket_of, mix, pieces
from leadloom.sources.scratch import materialize

#: Occurrences from which on a term has rows of the next level.
LEVELS = (1, 2, 4, 8)
#: Rows of a term and level, and rows of a block for every distinct term of its longest documents.
HASHES, ROWS_PER_TERM = 3, 8
#: Documents and counts that a block holds at most (one document at least).
BLOCK_DOCS, BLOCK_COUNTS = 1024, 1 << 18
SLICE = 1 << 20
#: Query terms that are sent to tasks together; more queries take further passes.
CHUNK_TERMS = 100_000

_STEP = 0x9E3779B97F4A7C15
_TERM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z and all beyond ASCII, A-Z lower-cased."""
    return text.translate(_TERM).split()


def _hashes(terms: list[bytes]) -> np.ndarray:
    digest = hashlib.blake2b
    return np.frombuffer(b"".join(digest(t, digest_size=8).digest() for t in terms), np.uint64)


def _rows(hashes: np.ndarray, level: int, k: int, width: int) -> np.ndarray:
    step = np.uint64((level * HASHES + k + 1) * _STEP % 2**64)
    return bucket_of(mix(hashes + step), width)


# -- index ---------------------------------------------------------------------


def _smallest(values: np.ndarray) -> np.ndarray:
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


class _Block:
    """Documents of one width, until they become a row of the index."""

    def __init__(self, width: int):
        self.width, self.held = width, 0
        self.known: dict[bytes, int] = {}
        self.ids, self.lengths, self.terms, self.times = [], [], [], []

    def add(self, i, words: list[bytes], counts: Counter) -> None:
        known, n = self.known, len(counts)
        self.ids.append(i)
        self.lengths.append(len(words))
        # Numbers in place of counters: a block waits for many documents.
        self.terms.append(np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int32, n))
        self.times.append(np.fromiter(counts.values(), np.int32, n))
        self.held += n

    def row(self) -> dict:
        term, times = np.concatenate(self.terms), np.concatenate(self.times)
        sizes = np.array(list(map(len, self.terms)))
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        hashes = _hashes(list(self.known))
        bits = np.zeros((self.width, len(sizes)), bool)
        for level, least in enumerate(LEVELS):
            often = times >= least
            for k in range(HASHES):
                bits[_rows(hashes, level, k, self.width)[term[often]], doc[often]] = True
        order = np.lexsort((term, doc))
        return {
            "ids": self.ids, "lengths": self.lengths, "width": self.width,
            "slices": np.packbits(bits, axis=1).tobytes(),
            "terms": b" ".join(self.known), "dfs": np.bincount(term, minlength=len(self.known)).tolist(),
            "sizes": sizes.tolist(),
            "doc_terms": _smallest(term[order]).tobytes(), "doc_times": _smallest(times[order]).tobytes(),
        }


def build_index(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text",
    block_docs: int = BLOCK_DOCS, block_counts: int = BLOCK_COUNTS,
) -> DataFrame:
    """Blocks of signatures and counts of all documents; land them before they are searched.

    Null and empty texts are in the index without terms.  Repeated rows are documents each;
    other columns are not read.  Texts are indexed whole; one that is longer than a block may
    hold is a block alone.
    """
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in (id_column, text)]
    rows = docs.select(quoted[0].alias("id"), quoted[1].alias("text"))
    id_type = rows.schema["id"].dataType

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, _Block] = {}
        schema = None

        def flush(width: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([waiting.pop(width).row()], schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema(
                    [("ids", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int64())), ("width", pa.int32()),
                     ("slices", pa.binary()), ("terms", pa.binary()), ("dfs", pa.list_(pa.int32())),
                     ("sizes", pa.list_(pa.int32())), ("doc_terms", pa.binary()), ("doc_times", pa.binary())]
                )
            for part, data, offsets in pieces(batch.column(1), SLICE):
                raw, at = data.tobytes(), offsets.tolist()
                for i, a, b in zip(batch.column(0)[part.start : part.stop].to_pylist(), at, at[1:]):
                    words = terms_of(raw[a:b])
                    counts = Counter(words)
                    width = ROWS_PER_TERM * 16 << max(0, (max(len(counts), 1) - 1).bit_length() - 4)
                    if width not in waiting:
                        waiting[width] = _Block(width)
                    block = waiting[width]
                    block.add(i, words, counts)
                    if len(block.ids) >= block_docs or block.held >= block_counts:
                        yield flush(width)
        for width in list(waiting):
            yield flush(width)

    return rows.mapInArrow(
        index,
        f"ids array<{id_type.simpleString()}>, lengths array<bigint>, width int, slices binary, "
        "terms binary, dfs array<int>, sizes array<int>, doc_terms binary, doc_times binary",
    )


# -- search --------------------------------------------------------------------


def _query_terms(items: DataFrame, text: str) -> DataFrame:
    """``(query, term, times)`` of all queries."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, said in zip(*(c.to_pylist() for c in batch.columns)):
                counts = Counter(terms_of((said or "").encode()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([query] * len(counts), pa.int64()), pa.array([t.decode() for t in counts], pa.string()),
                     pa.array(list(counts.values()), pa.int64())],
                    ["query", "term", "times"],
                )

    return items.select("query", text).mapInArrow(split, "query bigint, term string, times bigint")


def _weighted(index: DataFrame, queries: DataFrame, n_docs: int) -> DataFrame:
    """``queries`` with the weight of each term, from the number of documents that hold it."""
    wanted = materialize(queries.select("term").distinct(), "query_terms")
    terms = F.split(F.col("terms").cast("string"), " ")
    held = index.select(F.explode(F.arrays_zip(terms.alias("term"), "dfs")).alias("t")).select("t.term", "t.dfs")
    found = held.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("dfs").alias("df"))
    df = F.coalesce("df", F.lit(0))
    return queries.join(found, "term", "left").withColumn(
        "weight", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * df + 1))).cast("bigint")
    )


class _Searcher:
    """The best documents of some queries over the blocks of a task."""

    def __init__(self, queries: dict[int, list[tuple[bytes, int]]], k: int, n_docs: int, n_terms: int):
        self.k, self.n_docs, self.n_terms = k, n_docs, n_terms
        vocabulary = sorted({t for terms in queries.values() for t, _ in terms})
        place = {t: i for i, t in enumerate(vocabulary)}
        self.terms, self.hashes = pa.array(vocabulary, pa.binary()), _hashes(vocabulary)
        self.queries = {
            q: (np.array([place[t] for t, _ in terms], np.int64), np.array([w for _, w in terms], np.int64))
            for q, terms in queries.items()
        }
        self.best: dict[int, list] = {q: [] for q in queries}

    def _gain(self, times, m):
        return 1_000_000_000 * times // (1000 * times + 12 * m)

    def block(self, row: dict) -> None:
        ids, width = row["ids"], row["width"]
        n = len(ids)
        lengths = row["lengths"]
        m = np.array([100 - 25 + 25 * x * self.n_docs // max(self.n_terms, 1) for x in lengths], np.int64)
        slices = np.frombuffer(row["slices"], np.uint8).reshape(width, -1)
        # What a further level adds at most: a term below the next level occurs once less than it asks.
        most = [self._gain(np.full(n, x - 1), m) for x in LEVELS[1:]] + [self._gain(np.array(lengths, np.int64), m)]
        steps, bits = [], []
        for level, gain in enumerate(most):
            steps.append(gain - most[level - 1] if level else gain)
            has = slices[_rows(self.hashes, level, 0, width)]
            for h in range(1, HASHES):
                has = has & slices[_rows(self.hashes, level, h, width)]
            bits.append(np.unpackbits(has, axis=1, count=n))
        counts = None
        for query, (at, weight) in self.queries.items():
            # Sums of whole numbers below 2**53, so exact.
            bound = np.zeros(n)
            for step, has in zip(steps, bits):
                bound += (weight.astype(float) @ has[at]) * step
            best = self.best[query]
            least = best[-1][0] if len(best) == self.k else 1
            maybe = np.flatnonzero(bound >= least)
            if not len(maybe):
                continue
            if counts is None:
                counts = self._counts(row)
            # The most promising first: they raise the bar for the others.
            maybe = maybe[np.argsort(-bound[maybe], kind="stable")]
            done, size = 0, self.k
            while done < len(maybe):
                least = self._exact(query, maybe[done : done + size], counts, m, ids)
                done, size = done + size, 2 * size
                maybe = maybe[: np.searchsorted(-bound[maybe], -least, side="right")]

    def _counts(self, row: dict) -> tuple:
        def numbers(raw: bytes, size: int) -> np.ndarray:
            return np.frombuffer(raw, f"u{len(raw) // max(size, 1) or 1}").astype(np.int64)

        terms = pa.array(row["terms"].split(), pa.binary())
        sizes = np.array(row["sizes"])
        total = int(sizes.sum())
        keys = np.repeat(np.arange(len(sizes)), sizes) * len(terms) + numbers(row["doc_terms"], total)
        here = pc.index_in(self.terms, value_set=terms).fill_null(-1).to_numpy()
        return keys, numbers(row["doc_times"], total), here, len(terms)

    def _exact(self, query: int, docs: np.ndarray, counts: tuple, m: np.ndarray, ids: list) -> int:
        """Scores documents exactly; returns what a further one has to reach."""
        keys, times, here, width = counts
        at, weight = self.queries[query]
        known = here[at] >= 0
        wanted = docs[:, None] * width + here[at][known][None, :]
        found = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        often = np.where(keys[found] == wanted, times[found], 0) if len(keys) else np.zeros(wanted.shape, np.int64)
        score = (weight[known] * self._gain(often, m[docs][:, None])).sum(axis=1)
        best = self.best[query]
        least = best[-1][0] if len(best) == self.k else 1
        good = np.flatnonzero(score >= least)
        if len(good):
            best += [(int(score[g]), ids[docs[g]]) for g in good.tolist()]
            best.sort(key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))
            del best[self.k :]
        return best[-1][0] if len(best) == self.k else 1


def search(
    index: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text",
    doc_id: str = "doc_id", chunk_terms: int = CHUNK_TERMS,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item, scores above 0.

    Equal scores are ranked by ascending id, null last.  Items without terms have no rows; an
    item row that is repeated is a query each time.  ``index`` has to be a landed ``build_index``.
    """
    spark = index.sparkSession
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in (item_id, text)]
    asked = materialize(
        items.select(F.monotonically_increasing_id().alias("query"), quoted[0].alias("item"), quoted[1].alias("text")), "queries"
    )
    some = index.agg(
        F.sum(F.size(F.filter("lengths", lambda x: x > 0))).alias("docs"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("terms"),
    ).first()
    n_docs, n_terms = some["docs"] or 0, some["terms"] or 0
    weighted = materialize(_weighted(index, materialize(_query_terms(asked, "text"), "asked_terms"), n_docs), "weighted_terms")
    # A chunk of queries has about so many terms, however many queries there are.
    chunks = -(-weighted.count() // chunk_terms)
    id_type = index.schema["ids"].dataType.elementType
    parts = []
    for chunk in range(chunks):
        queries: dict[int, list[tuple[bytes, int]]] = {}
        for r in weighted.where(F.pmod(F.xxhash64("query"), F.lit(chunks)) == chunk).collect():
            queries.setdefault(r["query"], []).append((r["term"].encode(), r["weight"] * r["times"]))
        if queries:
            parts.append(index.mapInArrow(_best_of(queries, k, n_docs, n_terms), T.StructType(
                [T.StructField("query", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.LongType())]
            )))
    if not parts:
        found = spark.createDataFrame([], T.StructType(
            [T.StructField("query", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.LongType())]
        ))
    else:
        # Every chunk is landed, so that the passes do not pile up in one plan.
        found = materialize(parts[0], "best") if len(parts) == 1 else _union([materialize(p, "best") for p in parts])
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    top = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return top.join(asked.select("query", "item"), "query").select(
        F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(doc_id), "score"
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _best_of(queries: dict[int, list[tuple[bytes, int]]], k: int, n_docs: int, n_terms: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _Searcher(queries, k, n_docs, n_terms)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                searcher.block({c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "dfs"})
        found = [(q, i, s) for q, rows in searcher.best.items() for s, i in rows]
        if found:
            query, ids, scores = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int64()), pa.array(ids, id_type), pa.array(scores, pa.int64())], ["query", "id", "score"]
            )

    return best
