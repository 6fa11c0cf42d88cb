"""Scores of texts under a Katz back-off model with Good-Turing discounts.

    P(w | v) = d * c(vw) / c(v)      if the corpus has vw
             = a(v) * P(w)           else, with a(v) such that all words sum to one
    P(w)     = D * c(w) / N          if the corpus has w
             = what the discounts leave, for all unknown words together

``d`` and ``D`` are Good-Turing discounts of counts up to ``KEEP`` (counts of
counts cover the whole corpus), 1 beyond.  A history without discounted successors keeps half
a count for the rest.

Counting and scoring are shuffles of packed arrays:

* texts become chunks: a list of distinct words and, per token, a place in it.
  Chunks are written to the shared folder;
* distinct words of all chunks meet by hash: counts and numbers of words, a table
  with one row per partition and chunk;
* chunks take their rows back and send every token, with its history, to the
  history's partition.  Frequent histories are split by word.  Both the counts of counts and
  then the scores are read from this one shuffle;
* scores return as one sum per chunk, partition and document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.arrays import U64, bucket_of, group_starts, mix, pieces, words
from leadloom.llm.tables import bounded_batches, parts_for
from leadloom.sources.scratch import new_path

#: Counts up to this one are discounted.
KEEP = 5
CHUNK_BYTES = 12 << 20
BUCKET_BYTES = 8 << 20
#: A history with more than this part of a partition's tokens is split.
HOT_SHARE = 4
_PIECE = 1 << 20
_END = mix(np.array([0xE0D], U64))[0]


def pack(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane, compressed; high bytes are mostly zero."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def discounts(n: list[int] | np.ndarray) -> np.ndarray:
    """Factors for counts 0 to ``KEEP`` (0: unused) from how many events occur once, twice, ... ``KEEP`` + 1 times.

    Katz's form: d_r = (r*/r - q) / (1 - q), r* = (r + 1) n_(r+1) / n_r, q = (KEEP + 1) n_(KEEP+1) / n_1.
    Where counts of counts give no factor in (0, 1), as in tiny corpora, it is 1 - 0.5 / r.
    """
    n = np.asarray(n, np.float64)
    out = np.ones(KEEP + 1)
    q = (KEEP + 1) * n[KEEP] / n[0] if n[0] else 1.0
    for r in range(1, KEEP + 1):
        d = ((r + 1) * n[r] / n[r - 1] / r - q) / (1 - q) if n[r - 1] and q < 1 else 0.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


def discounted(count: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return count * np.where(count <= KEEP, factor[np.minimum(count, KEEP)], 1.0)


def held_back(n: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Counts that discounts leave, given the numbers of events that occur 1 to ``KEEP`` times; half a count at least."""
    left = (n[..., :KEEP] * np.arange(1, KEEP + 1) * (1 - factor[1:])).sum(axis=-1)
    return np.where(left > 0, left, 0.5)


@dataclass(frozen=True)
class Unigrams:
    """What the whole corpus says about single words."""

    tokens: int
    distinct: int
    texts: int
    counts_of_counts: tuple[int, ...]
    first_number: tuple[int, ...]  # of each partition's words

    def probability(self, count: np.ndarray) -> np.ndarray:
        factor = discounts(self.counts_of_counts)
        n = np.array(self.counts_of_counts, np.float64)
        left = float(held_back(n, factor))
        taken = (n[:KEEP] * np.arange(1, KEEP + 1) * (1 - factor[1:])).sum()
        total = max(1.0, self.tokens - taken + left)
        return np.where(count > 0, discounted(count, factor), left) / total

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    @property
    def unknown(self) -> int:
        return self.distinct

    @property
    def begin(self) -> int:
        return self.distinct + 1


def _chunks(docs: DataFrame) -> DataFrame:
    """Batches of texts as distinct words (hashes in order, training counts) and places of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(batches):
            held = np.array(batch.column("held").to_pylist(), bool)
            tokens, lengths = [], []
            for _, data, offsets in pieces(batch.column("text"), _PIECE):
                first, hashes = words(data, offsets, lower=True)
                # An end token behind every text.
                lengths.append(np.diff(first) + 1)
                tokens.append(np.insert(hashes, first[1:], _END))
            if not tokens:
                continue
            lengths = np.concatenate(lengths)
            distinct, place = np.unique(np.concatenate(tokens), return_inverse=True)
            training = np.repeat(~held, lengths)
            counts = np.bincount(place[training], minlength=len(distinct))
            yield pa.RecordBatch.from_pydict(
                {
                    "chunk": [base + number],
                    "ids": pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([held.tolist()], pa.list_(pa.bool_())),
                    "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "distinct": pa.array([pack(distinct)], pa.binary()),
                    "counts": pa.array([pack(counts)], pa.binary()),
                    "places": pa.array([pack(place.astype(np.uint32))], pa.binary()),
                }
            )

    return docs.mapInArrow(
        run,
        "chunk bigint, ids array<bigint>, held array<boolean>, lengths array<bigint>, "
        "distinct binary, counts binary, places binary",
    )


_UNIGRAM = (
    "bucket int, chunk bigint, counts binary, ranks binary, known bigint, tokens bigint, "
    "counts_of_counts array<bigint>"
)


def _unigram_table(chunks: DataFrame, buckets: int) -> DataFrame:
    """Per partition and chunk, corpus counts and ranks of the chunk's words; per partition, totals (no chunk)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, counts = unpack(row["distinct"], U64), unpack(row["counts"], np.int64)
                edge = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
                to = np.flatnonzero(np.diff(edge)).tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "bucket": pa.array(to, pa.int32()),
                        "chunk": pa.array([row["chunk"]] * len(to), pa.int64()),
                        "hashes": pa.array([hashes[edge[b] : edge[b + 1]].tobytes() for b in to], pa.binary()),
                        "counts": pa.array([pack(counts[edge[b] : edge[b + 1]]) for b in to], pa.binary()),
                    }
                )

    def count(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = [np.frombuffer(r["hashes"], U64) for r in rows]
        counts = np.concatenate([unpack(r["counts"], np.int64) for r in rows])
        distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, which, counts)
        known = total > 0
        rank = np.where(known, np.cumsum(known) - 1, -1)
        edge = np.cumsum([0] + [len(h) for h in hashes])
        mine = [which[a:b] for a, b in zip(edge[:-1], edge[1:])]
        of = np.bincount(np.minimum(total[known], KEEP + 2), minlength=KEEP + 3)[1 : KEEP + 2]
        bucket, n = rows[0]["bucket"], len(rows)
        return pa.Table.from_pydict(
            {
                "bucket": pa.array([bucket] * (n + 1), pa.int32()),
                "chunk": pa.array([r["chunk"] for r in rows] + [None], pa.int64()),
                "counts": pa.array([pack(total[m]) for m in mine] + [None], pa.binary()),
                "ranks": pa.array([pack(rank[m]) for m in mine] + [None], pa.binary()),
                "known": pa.array([None] * n + [int(known.sum())], pa.int64()),
                "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()),
                "counts_of_counts": pa.array([None] * n + [of.tolist()], pa.list_(pa.int64())),
            }
        )

    sent = chunks.select("chunk", "distinct", "counts").mapInArrow(
        send, "bucket int, chunk bigint, hashes binary, counts binary"
    )
    return sent.groupBy("bucket").applyInArrow(count, _UNIGRAM)


_PAIRS = (
    "bucket int, chunk bigint, v binary, w binary, cw binary, doc binary, "
    "ids array<bigint>, held array<boolean>, n_tokens array<bigint>, n_known array<bigint>, "
    "base array<double>, direct array<double>"
)


def _empty_info(n: int) -> dict:
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    names = ("ids", "held", "n_tokens", "n_known", "base", "direct")
    return {name: pa.nulls(n, pa.list_(kind)) for name, kind in zip(names, kinds)}


def _pairs_of_chunk(chunk: dict, rows: list[dict], corpus: Unigrams, buckets: int) -> pa.Table:
    """A chunk's tokens with their histories by partition, and one row about its documents."""
    rows = sorted(rows, key=lambda r: r["bucket"])
    count = np.concatenate([unpack(r["counts"], np.int64) for r in rows])
    rank = [unpack(r["ranks"], np.int64) for r in rows]
    number = np.concatenate(
        [np.where(k >= 0, k + corpus.first_number[r["bucket"]], corpus.unknown) for r, k in zip(rows, rank)]
    )
    place = unpack(chunk["places"], np.uint32)
    lengths = np.array(chunk["lengths"], np.int64)
    held = np.array(chunk["held"], bool)
    first = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    cw, w = count[place], number[place]
    v, cv = np.empty_like(w), np.empty_like(cw)
    v[1:], cv[1:] = w[:-1], cw[:-1]
    v[first], cv[first] = corpus.begin, corpus.texts

    direct = cv == 0  # the history is unknown: P(w)
    sums = np.bincount(doc[direct], np.log10(corpus.probability(cw[direct])), len(lengths))
    info = {
        "ids": pa.array([chunk["ids"]], pa.list_(pa.int64())),
        "held": pa.array([chunk["held"]], pa.list_(pa.bool_())),
        "n_tokens": pa.array([lengths], pa.list_(pa.int64())),
        "n_known": pa.array([np.add.reduceat((cw > 0).astype(np.int64), first)], pa.list_(pa.int64())),
        "base": pa.array([np.add.reduceat(corpus.base(cw), first)], pa.list_(pa.float64())),
        "direct": pa.array([sums], pa.list_(pa.float64())),
    }
    send = np.flatnonzero(~direct)
    v, w, cw, cv = v[send], w[send], cw[send], cv[send]
    code = doc[send] * 2 + held[doc[send]]
    hot = max(1, corpus.tokens // (HOT_SHARE * buckets))
    part = np.where(cv > hot, mix(w.astype(U64)) % (cv // hot + 1).astype(U64), 0).astype(U64)
    to = bucket_of(mix(v.astype(U64) * U64(0x9E3779B97F4A7C15) + part), buckets)
    order = np.lexsort((v, to))
    edge = np.append(group_starts(to[order]), len(order))
    split = [order[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
    v = v * 2 + (cv > hot)  # the lowest bit: other partitions have some of this history's words
    n = len(split)
    name = chunk["chunk"]
    columns = {
        "bucket": pa.array([*(int(to[s[0]]) for s in split), name % buckets], pa.int32()),
        "chunk": pa.array([name] * (n + 1), pa.int64()),
        "v": pa.array([*(pack(np.diff(v[s], prepend=0)) for s in split), None], pa.binary()),
        "w": pa.array([*(pack(w[s]) for s in split), None], pa.binary()),
        "cw": pa.array([*(pack(cw[s]) for s in split), None], pa.binary()),
        "doc": pa.array([*(pack(code[s].astype(np.uint32)) for s in split), None], pa.binary()),
    }
    return pa.table(
        columns | {k: pa.chunked_array([x, info[k]]) for k, x in _empty_info(n).items()}
    )


class _Histories:
    """The pairs of one partition: counts of pairs, and sums per history (``names``, odd if split)."""

    def __init__(self, rows: list[dict], corpus: Unigrams) -> None:
        self.v = np.concatenate([np.cumsum(unpack(r["v"], np.int64)) for r in rows])
        w = np.concatenate([unpack(r["w"], np.int64) for r in rows])
        self.cw = np.concatenate([unpack(r["cw"], np.int64) for r in rows])
        code = [unpack(r["doc"], np.uint32) for r in rows]
        self.row = np.repeat(np.arange(len(rows)), [len(c) for c in code])
        code = np.concatenate(code)
        self.doc, training = (code >> 1).astype(np.int64), (code & 1) == 0
        order = np.lexsort((w, self.v))
        sv, sw = self.v[order], w[order]
        new = np.ones(len(order), bool)
        new[1:] = (sv[1:] != sv[:-1]) | (sw[1:] != sw[:-1])
        pair_at = np.flatnonzero(new)
        pair = np.cumsum(new) - 1
        counts = np.add.reduceat(training[order].astype(np.int64), pair_at)
        pair_v = sv[pair_at]
        history_at = group_starts(pair_v)
        history = np.repeat(np.arange(len(history_at)), np.diff(np.append(history_at, len(pair_v))))
        self.names = pair_v[history_at]
        # Pairs that occur 1 to KEEP times, of each history.
        few = (counts > 0) & (counts <= KEEP)
        self.few = np.bincount(
            history[few] * KEEP + counts[few] - 1, minlength=len(self.names) * KEEP
        ).reshape(-1, KEEP)
        self.total = np.add.reduceat(counts, history_at)
        seen = corpus.probability(self.cw[order][pair_at]) * (counts > 0)
        self.mass = np.add.reduceat(seen, history_at)
        self.of_counts = np.bincount(np.minimum(counts[counts > 0], KEEP + 2), minlength=KEEP + 3)[1 : KEEP + 2]
        self.count, self.history = np.empty_like(counts, shape=len(order)), np.empty(len(order), np.int64)
        self.count[order], self.history[order] = counts[pair], history[pair]


_STATS = "v bigint, few array<bigint>, total bigint, mass double"


def _statistics(table: pa.Table, corpus: Unigrams) -> pa.Table:
    """Counts of counts of a partition's pairs (v is -1), and its share of each split history."""
    rows = [r for r in table.select(["v", "w", "cw", "doc"]).to_pylist() if r["v"] is not None]
    v, few, total, mass = [], [], [], []
    if rows:
        h = _Histories(rows, corpus)
        some = np.flatnonzero(h.names & 1)
        v = [-1, *h.names[some].tolist()]
        few = [h.of_counts.tolist(), *h.few[some].tolist()]
        total = [0, *h.total[some].tolist()]
        mass = [0.0, *h.mass[some].tolist()]
    return pa.table(
        {
            "v": pa.array(v, pa.int64()), "few": pa.array(few, pa.list_(pa.int64())),
            "total": pa.array(total, pa.int64()), "mass": pa.array(mass, pa.float64()),
        }
    )


_SUMS = (
    "chunk bigint, docs binary, sums binary, ids array<bigint>, held array<boolean>, "
    "n_tokens array<bigint>, n_known array<bigint>, base array<double>, direct array<double>"
)
_INFO = ["ids", "held", "n_tokens", "n_known", "base", "direct"]


def _score(table: pa.Table, stats: pa.Table, corpus: Unigrams) -> pa.Table:
    """Log probabilities of a partition's tokens, summed per chunk and document."""
    info = table.filter(pc.is_null(table["v"])).select(["chunk", *_INFO])
    rows = table.select(["chunk", "v", "w", "cw", "doc"]).filter(pc.is_valid(table["v"])).to_pylist()
    chunk, docs, sums = [], [], []
    if rows:
        h = _Histories(rows, corpus)
        whole = {x["v"]: x for x in stats["stats"][0].as_py()}
        factor = discounts(whole[-1]["few"])
        for i in np.flatnonzero(h.names & 1).tolist():
            own = whole[int(h.names[i])]
            h.few[i], h.total[i], h.mass[i] = own["few"], own["total"], own["mass"]
        left = held_back(h.few, factor)
        taken = (h.few * np.arange(1, KEEP + 1) * (1 - factor[1:])).sum(axis=1)
        total = h.total - taken + left
        backoff = left / total / (1 - h.mass)
        p = np.where(
            h.count > 0,
            discounted(h.count, factor) / total[h.history],
            backoff[h.history] * corpus.probability(h.cw),
        )
        key = h.row << 32 | h.doc
        each, which = np.unique(key, return_inverse=True)
        added = np.bincount(which, np.log10(p), len(each))
        edge = np.searchsorted(each >> 32, np.arange(len(rows) + 1))
        for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
            chunk.append(rows[i]["chunk"])
            docs.append((each[a:b] & 0xFFFFFFFF).astype(np.uint32).tobytes())
            sums.append(added[a:b].tobytes())
    scored = pa.table(
        {
            "chunk": pa.array(chunk, pa.int64()), "docs": pa.array(docs, pa.binary()),
            "sums": pa.array(sums, pa.binary()),
        }
        | _empty_info(len(chunk))
    )
    none = pa.nulls(len(info), pa.binary())
    about = pa.table({"chunk": info["chunk"], "docs": none, "sums": none} | {k: info[k] for k in _INFO})
    return pa.concat_tables([scored, about])


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _documents(table: pa.Table) -> pa.Table:
    """The documents of one chunk with the sums that came back for them."""
    rows = table.to_pylist()
    info = next(r for r in rows if r["ids"] is not None)
    score = np.array(info["direct"])
    for row in rows:
        if row["docs"] is not None:
            score[np.frombuffer(row["docs"], np.uint32)] += np.frombuffer(row["sums"])
    return pa.table(
        {
            "doc_id": pa.array(info["ids"], pa.int64()), "held_out": pa.array(info["held"], pa.bool_()),
            "n_tokens": pa.array(info["n_tokens"], pa.int64()),
            "n_known": pa.array(info["n_known"], pa.int64()),
            "base_score": pa.array(info["base"], pa.float64()), "score": score,
        }
    )


def score_documents(
    docs: DataFrame, held_out, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Scores of all texts under a model of those that are not ``held_out`` (a boolean column expression).

    Returns ``id_column, held_out, n_tokens, n_known, train_tokens, base_score, score``.  Tokens are
    words (runs of bytes other than ASCII white space, A-Z lower-cased), then one end token, so a
    null or empty text has one.  ``base_score`` adds a half to every count of single words,
    ``score`` is the model's log10 probability of the text.  A null ``held_out`` counts as
    false.  Null ids and repeated rows stay; an empty table gives an empty one; other
    columns are not read.
    """
    spark = bounded_batches(docs.sparkSession, CHUNK_BYTES)
    buckets = parts_for(docs, text, BUCKET_BYTES)
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(text).alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held"),
    )
    folder = new_path(spark, "katz")

    def landed(df: DataFrame, name: str) -> DataFrame:
        # What is binary here is compressed already.
        df.write.option("compression", "none").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    chunks = landed(_chunks(rows), "chunks")
    unigrams = landed(_unigram_table(chunks, buckets), "unigrams")
    totals = unigrams.where("chunk is null")
    known = {r["bucket"]: r["known"] for r in totals.select("bucket", "known").collect()}
    summed = totals.agg(
        F.sum("tokens"), *[F.sum(F.col("counts_of_counts")[i]) for i in range(KEEP + 1)]
    ).first()
    texts = chunks.agg(
        F.sum(F.size(F.filter("held", lambda h: ~h)).cast("bigint"))
    ).first()[0]
    sizes = [known.get(b, 0) for b in range(buckets)]
    corpus = Unigrams(
        tokens=summed[0] or 0,
        distinct=sum(sizes),
        texts=texts or 0,
        counts_of_counts=tuple(x or 0 for x in summed[1:]),
        first_number=tuple(int(x) for x in np.cumsum([0, *sizes])[:-1]),
    )

    def send(chunk: pa.Table, words_: pa.Table) -> pa.Table:
        return _pairs_of_chunk(chunk.to_pylist()[0], words_.to_pylist(), corpus, buckets)

    counted = unigrams.where("chunk is not null").select("bucket", "chunk", "counts", "ranks")
    pairs = (
        chunks.select("chunk", "ids", "held", "lengths", "places")
        .groupBy("chunk")
        .cogroup(counted.groupBy("chunk"))
        .applyInArrow(send, _PAIRS)
        .repartition(buckets, "bucket")
    )
    # Both readings of ``pairs`` share its one shuffle.
    stats = (
        pairs.groupBy("bucket")
        .applyInArrow(lambda table: _statistics(table, corpus), _STATS)
        .groupBy("v")
        .agg(
            F.array(*[F.sum(F.coalesce(F.get("few", F.lit(i)), F.lit(0))) for i in range(KEEP + 1)]).alias("few"),
            F.sum("total").alias("total"), F.sum("mass").alias("mass"),
        )
        .select("v", F.when(F.col("v") < 0, F.col("few")).otherwise(F.slice("few", 1, KEEP)).alias("few"), "total", "mass")
        # Split histories are few: each has more than a fraction of a partition's tokens.
        .agg(F.collect_list(F.struct("v", "few", "total", "mass")).alias("stats"))
        .select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "stats")
    )
    scored = (
        pairs.groupBy("bucket")
        .cogroup(stats.groupBy("bucket"))
        .applyInArrow(
            lambda table, s: _score(table, s, corpus) if len(table) else _score_none(), _SUMS
        )
    )
    return (
        scored.groupBy("chunk")
        .applyInArrow(_documents, _SCORES)
        .select(
            F.col("doc_id").alias(id_column), "held_out", "n_tokens", "n_known",
            F.lit(corpus.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
        )
    )


def _score_none() -> pa.Table:
    """No rows: the statistics go to every partition, also to those without pairs."""
    return pa.table(
        {"chunk": pa.nulls(0, pa.int64()), "docs": pa.nulls(0, pa.binary()), "sums": pa.nulls(0, pa.binary())}
        | _empty_info(0)
    )
