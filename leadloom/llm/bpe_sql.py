"""Byte-level BPE by recursive queries in DuckDB, one database per Python worker.

Spark deals out the texts.  Inside a task the distinct pieces of a batch become
rows of token and position.  A recursive query joins neighbouring tokens
with the merge table, contracts every piece's leftmost pair of the lowest rank,
and goes on with the pieces that had one until none has.  Decoding is an
ordered aggregation of the tokens' bytes.

A recursive query holds the rows of all its rounds, so it stops after as many as
fit into ``HELD_ROWS`` and the next query goes on from there.  In long pieces a round contracts
all pairs of the lowest rank that the leftmost rule would come to one after the other;
else a run of n letters would take n rounds over n rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.arrays import group_starts, pieces
from leadloom.llm.segments import Known, cut_bytes, flatten, gather
from leadloom.llm.tables import bounded_batches

#: Bytes of text whose distinct pieces are encoded together.
BATCH_BYTES = 4 << 20
#: Segments that a worker keeps.
KEPT = 400_000
#: Bytes of distinct pieces per recursive query; bounds what its rounds hold.
QUERY_BYTES = 200_000
#: Memory that a query may use for every byte of a piece beyond 300 MB in all.
ROW_BYTES = 1000
#: Rows that the rounds of one recursive query may hold together (two rounds at least).
HELD_ROWS = 3_000_000
#: Pieces with more bytes than this are long.
LONG_PIECE = 64

# Places run on over the pieces with one left out between two, so that a place and the next one
# are of the same piece and tokens meet their neighbours by one number.
_ENCODE = """
WITH RECURSIVE token(piece, round, pos, id) AS (
  SELECT piece, 0::SMALLINT, pos::INTEGER, id FROM bytes
  UNION ALL
  SELECT * FROM (
    WITH pair AS (
      SELECT a.piece, min(m.rank::BIGINT << 32 | a.pos) AS best
      FROM token a
      JOIN token b ON b.pos = a.pos + 1
      JOIN merges m ON m.l = a.id AND m.r = b.id
      GROUP BY a.piece
    )
    SELECT t.piece, (t.round + 1)::SMALLINT,
      (CASE WHEN t.pos > best & 4294967295 THEN t.pos - 1 ELSE t.pos END)::INTEGER,
      CASE WHEN t.pos = best & 4294967295 THEN (best >> 32)::INTEGER ELSE t.id END
    FROM token t JOIN pair USING (piece)
    WHERE t.pos <> (best & 4294967295) + 1 AND t.round < $rounds
  )
)
SELECT id, piece, pos, round FROM token
"""

# Of neighbouring pairs with the lowest rank, the leftmost rule takes every second one.  It takes
# them all before any other pair if no pair with the new token ranks lower (``calm``).
_ENCODE_LONG = """
WITH RECURSIVE token(piece, round, pos, id) AS (
  SELECT piece, 0::SMALLINT, pos, id FROM bytes
  UNION ALL
  SELECT * FROM (
    WITH pair AS (
      SELECT a.piece, a.pos, m.rank, m.calm
      FROM token a
      JOIN token b ON b.piece = a.piece AND b.pos = a.pos + 1
      JOIN merges m ON m.l = a.id AND m.r = b.id
    ), lowest AS (
      SELECT piece, pos, rank, calm, row_number() OVER by_pos AS nth
      FROM pair JOIN (SELECT piece, min(rank) AS rank FROM pair GROUP BY piece) USING (piece, rank)
      WINDOW by_pos AS (PARTITION BY piece ORDER BY pos)
    ), chosen AS (
      SELECT piece, pos, rank FROM lowest
      QUALIFY nth = 1 OR (calm AND row_number() OVER (PARTITION BY piece, pos - nth ORDER BY pos) % 2 = 1)
    )
    SELECT t.piece, (t.round + 1)::SMALLINT,
      row_number() OVER (PARTITION BY t.piece ORDER BY t.pos) - 1,
      coalesce(here.rank, t.id)
    FROM token t
    LEFT JOIN chosen here ON here.piece = t.piece AND here.pos = t.pos
    LEFT JOIN chosen before ON before.piece = t.piece AND before.pos = t.pos - 1
    WHERE before.pos IS NULL AND t.round < $rounds AND t.piece IN (SELECT piece FROM chosen)
  )
)
SELECT id, piece, pos, round FROM token
"""

_DECODE = """
SELECT unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS raw
FROM tokens t JOIN vocabulary v USING (id)
GROUP BY t.piece ORDER BY t.piece
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank from a file of base64 tokens."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class BpeDatabase:
    """Merge table and vocabulary of some ranks, and the queries over them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import duckdb
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.known = Known(self._segments, (np.int32, np.uint8), KEPT)
        # Two tokens merge if their bytes together are a token; its rank is the merge's.
        merges = [
            (ranks[whole[:i]], ranks[whole[i:]], rank)
            for whole, rank in ranks.items()
            for i in range(1, len(whole))
            if whole[:i] in ranks and whole[i:] in ranks
        ]
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError("every single byte must have a rank")
        # One core, and nothing is spilled to a local disk: queries are small.
        self.con = duckdb.connect(
            config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""}
        )
        # Tokens that are part of one with a lower rank.
        stirred = {part for left, right, rank in merges for part in (left, right) if rank < part}
        left, right, rank = (pa.array(x, pa.int32()) for x in zip(*merges)) if merges else (
            pa.array([], pa.int32()),
        ) * 3
        calm = pa.array([m[2] not in stirred for m in merges], pa.bool_())
        self._table("merges", l=left, r=right, rank=rank, calm=calm)
        self._table(
            "vocabulary", id=pa.array(ranks.values(), pa.int32()),
            hex=pa.array([token.hex() for token in ranks]),
        )

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def encode(self, names: list[bytes]) -> list[list[int]]:
        """Ids of pieces; a piece that is a token as a whole is that token."""
        found = [None if name not in self.ranks else [self.ranks[name]] for name in names]
        rest = [i for i, ids in enumerate(found) if ids is None and names[i]]
        for query, some in (
            (_ENCODE, [i for i in rest if len(names[i]) <= LONG_PIECE]),
            (_ENCODE_LONG, [i for i in rest if len(names[i]) > LONG_PIECE]),
        ):
            at = 0
            while at < len(some):
                to, size = at, 0
                while to < len(some) and (to == at or size + len(names[some[to]]) <= QUERY_BYTES):
                    size += len(names[some[to]])
                    to += 1
                for i, ids in zip(some[at:to], self._contract([names[i] for i in some[at:to]], query)):
                    found[i] = ids
                at = to
        return [ids or [] for ids in found]

    def _contract(self, names: list[bytes], query: str) -> list[list[int]]:
        size = np.fromiter(map(len, names), np.int64, len(names))
        piece = np.repeat(np.arange(len(names), dtype=np.int32), size)
        now = {
            "piece": piece,
            "pos": np.arange(len(piece), dtype=np.int64) + piece,
            "id": self.byte[np.frombuffer(b"".join(names), np.uint8)],
        }
        # A long piece needs memory by its length; it is one text's, and has no other way.
        self.con.execute(f"SET memory_limit = '{max(300, len(piece) * ROW_BYTES >> 20)}MB'")
        done: list[list[int]] = [[] for _ in names]
        while len(now["piece"]):
            rounds = min(30_000, max(1, HELD_ROWS // len(now["piece"]) - 1))
            self.con.register("bytes", pa.table(now))
            out = self.con.execute(query, {"rounds": rounds}).fetchnumpy()
            self.con.unregister("bytes")
            # Every piece's last round.
            last = np.full(len(names), -1, np.int16)
            np.maximum.at(last, out["piece"], out["round"])
            end = np.flatnonzero(out["round"] == last[out["piece"]])
            end = end[np.lexsort((out["pos"][end], out["piece"][end]))]
            out = {name: column[end] for name, column in out.items()}
            # Pieces that used all rounds may have more pairs; the others are done.
            more = out["round"] == rounds
            ids, which = out["id"][~more].tolist(), out["piece"][~more]
            opens = np.append(group_starts(which), len(which)).tolist()
            for a, b in zip(opens[:-1], opens[1:]):
                done[which[a]] = ids[a:b]
            now = {name: np.ascontiguousarray(out[name][more]) for name in ("piece", "pos", "id")}
        return done

    def decode(self, flat: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """Bytes of each list of ids; an empty list has none."""
        some = np.flatnonzero(lengths)
        out = [b""] * len(lengths)
        if len(some):
            piece = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
            begin = np.cumsum(lengths) - lengths
            self.con.register(
                "tokens",
                pa.table({"piece": piece, "pos": np.arange(len(piece)) - begin[piece], "id": flat}),
            )
            raws = self.con.execute(_DECODE).fetchall()
            self.con.unregister("tokens")
            for i, (raw,) in zip(some.tolist(), raws, strict=True):
                out[i] = raw
        return out

    def texts(
        self, data: np.ndarray, offsets: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text begins in them, their decoded bytes, and the same."""
        first, which, names = cut_bytes(data, offsets)
        at = self.known(names)[which]
        ids, raws = self.known.lists
        tokens, token_at = gather(*ids, at)
        raw, raw_at = gather(*raws, at)
        return tokens, token_at[first], raw, raw_at[first]

    def _segments(self, names: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of segments, and the bytes that these decode to."""
        number: dict[str, int] = {}
        inside = [self.pattern.findall(name.decode()) for name in names]
        pieces_of = np.fromiter(map(len, inside), np.int64, len(inside))
        which = np.array(
            [number.setdefault(piece, len(number)) for some in inside for piece in some], np.int64
        )
        lists = self.encode([name.encode() for name in number])
        ids = (
            np.fromiter(chain.from_iterable(lists), np.int32),
            np.fromiter(map(len, lists), np.int64, len(lists)),
        )
        raws = flatten(self.decode(*ids), np.uint8)
        return [_of_segments(*lists, which, pieces_of) for lists in (ids, raws)]


def _of_segments(
    flat: np.ndarray, lengths: np.ndarray, which: np.ndarray, pieces_of: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Lists of segments put together from those of their pieces, ``pieces_of`` each."""
    flat, begin = gather(flat, lengths, which)
    return flat, np.diff(begin[np.append(0, np.cumsum(pieces_of))])


@functools.lru_cache(maxsize=2)
def _database(content: bytes, pattern: str) -> BpeDatabase:
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines())}
    return BpeDatabase(ranks, pattern)


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_column: str = "doc_id",
    text: str = "text",
    ids: bool = True,
) -> DataFrame:
    """Ids of every whole text and the text they decode to.

    Returns ``id_column, n_tokens, ids_sha256`` (over little-endian unsigned 32-bit
    ids), ``decoded_sha256``, and with ``ids`` also ``ids array<int>`` and
    ``decoded binary``.  A null text counts as an empty one, which has no id.  Null
    ids and repeated rows stay; an empty table gives an empty one; other columns
    are not read.
    """
    bounded_batches(docs.sparkSession, BATCH_BYTES)
    with open(ranks_path, "rb") as f:
        content = f.read()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        database = _database(content, pattern)
        for batch in batches:
            for rows_, data, offsets in pieces(batch.column("text"), BATCH_BYTES):
                tokens, token_at, raw, raw_at = database.texts(data, offsets)
                tokens = tokens.astype("<u4")
                columns = {
                    "id": batch.column("id").slice(rows_.start, rows_.stop - rows_.start),
                    "n_tokens": np.diff(token_at),
                    "ids_sha256": _digests(tokens, token_at),
                    "decoded_sha256": _digests(raw, raw_at),
                }
                if ids:
                    columns["ids"] = pa.ListArray.from_arrays(
                        pa.array(token_at, pa.int32()), pa.array(tokens.astype(np.int32))
                    )
                    columns["decoded"] = pa.array(
                        [raw[a:b].tobytes() for a, b in zip(raw_at[:-1], raw_at[1:])], pa.binary()
                    )
                yield pa.RecordBatch.from_pydict(columns)

    fields = f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, "
    fields += "ids_sha256 string, decoded_sha256 string"
    fields += ", ids array<int>, decoded binary" if ids else ""
    return rows.mapInArrow(run, fields).withColumnRenamed("id", id_column)


def _digests(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.array(
        [hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())],
        pa.string(),
    )
