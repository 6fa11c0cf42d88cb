"""URL rules as one bit-parallel wildcard automaton.

Every rule becomes glob patterns over the canonical URL ``.host/path``.  All
patterns lie one after another in a state of 64-bit words, a bit per pattern
position (Shift-And).  Reading one byte shifts the state, admits pattern
starts, and masks it with the bits that accept this byte; a ``*`` is a bit that
stays set while the byte may be skipped.  All URLs of a batch step together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from leadloom.llm.arrays import utf8

#: Bytes of canonical URLs that step through the automaton together.
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host, its subdomains and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Automaton:
    """Masks of all patterns: ``accept[byte, word]``, ``stay[byte, word]``, first and last bits."""

    accept: np.ndarray
    stay: np.ndarray
    first: np.ndarray
    last: tuple[tuple[int, int], ...]


def compile_rules(rules: Sequence[Rule]) -> Automaton:
    """Patterns ``*.host path*``, where the leading ``*`` skips no slash.

    The canonical URL has a dot before its host, so the host itself and its
    subdomains match alike.  A trailing ``*`` is the last bit staying set.
    """
    literal = [f".{r.host}{r.path}".encode() for r in rules]
    bits = sum(len(x) + 1 for x in literal)
    words = -(-max(bits, 1) // 64)
    accept, stay = np.zeros((2, 256, words), np.uint64)
    first, last, at = np.zeros(words, np.uint64), [], 0

    def put(table, byte, bit):
        table[byte, bit // 64] |= np.uint64(1 << bit % 64)

    not_slash = np.arange(256) != ord("/")
    for text in literal:
        first[at // 64] |= np.uint64(1 << at % 64)
        put(stay, not_slash, at)  # the leading wildcard
        for i, byte in enumerate(text, 1):
            put(accept, byte, at + i)
        put(stay, slice(None), at + len(text))  # the trailing wildcard
        last.append(((at + len(text)) // 64, (at + len(text)) % 64))
        at += len(text) + 1
    return Automaton(accept, stay, first, tuple(last))


def simulate(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text fits each pattern, as a boolean matrix."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    order = np.argsort(-length, kind="stable")
    start, length = offsets[:-1][order], length[order]
    state = np.tile(automaton.first, (n, 1))
    active = n
    for step in range(int(length[0]) if n else 0):
        while active and length[active - 1] <= step:
            active -= 1
        byte, now = data[start[:active] + step], state[:active]
        carry = now >> np.uint64(63)
        moved = now << np.uint64(1)
        moved[:, 1:] |= carry[:, :-1]
        state[:active] = (moved & automaton.accept[byte]) | (now & automaton.stay[byte])
    out = np.zeros((n, len(automaton.last)), bool)
    for k, (word, bit) in enumerate(automaton.last):
        out[order, k] = state[:, word] >> np.uint64(bit) & np.uint64(1)
    return out


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    otherwise: str = "allow",
) -> DataFrame:
    """``keep`` with ``host``, ``path``, ``rule`` and ``verdict`` of every URL.

    The longest rule that fits decides; of equally long ones ``block`` wins.
    Null, or a URL without ``://``, has an empty host and path and fits no
    rule.  Repeated rows stay; other columns are not read; an empty table
    gives an empty one.  A host is lower-cased in A-Z only.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    automaton = compile_rules(ranked)
    names = np.array([r.name for r in ranked] + [None], object)
    verdicts = np.array([r.verdict for r in ranked] + [otherwise], object)

    rest = F.when(
        F.col(url).contains("://"),
        F.regexp_extract(url, r"(?s)://([^?#]*)", 1),
    ).otherwise("")
    host = F.translate(
        F.regexp_extract(rest, r"(?s)^[^/]*", 0),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )
    # Other columns may be called like ours, so kept ones travel under plain numbers.
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    parts = pages.select(
        *kept, F.coalesce(host, F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1), F.lit("")).alias("path"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = max(1, whole.get_total_buffer_size())
            rows = max(1, whole.num_rows * BATCH_BYTES // size)
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
                data, offsets = utf8(
                    pa.array([f".{h}{p}" for h, p in zip(hosts, paths)], pa.large_string())
                )
                fits = np.column_stack(
                    [simulate(automaton, data, offsets), np.ones(batch.num_rows, bool)]
                )
                best = fits.argmax(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names[best], pa.string()),
                     pa.array(verdicts[best], pa.string())],
                    [*batch.schema.names, "rule", "verdict"],
                )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    judged = parts.mapInArrow(judge, f"{fields}, rule string, verdict string")
    return judged.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", "rule", "verdict"
    )
