"""Language identification: the family first, then the languages within it.

Features are hashed byte n-grams over letters, as shares of a text's n-grams.
A linear support vector machine per family (one against the rest) picks the
family; one per pair of languages in it votes on the language.  All machines
are rows of one weight matrix, so a batch is scored by one gather and one sum
per text.

Machines only choose among the learned languages.  Whether a text is in one of them
at all is told by its support: how likely its letters are under the learned
languages, held against labelled texts of the same length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from leadloom.llm.arrays import mix, pieces

# Families of language codes (ISO 639-1).  A code that is not
# listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "lb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "finnic": ("et", "fi"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}

UNKNOWN = "und"
#: Labelled texts per language that the machines are fitted on, chosen by a hash of the id.
SAMPLE_PER_LANGUAGE = 400
ORDERS = (1, 2, 3, 4)
DIMENSIONS = 1 << 14
#: Slots of the letter triples that support is measured by, and the share that unseen ones get.
SUPPORT_SLOTS = 1 << 16
UNSEEN = 0.01
#: A text has no support from this many times the shortfall of the poorest hundredth of labelled texts on.
SLACK = 2
#: Labelled texts that a length needs for a threshold of its own.
LEAST_TEXTS = 30
_PIECE = 1 << 20
#: Texts up to which the products of every two are held, and slots that they are summed over at once.
_MATRIX, _COLUMNS = 2000, 1024

# ASCII letters in lower case, bytes of other scripts as they are, all else a blank.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per order: slots of the n-grams that begin at each byte, and which lie in one text."""
    folded = _FOLD[data].astype(np.uint64)
    last = np.repeat(offsets[1:], np.diff(offsets))
    at, code = np.arange(len(data)), np.zeros(len(data), np.uint64)
    for order in ORDERS:
        code[: len(data) - order + 1] |= folded[order - 1 :] << np.uint64(8 * (order - 1))
        slot = mix(code + np.uint64(order << 40)) % np.uint64(DIMENSIONS)
        yield slot.astype(np.int32), at + order <= last


class Shares:
    """Share of every slot in each text, only the slots that a text has being held."""

    def __init__(self, row: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int):
        self.row, self.slot, self.value, self.n = row, slot, value, n

    def where(self, chosen: np.ndarray) -> Shares:
        """The texts of a mask, numbered anew."""
        some, place = chosen[self.row], np.cumsum(chosen) - 1
        return Shares(place[self.row[some]], self.slot[some], self.value[some], int(chosen.sum()))

    def summed(self, factor: np.ndarray) -> np.ndarray:
        """The texts added up, each times its factor."""
        return np.bincount(self.slot, self.value * factor[self.row], DIMENSIONS)

    @cached_property
    def products(self) -> np.ndarray:
        """The product of every two texts."""
        out = np.zeros((self.n, self.n))
        for low in range(0, DIMENSIONS, _COLUMNS):
            some = (self.slot >= low) & (self.slot < low + _COLUMNS)
            part = np.zeros((self.n, _COLUMNS))
            part[self.row[some], self.slot[some] - low] = self.value[some]
            out += part @ part.T
        return out

    def margins(self, factor: np.ndarray) -> np.ndarray:
        """Product of each text and ``summed(factor)``."""
        if self.n <= _MATRIX:
            return self.products @ factor
        return np.bincount(self.row, self.value * self.summed(factor)[self.slot], self.n)


def _features(column: pa.Array) -> Shares:
    """Shares of the slots in each text; for the bounded sample only."""
    rows, slots, values, n = [], [], [], 0
    for _, data, offsets in pieces(column, _PIECE):
        grams = list(_grams(data, offsets))
        for a, b in zip(offsets[:-1], offsets[1:]):
            counts = np.zeros(DIMENSIONS, np.int64)
            for slot, whole in grams:
                counts += np.bincount(slot[a:b][whole[a:b]], minlength=DIMENSIONS)
            some = np.flatnonzero(counts)
            rows.append(np.full(len(some), n))
            slots.append(some)
            values.append(counts[some].astype(np.float32) / np.float32(max(1, counts.sum())))
            n += 1
    return Shares(np.concatenate(rows), np.concatenate(slots), np.concatenate(values), n)


def _triples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the letter triples of all texts, and each text's edges among them.

    Runs of blanks are one blank, and accented Latin capitals are in lower case too.
    """
    folded = _FOLD[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    folded[after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    blank = folded == 32
    before = np.append(True, blank[:-1])[: len(data)]
    # Blanks at a text's beginning go whatever the text before ends with.
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    keep = ~(blank & before)
    edge = np.append(0, np.cumsum(keep))[offsets]
    folded = folded[keep].astype(np.uint64)
    code = folded[:-2] | folded[1:-1] << np.uint64(8) | folded[2:] << np.uint64(16)
    slot = (mix(code) % np.uint64(SUPPORT_SLOTS)).astype(np.int64)
    whole = np.arange(len(slot)) + 3 <= np.repeat(edge[1:], np.diff(edge))[: len(slot)]
    return slot[whole], np.append(0, np.cumsum(whole))[np.minimum(edge, len(slot))]


def _likelihood(slots: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Logarithm of each slot's share in the learned languages, every language counting alike."""
    shares = []
    for name in sorted(set(label)):
        counts = np.zeros(SUPPORT_SLOTS)
        for i in np.flatnonzero(label == name):
            counts += np.bincount(slots[i], minlength=SUPPORT_SLOTS)
        shares.append(counts / max(1.0, counts.sum()))
    return np.log((1 - UNSEEN) * np.mean(shares, axis=0) + UNSEEN / SUPPORT_SLOTS)


def _support(column: pa.Array, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Likelihoods of slots, and per power of two of triples the median and least mean of a text.

    Thresholds come from beginnings of labelled texts under the likelihoods of the other half
    of the sample, so texts are judged as texts that were not learned are.
    """
    if len(label) < LEAST_TEXTS:
        return np.zeros(SUPPORT_SLOTS), np.zeros((0, 2))
    slots: list[np.ndarray] = []
    for _, data, offsets in pieces(column, _PIECE):
        slot, edge = _triples(data, offsets)
        slots += np.split(slot, edge[1:-1])
    fold = np.arange(len(label)) % 2
    means: dict[int, list[float]] = {}
    for half in (0, 1):
        likely = _likelihood([s for s, f in zip(slots, fold) if f != half], label[fold != half])
        for i in np.flatnonzero(fold == half):
            sums = np.cumsum(likely[slots[i]])
            for power in range(len(sums).bit_length()):
                means.setdefault(power, []).append(sums[2**power - 1] / 2**power)
    limits = []
    for power in sorted(means):
        if len(means[power]) < LEAST_TEXTS:
            break
        usual = np.median(means[power])
        limits.append((usual, usual - SLACK * (usual - np.quantile(means[power], 0.01))))
    return _likelihood(slots, label), np.array(limits).reshape(-1, 2)


def _machine(x: Shares, y: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine, squared hinge, both classes equal.

    Full gradients with momentum from zero: the same sample gives the same machine.  Weights are
    the texts added up, each times a factor, and the factors are what the rounds change.
    """
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, v, step, shrink = np.zeros(x.n), np.zeros(x.n), 0.25, 1e-4
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x.margins(w) + w.sum()))
        v = 0.9 * v - step * (shrink * w - 2 * cost * slack * y)
        w = w + v
    return x.summed(w), w.sum()


@dataclass(frozen=True)
class LanguageModel:
    """Families with their languages, and the machines as columns of ``weights``.

    Column f is family f against the rest; ``pairs`` name the columns after.  ``likely`` has the
    logarithms of the shares of letter triples, ``limits`` the median and the least mean of a text
    of 1, 2, 4, 8 ... triples.
    """

    families: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[str, str], ...]
    weights: np.ndarray
    bias: np.ndarray
    likely: np.ndarray
    limits: np.ndarray

    def support(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How well the learned languages account for each text, 0 to 1.

        1 is the median of labelled texts of its length; 0 is less than any of them should have.
        Without a whole triple, or with too few labelled texts for a threshold, it is 1.
        """
        slot, edge = _triples(data, offsets)
        count, out = np.diff(edge), np.ones(len(offsets) - 1)
        some = np.flatnonzero(count)
        if not len(some) or not len(self.limits):
            return out
        mean = np.add.reduceat(self.likely[slot], edge[some]) / count[some]
        power = np.minimum(np.log2(count[some]).astype(np.int64), len(self.limits) - 1)
        usual, least = self.limits[power].T
        out[some] = np.clip((mean - least) / np.maximum(usual - least, 1e-9), 0, 1)
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and confidence (0 to 1) of each text."""
        n, sums = len(offsets) - 1, np.zeros((len(offsets) - 1, self.weights.shape[1]))
        count = np.zeros(n)
        edges = np.minimum(offsets[:-1], max(0, len(data) - 1))
        some = np.diff(offsets) > 0
        if len(data):
            for slot, whole in _grams(data, offsets):
                gathered = self.weights[slot]
                gathered[~whole] = 0
                sums[some] += np.add.reduceat(gathered, edges[some], axis=0)
                count[some] += np.add.reduceat(whole, edges[some], dtype=np.int64)
        margin = sums / np.maximum(count, 1)[:, None] + self.bias
        sure = 1 / (1 + np.exp(-np.clip(4 * margin, -50, 50)))
        k = len(self.families)
        family = margin[:, :k].argmax(axis=1)
        best, score = [""] * n, np.zeros(n)
        for i in range(n):
            names = self.families[family[i]]
            votes = dict.fromkeys(names, 0.0)
            weakest = {name: 1.0 for name in names}
            for j, (a, b) in enumerate(self.pairs, k):
                if a in votes and b in votes:
                    # A vote each; the margin only breaks ties.
                    p = sure[i, j]
                    votes[a] += (p >= 0.5) + p * 1e-6
                    votes[b] += (p < 0.5) + (1 - p) * 1e-6
                    weakest[a], weakest[b] = min(weakest[a], p), min(weakest[b], 1 - p)
            best[i] = max(names, key=lambda name: votes[name])
            score[i] = (sure[i, family[i]] if k > 1 else 1.0) * weakest[best[i]]
        return best, score


def fit(
    labelled: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> LanguageModel | None:
    """Fit on at most ``per_language`` texts of each label; null labels and texts are left out.

    The sample are the rows with the smallest hash of their id (bounded, so the
    driver holds it).  None if there is no labelled row.
    """
    rows = labelled.where(F.col(lang).isNotNull() & (F.trim(text) != "")).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"),
        F.xxhash64(F.lit("language"), F.col(id_column)).alias("draw"),
    )
    # Draws are chosen without their texts; texts are read for the chosen ones alone.
    first = Window.partitionBy("lang").orderBy("draw")
    drawn = rows.select("lang", "draw").withColumn("n", F.row_number().over(first))
    draws = sorted({r["draw"] for r in drawn.where(F.col("n") <= per_language).collect()})
    if not draws:
        return None
    # Rows that share an id share a draw; one text of each is enough.
    sample = rows.where(F.col("draw").isin(draws)).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    table = sample.select("lang", "text").toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    label = np.array(table["lang"].to_pylist(), object)
    x = _features(table["text"])
    # Texts are few and long vectors mostly empty: as a whole matrix they would be the most that the driver holds.
    squares = np.zeros(DIMENSIONS, np.float32)
    np.add.at(squares, x.slot, x.value**2)
    scale = np.sqrt(np.maximum(squares / np.float32(x.n), np.float32(1e-8)))
    x.value = (x.value / scale[x.slot]) / np.sqrt(DIMENSIONS)
    known = {code: name for name, codes in FAMILIES.items() for code in codes}
    by_family: dict[str, list[str]] = {}
    for name in sorted(set(label)):
        by_family.setdefault(known.get(name, f"only {name}"), []).append(name)
    families = tuple(tuple(by_family[f]) for f in sorted(by_family))
    pairs = tuple(p for names in families for p in combinations(names, 2))
    machines = [_machine(x, np.where(np.isin(label, names), 1.0, -1.0)) for names in families]
    for a, b in pairs:
        mine = (label == a) | (label == b)
        machines.append(_machine(x.where(mine), np.where(label[mine] == a, 1.0, -1.0)))
    w = np.column_stack([m[0] for m in machines])
    bias = np.array([m[1] for m in machines])
    weights = (w / scale[:, None] / np.sqrt(DIMENSIONS)).astype(np.float32)
    return LanguageModel(families, pairs, weights, bias, *_support(table["text"], label))


def identify(
    docs: DataFrame,
    model: LanguageModel | None,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    names: tuple[str, ...] = ("lang_pred", "score"),
) -> DataFrame:
    """``keep`` with the language and its score (0 to 1), called ``names``, for every row's whole text.

    The score tells the language from the other learned ones.  A third name adds the support (0 to
    1) that the text has in the learned languages; 0 means that it is in none of them.

    Text that is null or has no letter (Unicode category L) is ``und`` with
    score and support 0; so is all text if there is no model.  Repeated rows stay and get equal
    results, an empty table gives an empty one, and names of other columns
    don't matter.
    """
    kept = [f"k{i}" for i in range(len(keep))]
    columns = ("found", "score", "support")[: len(names)]
    body = kept[keep.index(text)] if text in keep else "text"
    rows = docs.select(
        *[F.col("`" + c.replace("`", "``") + "`").alias(k) for c, k in zip(keep, kept)],
        *[F.col(text).alias("text")] * (body == "text"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores, supports = [], [], []
            if model is None:
                found, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
                supports = scores
            else:
                for _, data, offsets in pieces(batch.column(body), _PIECE):
                    best, score = model.predict(data, offsets)
                    found += best
                    scores += score.tolist()
                    if len(names) > 2:
                        supports += model.support(data, offsets).tolist()
                letters = batch.column("letters").to_pylist()
                found = [x if some else UNKNOWN for x, some in zip(found, letters)]
                scores = [x if some else 0.0 for x, some in zip(scores, letters)]
                supports = [x if some else 0.0 for x, some in zip(supports, letters)]
            made = [pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(supports, pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *made[: len(names)]], [*kept, *columns]
            )

    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept]
    fields += ["found string", "score double", "support double"][: len(names)]
    made = rows.mapInArrow(predict, ", ".join(fields))
    return made.select(
        *[F.col(k).alias(c) for k, c in zip(kept, keep)],
        *[F.col(c).alias(name) for c, name in zip(columns, names)],
    )
