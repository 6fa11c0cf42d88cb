"""Benchmark passages in documents: a prefix-filtered set join in native expressions.

An item's windows of consecutive words must occur in a document as a whole.
For containment of the whole window one prefix token is enough: its rarest
word, by how often words occur in all documents.  Documents are searched for
prefix words only.  A hit at word p and the prefix's place in the window fix where
the window would start (positional bound) and end (length bound); within these the
words themselves are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from leadloom.sources.scratch import materialize

WINDOW = 10
#: Words that may be compared as a set of literals; more of them are joined.
MAX_LITERALS = 100_000
#: Bytes of windows that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: str) -> Column:
    """Words of a text, A-Z lower-cased: runs of 0-9, a-z and all beyond ASCII.  Null has none."""
    body = F.col(text)
    # Lower-casing pure ASCII touches A-Z only, and is much cheaper.
    ascii_only = F.octet_length(body) == F.char_length(body)
    lowered = F.when(ascii_only, F.lower(body)).otherwise(F.translate(body, _UPPER, _LOWER))
    return F.coalesce(
        F.array_remove(F.split(lowered, _BETWEEN), ""), F.array().cast("array<string>")
    )


def windows(items: DataFrame, size: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows ``(window, items)``: the words, and the ids of the items that have them.

    An item with fewer words than ``size``, but some, is one window.
    """
    words = items.select(F.col(item_id).cast("string").alias("item"), word_list(text).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(size - 1), F.lit(1)))
    return (
        words.where(F.size("words") > 0)
        .select("item", "words", F.explode(starts).alias("start"))
        .groupBy(F.slice("words", F.col("start"), size).alias("window"))
        .agg(F.collect_set("item").alias("items"))
    )


def _positions(words: Column, wanted: DataFrame) -> Column | None:
    """Places of the wanted words, or None if there are too many for literals."""
    some = [r[0] for r in wanted.limit(MAX_LITERALS + 1).collect()]
    if len(some) > MAX_LITERALS:
        return None
    if not some:
        return F.array().cast("array<int>")
    found = F.transform(words, lambda w, i: F.when(w.isin(some), i))
    return F.filter(found, lambda i: i.isNotNull())


def frequencies(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """How often each word of ``vocabulary`` (column ``word``) occurs in all documents."""
    words = docs.select(word_list(text).alias("words"))
    some = [r[0] for r in vocabulary.limit(MAX_LITERALS + 1).collect()]
    if len(some) <= MAX_LITERALS:
        kept = F.filter("words", lambda w: w.isin(some)) if some else F.col("words")
        every = words.select(F.explode(kept).alias("word"))
        return every.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    every = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return every.join(vocabulary, "word", "left_semi")


def prefixed(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """``found`` windows with their prefix word (``token``) and its place in the window (``at``)."""
    each = found.select("window", "items", F.posexplode("window").alias("at", "word"))
    counted = materialize(
        frequencies(docs, each.select("word").distinct(), text), "prefix_frequencies"
    )
    return (
        each.join(counted, "word", "left")
        .groupBy("window")
        .agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("rarest"),
            F.first("items").alias("items"),
        )
        .select(
            F.col("rarest.word").alias("token"), F.col("rarest.at").alias("at"), "window",
            F.size("window").alias("length"), "items",
        )
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document: ``id_column, n_words, n_hit, n_items, items`` and the hit ``spans``.

    ``spans`` are ``(start, end)`` of merged-in windows in words, sorted; a word inside any of
    them is hit.  ``items`` are the ids as text, sorted; an item without an id marks
    words but is not listed.  Null or empty texts have no words; repeated rows and
    repeated ids are judged each on its own; without documents the result is empty, without
    items nothing is hit.  Other columns are not read.
    """
    table = materialize(
        prefixed(materialize(windows(items, size, item_id, item_text), "windows"), docs, text),
        "prefixed_windows",
    )
    size_of = table.agg(
        F.sum(F.octet_length(F.concat_ws(" ", "window")) + 8 * F.size("items") + 64)
    ).first()[0] or 0
    joined = F.broadcast(table) if size_of <= MAX_BROADCAST else table

    rows = docs.select(
        F.col(id_column).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        word_list(text).alias("words"),
    ).withColumn("n_words", F.size("words").cast("bigint"))
    places = _positions(F.col("words"), table.select("token").distinct())
    if places is None:
        # Too many prefix words: join all words once and keep the places of those wanted.
        # Row numbers are read twice here, so they are landed.
        rows = materialize(rows, "numbered_rows")
        every = rows.select("row", F.posexplode("words").alias("p", "token"))
        hit = every.join(table.select("token").distinct(), "token", "left_semi")
        rows = rows.join(hit.groupBy("row").agg(F.array_sort(F.collect_list("p")).alias("places")), "row", "left")
        rows = rows.withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    else:
        rows = rows.withColumn("places", places)

    def around(p: Column) -> Column:
        low = F.greatest(p - (size - 1), F.lit(0))
        return F.struct(
            p.alias("p"), low.alias("low"), F.get("words", p).alias("token"),
            F.slice("words", low + 1, F.lit(2 * size - 1)).alias("context"),
        )

    hits = rows.select(
        "id", "row", "n_words", F.posexplode_outer(F.transform("places", around)).alias("nth", "hit")
    ).select("id", "row", "n_words", "nth", "hit.p", "hit.low", "hit.context", F.col("hit.token").alias("token"))
    start = F.col("p") - F.col("at")
    same = (
        (start >= F.col("low"))
        & (start + F.col("length") <= F.col("n_words"))
        & (F.slice("context", start - F.col("low") + 1, F.col("length")) == F.col("window"))
    )
    tried = hits.join(joined, "token", "left").withColumn(
        "span",
        F.when(
            F.col("window").isNotNull()
            & F.when(start >= F.col("low"), same).otherwise(F.lit(False)),
            F.struct(start.cast("bigint").alias("start"), (start + F.col("length")).cast("bigint").alias("end")),
        ),
    )
    # A document without any match keeps its first row alone.
    per_doc = (
        tried.where(F.col("span").isNotNull() | F.coalesce(F.col("nth") == 0, F.lit(True)))
        .groupBy("row")
        .agg(
            F.first("id").alias("id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.collect_set("span")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("span").isNotNull(), F.col("items")))))).alias("items"),
        )
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("reach")),
        lambda done, s: F.struct(
            (done["n"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(s["start"], done["reach"]))).alias("n"),
            F.greatest(done["reach"], s["end"]).alias("reach"),
        ),
        lambda done: done["n"],
    )
    return per_doc.select(
        F.col("id").alias(id_column), "n_words", covered.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), "items", "spans",
    )
