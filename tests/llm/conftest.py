import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators might use inside.
        T.StructField("id", T.StringType()),
        T.StructField("twin", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("words", T.StringType()),
        T.StructField("bucket", T.StringType()),
    ]
)

SENTENCES = (
    "the quick brown fox jumps over the lazy dog near the river bank today",
    "ein kleiner Hund läuft über die grüne Wiese und sucht nach einem Ball",
    "le petit chat dort sur la chaise rouge près de la fenêtre ouverte",
    "el niño come una manzana roja mientras mira por la ventana abierta",
)


def awkward_texts() -> list[tuple[int | None, str | None, str | None]]:
    """Ids, texts and languages with every odd case."""
    rows: list[tuple[int | None, str | None, str | None]] = []
    for i in range(40):
        text = " ".join(f"{w}{i if k % 7 == 3 else ''}" for k, w in enumerate(SENTENCES[i % 4].split() * 3))
        rows.append((i * 3, text, ("en", "de", "fr", "es")[i % 4]))
    long = " ".join(f"word{i % 977} Über{i % 31}" for i in range(6000))
    rows += [
        (200, None, "en"),
        (201, "", "en"),
        (202, " \n\t ", None),
        (203, "12345 !!! $$$", "en"),
        (204, long, "en"),
        (205, long + " tail", "en"),
        (206, rows[0][1], "en"),  # an exact copy
        (207, rows[0][1], "en"),
        (207, rows[0][1], "en"),  # a repeated row
        (208, rows[1][1], None),  # equal ids, other texts
        (208, "one two three", "en"),
        (None, "null id text with a few words", "en"),
        (None, "null id text with a few words", "en"),
        (None, None, None),
        (209, "One TWO three", "en"),
        (210, "a\u00a0b \u3000 c\u2028d  e\r\n\r\nf\x1cg 𝔘𝔫𝔦 it's 'S", "fr"),
        (211, "\n".join(SENTENCES) + "\n", "de"),
        (212, "\n".join(reversed(SENTENCES)) + "\n", "de"),
        (-5, " ".join(SENTENCES * 2), "es"),
        (213, "before it " + " ".join(SENTENCES * 2) + " after it", None),
        (214, "ein Satz davor\n" + "  ".join((" ".join(SENTENCES * 3)).split()[7:80]), None),
        (300, "x" * 5000, None),
    ]
    # Words that hashes modulo a power of two cannot tell apart, alone and in long passages.
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate({97: "b", 98: "a"})
    passage = " ".join(f"same{i}" for i in range(49))
    rows += [(310, one, None), (311, other, None), (312, f"{passage} {one}", None), (313, f"{passage} {other}", None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward_texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = ("x",) * 6
    table = [(i, t, lang, "s", None if t is None else len(t), *extra) for i, t, lang in rows]
    return spark.createDataFrame(table, DOCUMENT).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENT)


def key(values):
    """A sort key for tuples with nulls."""
    return tuple((v is not None, v) for v in values)
