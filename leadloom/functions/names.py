"""Person names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions.text import collapse, strip
from leadloom.schema import NAME_PUNCTUATION, NAME_TITLES, WHITESPACE

_TITLES = "|".join(t.replace(".", r"\.") for t in NAME_TITLES)
_TITLE = f"(?i)^(?:{_TITLES})"
#: A title that stands for itself: dotted, or followed by a space or the end.
_WHOLE_TITLE = rf"(?i)^(?:(?:{_TITLES})(?<=\.)|(?:{_TITLES})(?=\s|$))"

#: The text after the first comma, or else the first word.
_FIRST = f"(?s)^(?:[^,]*,(.*)|([^,{WHITESPACE}]*)[^,]*)$"
#: The text before the first comma, or else the last of several words.
_LAST = f"(?s)^(?:([^,]*),.*|[^,{WHITESPACE}]*(?:[^,]*[{WHITESPACE}])?([^,{WHITESPACE}]*))$"


def normalize_name(c: Column) -> Column:
    """White space collapsed, each word with one capital letter in front."""
    return F.initcap(collapse(c))


def split_full_names(first: Column, last: Column) -> Column:
    """Struct ``(first, last)`` of two normalised name fields.

    A last name of several words next to an empty first name is taken apart:
    the first word becomes the first name, all others stay the last name.
    """
    apart = (first == "") & F.contains(last, F.lit(" "))
    return F.struct(
        F.when(apart, F.substring_index(last, " ", 1)).otherwise(first).alias("first"),
        F.when(apart, F.regexp_replace(last, "^[^ ]* ", "")).otherwise(last).alias("last"),
    )


def clean_name_part(c: Column, strict_titles: bool = False) -> Column:
    """One name part without a leading title and without outer punctuation.

    By default a title is removed wherever the text starts with its letters
    (``Sirius`` gives ``ius``); ``strict_titles`` asks for a whole word.
    """
    untitled = strip(F.regexp_replace(strip(c), _WHOLE_TITLE if strict_titles else _TITLE, ""))
    return strip(F.btrim(untitled, F.lit(NAME_PUNCTUATION)))


def split_names(c: Column, strict_titles: bool = False) -> Column:
    """Struct ``(first, last)`` of a whole name.

    ``Last, First`` is cut at the first comma; otherwise the first and the last
    word are used.  With ``strict_titles`` a leading title goes before the cut,
    so ``Mr. John Smith`` keeps ``John``.
    """
    text = strip(c)
    if strict_titles:
        text = strip(F.regexp_replace(text, _WHOLE_TITLE, ""))
    first = F.regexp_replace(text, _FIRST, "$1$2")
    last = F.regexp_replace(text, _LAST, "$1$2")
    return F.struct(
        clean_name_part(first, strict_titles).alias("first"),
        clean_name_part(last, strict_titles).alias("last"),
    )
