"""White space, null tokens and the plain text fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.schema import NULL_TOKENS, SUMMARY_LENGTH, WHITESPACE

_SPACES = "[" + WHITESPACE + "]+"

#: Bytes of a character at most.
UTF8_BYTES = 4


def strip(c: Column) -> Column:
    """Text without white space at both ends; null becomes the empty text."""
    return F.coalesce(F.btrim(c, F.lit(WHITESPACE)), F.lit(""))


def collapse(c: Column) -> Column:
    """Stripped text with every inner run of white space made one space."""
    return F.coalesce(F.btrim(F.regexp_replace(c, _SPACES, " ")), F.lit(""))


def drop_null_tokens(c: Column) -> Column:
    """Null where the raw cell is one of the "missing" tokens."""
    return F.when(~c.isin(*NULL_TOKENS), c)


def normalize_company(c: Column) -> Column:
    return strip(c)


def normalize_job_title(c: Column) -> Column:
    return collapse(c)


def normalize_summary(c: Column) -> Column:
    """Stripped text, at most 2,000 characters (code points) long.

    Counting characters walks through a text, so what fits by its bytes is not counted, and
    other texts in as many bytes only as the cut can have.  What follows the cut is found by its
    bytes, and white space at the end is trimmed only where the last bytes show some.
    """
    spaces = F.lit(WHITESPACE)
    begun = F.ltrim(c, spaces)
    raw = begun.cast("binary")

    def head(n: int) -> Column:
        return F.substring(raw, 1, n).cast("string")

    # A character that begins in the first 2,000 bytes ends in these: are they one byte each?
    enough = SUMMARY_LENGTH + UTF8_BYTES - 1
    cut = (
        F.when(F.octet_length(raw) <= SUMMARY_LENGTH, begun)
        .when(F.length(head(enough)) == enough, head(SUMMARY_LENGTH))
        .otherwise(F.substring(head(UTF8_BYTES * SUMMARY_LENGTH), 1, SUMMARY_LENGTH))
    )
    rest = F.substr(raw, F.octet_length(cut) + 1).cast("string")
    goes_on = F.ltrim(rest, spaces) != ""
    # A character of white space has three bytes at most.
    last = F.substring(cut.cast("binary"), -3, 3).cast("string")
    trimmed = F.when(last.rlike(f"[{WHITESPACE}]\\z"), F.rtrim(cut, spaces)).otherwise(cut)
    return F.coalesce(F.when(goes_on, cut).otherwise(trimmed), F.lit(""))


def normalize_sources(c: Column) -> Column:
    """The text as it is, unless there is nothing but white space in it."""
    return F.when(strip(c) != "", c).otherwise("")


def source_label(sources: Column, label: str) -> Column:
    """``label`` appended to the sources already listed."""
    listed = strip(sources)
    return F.when(listed != "", F.concat(listed, F.lit(", " + label))).otherwise(label)
