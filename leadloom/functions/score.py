"""Predicates and the contact priority, all over normalised fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from leadloom.functions.contact import normalize_email
from leadloom.functions.text import collapse, strip
from leadloom.functions.urls import is_profile_url, normalize_linkedin_url
from leadloom.schema import (
    SCORE_EMAIL,
    SCORE_PROFILE,
    SCORE_SENIOR,
    SENIOR_KEYWORDS,
    TARGET,
    WHITESPACE,
)

#: Short fields whose normal form is empty only where the cell is blank.
_SHORT_TEXTS = (
    "company_name", "last_name", "first_name", "job_title", "sources",
)

def company_key(company: Column) -> Column:
    """Company name as compared: stripped and in lower case."""
    return F.lower(strip(company))


def has_data() -> Column:
    """True where any of the ten normalised fields holds text."""
    return reduce(lambda a, b: a | b, [F.col(c) != "" for c in TARGET])


def will_have_data(allow_schemeless: bool = False) -> Column:
    """``has_data`` told from the mapped, still raw cells.

    Filtering on normalised columns would make Catalyst copy their expressions
    into the filter.  This test is written for raw cells: it runs right after
    the scan, the first filled field ends it, and text is read only up to its
    first character that is not white space.
    """
    blank_free = f"[^{WHITESPACE}]"
    tests = [
        F.concat_ws("", *_SHORT_TEXTS).rlike(blank_free),
        F.col("company_summary").rlike(blank_free),
        F.col("phone_number").rlike(r"[\p{Nd}+]"),
        F.contains("email", F.lit("@")) & (normalize_email(F.col("email")) != ""),
        # White space and control characters around an address go; nothing may be left.
        F.col("website").rlike(f"[^{WHITESPACE}\x00-\x20]"),
        is_profile_url(F.col("linkedin_url")),
    ]
    if allow_schemeless:
        tests.append(normalize_linkedin_url(F.col("linkedin_url"), True) != "")
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def will_be_filled(allow_schemeless: bool = False) -> dict[str, Column]:
    """Whether each field will hold text once it is normalised, told from the mapped, still raw cells.

    ``will_have_data`` says that of any of them.  Nothing is rewritten, so this costs much less
    than normalising a row.
    """
    filled = f"[^{WHITESPACE}]"
    words = F.col("last_name").rlike(f"{filled}[{WHITESPACE}]+{filled}")
    tests = {c: F.col(c).rlike(filled) for c in TARGET} | {
        # Several words of a last name give the missing first name too.
        "first_name": F.col("first_name").rlike(filled) | words,
        "email": F.contains("email", F.lit("@")) & (normalize_email(F.col("email")) != ""),
        "phone_number": F.col("phone_number").rlike(r"[\p{Nd}+]"),
        "website": F.col("website").rlike(f"[^{WHITESPACE}\x00-\x20]"),
        "linkedin_url": is_profile_url(F.col("linkedin_url")),
    }
    if allow_schemeless:
        tests["linkedin_url"] = normalize_linkedin_url(F.col("linkedin_url"), True) != ""
    return {c: F.coalesce(tests[c], F.lit(False)) for c in TARGET}


def priority_to_be(word_match: bool = False, allow_schemeless: bool = False) -> Column:
    """``priority_score`` told from the mapped, still raw cells; every address that is kept has ``@`` and a dot."""
    points = {"email": SCORE_EMAIL, "linkedin_url": SCORE_PROFILE}
    filled = will_be_filled(allow_schemeless)
    score = reduce(
        lambda a, b: a + b, [F.when(filled[c], F.lit(points.get(c, 0) + 1)).otherwise(F.lit(0)) for c in TARGET]
    )
    senior = F.coalesce(F.lower(collapse(F.col("job_title"))).rlike(_senior(word_match)), F.lit(False))
    return (score + F.when(senior, F.lit(SCORE_SENIOR)).otherwise(F.lit(0))).cast("bigint")


def _senior(word_match: bool) -> str:
    words = "|".join(SENIOR_KEYWORDS)
    return rf"\b(?:{words})\b" if word_match else words


def priority_score(word_match: bool = False) -> Column:
    """Contact priority, 0 to 190, from the ten normalised columns.

    Senior words count as substrings of the job title (``contractor`` contains
    ``cto``); ``word_match`` asks for whole words.
    """
    email = F.col("email")

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    score = (
        points(F.contains(email, F.lit("@")) & F.contains(email, F.lit(".")), SCORE_EMAIL)
        + points(F.col("linkedin_url") != "", SCORE_PROFILE)
        + points(F.lower("job_title").rlike(_senior(word_match)), SCORE_SENIOR)
    )
    filled = reduce(lambda a, b: a + b, [points(F.col(c) != "", 1) for c in TARGET])
    return (score + filled).cast("bigint")
