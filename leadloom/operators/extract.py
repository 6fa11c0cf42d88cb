"""Contact data found in free text (off by default)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_PHONE = r"\+[0-9][0-9 ().-]{6,18}[0-9]"


def extract_contacts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, kind, value)``: each distinct e-mail and phone of every text."""

    def found(pattern: str, kind: str):
        return F.transform(
            F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
            lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")),
        )

    # Both tests are cheap and skip nearly all texts before the full search.
    emails = F.when(F.contains(F.col(text), F.lit("@")), found(_EMAIL, "email"))
    phones = F.when(F.contains(F.col(text), F.lit("+")), found(_PHONE, "phone"))
    nothing = F.array().cast("array<struct<kind:string,value:string>>")
    return df.select(
        key,
        F.inline(F.concat(F.coalesce(emails, nothing), F.coalesce(phones, nothing))),
    )
