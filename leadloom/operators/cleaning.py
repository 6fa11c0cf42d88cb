"""From mapped columns to normalised, non-empty rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom import functions as L
from leadloom.schema import (
    DETAILS_EMPTY,
    REASON_EMPTY,
    TARGET,
    identity_columns,
)


def normalize_fields(df: DataFrame, allow_schemeless: bool = False) -> DataFrame:
    """The ten target columns normalised; nulls become empty texts."""
    names = L.split_full_names(
        L.normalize_name(F.col("first_name")), L.normalize_name(F.col("last_name"))
    )
    fields = {
        "first_name": names["first"],
        "last_name": names["last"],
        "company_name": L.normalize_company(F.col("company_name")),
        "email": L.normalize_email(F.col("email")),
        "phone_number": L.normalize_phone(F.col("phone_number")),
        "job_title": L.normalize_job_title(F.col("job_title")),
        "linkedin_url": L.normalize_linkedin_url(F.col("linkedin_url"), allow_schemeless),
        "website": L.normalize_website(F.col("website")),
        "company_summary": L.normalize_summary(F.col("company_summary")),
        "sources": L.normalize_sources(F.col("sources")),
    }
    return df.select(
        *identity_columns(df.columns), *(fields[c].alias(c) for c in TARGET)
    )


def non_empty_rows(normalized: DataFrame) -> DataFrame:
    """Normalised rows with data in any field."""
    return normalized.where(L.has_data())


def filled_rows(mapped: DataFrame, allow_schemeless: bool = False) -> DataFrame:
    """Mapped rows that will not be empty once they are normalised."""
    return mapped.where(L.will_have_data(allow_schemeless))


def empty_ledger(empty: DataFrame) -> DataFrame:
    """Ledger rows for contacts known to be empty."""
    return empty.select(
        *identity_columns(empty.columns),
        F.lit(REASON_EMPTY).alias("reason"),
        F.lit(DETAILS_EMPTY).alias("details"),
    )


def drops_empty(normalized: DataFrame) -> DataFrame:
    """Ledger rows for normalised contacts that have no data at all."""
    return empty_ledger(normalized.where(~L.has_data()))


def drops_unfilled(mapped: DataFrame, allow_schemeless: bool = False) -> DataFrame:
    """The same ledger rows, told from mapped, still raw cells."""
    return empty_ledger(mapped.where(~L.will_have_data(allow_schemeless)))


def add_source_label(df: DataFrame, label: str | None) -> DataFrame:
    """``label`` appended to ``sources`` of every row; no label, no change."""
    if not label:
        return df
    return df.withColumn("sources", L.source_label(F.col("sources"), label))


def fill_company_from_email(normalized: DataFrame) -> DataFrame:
    """Missing company names guessed from the mail domain (off by default)."""
    return normalized.withColumn(
        "company_name", L.company_from_email(F.col("company_name"), F.col("email"))
    )
