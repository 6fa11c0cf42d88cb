"""The cleaning plan: map, normalise, drop empty rows, choose, label."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from leadloom import functions as L
from leadloom.operators import cleaning
from leadloom.operators.cleaning import add_source_label, normalize_fields
from leadloom.operators.dedup import (
    Choice,
    best_contact_per_company,
    choose,
    choose_landed,
    contact_scores,
    duplicates_of,
    land_scores,
)
from leadloom.operators.mapping import HeaderMapping, apply_mapping
from leadloom.operators.report import stats
from leadloom.schema import TARGET, identity_columns


@dataclass(frozen=True)
class CleanOptions:
    """What a run does.  The last three deviate from the default results."""

    one_contact_per_company: bool = False
    source_label: str | None = None
    allow_schemeless: bool = False
    strict_titles: bool = False
    word_match: bool = False


class CleanResult:
    """Clean rows, ledger of dropped rows and one-row statistics.

    All are plans.  Those of the contacts chosen per company start from one landed table of ids,
    companies and scores: asking for any of them the first time scans the input, once.
    """

    def __init__(
        self, df: DataFrame, mapping: HeaderMapping, options: CleanOptions, look_up: Callable[[Choice], DataFrame] | None = None
    ):
        self._df, self._mapping, self._options, self._look_up = df, mapping, options, look_up

    @cached_property
    def _scores(self) -> DataFrame:
        return land_scores(row_scores(self._df, self._mapping, self._options))

    @cached_property
    def clean(self) -> DataFrame:
        if not self._options.one_contact_per_company:
            return clean_leads(self._df, self._mapping, self._options)
        return _chosen_leads(self._df, self._mapping, self._options, choose_landed(self._scores), self._look_up)

    @cached_property
    def stats(self) -> DataFrame:
        return stats(self.clean, self._df)

    @cached_property
    def drops(self) -> DataFrame:
        options = self._options
        if not options.one_contact_per_company:
            mapped = apply_mapping(self._df, self._mapping, options.strict_titles)
            return cleaning.drops_unfilled(mapped, options.allow_schemeless)
        empty = cleaning.empty_ledger(self._scores.where("NOT filled"))
        return empty.unionByName(duplicates_of(self._scores.where("filled AND company_key != ''").drop("filled")))


def filled_rows(df: DataFrame, mapping: HeaderMapping, options: CleanOptions) -> DataFrame:
    """Mapped and normalised rows that hold any data."""
    mapped = apply_mapping(df, mapping, options.strict_titles)
    filled = cleaning.filled_rows(mapped, options.allow_schemeless)
    return normalize_fields(filled, options.allow_schemeless)


def row_scores(df: DataFrame, mapping: HeaderMapping, options: CleanOptions) -> DataFrame:
    """What the choice per company needs of all rows, without normalising them."""
    mapped = apply_mapping(df, mapping, options.strict_titles)
    return contact_scores(mapped, options.word_match, options.allow_schemeless)


def chosen_rows(candidates: DataFrame, mapping: HeaderMapping, options: CleanOptions, choice: Choice) -> DataFrame:
    """``filled_rows`` of the choice's candidates, which are filled where the choice is exact."""
    make = normalized_rows if choice.exact else filled_rows
    return make(candidates, mapping, options)


def normalized_rows(df: DataFrame, mapping: HeaderMapping, options: CleanOptions) -> DataFrame:
    """All rows mapped and normalised, empty ones included."""
    return normalize_fields(
        apply_mapping(df, mapping, options.strict_titles), options.allow_schemeless
    )


def finish(filled: DataFrame, options: CleanOptions, choice: Choice | None = None) -> DataFrame:
    """From non-empty normalised rows (or only those that a ``choice`` names) to the clean table with its row identity."""
    kept = filled
    if options.one_contact_per_company:
        kept = best_contact_per_company(kept, options.word_match, choice)
    return add_source_label(kept, options.source_label).select(
        *identity_columns(filled.columns), *TARGET
    )


def clean_leads(
    df: DataFrame,
    mapping: HeaderMapping,
    options: CleanOptions = CleanOptions(),
    look_up: Callable[[Choice], DataFrame] | None = None,
) -> DataFrame:
    """The clean table of ``df``: ``row_index`` and the ten target columns.

    ``look_up`` gives the rows of ``df`` that are a choice's candidates, for tables that find them
    before anything wide is joined; a plain table is joined to their ids.
    """
    if not options.one_contact_per_company:
        return finish(filled_rows(df, mapping, options), options)
    return _chosen_leads(df, mapping, options, choose(row_scores(df, mapping, options)), look_up)


def _chosen_leads(
    df: DataFrame,
    mapping: HeaderMapping,
    options: CleanOptions,
    choice: Choice,
    look_up: Callable[[Choice], DataFrame] | None,
) -> DataFrame:
    candidates = look_up(choice) if look_up else choice.candidates(df)
    return finish(chosen_rows(candidates, mapping, options, choice), options, choice)


def clean(
    df: DataFrame,
    mapping: HeaderMapping,
    options: CleanOptions = CleanOptions(),
    look_up: Callable[[Choice], DataFrame] | None = None,
) -> CleanResult:
    """Clean table, ledger and statistics; ``look_up`` as for ``clean_leads``.

    Each of the three is a plan of its own.  To run more than one of them, land
    the normalised rows first (``leadloom.plans.run``), so that cells are
    normalised once.
    """
    return CleanResult(df, mapping, options, look_up)
