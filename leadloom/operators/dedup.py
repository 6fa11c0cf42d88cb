"""One contact per company.

A group is a company (inside one file, where rows carry ``source_file``), and a
single company may hold a large part of all rows.  So no operator here brings a
whole group together:

* the best contact is a top-1 window over ids and scores, which Spark reduces inside every
  map task (``WindowGroupLimit``) before anything is shuffled; whole rows follow by their ids;
* the duplicates come from an anti join on the row identity, whose hash is even
  whatever the company sizes are;
* rows without a company form a group of their own each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom import functions as L
from leadloom.schema import (
    DETAILS_DUPLICATE,
    REASON_DUPLICATE,
    ROW_INDEX,
    SOURCE_FILE,
    identity_columns,
)
from leadloom.sources.scratch import materialize, rows_with

#: Row positions below this share one 64-bit number with the priority.
_POSITION_LIMIT = 1 << 54
_SCORE = ("company_key", "priority_score")


def _scope(df: DataFrame) -> list[str]:
    return [SOURCE_FILE] if SOURCE_FILE in df.columns else []


def with_company_key(normalized: DataFrame) -> DataFrame:
    return normalized.withColumn("company_key", L.company_key(F.col("company_name")))


def with_priority(normalized: DataFrame, word_match: bool = False) -> DataFrame:
    return with_company_key(normalized).withColumn(
        "priority_score", L.priority_score(word_match)
    )


def contact_scores(mapped: DataFrame, word_match: bool = False, allow_schemeless: bool = False) -> DataFrame:
    """Ids, ``company_key``, ``priority_score`` and ``filled`` of rows that are mapped, but not normalised yet."""
    return mapped.select(
        *identity_columns(mapped.columns),
        L.company_key(F.col("company_name")).alias("company_key"),
        L.priority_to_be(word_match, allow_schemeless).alias("priority_score"),
        L.will_have_data(allow_schemeless).alias("filled"),
    )


@dataclass(frozen=True)
class Choice:
    """The ids, companies and scores of the contacts to keep, landed.

    ``exact`` says that each id stands for one row, so its candidates need no filter for empty
    rows; else ids that come again do not tell which row was chosen.
    """

    best: DataFrame
    exact: bool

    def candidates(self, df: DataFrame) -> DataFrame:
        """Rows of ``df`` that have the id of a contact to keep, whatever else is in them.

        Ask for them where rows are narrow, before texts are joined to them.
        """
        ids = identity_columns(df.columns)
        return rows_with(df, self.best.select(*ids), ids)


def choose(scores: DataFrame) -> Choice:
    """The best contact of each company, and every one without a company, by ``contact_scores`` alone.

    Without the column ``filled`` all rows count as filled.
    """
    return choose_landed(land_scores(scores))


def land_scores(scores: DataFrame) -> DataFrame:
    ids = identity_columns(scores.columns)
    filled = F.col("filled") if "filled" in scores.columns else F.lit(True).alias("filled")
    return materialize(scores.select(*ids, *_SCORE, filled), "contact_scores")


def choose_landed(landed: DataFrame) -> Choice:
    """``choose`` from scores that ``land_scores`` gave."""
    repeated = landed.groupBy(*identity_columns(landed.columns)).agg(F.count("*").alias("n")).where("n > 1")
    return Choice(materialize(_top(landed.where("filled").drop("filled")), "best_contacts"), repeated.isEmpty())


def best_contact_per_company(
    normalized: DataFrame, word_match: bool = False, choice: Choice | None = None
) -> DataFrame:
    """Rows with the highest priority per company; ties go to the first row.

    Rows without a company are all kept.

    Contacts are chosen by their ids, companies and scores, and whole rows are looked up for
    the chosen ones.  That reads ``normalized`` twice; with a ``choice`` made before, it holds
    what became of the ``choice.candidates``.
    """
    ids = identity_columns(normalized.columns)
    rows = with_priority(normalized, word_match)
    if choice is None:
        choice = choose(rows)
        rows = rows_with(rows, choice.best.select(*ids), ids)
    return rows if choice.exact else _top(rows_with(rows, choice.best, [*ids, *_SCORE]))


def _top(scored: DataFrame) -> DataFrame:
    """The best row of each company, and every row without one."""
    alone = F.when(F.col("company_key") == "", F.col(ROW_INDEX))
    group = Window.partitionBy(*_scope(scored), "company_key", alone).orderBy(
        F.col("priority_score").desc(), F.col(ROW_INDEX)
    )
    return (
        scored.withColumn("contact_rank", F.row_number().over(group))
        .where(F.col("contact_rank") == 1)
        .drop("contact_rank")
    )


def _rank_number() -> Column:
    """Priority and row position as one number, larger for the better contact.

    A hash aggregate can hold a number but not a struct, which would need the
    input sorted by company first.
    """
    position = F.when(
        F.col(ROW_INDEX).between(0, _POSITION_LIMIT - 1), F.col(ROW_INDEX)
    ).otherwise(F.raise_error(F.lit("row_index must lie in 0 .. 2^54-1")).cast("bigint"))
    return F.col("priority_score") * _POSITION_LIMIT + (_POSITION_LIMIT - 1 - position)


def company_groups(normalized: DataFrame, word_match: bool = False) -> DataFrame:
    """Per company: the contact to keep, its priority, group size and span.

    The members themselves stay rows (``company_members``); a list of them
    would put a whole company into one cell.
    """
    return _groups(with_priority(normalized, word_match))


def _groups(scored: DataFrame) -> DataFrame:
    scope = _scope(scored)
    return (
        scored.where(F.col("company_key") != "")
        .groupBy(*scope, "company_key")
        .agg(
            F.max(_rank_number()).alias("rank_number"),
            F.count("*").alias("contacts"),
            F.min(ROW_INDEX).alias("first_row_index"),
            F.max(ROW_INDEX).alias("last_row_index"),
        )
        .select(
            *scope,
            "company_key",
            (_POSITION_LIMIT - 1 - F.col("rank_number").bitwiseAND(_POSITION_LIMIT - 1)).alias(
                "kept_row_index"
            ),
            F.shiftright("rank_number", 54).alias("priority_score"),
            "contacts",
            "first_row_index",
            "last_row_index",
        )
    )


def company_members(normalized: DataFrame) -> DataFrame:
    """Row positions of every company, one row each."""
    return (
        with_company_key(normalized)
        .where(F.col("company_key") != "")
        .select(*_scope(normalized), "company_key", ROW_INDEX)
    )


def drops_duplicate(normalized: DataFrame, word_match: bool = False) -> DataFrame:
    """Ledger rows for contacts that lost against another one of their company.

    Rows are scored once; the narrow table of ids, companies and scores is landed, and groups
    and members both start from it.
    """
    return duplicates_of(materialize(company_scores(normalized, word_match), "company_scores"))


def company_scores(normalized: DataFrame, word_match: bool = False) -> DataFrame:
    """What the choice per company needs: ids, ``company_key`` and ``priority_score``."""
    ids = identity_columns(normalized.columns)
    scored = with_priority(normalized, word_match).where(F.col("company_key") != "")
    return scored.select(*ids, "company_key", "priority_score")


def duplicates_of(scores: DataFrame) -> DataFrame:
    """Ledger rows from a landed ``company_scores``."""
    ids = identity_columns(scores.columns)
    kept = _groups(scores).select(*_scope(scores), F.col("kept_row_index").alias(ROW_INDEX))
    return scores.join(kept, ids, "left_anti").select(
        *ids,
        F.lit(REASON_DUPLICATE).alias("reason"),
        F.concat(F.lit(DETAILS_DUPLICATE), F.col("company_key")).alias("details"),
    )


def without_company(normalized: DataFrame) -> DataFrame:
    return with_company_key(normalized).where(F.col("company_key") == "").drop("company_key")


def with_company(normalized: DataFrame) -> DataFrame:
    return with_company_key(normalized).where(F.col("company_key") != "").drop("company_key")


def output_order(df: DataFrame) -> DataFrame:
    """Kept contacts by company, then contacts without one, in file order.

    Sorts the whole table; use it for the final file only.
    """
    key = L.company_key(F.col("company_name"))
    return df.orderBy(*_scope(df), key == "", key, ROW_INDEX)
