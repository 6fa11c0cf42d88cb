"""Header mapping: which input column feeds which target column.

Replies are data: one row ``(source_file, reply)`` per file, next to a table of
headers ``(source_file, pos, input_header)``.  Everything is joined on the file
and the header, so any number of feeds is validated in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from leadloom import functions as L
from leadloom.schema import (
    HEADER_ALIASES,
    PROFILE_TARGETS,
    REPLY_SCHEMA,
    ROW_INDEX,
    SOURCE_FILE,
    SPLIT_HEADERS,
    TARGET,
    identity_columns,
)

SPLIT_SUFFIX = "__SPLIT__"
SPLIT_TARGET = "split_names"


@dataclass(frozen=True)
class HeaderMapping:
    """Mapping of one table: ``direct`` header -> target, headers to split."""

    direct: Mapping[str, str] = field(default_factory=dict)
    splits: Sequence[str] = ()
    unmapped: Sequence[str] = ()

    @property
    def pairs(self) -> dict[str, str]:
        """All pairs in one map, as they are shown in reports."""
        marks = {f"{h}{SPLIT_SUFFIX}": SPLIT_TARGET for h in self.splits}
        return {**self.direct, **marks}


# -- replies ---------------------------------------------------------------


def _reply_text(reply: Column) -> Column:
    """Reply without the code fence that may surround it."""
    text = L.strip(reply)
    text = F.regexp_replace(text, "^```json", "")
    text = F.regexp_replace(text, "^```", "")
    return L.strip(F.regexp_replace(text, "```$", ""))


def _last_of_each(pairs: Column) -> Column:
    """A map read from JSON, whose keys may repeat: the first place of a key, its last value."""
    entries = F.map_entries(pairs)
    keys = F.map_keys(pairs)
    once = F.transform(
        F.array_distinct(keys),
        lambda key: F.struct(
            key.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == key), -1)["value"].alias("value")
        ),
    )
    return F.map_from_entries(once)


def parse_replies(replies: DataFrame) -> DataFrame:
    """``(source_file, parsed, reason)``; exactly one of the last two is null.

    JSON inside other text is accepted as well.  ``reason`` is
    ``empty_response`` or ``invalid_json``.  Of a repeated key the last value counts
    (``tune`` lets the JSON parser accept them).
    """
    # Each step is a projection of its own, so that a reply is parsed once and not per use.
    text, inner = F.col("text"), F.col("inner")
    tried = replies.select(
        SOURCE_FILE, "reply", _reply_text(F.col("reply")).alias("text"),
        F.regexp_extract(F.col("reply"), r"(?s)\{.*\}", 0).alias("inner"),
    ).select(
        SOURCE_FILE, "reply", "text", "inner", F.try_parse_json(text).isNotNull().alias("whole"),
    )
    json_text = F.when(F.col("whole") & F.startswith(text, F.lit("{")), text).when(
        ~F.col("whole") & F.try_parse_json(inner).isNotNull(), inner
    )
    read = tried.select(SOURCE_FILE, "reply", json_text.alias("json_text")).select(
        SOURCE_FILE, "reply", "json_text", F.from_json("json_text", REPLY_SCHEMA).alias("read")
    )
    return read.select(
        SOURCE_FILE,
        F.struct(
            *(
                F.coalesce(_last_of_each(F.col("read")[name]), F.create_map().cast("map<string,string>")).alias(name)
                for name in ("mapping", "split_fields")
            ),
            F.coalesce(F.col("read")["unmapped"], F.array().cast("array<string>")).alias("unmapped"),
        ).alias("parsed"),
        F.when(L.strip(F.col("reply")) == "", "empty_response")
        .when(F.col("json_text").isNull(), "invalid_json")
        .alias("reason"),
    ).withColumn("parsed", F.when(F.col("reason").isNull(), F.col("parsed")))


def proposals(parsed: DataFrame) -> DataFrame:
    """``(source_file, pos, input_header, target)`` in reply order."""
    return parsed.where("reason IS NULL").select(
        SOURCE_FILE, F.posexplode("parsed.mapping").alias("pos", "input_header", "target")
    )


def validate_mapping(proposed: DataFrame, headers: DataFrame) -> DataFrame:
    """Every proposed pair with its verdict in ``status``.

    ``ok``, ``unknown_header``, ``unknown_target`` or ``target_taken``: among
    the pairs that pass the first two tests, the first one per target wins.
    """
    known = headers.select(SOURCE_FILE, "input_header").distinct().withColumn("known", F.lit(True))
    checked = proposed.join(known, [SOURCE_FILE, "input_header"], "left").withColumn(
        "status",
        F.when(F.col("known").isNull(), "unknown_header")
        .when(F.col("target").isNull() | ~F.col("target").isin(*TARGET), "unknown_target")
        .otherwise("ok"),
    )
    # A file has a few dozen headers, so these groups are small by nature.
    same_target = Window.partitionBy(SOURCE_FILE, "target", "status").orderBy("pos")
    return checked.select(
        SOURCE_FILE,
        "pos",
        "input_header",
        "target",
        F.when(
            (F.col("status") == "ok") & (F.row_number().over(same_target) > 1), "target_taken"
        )
        .otherwise(F.col("status"))
        .alias("status"),
    )


def split_marks(parsed: DataFrame, headers: DataFrame) -> DataFrame:
    """Headers whose cells hold whole names: ``(source_file, pos, input_header)``."""
    marked = parsed.where("reason IS NULL").select(
        SOURCE_FILE,
        F.posexplode(F.map_keys("parsed.split_fields")).alias("pos", "input_header"),
    )
    return marked.join(
        headers.select(SOURCE_FILE, "input_header"), [SOURCE_FILE, "input_header"], "left_semi"
    ).select(SOURCE_FILE, "pos", "input_header")


def unmapped_headers(parsed: DataFrame, headers: DataFrame, validated: DataFrame) -> DataFrame:
    """Headers without a direct target, and those the reply lists as such."""
    mapped = validated.where("status = 'ok'").select(SOURCE_FILE, "input_header")
    answered = parsed.where("reason IS NULL")
    left_over = (
        headers.join(answered, SOURCE_FILE, "left_semi")
        .join(mapped, [SOURCE_FILE, "input_header"], "left_anti")
        .select(SOURCE_FILE, "input_header")
    )
    listed = answered.select(SOURCE_FILE, F.explode("parsed.unmapped").alias("input_header"))
    return left_over.unionByName(listed).distinct()


def mapping_table(parsed: DataFrame, headers: DataFrame) -> DataFrame:
    """Accepted pairs and split marks: ``(source_file, pos, input_header, target, kind)``."""
    direct = validate_mapping(proposals(parsed), headers).where("status = 'ok'")
    split = split_marks(parsed, headers).withColumn("target", F.lit(SPLIT_TARGET))
    columns = [SOURCE_FILE, "pos", "input_header", "target"]
    return direct.select(*columns, F.lit("direct").alias("kind")).unionByName(
        split.select(*columns, F.lit("split").alias("kind"))
    )


def mapping_for(mapping: HeaderMapping, headers: DataFrame) -> DataFrame:
    """One mapping for all files as a ``mapping_table``: headers that a file lacks are skipped."""
    pairs = [*mapping.direct.items(), *((h, SPLIT_TARGET) for h in mapping.splits)]
    rows = [(i, h, t, "direct" if i < len(mapping.direct) else "split") for i, (h, t) in enumerate(pairs)]
    given = headers.sparkSession.createDataFrame(rows, "pos int, input_header string, target string, kind string")
    return headers.select(SOURCE_FILE, "input_header").join(given, "input_header").select(
        SOURCE_FILE, "pos", "input_header", "target", "kind"
    )


def unmapped_by(mapping: DataFrame, headers: DataFrame) -> DataFrame:
    """``(source_file, input_header)`` of all headers that feed no target directly."""
    return headers.select(SOURCE_FILE, "input_header").join(
        mapping.where("kind = 'direct'"), [SOURCE_FILE, "input_header"], "left_anti"
    )


def mapping_of_files(mapping: DataFrame, unmapped: DataFrame) -> DataFrame:
    """One row per file: ``(source_file, mapping, unmapped_input_headers)``, as reports show them."""
    shown = F.when(
        F.col("kind") == "split", F.concat("input_header", F.lit(SPLIT_SUFFIX))
    ).otherwise(F.col("input_header"))
    # A file has a few dozen headers, so a map of them is small by nature.
    # A header may be called like another one's mark; the mark, of the later kind, is shown.
    pairs = mapping.groupBy(SOURCE_FILE, shown.alias("key")).agg(
        F.max_by("target", "kind").alias("target"), F.max(F.struct("kind", "pos")).alias("place")
    )
    entries = F.sort_array(F.collect_list(F.struct("place", "key", "target")))
    maps = pairs.groupBy(SOURCE_FILE).agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], e["target"]))).alias("mapping")
    )
    left = unmapped.groupBy(SOURCE_FILE).agg(
        F.sort_array(F.collect_set("input_header")).alias("unmapped_input_headers")
    )
    return maps.join(left, SOURCE_FILE, "full")


# -- applying --------------------------------------------------------------


def apply_mapping(df: DataFrame, mapping: HeaderMapping, strict_titles: bool = False) -> DataFrame:
    """The ten target columns of ``df`` in one projection, raw cells.

    Headers that ``df`` lacks are skipped.  Split marks come after the direct
    pairs and replace first and last name; the last mark wins.  An empty
    mapping gives an empty table.
    """
    # Headers are data: they may hold any character, or differ in case only, so columns are
    # taken by position.  Of equal names the first is meant.
    names = df.columns
    df = df.toDF(*(f"c{i}" for i in range(len(names))))
    at = {name: F.col(f"c{i}") for i, name in reversed(list(enumerate(names)))}
    cells: dict[str, Column] = {c: F.lit(None) for c in TARGET}
    for header, target in mapping.direct.items():
        if header in at:
            cells[target] = at[header]
    split = [h for h in mapping.splits if h in at]
    if split:
        name = L.split_names(at[split[-1]], strict_titles)
        cells["first_name"], cells["last_name"] = name["first"], name["last"]
    mapped = df.select(
        *(at[c].alias(c) for c in identity_columns(names)), *(cells[c].cast("string").alias(c) for c in TARGET)
    )
    return mapped if mapping.pairs else mapped.where(F.lit(False))


def cell_positions(headers: DataFrame, mapping: DataFrame) -> DataFrame:
    """The mapping as one row per file: the cell position of each target."""
    located = mapping.withColumnRenamed("pos", "reply_pos").join(
        headers.select(SOURCE_FILE, "pos", "input_header"), [SOURCE_FILE, "input_header"]
    )
    return located.groupBy(SOURCE_FILE).agg(
        *(
            F.max_by(
                "pos", F.when((F.col("kind") == "direct") & (F.col("target") == t), F.col("reply_pos"))
            ).alias(f"at_{t}")
            for t in TARGET
        ),
        F.max_by("pos", F.when(F.col("kind") == "split", F.col("reply_pos"))).alias("at_split"),
    )


def with_positions(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows of files that have an accepted pair, with the positions of their file's targets.

    Ask for them where rows are narrow, before cells are joined to them.
    """
    return rows.join(positions, SOURCE_FILE)


def apply_mapping_table(
    rows: DataFrame, positions: DataFrame | None = None, strict_titles: bool = False
) -> DataFrame:
    """Targets of many feeds at once: ``rows`` hold ``cells`` by position.

    ``positions`` (``cell_positions``) is joined to the rows, unless they went through
    ``with_positions`` before; files without an accepted pair give no rows.  Land it first for
    large inputs: Spark then knows its size and broadcasts it if, and only if, it is small;
    otherwise whole rows are shuffled, and a file with very many of them is split by the adaptive
    skew join.
    """
    split_name = L.split_names(F.get("cells", "at_split"), strict_titles)

    def cell(target: str) -> Column:
        raw = F.get("cells", f"at_{target}")
        part = {"first_name": "first", "last_name": "last"}.get(target)
        if part is None:
            return raw
        return F.when(F.col("at_split").isNotNull(), split_name[part]).otherwise(raw)

    placed = rows if positions is None else with_positions(rows, positions)
    return placed.select(SOURCE_FILE, ROW_INDEX, *(cell(t).alias(t) for t in TARGET))


# -- profile and proposal --------------------------------------------------

_EMAIL_LIKE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
_PHONE_LIKE = r"^\+?[0-9 ().\-]{7,20}$"
_PHONE_LENGTH = 21
_URL_START = r"^(https?://|www\.)"
_URL_LIKE = r"^(https?://|www\.)[^\s]+$"
_TWO_WORDS = r"^[^\s0-9@/]+ [^\s0-9@/]+$"
_LONG_TEXT = 200

PROFILE_TESTS = ("email", "phone", "linkedin", "url", "two_words", "long_text")


def _cell_tests(cell: Column) -> dict[str, Column]:
    """A cheap test goes first and spares long cells the regular expression."""
    return {
        "filled": cell != "",
        "email": F.contains(cell, F.lit("@")) & cell.rlike(_EMAIL_LIKE),
        "phone": (F.octet_length(cell) <= _PHONE_LENGTH) & cell.rlike(_PHONE_LIKE),
        "linkedin": F.contains(cell, F.lit("/"))
        & F.contains(F.lower(cell), F.lit("linkedin.com/")),
        "url": F.lower(F.substring(cell, 1, 8)).rlike(_URL_START)
        & F.lower(cell).rlike(_URL_LIKE),
        "two_words": cell.rlike(_TWO_WORDS),
        "long_text": F.length(cell) > _LONG_TEXT,
    }


def _with_shares(profile: DataFrame) -> DataFrame:
    shares = [
        F.when(F.col("filled") > 0, F.col(t) / F.col("filled")).otherwise(0.0).alias(f"{t}_share")
        for t in PROFILE_TESTS
    ]
    return profile.select(
        "*",
        F.when(F.col("filled") > 0, F.col("characters") / F.col("filled"))
        .otherwise(0.0)
        .alias("mean_length"),
        *shares,
    )


def column_profile(df: DataFrame, columns: Sequence[str], distinct: bool = True) -> DataFrame:
    """What the cells of each column look like: one row per column.

    All columns are measured in a single aggregate; only its one row is turned
    into a table afterwards.
    """
    aggregates: list[Column] = []
    for i, name in enumerate(columns):
        cell = L.strip(F.col("`" + name.replace("`", "``") + "`"))
        aggregates += [F.count_if(t).alias(f"{k}_{i}") for k, t in _cell_tests(cell).items()]
        aggregates.append(F.sum(F.length(cell)).alias(f"characters_{i}"))
        if distinct:
            aggregates.append(
                F.approx_count_distinct(F.when(cell != "", cell)).alias(f"distinct_{i}")
            )
    measures = ["filled", *PROFILE_TESTS, "characters"] + (["distinct"] if distinct else [])
    entries = F.array(
        *(
            F.struct(
                F.lit(i).cast("bigint").alias("pos"),
                F.lit(name).alias("input_header"),
                *(F.coalesce(F.col(f"{m}_{i}"), F.lit(0)).cast("bigint").alias(m) for m in measures),
            )
            for i, name in enumerate(columns)
        )
    )
    return _with_shares(df.agg(*aggregates).select(F.inline(entries)))


def feed_profile(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """What the cells of each column of each file look like: one row per file and header.

    ``rows`` hold ``cells`` by position, so files of any layout are measured in one aggregate
    over ``(source_file, pos)``, combined in map tasks.  ``sketch`` is a HyperLogLog sketch of
    the filled cells, ``distinct`` its estimate; sketches of several runs or files merge
    (``merge_profiles``).  Headers without any row have zeros.
    """
    cells = rows.select(SOURCE_FILE, F.posexplode("cells").alias("pos", "cell")).withColumn(
        "cell", L.strip(F.col("cell"))
    )
    counts = [F.count_if(t).alias(k) for k, t in _cell_tests(F.col("cell")).items()]
    measured = cells.groupBy(SOURCE_FILE, "pos").agg(
        *counts,
        F.sum(F.length("cell")).cast("bigint").alias("characters"),
        F.hll_sketch_agg(F.when(F.col("cell") != "", F.col("cell"))).alias("sketch"),
    )
    return _profile(headers.select(SOURCE_FILE, "pos", "input_header").join(measured, [SOURCE_FILE, "pos"], "left"))


def _profile(measured: DataFrame) -> DataFrame:
    whole = measured.select(
        *(c for c in measured.columns if c in (SOURCE_FILE, "input_header")),
        F.col("pos").cast("bigint").alias("pos"),
        *(F.coalesce(m, F.lit(0)).cast("bigint").alias(m) for m in ("filled", *PROFILE_TESTS, "characters")),
        F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("distinct"),
        "sketch",
    )
    return _with_shares(whole)


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of several files as one per header name, whatever its place: counts add, sketches merge."""
    sums = [F.sum(m).alias(m) for m in ("filled", *PROFILE_TESTS, "characters")]
    return _profile(
        profiles.groupBy("input_header").agg(F.min("pos").alias("pos"), *sums, F.hll_union_agg("sketch").alias("sketch"))
    )


def _header_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def propose_mapping(profile: DataFrame) -> DataFrame:
    """A mapping found from header names and cell contents.

    This is our own rule and stands in for a language model: 100 points for a
    known header name, up to 100 for the share of cells that look right; pairs
    from 50 points that are best for both the header and the target are kept,
    ties going to the earlier header and target.  Headers of whole names become
    split marks.  Returns ``(pos, input_header, target, kind, score)``; a profile of
    several files (``feed_profile``) gives a mapping for each, with ``source_file``.
    """
    file = [c for c in profile.columns if c == SOURCE_FILE]
    key = _header_key(F.col("input_header"))
    aliases = F.create_map(
        *(
            F.lit(x)
            for target, names in HEADER_ALIASES.items()
            for name in names
            for x in (name, target)
        )
    )
    alias_hits = profile.select(
        *file, "pos", "input_header", F.try_element_at(aliases, key).alias("target"),
        F.lit(100).cast("bigint").alias("points"),
    ).where("target IS NOT NULL")
    looks = profile.select(
        *file,
        "pos",
        "input_header",
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(target).alias("target"),
                        F.floor(F.col(f"{test}_share") * 100).cast("bigint").alias("points"),
                    )
                    for test, target in PROFILE_TARGETS.items()
                )
            )
        ),
    )
    target_pos = F.array_position(F.array(*(F.lit(t) for t in TARGET)), F.col("target"))
    by_header = Window.partitionBy(*file, "pos").orderBy(F.desc("score"), "pos", "target_pos")
    by_target = Window.partitionBy(*file, "target").orderBy(F.desc("score"), "pos", "target_pos")
    direct = (
        alias_hits.unionByName(looks)
        .groupBy(*file, "pos", "input_header", "target")
        .agg(F.sum("points").alias("score"))
        .where("score >= 50")
        .withColumn("target_pos", target_pos)
        .withColumn("header_rank", F.row_number().over(by_header))
        .withColumn("target_rank", F.row_number().over(by_target))
        .where("header_rank = 1 AND target_rank = 1")
        .select(*file, "pos", "input_header", "target", F.lit("direct").alias("kind"), "score")
    )
    split = profile.where(key.isin(*SPLIT_HEADERS)).select(
        *file,
        "pos",
        "input_header",
        F.lit(SPLIT_TARGET).alias("target"),
        F.lit("split").alias("kind"),
        F.lit(100).cast("bigint").alias("score"),
    )
    return direct.unionByName(split)


def collect_mapping(table: DataFrame) -> HeaderMapping:
    """The mapping of one file as a plain value (a row per header)."""
    rows = sorted(table.collect(), key=lambda r: r["pos"])
    return HeaderMapping(
        direct={r["input_header"]: r["target"] for r in rows if r["kind"] == "direct"},
        splits=[r["input_header"] for r in rows if r["kind"] == "split"],
    )
