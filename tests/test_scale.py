"""Plans that keep whole rows out of shuffles give the rows of the plain ones."""

from pyspark.sql import functions as F

from checks import leads as fixture, queries as Q
from checks.leads import raw_leads
from leadloom import CleanOptions, clean, clean_leads, functions as L
from leadloom.operators import cleaning, dedup, mapping as maps
from leadloom.operators.mapping import HeaderMapping
from leadloom.schema import SUMMARY_LENGTH, TARGET, WHITESPACE
from leadloom.sources import feeds, sinks
from leadloom.sources.scratch import likely_with, new_path


def _rows(spark, ids):
    """Contacts of two files, their numbers as given (they may repeat or be null)."""
    rows = [(f"f{i % 2}.csv", n, *(f"{c} {i}" for c in TARGET)) for i, n in enumerate(ids)]
    return spark.createDataFrame(rows, ", ".join(["source_file string, row_index bigint", *(f"{c} string" for c in TARGET)]))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_batch_ids_by_range(spark):
    clean = _rows(spark, [*range(40), *range(65_530, 65_560), 7, 9, 9, 65_540, None])
    want = sinks.payload_batches(clean, 500).drop("csv_bytes", "byte_offset")
    got = sinks.with_batch_id(clean, 500)
    assert got.columns == [*clean.columns, "batch_id"] and sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.select("batch_id").distinct().count() > 10
    # Whole rows meet small tables only.
    assert "Exchange hashpartitioning" not in _plan(sinks.with_batch_id(_rows(spark, range(40))))


def test_replies_are_parsed_once(spark):
    replies = spark.createDataFrame([("a", '{"mapping": {"x": "email", "y": "sources", "x": "phone_number"}}')], "source_file string, reply string")
    parsed = maps.parse_replies(replies)
    assert parsed.first()["parsed"]["mapping"] == {"x": "phone_number", "y": "sources"}
    assert parsed._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 1


def test_replies_use_all_cores(spark, sf_dir):
    assert fixture.feeds(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_join_last(spark, sf_dir):
    """No join or shuffle of feed rows comes after the one with the documents."""
    plan = fixture.feed_cells(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert "doc_id" in joins[0]


def test_feeds_are_mapped_before_the_texts_come_in(spark, sf_dir):
    """Positions of files and chosen ids are joined to narrow rows, not to whole ones."""
    for name, kinds in (("apply_feed_mapping", {"Inner"}), ("clean_feeds", {"Inner", "LeftSemi"})):
        plan = Q.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join " in line]
        assert "doc_id" in joins[0] and all(any(f"Join {kind}" in line for line in joins[1:]) for kind in kinds), name


def test_positions_may_come_before(spark):
    rows = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, ["z"]), ("a", 1, ["u", None])], "source_file string, row_index bigint, cells array<string>")
    headers = spark.createDataFrame([("a", 0, "E"), ("a", 1, "F"), ("b", 0, "E")], "source_file string, pos int, input_header string")
    mapping = spark.createDataFrame([("a", 0, "E", "email", "direct"), ("a", 1, "F", "sources", "direct")], "source_file string, pos int, input_header string, target string, kind string")
    positions = maps.cell_positions(headers, mapping)
    want = maps.apply_mapping_table(rows, positions)
    got = maps.apply_mapping_table(maps.with_positions(rows, positions))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.columns == want.columns and want.count() == 2


def test_sample_is_chosen_by_numbers(spark):
    rows = _rows(spark, [*range(100, 0, -1), 3, 3, None])
    got = sinks.sample_rows(rows, 4)
    assert sorted((r[0], r[1] or 0) for r in got.collect()) == [
        ("f0.csv", 0), ("f0.csv", 2), ("f0.csv", 3), ("f0.csv", 4), ("f1.csv", 1), ("f1.csv", 3), ("f1.csv", 3), ("f1.csv", 5)
    ]
    assert "LeftSemi" in _plan(got)


def test_landed_csv_is_compressed(spark, sf_dir):
    path = new_path(spark, "landed")
    raw_leads(spark, sf_dir).withColumnRenamed("row_index", "lead_no").write.options(**sinks.LANDED_CSV).csv(path)
    files = spark.read.format("binaryFile").load(path).select("path").collect()
    assert files and all(f[0].endswith(".csv.gz") for f in files)
    assert Q.csv_feeds(spark, sf_dir).count() == raw_leads(spark, sf_dir, ()).count()


def test_contacts_are_chosen_by_numbers(spark, sf_dir):
    """Whole rows are looked up for the chosen contacts, and shuffled no more after the documents came in."""
    for name in ("clean_leads_dedup", "best_contact_per_company", "concat_leads"):
        plan = Q.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        first = plan[: plan.index("doc_id")]
        assert "LeftSemi" in plan and "LeftSemi" not in first and "Window" not in plan


def test_scores_are_landed_once_for_rows_and_drops(spark, sf_dir):
    """Clean rows and ledger start from one table of scores; a file's rows are looked up by file and number."""
    result = clean(raw_leads(spark, sf_dir, source_file=True), Q.MAPPING, Q.DEDUP, lambda c: raw_leads(spark, sf_dir, source_file=True, choice=c))
    assert result._scores.inputFiles() and set(result.drops.inputFiles()) == set(result._scores.inputFiles())
    want = clean_leads(raw_leads(spark, sf_dir, source_file=True), Q.MAPPING, Q.DEDUP)
    assert sorted(map(str, result.clean.collect())) == sorted(map(str, want.collect()))
    file, number = raw_leads(spark, sf_dir, (), True).select("source_file", "row_index").first()
    best = spark.createDataFrame([(file, number), ("other.csv", number + 1), (None, number)], "source_file string, row_index bigint")
    rows = raw_leads(spark, sf_dir, ("about",), True, dedup.Choice(best, True))
    assert [(r["source_file"], r["row_index"]) for r in rows.collect()] == [(file, number)]


def test_likely_rows(spark):
    """All rows with a chosen id, null included, few others, and no shuffle of the table."""
    table = spark.range(20_000).selectExpr("id", "CASE WHEN id % 7 > 0 THEN id * 3 END AS `a.b`", "'x' AS v")
    chosen = table.where("id % 10 = 3").select("id", "`a.b`")
    got = likely_with(table, chosen, ["id", "`a.b`"])
    assert got.columns == table.columns and got.where("id % 10 = 3").count() == 2_000 and got.count() < 2_100
    assert likely_with(table, chosen.where("false"), ["id"]).isEmpty()
    nulls = table.where("`a.b` IS NULL")
    assert likely_with(table, nulls.limit(1).select("`a.b`"), ["`a.b`"]).count() >= nulls.count()
    probed = _plan(got).split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in probed and "Exchange" not in probed


def test_scores_of_raw_cells(spark):
    """Scores told from raw cells are those of the normalised rows."""
    texts = [None, "", " ", "\u00a0", "a", " a  b ", "x@y.co", "x@localhost", "+", "n/a 5", "#", "\x01", "//linkedin.com/in/a",
             "linkedin.com/in/a", "https://[x", "Vice  President", "contractor", "o'neil@x.com", "https://linkedin.com?x#y"]
    rows = [(n, *(t if c == d else None for d in TARGET)) for n, (c, t) in enumerate((c, t) for c in TARGET for t in texts)]
    rows += [(1000 + i, *(texts[(i * 7 + j * 3) % len(texts)] for j in range(len(TARGET)))) for i in range(40)]
    mapped = spark.createDataFrame(rows, "row_index bigint, " + ", ".join(f"{c} string" for c in TARGET))
    for schemeless in (False, True):
        for word_match in (False, True):
            want = dedup.with_priority(cleaning.normalize_fields(mapped, schemeless), word_match).withColumn("filled", L.has_data())
            got = dedup.contact_scores(mapped, word_match, schemeless)
            assert sorted(got.collect()) == sorted(want.select(got.columns).collect())


def test_choice_of_ids_that_come_again(spark):
    """One row is kept per company though its id stands for rows of others and empty ones; null is an id."""
    def row(n, company, **cells):
        given = {"company_name": company} | cells
        return (n, *(given.get(c, "") for c in TARGET))

    rows = [row(1, "A", email="a@x.co"), row(1, "A"), row(1, "B"), row(1, ""), row(2, "B"), row(2, "B"), row(3, "A"), row(3, "", email="q@x.co"), row(None, "C")]
    table = spark.createDataFrame(rows, "row_index bigint, " + ", ".join(f"{c} string" for c in TARGET))
    filled = table.where(L.has_data())
    want = [("", 3), ("A", 1), ("B", 1), ("C", None)]
    kept = dedup.best_contact_per_company(filled)
    assert sorted(((r["company_name"], r["row_index"]) for r in kept.collect()), key=str) == sorted(want, key=str)
    cleaned = clean_leads(table, HeaderMapping({c: c for c in TARGET}), CleanOptions(one_contact_per_company=True))
    assert sorted(((r["company_name"], r["row_index"]) for r in cleaned.collect()), key=str) == sorted(want, key=str)


def test_summaries_are_counted_once(spark):
    """Characters are counted in the bytes that a summary can have, not in whole texts."""
    ends = ["", "x", "é", "\u3000", "\u00a0", " \n", "𝔘", "\u2003x", "é ", "x\x85"]
    texts = [None, *(w + fill * n + a + b for w in ("", " \u3000") for fill in ("a", "é", "中", "𝔘", " b") for n in (0, 1, 665, 999, 1000, 1998, 1999, 2000, 2001, 2003) for a in ends for b in ("", " ", "tail"))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def want(text):
        begun = (text or "").lstrip(WHITESPACE)
        return begun[:SUMMARY_LENGTH] if begun[SUMMARY_LENGTH:].strip(WHITESPACE) else begun[:SUMMARY_LENGTH].rstrip(WHITESPACE)

    made = rows.select("i", L.normalize_summary(F.col("t")).alias("t"))
    assert {r["i"]: r["t"] for r in made.collect()} == {i: want(t) for i, t in enumerate(texts)}
    assert "substring(ltrim(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_splits_are_read_in_pieces(spark, tmp_path, monkeypatch):
    """Records over pieces of four lines are those over whole splits, whatever state a piece begins in."""
    lines = ["a,b"] + [("x,1", '"open', "still", 'shut",2', "", '"y ""q"" z",3', "  ", '"1\r', 'in ""', '",4')[i * 7 % 10 if i % 50 > 40 else i % 10] for i in range(200)]
    (tmp_path / "f.csv").write_text("\n".join(lines), newline="")
    (tmp_path / "never.csv").write_text('a,b\n1,2\n"x,y\n' + "1,2\n" * 9, newline="")
    whole = feeds.read_feeds(spark, str(tmp_path))
    made = [sorted(map(str, d.collect())) for d in (whole.headers, whole.rows, whole.rejects, whole.unread)]
    landed = []
    monkeypatch.setattr(feeds, "_PIECE_BITS", 2)
    monkeypatch.setattr(feeds, "materialize", lambda df, name, land=feeds.materialize: landed.append((name, land(df, name))) or landed[-1][1])
    pieces = feeds.read_feeds(spark, str(tmp_path))
    assert [sorted(map(str, d.collect())) for d in (pieces.headers, pieces.rows, pieces.rejects, pieces.unread)] == made
    assert dict(landed)["piece_states"].count() > 50 and len(made[1]) > 20 and len(made[3]) == 12
    # More tasks than shuffles have by default, where there are more lines.
    assert dict(landed)["marked_lines"].inputFiles().__len__() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_of_lines_are_shuffled_once(spark, tmp_path, monkeypatch):
    """States are told without texts; records are put together in pieces, and only cut ones meet again."""
    lines = ["a,b"] + [x for i in range(60) for x in (f'{i},"x', "", "m", f'y{i}"', f"p,{i}")]
    (tmp_path / "f.csv").write_text("\n".join(lines))
    landed = {}

    def land(df, name, land=feeds.materialize):
        landed[name] = land(df, name)
        return landed[name]

    monkeypatch.setattr(feeds, "_PIECE_BITS", 3)
    monkeypatch.setattr(feeds, "materialize", land)
    rows = feeds.read_feeds(spark, str(tmp_path)).rows
    assert [r["cells"] for r in rows.orderBy("row_index").collect()] == [c for i in range(60) for c in ([str(i), f"x\n\nm\ny{i}"], ["p", str(i)])]
    assert "text" not in landed["marked_lines"].columns
    cut = landed["pieces_of_records"].groupBy("cut").count().collect()
    assert 0 < dict(map(tuple, cut))[True] < dict(map(tuple, cut))[False]


def test_files_are_written_by_blocks_of_lines(spark, monkeypatch):
    """The task that writes a file sorts blocks; lines are in order, those without a number first."""
    monkeypatch.setattr(fixture, "LINES_PER_BLOCK", 8)
    given = [None, None, None, 5, 5, *range(100, 0, -1), 10**12]
    rows = spark.createDataFrame([("f.csv", n, f"v{i}") for i, n in enumerate(given)], "source_file string, row_index bigint, v string")
    for end in ("\n", "\r"):
        path = new_path(spark, "blocks")
        fixture.write_lines(rows, {"f.csv": "v"}, ["v"], path, {"f.csv": end})
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()
        text = files[0]["content"].decode()
        assert len(files) == 1 and text.endswith(end)
        got = text[:-1].split(end)
        number = {f"v{i}": n for i, n in enumerate(given)}
        assert got[3] == "v" and sorted(got[:3]) == ["v0", "v1", "v2"] and sorted(got[4:]) == sorted(f"v{i}" for i in range(3, len(given)))
        assert [number[v] for v in got[4:]] == sorted(n for n in given if n is not None)
