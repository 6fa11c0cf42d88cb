"""Replies, validation, split marks, profile and proposal."""

import pytest

from leadloom.operators import mapping as M
from leadloom.schema import TARGET

FENCE = "`" * 3
HEADERS = ["Name", "Mail", "Org", "Other"]
REPLIES = {
    "plain": '{"mapping": {"Mail": "email", "Org": "company_name"}, "unmapped": ["Other"]}',
    "fenced": FENCE + 'json\n{"mapping": {"Mail": "email"}, "split_fields": {"Name": {}}}\n' + FENCE,
    "bare_fence": " " + FENCE + '{"mapping": {"Mail": "email"}}' + FENCE + " ",
    "prose": 'Sure! {"mapping": {"Org": "company_name"}} Bye',
    "empty": " \n",
    "text": "no idea",
    "broken": '{"mapping": {"Org": ',
    "list": '["Mail"]',
    "wrong": '{"mapping": {"Mial": "email", "Mail": "e-mail", "Org": "email", "Other": "email"}}',
    "splits": '{"split_fields": {"Name": {"first_name": "x"}, "Nope": {}}, "unmapped": ["Zzz"]}',
    "object": "{}",
    "twice": '{"mapping": {"Mail": "website", "Org": "company_name", "Mail": "email"}, "split_fields": {"Name": 1, "Name": 2}, "mapping": {"Org": "email", "Mail": "email", "Org": "website"}}',
}


@pytest.fixture(scope="module")
def parsed(spark):
    return M.parse_replies(
        spark.createDataFrame(list(REPLIES.items()), "source_file string, reply string")
    ).cache()


@pytest.fixture(scope="module")
def headers(spark):
    rows = [(f, i, h) for f in REPLIES for i, h in enumerate(HEADERS)]
    return spark.createDataFrame(rows, "source_file string, pos int, input_header string").cache()


def test_rejects(parsed):
    got = {r["source_file"]: r["reason"] for r in parsed.where("reason IS NOT NULL").collect()}
    assert got == {
        "empty": "empty_response", "text": "invalid_json", "broken": "invalid_json", "list": "invalid_json",
    }


def test_validation_in_reply_order(parsed, headers):
    rows = M.validate_mapping(M.proposals(parsed), headers).where("source_file = 'wrong'").orderBy("pos")
    assert [r["status"] for r in rows.collect()] == ["unknown_header", "unknown_target", "ok", "target_taken"]


def test_mapping_table(parsed, headers):
    got = {}
    for r in M.mapping_table(parsed, headers).collect():
        got.setdefault(r["source_file"], set()).add((r["input_header"], r["target"], r["kind"]))
    assert got["plain"] == {("Mail", "email", "direct"), ("Org", "company_name", "direct")}
    assert got["fenced"] == {("Mail", "email", "direct"), ("Name", "split_names", "split")}
    assert got["bare_fence"] == {("Mail", "email", "direct")}
    assert got["prose"] == {("Org", "company_name", "direct")}
    assert got["splits"] == {("Name", "split_names", "split")}
    assert "object" not in got and "text" not in got
    assert got["twice"] == {("Mail", "email", "direct"), ("Org", "website", "direct"), ("Name", "split_names", "split")}


def test_a_repeated_key_keeps_its_first_place(parsed):
    rows = M.proposals(parsed).where("source_file = 'twice'").orderBy("pos").collect()
    assert [(r["pos"], r["input_header"], r["target"]) for r in rows] == [(0, "Org", "website"), (1, "Mail", "email")]


def test_unmapped(parsed, headers):
    validated = M.validate_mapping(M.proposals(parsed), headers)
    got = {}
    for r in M.unmapped_headers(parsed, headers, validated).collect():
        got.setdefault(r["source_file"], set()).add(r["input_header"])
    assert got["plain"] == {"Name", "Other"}
    assert got["splits"] == {*HEADERS, "Zzz"}
    assert got["object"] == set(HEADERS)
    assert "empty" not in got


def test_apply_mapping(spark):
    df = spark.createDataFrame([(0, "Ray, Ann", "x@y.zz", "F")], "row_index bigint, Name string, Mail string, `F.N` string")
    mapping = M.HeaderMapping({"Mail": "email", "F.N": "first_name", "Gone": "website"}, splits=["Name"])
    row = M.apply_mapping(df, mapping).first().asDict()
    assert (row["first_name"], row["last_name"], row["email"], row["website"]) == ("Ann", "Ray", "x@y.zz", None)
    assert list(row) == ["row_index", *TARGET]
    direct = M.apply_mapping(df, M.HeaderMapping({"F.N": "first_name"})).first()
    assert direct["first_name"] == "F"
    assert mapping.pairs["Name__SPLIT__"] == "split_names"


def test_empty_mapping_gives_no_rows(spark):
    from leadloom import clean

    df = spark.createDataFrame([(0, "a"), (1, "b")], "row_index bigint, x string")
    result = clean(df, M.HeaderMapping())
    assert result.clean.count() == 0 and result.drops.count() == 0
    assert result.stats.first()["dropped_rows"] == 2


def test_profile_and_proposal(spark):
    rows = [(f"Ann Lee{i}", f"a{i}@x.co", "https://linkedin.com/in/a", "text " * 60, "+1 415 555 2671") for i in range(8)]
    rows += [(None, "", " ", None, "n/a")] * 2
    names = ["Primary Contact", "c2", "Profile", "About Us", "Tel."]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
    profile = M.column_profile(df, names)
    rows = {r["input_header"]: r for r in profile.collect()}
    assert rows["c2"]["filled"] == 8 and rows["c2"]["email_share"] == 1.0 and rows["c2"]["distinct"] == 8
    assert rows["Tel."]["filled"] == 10 and rows["Tel."]["phone"] == 8
    found = M.collect_mapping(M.propose_mapping(profile))
    assert found.direct == {"c2": "email", "Profile": "linkedin_url", "About Us": "company_summary", "Tel.": "phone_number"}
    assert list(found.splits) == ["Primary Contact"]


def test_headers_are_exact_text(spark):
    """Names with backticks and dots, and names that differ in case only."""
    names = ["row_index", "Email", "email", "a`b", "meta.url", "SOURCE_FILE"]
    df = spark.createDataFrame([(3, "x@y.zz", "t@u.vv", "Ann", "Acme", "f")], "a int, b string, c string, d string, e string, f string").toDF(*names)
    mapping = M.HeaderMapping({"email": "email", "Email": "website", "a`b": "first_name", "meta.url": "company_name", "SOURCE_FILE": "sources"})
    row = M.apply_mapping(df, mapping).first().asDict()
    assert (row["row_index"], row["email"], row["website"], row["first_name"], row["company_name"], row["sources"]) == (
        3, "t@u.vv", "x@y.zz", "Ann", "Acme", "f")
    assert list(row) == ["row_index", *TARGET]


def test_profiles_of_files_merge(spark):
    headers = spark.createDataFrame([("f", 0, "Mail"), ("f", 1, "N"), ("g", 0, "N"), ("g", 1, "Mail"), ("h", 0, "Mail")], "source_file string, pos int, input_header string")
    rows = [("f", i, [f"a{i % 50}@x.co", None]) for i in range(100)] + [("g", i, [" n ", f"a{i}@x.co"]) for i in range(80)]
    cells = spark.createDataFrame(rows, "source_file string, row_index int, cells array<string>")
    profile = M.feed_profile(cells, headers)
    got = {(r["source_file"], r["pos"]): r for r in profile.collect()}
    assert got["f", 0]["filled"] == got["f", 0]["email"] == 100 and abs(got["f", 0]["distinct"] - 50) <= 1
    assert got["f", 1]["filled"] == got["f", 1]["distinct"] == 0 and got["g", 0]["distinct"] == 1
    assert got["h", 0]["filled"] == 0 and got["h", 0]["email_share"] == 0.0
    merged = {r["input_header"]: r for r in M.merge_profiles(profile).collect()}
    assert merged["Mail"]["filled"] == 180 and abs(merged["Mail"]["distinct"] - 80) <= 2
    assert merged["N"]["filled"] == 80 and merged["N"]["characters"] == 80
    found = {(r["source_file"], r["input_header"], r["target"]) for r in M.propose_mapping(profile).collect()}
    # A header name alone is enough; a file without rows has that.
    assert found == {("f", "Mail", "email"), ("g", "Mail", "email"), ("h", "Mail", "email")}
