"""Expected results as SQL over the driver tables (DuckDB dialect).

Written apart from the Spark code: where the library cuts strings, the SQL here
uses one regular expression, and the other way round.
"""

from __future__ import annotations

from checks.leads import (
    BAD_ROW_SQL,
    DIRECT,
    JOB_EVENTS_SQL,
    NOTE_SQL,
    ODD_CELLS,
    ODD_NAMES,
    ODD_TARGETS,
    RAW_COLUMNS,
    RUN_CELLS,
    feed_cells_sql,
    feed_headers_sql,
    feeds_sql,
    raw_leads_sql,
)
from leadloom.schema import (
    FREE_MAIL_DOMAINS,
    HEADER_ALIASES,
    NULL_TOKENS,
    PAYLOAD_LIMIT_BYTES,
    SPLIT_HEADERS,
    TARGET,
    WHITESPACE,
)

_WS = f"'{WHITESPACE}'"
TARGET_LIST = ", ".join(TARGET)


_FIRST_LABEL = "split_part(split_part(email, '@', -1), '.', 1)"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _cell(x: str) -> str:
    """A cell as the reader gives it: null for the tokens that mean so."""
    return f"CASE WHEN {x} IN ({_quoted(NULL_TOKENS)}) THEN NULL ELSE {x} END"


def strip(x: str) -> str:
    return f"coalesce(trim({x}, {_WS}), '')"


def collapse(x: str) -> str:
    return f"coalesce(trim(regexp_replace({x}, '[{WHITESPACE}]+', ' ', 'g')), '')"


def initcap(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({x}, ' '), "
        "lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
    )


def name(x: str) -> str:
    return initcap(collapse(x))


_ATOMS = r"""([a-z0-9!#$%&\x27*+/=?^_`{|}~-]|[^\x00-\x7F\pC\pZ\pM]\pM*)+"""


def email(x: str) -> str:
    v = f"lower({strip(x)})"
    local, domain = f"split_part({v}, '@', 1)", f"split_part({v}, '@', 2)"
    labels = f"string_split({domain}, '.')"
    label = r"^[a-z0-9\pL\pN]([a-z0-9\pL\pN\pM-]*[a-z0-9\pL\pN\pM])?$"
    syntax = (
        f"len(string_split({v}, '@')) = 2 AND length({v}) <= 254 AND length({local}) <= 64 "
        f"AND regexp_matches({local}, '^{_ATOMS}(\\.{_ATOMS})*$') AND len({labels}) > 1 AND length({labels}[-1]) > 1 "
        f"AND len(list_filter({labels}, lambda l: NOT regexp_matches(l, '{label}') OR length(l) > 63 "
        "OR (substr(l, 3, 2) = '--' AND NOT starts_with(l, 'xn')))) = 0 "
        f"AND regexp_matches({domain}, '[\\pL\\pM]$') "
        f"AND NOT regexp_matches({domain}, '(^|\\.)(arpa|invalid|local|localhost|onion|test)$')"
    )
    pattern = f"regexp_matches({v}, '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}$')"
    return f"CASE WHEN {pattern} OR ({syntax}) THEN {v} ELSE '' END"


def phone(x: str) -> str:
    d = f"regexp_replace(coalesce({x}, ''), '[^\\p{{Nd}}+]', '', 'g')"
    return (
        f"CASE WHEN {d} = '' OR {d} LIKE '+%' THEN {d} "
        f"WHEN length({d}) = 10 THEN '+1' || {d} ELSE '+' || {d} END"
    )


_LINKEDIN = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?[^#]*)?(?:#.*)?$"


def linkedin(x: str) -> str:
    v = strip(x)
    part = lambda i: f"regexp_extract({v}, '{_LINKEDIN}', {i})"
    return (
        f"CASE WHEN lower({part(2)}) LIKE '%linkedin.com%' THEN "
        f"coalesce(nullif(lower({part(1)}), ''), 'https') || '://' || {part(2)} || {part(3)} ELSE '' END"
    )


_WEBSITE = r"^([A-Za-z][A-Za-z0-9+.\-]*):(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#.*)?$"


def website(x: str) -> str:
    s = strip(x)
    v = f"CASE WHEN regexp_matches({s}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {s} ELSE 'https://' || {s} END"
    part = lambda i: f"regexp_extract({v}, '{_WEBSITE}', {i})"
    kept = (
        f"array_to_string(list_filter(string_split({part(6)}, '&'), lambda p: contains(p, '=') AND "
        "split_part(p, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', "
        "'utm_term', 'gclid', 'fbclid')), '&')"
    )
    return (
        f"CASE WHEN {s} = '' THEN '' ELSE lower({part(1)}) || ':' || {part(2)} || {part(4)} || "
        f"CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END END"
    )


def summary(x: str) -> str:
    return f"substr({strip(x)}, 1, 2000)"


def sources(x: str) -> str:
    return f"CASE WHEN {strip(x)} = '' THEN '' ELSE {x} END"


def name_part(x: str) -> str:
    titled = f"regexp_replace({strip(x)}, '^(mr\\.|mrs\\.|ms\\.|dr\\.|prof\\.|sir|madam)', '', 'i')"
    return strip(f"trim({strip(titled)}, '.,;:()')")


def split_first(x: str) -> str:
    v = strip(x)
    raw = (
        f"CASE WHEN contains({v}, ',') THEN substr({v}, strpos({v}, ',') + 1) "
        f"ELSE split_part({collapse(x)}, ' ', 1) END"
    )
    return name_part(f"({raw})")


def split_last(x: str) -> str:
    v, w = strip(x), collapse(x)
    raw = (
        f"CASE WHEN contains({v}, ',') THEN substr({v}, 1, strpos({v}, ',') - 1) "
        f"WHEN NOT contains({w}, ' ') THEN '' ELSE split_part({w}, ' ', -1) END"
    )
    return name_part(f"({raw})")


# -- common table expressions ----------------------------------------------


def _with(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in ctes) + "\n"


def leads(columns=RAW_COLUMNS, source_file: bool = False) -> tuple[str, str]:
    return "raw_leads", raw_leads_sql(columns, source_file)


def _normalized(source: str, cells: dict[str, str], ids: str) -> list[tuple[str, str]]:
    one = (
        "norm0",
        f"SELECT {ids}, {name(cells['first_name'])} AS f0, {name(cells['last_name'])} AS l0, "
        f"{strip(cells['company_name'])} AS company_name, {email(cells['email'])} AS email, "
        f"{phone(cells['phone_number'])} AS phone_number, {collapse(cells['job_title'])} AS job_title, "
        f"{linkedin(cells['linkedin_url'])} AS linkedin_url, {website(cells['website'])} AS website, "
        f"{summary(cells['company_summary'])} AS company_summary, {sources(cells['sources'])} AS sources "
        f"FROM {source}",
    )
    cut = "f0 = '' AND contains(l0, ' ')"
    two = (
        "norm",
        f"SELECT *, CASE WHEN {cut} THEN split_part(l0, ' ', 1) ELSE f0 END AS first_name, "
        f"CASE WHEN {cut} THEN substr(l0, strpos(l0, ' ') + 1) ELSE l0 END AS last_name FROM norm0",
    )
    return [one, two]


_ANY = "concat(" + ", ".join(f"trim({c}, {_WS})" for c in TARGET) + ") <> ''"
_SCORE = (
    "CAST(CASE WHEN contains(email, '@') AND contains(email, '.') THEN 100 ELSE 0 END "
    "+ CASE WHEN linkedin_url <> '' THEN 50 ELSE 0 END "
    "+ CASE WHEN regexp_matches(lower(job_title), 'ceo|cto|cfo|president|director|vp|vice president|head|chief|founder') "
    "THEN 30 ELSE 0 END + "
    + " + ".join(f"CASE WHEN {c} <> '' THEN 1 ELSE 0 END" for c in TARGET)
    + " AS BIGINT)"
)


def _scored(scope: str = "") -> list[tuple[str, str]]:
    return [
        ("full_rows", f"SELECT * FROM norm WHERE {_ANY}"),
        ("scored", f"SELECT *, lower(company_name) AS company_key, {_SCORE} AS priority_score FROM full_rows"),
        (
            "ranked",
            "SELECT *, CASE WHEN company_key = '' THEN 1 ELSE row_number() OVER "
            f"(PARTITION BY {scope}company_key ORDER BY priority_score DESC, row_index) END AS rk FROM scored",
        ),
    ]


def chain(source_file: bool = False, split: bool = False) -> list[tuple[str, str]]:
    """CTEs from raw leads to ranked rows."""
    ids = "row_index, source_file" if source_file else "row_index"
    cells = {t: c for c, t in DIRECT.items()}
    if split:
        cells |= {"first_name": f"({split_first('full_name')})", "last_name": f"({split_last('full_name')})"}
    columns = RAW_COLUMNS if split else tuple(DIRECT)
    return [
        leads(columns, source_file),
        *_normalized("raw_leads", cells, ids),
        *_scored("source_file, " if source_file else ""),
    ]


_DROPS = [
    (
        "drops",
        "SELECT row_index, 'empty_row' AS reason, 'All target fields are empty' AS details "
        f"FROM norm WHERE NOT ({_ANY}) UNION ALL "
        "SELECT row_index, 'duplicate_contact', 'Duplicate contact for company: ' || company_key FROM ranked WHERE rk > 1",
    )
]


def _stats(where: str = "rk = 1") -> str:
    n = "nullif(count(*), 0)"
    ratio = lambda cond: f"coalesce(count(*) FILTER ({cond}) / {n}, 0.0)"
    return (
        f"SELECT {ratio('contains(email, chr(64))')} AS valid_email_ratio, "
        f"{ratio('length(linkedin_url) > 0')} AS linkedin_ratio, "
        f"{ratio('length(phone_number) > 0')} AS phone_ratio, "
        f"{ratio('length(company_name) > 0')} AS company_ratio, "
        "(SELECT count(*) FROM raw_leads) AS total_rows, count(*) AS output_rows, "
        f"(SELECT count(*) FROM drops) AS dropped_rows FROM ranked WHERE {where}"
    )


_LINE = " || ',' || ".join(
    f"CASE WHEN regexp_matches({c}, '[,\"\r\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
    for c in TARGET
)
_HEADER_BYTES = len(",".join(TARGET)) + 1

# -- mapping ---------------------------------------------------------------


def _mapping_ctes() -> list[tuple[str, str]]:
    fenced = f"regexp_replace(regexp_replace(regexp_replace({strip('reply')}, '^```json', ''), '^```', ''), '```$', '')"
    return [
        ("feeds", feeds_sql()),
        ("headers", feed_headers_sql()),
        (
            "texts",
            f"SELECT source_file, reply, {strip(fenced)} AS body, regexp_extract(reply, '(?s)\\{{.*\\}}', 0) AS inner_body FROM feeds",
        ),
        (
            "parsed",
            "SELECT source_file, reply, CASE WHEN json_valid(body) AND body LIKE '{%' THEN CAST(body AS JSON) "
            "WHEN NOT json_valid(body) AND inner_body <> '' AND json_valid(inner_body) THEN CAST(inner_body AS JSON) END AS j FROM texts",
        ),
        (
            "replies",
            f"SELECT source_file, j, CASE WHEN {strip('reply')} = '' THEN 'empty_response' WHEN j IS NULL THEN 'invalid_json' END AS reason FROM parsed",
        ),
        (
            "keyed",
            "SELECT source_file, j, unnest(json_keys(j, '$.mapping')) AS input_header, "
            "generate_subscripts(json_keys(j, '$.mapping'), 1) - 1 AS pos FROM replies WHERE reason IS NULL",
        ),
        (
            # A repeated key stands at its first place with its last value.
            "firsts",
            "SELECT source_file, input_header, min(pos) AS pos, any_value(json_extract(j, '$.mapping')::VARCHAR) AS pairs "
            "FROM keyed GROUP BY ALL",
        ),
        (
            "proposals",
            "SELECT source_file, CAST(row_number() OVER (PARTITION BY source_file ORDER BY pos) - 1 AS INT) AS pos, input_header, "
            "regexp_extract_all(pairs, '\"' || input_header || '\"\\s*:\\s*\"([^\"]*)\"', 1)[-1] AS target FROM firsts",
        ),
        (
            "checked",
            "SELECT p.*, CASE WHEN NOT EXISTS (SELECT 1 FROM headers h WHERE h.source_file = p.source_file "
            "AND h.input_header = p.input_header) THEN 'unknown_header' "
            f"WHEN target NOT IN ({_quoted(TARGET)}) THEN 'unknown_target' ELSE 'ok' END AS s FROM proposals p",
        ),
        (
            "validated",
            "SELECT source_file, pos, input_header, target, CASE WHEN s = 'ok' AND row_number() OVER "
            "(PARTITION BY source_file, target, s ORDER BY pos) > 1 THEN 'target_taken' ELSE s END AS status FROM checked",
        ),
        (
            "marks0",
            "SELECT source_file, unnest(json_keys(j, '$.split_fields')) AS input_header, "
            "generate_subscripts(json_keys(j, '$.split_fields'), 1) - 1 AS pos FROM replies WHERE reason IS NULL",
        ),
        (
            "marks",
            "SELECT m.source_file, CAST(m.pos AS INT) AS pos, m.input_header FROM marks0 m JOIN headers h "
            "ON h.source_file = m.source_file AND h.input_header = m.input_header",
        ),
    ]


_UNMAPPED = (
    "SELECT h.source_file, h.input_header FROM headers h JOIN replies r ON r.source_file = h.source_file "
    "AND r.reason IS NULL WHERE NOT EXISTS (SELECT 1 FROM validated v WHERE v.source_file = h.source_file "
    "AND v.input_header = h.input_header AND v.status = 'ok') UNION "
    "SELECT source_file, unnest(CAST(json_extract(j, '$.unmapped') AS VARCHAR[])) FROM replies WHERE reason IS NULL"
)


def _feed_rows() -> list[tuple[str, str]]:
    at = lambda t: (
        f"(SELECT max(h.pos) FROM validated v JOIN headers h ON h.source_file = v.source_file AND "
        f"h.input_header = v.input_header WHERE v.source_file = x.source_file AND v.status = 'ok' AND v.target = '{t}')"
    )
    return [
        leads(),
        ("cells", feed_cells_sql(array="[{}]")),
        (
            "places",
            "SELECT x.source_file, "
            + ", ".join(f"{at(t)} AS at_{t}" for t in TARGET)
            + ", (SELECT arg_max(h.pos, m.pos) FROM marks m JOIN headers h ON h.source_file = m.source_file AND "
            "h.input_header = m.input_header WHERE m.source_file = x.source_file) AS at_split "
            "FROM (SELECT DISTINCT source_file FROM validated WHERE status = 'ok' UNION SELECT source_file FROM marks) x",
        ),
        (
            "mapped0",
            "SELECT c.source_file, c.row_index, at_split IS NOT NULL AS sp, cells[at_split + 1] AS whole, "
            + ", ".join(f"cells[at_{t} + 1] AS raw_{t}" for t in TARGET)
            + " FROM cells c JOIN places p ON p.source_file = c.source_file",
        ),
        (
            "mapped",
            f"SELECT source_file, row_index, CASE WHEN sp THEN {split_first('whole')} ELSE raw_first_name END AS first_name, "
            f"CASE WHEN sp THEN {split_last('whole')} ELSE raw_last_name END AS last_name, "
            + ", ".join(f"raw_{t} AS {t}" for t in TARGET[2:])
            + " FROM mapped0",
        ),
    ]


# -- reports ---------------------------------------------------------------

_FILE_DROPS = (
    "file_drops",
    "SELECT source_file, row_index, 'empty_row' AS reason, 'All target fields are empty' AS details "
    f"FROM norm WHERE NOT ({_ANY}) UNION ALL SELECT source_file, row_index, 'duplicate_contact', "
    "'Duplicate contact for company: ' || company_key FROM ranked WHERE rk > 1",
)


def _report_ctes(
    source: str = "raw_leads", cells=tuple(DIRECT), unmapped: str = "full_name", correlation: str = "", drops: bool = True,
    file_type: str = "csv",
) -> str:
    """``reports``: every field of the reports but their times, behind CTEs ``ranked`` and ``norm``."""
    pairs = ",".join(f"{c}={DIRECT[c]}" for c in sorted(cells))
    ctes = [_FILE_DROPS] if drops else []
    ratio = lambda cond: f"coalesce(count(*) FILTER ({cond}) / nullif(count(*), 0), 0.0)"
    ctes += [
        ("files", f"SELECT source_file, count(*) AS rows FROM {source} GROUP BY source_file"),
        (
            "outputs",
            f"SELECT source_file, count(*) AS output_rows, {ratio('contains(email, chr(64))')} AS valid_email_ratio, "
            f"{ratio('length(linkedin_url) > 0')} AS linkedin_ratio, {ratio('length(phone_number) > 0')} AS phone_ratio, "
            f"{ratio('length(company_name) > 0')} AS company_ratio FROM ranked WHERE rk = 1 GROUP BY source_file",
        ),
        ("paged", "SELECT *, row_index // 1000 AS page, min(row_index // 1000) OVER (PARTITION BY source_file) AS first_page FROM file_drops"),
        (
            "pages",
            "SELECT source_file, count(DISTINCT page) AS drop_pages, md5(string_agg(row_index || ':' || reason || ':' || details, ',' "
            "ORDER BY row_index, reason, details) FILTER (page = first_page)) AS first_drops FROM paged GROUP BY source_file",
        ),
        (
            "reasons",
            "SELECT source_file, string_agg(reason || '=' || n, ',' ORDER BY reason) AS drop_counts FROM "
            "(SELECT source_file, reason, count(*) AS n FROM file_drops GROUP BY ALL) GROUP BY source_file",
        ),
        (
            "reports",
            f"SELECT source_file, rows, '{file_type}' AS file_type, '{pairs}' AS mapping, '{unmapped}' AS unmapped, "
            "coalesce(first_drops, md5('')) AS first_drops, coalesce(drop_pages, 0) AS drop_pages, coalesce(drop_counts, '') AS drop_counts, "
            "valid_email_ratio, linkedin_ratio, phone_ratio, company_ratio, rows AS total_rows, output_rows, "
            f"rows - output_rows AS dropped_rows, '1.0.0' AS version, '{correlation}' AS correlation_id, CAST(NULL AS VARCHAR) AS error "
            "FROM files JOIN outputs USING (source_file) LEFT JOIN pages USING (source_file) LEFT JOIN reasons USING (source_file)",
        ),
    ]
    return ",\n".join(f"{n} AS ({sql})" for n, sql in ctes) + "\n"


def _run_sql() -> str:
    """CTEs of a whole run over files in which some rows have a cell too many."""
    mapped = [c for c in RUN_CELLS if c != "src"]
    cells = {DIRECT[c]: DIRECT[c] for c in mapped}
    good, bad = _FILE_DROPS
    return _with(
        leads(RUN_CELLS, True),
        (
            "all_rows",
            "SELECT source_file, row_index AS lead_no, row_number() OVER (PARTITION BY source_file ORDER BY row_index) - 1 AS row_index, "
            f"{BAD_ROW_SQL} AS bad, " + ", ".join(f"{_cell(c)} AS {DIRECT[c]}" for c in mapped) + " FROM raw_leads",
        ),
        ("mapped", "SELECT * FROM all_rows WHERE NOT bad"),
        *_normalized("mapped", {t: cells.get(t, "''") for t in TARGET}, "source_file, row_index"),
        *_scored("source_file, "),
        (
            good,
            bad + " UNION ALL SELECT source_file, row_index, 'bad_row', "
            f"'Expected {len(RUN_CELLS)} cells, saw {len(RUN_CELLS) + 1}' FROM all_rows WHERE bad",
        ),
    )


# -- profile ---------------------------------------------------------------

_TESTS = {
    "filled": "{c} <> ''",
    "email": "regexp_matches({c}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')",
    "phone": "regexp_matches({c}, '^\\+?[0-9 ().\\-]{{7,20}}$')",
    "linkedin": "contains(lower({c}), 'linkedin.com/')",
    "url": "regexp_matches(lower({c}), '^(https?://|www\\.)[^\\s]+$')",
    "two_words": "regexp_matches({c}, '^[^\\s0-9@/]+ [^\\s0-9@/]+$')",
    "long_text": "length({c}) > 200",
}


def _profile_ctes() -> list[tuple[str, str]]:
    parts = []
    for i, column in enumerate(RAW_COLUMNS):
        c = "v"
        tests = ", ".join(
            f"count(*) FILTER ({t.format(c=c)}) AS {n}" for n, t in _TESTS.items()
        )
        parts.append(
            f"SELECT {i} AS pos, '{column}' AS input_header, {tests}, CAST(sum(length(v)) AS BIGINT) AS characters "
            f"FROM (SELECT {strip(column)} AS v FROM raw_leads)"
        )
    shares = ", ".join(
        f"CASE WHEN filled > 0 THEN {t} / filled ELSE 0.0 END AS {t}_share" for t in _TESTS if t != "filled"
    )
    return [
        leads(),
        ("counts", " UNION ALL ".join(parts)),
        (
            "profile",
            "SELECT CAST(pos AS BIGINT) AS pos, input_header, filled, email, phone, linkedin, url, two_words, long_text, "
            f"characters, CASE WHEN filled > 0 THEN characters / filled ELSE 0.0 END AS mean_length, {shares} FROM counts",
        ),
    ]


def _feed_profile_sql(body: str) -> str:
    """Profile of the feeds' columns as CTE ``profile``, then ``body``."""
    tests = ", ".join(f"count(*) FILTER ({t.format(c='v')}) AS {n}" for n, t in _TESTS.items())
    names = [t for t in _TESTS]
    shares = ", ".join(
        f"CASE WHEN filled > 0 THEN {t} / filled ELSE 0.0 END AS {t}_share" for t in _TESTS if t != "filled"
    )
    zeros = ", ".join(f"coalesce({n}, 0) AS {n}" for n in (*names, "characters"))
    return _with(
        leads(),
        ("feeds", feeds_sql()),
        ("headers", feed_headers_sql()),
        ("cells", feed_cells_sql(array="[{}]")),
        (
            "long",
            f"SELECT source_file, pos, {strip('cell')} AS v FROM (SELECT source_file, unnest(cells) AS cell, "
            "generate_subscripts(cells, 1) - 1 AS pos FROM cells)",
        ),
        ("measured", f"SELECT source_file, pos, {tests}, CAST(sum(length(v)) AS BIGINT) AS characters FROM long GROUP BY ALL"),
        (
            "counts",
            f"SELECT h.source_file, CAST(h.pos AS BIGINT) AS pos, h.input_header, {zeros} FROM headers h "
            "LEFT JOIN measured m ON m.source_file = h.source_file AND m.pos = h.pos",
        ),
        (
            "profile",
            f"SELECT *, CASE WHEN filled > 0 THEN characters / filled ELSE 0.0 END AS mean_length, {shares} FROM counts",
        ),
    ) + body


def _propose_sql(feeds: bool = False) -> str:
    aliases = ", ".join(f"('{a}', '{t}')" for t, names in HEADER_ALIASES.items() for a in names)
    targets = ", ".join(f"('{t}', {i})" for i, t in enumerate(TARGET))
    looks = " UNION ALL ".join(
        f"SELECT {'source_file, ' if feeds else ''}pos, '{target}' AS target, CAST(floor(100 * {test}_share) AS BIGINT) AS points FROM profile"
        for test, target in (
            ("email", "email"), ("phone", "phone_number"), ("linkedin", "linkedin_url"),
            ("url", "website"), ("long_text", "company_summary"),
        )
    )
    key = "regexp_replace(lower(input_header), '[^a-z0-9]', '', 'g')"
    # One mapping of the whole table, or one for each file.
    file = "source_file, " if feeds else ""
    steps = [
        ("aliases", f"SELECT * FROM (VALUES {aliases}) AS t(h, target)"),
        ("targets", f"SELECT * FROM (VALUES {targets}) AS t(target, tpos)"),
        (
            "points",
            f"SELECT {file}pos, target, CAST(100 AS BIGINT) AS points FROM profile JOIN aliases ON h = {key} UNION ALL {looks}",
        ),
        (
            "scores",
            f"SELECT {file}pos, target, tpos, CAST(sum(points) AS BIGINT) AS score FROM points JOIN targets USING (target) "
            "GROUP BY ALL HAVING sum(points) >= 50",
        ),
        (
            "best",
            f"SELECT *, row_number() OVER (PARTITION BY {file}pos ORDER BY score DESC, pos, tpos) AS a, "
            f"row_number() OVER (PARTITION BY {file}target ORDER BY score DESC, pos, tpos) AS b FROM scores",
        ),
    ]
    chosen = (
        f"SELECT {file}pos, input_header, target, 'direct' AS kind, score FROM best JOIN profile USING ({file}pos) WHERE a = 1 AND b = 1 "
        f"UNION ALL SELECT {file}pos, input_header, 'split_names', 'split', 100 FROM profile WHERE {key} IN ({_quoted(SPLIT_HEADERS)})"
    )
    if feeds:
        return _feed_profile_sql(", " + ", ".join(f"{n} AS ({q})" for n, q in steps) + " " + chosen)
    return _with(*_profile_ctes(), *steps) + chosen


# -- jobs ------------------------------------------------------------------

_JOBS = [
    ("log", JOB_EVENTS_SQL),
    (
        "last_event",
        "SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n, "
        "min(ts) OVER (PARTITION BY job_id) AS created_at FROM log",
    ),
    (
        "jobs",
        "SELECT job_id, status, CASE status WHEN 'queued' THEN 0.0::DOUBLE WHEN 'completed' THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS progress, "
        "created_at, ts AS updated_at, status = 'completed' AS has_result, CASE WHEN status = 'failed' THEN error END AS error "
        "FROM last_event WHERE n = 1",
    ),
]


def oracle_sql() -> dict[str, str]:
    one = lambda column, expr, out: (
        _with(leads((column,))) + f"SELECT row_index, {expr(column)} AS {out} FROM raw_leads"
    )
    base = _with(*chain())
    with_drops = _with(*chain(), *_DROPS)
    by_file = _with(*chain(source_file=True))
    mapping = _with(*_mapping_ctes())
    clean = f"SELECT row_index, {TARGET_LIST} FROM full_rows"
    dedup = f"SELECT row_index, {TARGET_LIST} FROM ranked WHERE rk = 1"
    label = (
        f"SELECT row_index, {', '.join(TARGET[:-1])}, CASE WHEN {strip('sources')} <> '' "
        f"THEN {strip('sources')} || ', Trade Fair' ELSE 'Trade Fair' END AS sources "
    )
    cells_in = {t: c for c, t in DIRECT.items()}
    sized = (
        "sized",
        f"SELECT source_file, row_index, CAST(strlen({_LINE}) + 1 AS BIGINT) AS csv_bytes FROM full_rows",
    )
    raw = ", ".join(f"{c} AS {t}" for t, c in cells_in.items())
    jobs = _with(*_JOBS)
    return {
        # sources and sinks
        "csv_roundtrip": base + dedup,
        "csv_feeds": _with(leads())
        + "SELECT row_index, "
        + ", ".join(f"CASE WHEN {c} IN ({_quoted(NULL_TOKENS)}) THEN NULL ELSE {c} END AS {c}" for c in RAW_COLUMNS)
        + " FROM raw_leads",
        "encoding_class": "SELECT lang, CASE WHEN lang = 'fr' THEN 'ISO-8859-1' ELSE 'UTF-8' END AS encoding "
        "FROM documents GROUP BY lang",
        "encoding_fallback": "SELECT doc_id, lang, CASE WHEN text IN "
        f"({_quoted(NULL_TOKENS)}) THEN NULL ELSE text END AS text FROM documents",
        "null_tokens": _with(leads(("phone", "title", "company")))
        + f"SELECT row_index, CASE WHEN phone IN ({_quoted(NULL_TOKENS)}) THEN NULL ELSE phone END AS phone, "
        f"CASE WHEN title IN ({_quoted(NULL_TOKENS)}) THEN NULL ELSE title END AS title, "
        f"CASE WHEN company IN ({_quoted(NULL_TOKENS)}) THEN NULL ELSE company END AS company FROM raw_leads",
        "row_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents",
        "csv_line_ends": _with(leads(("email", "company"), True))
        + f"SELECT source_file AS file, row_index AS lead_no, {_cell('note')} AS note, {_cell('email')} AS email, "
        f"{_cell('company')} AS company FROM (SELECT *, {NOTE_SQL} AS note FROM raw_leads)",
        "odd_headers": "SELECT * FROM (VALUES "
        + ", ".join(f"({_quoted([f])}, {i}, {_quoted([h])})" for f, names in ODD_NAMES.items() for i, h in enumerate(names))
        + ") AS t(file, pos, input_header)",
        "odd_headers_mapped": _with(leads(ODD_CELLS, True))
        + "SELECT source_file AS file, row_number() OVER (PARTITION BY source_file ORDER BY row_index) - 1 AS row_index, "
        + ", ".join(f"{_cell(c)} AS {t}" for c, t in zip(ODD_CELLS, ODD_TARGETS))
        + f" FROM (SELECT *, {NOTE_SQL} AS note FROM raw_leads)",
        "feed_profile": _feed_profile_sql("SELECT * FROM profile"),
        "propose_feed_mapping": _propose_sql(feeds=True),
        "feed_headers": mapping + "SELECT source_file, pos, input_header FROM headers",
        "lead_json": base
        + "SELECT row_index, " + ", ".join(TARGET) + " FROM full_rows",
        "payload_size": by_file.rstrip()
        + f", {sized[0]} AS ({sized[1]}), t AS (SELECT source_file, count(*) AS rows, "
        f"CAST(sum(csv_bytes) + {_HEADER_BYTES} AS BIGINT) AS csv_bytes FROM sized GROUP BY source_file) "
        f"SELECT *, csv_bytes / (1024 * 1024) AS csv_mb, csv_bytes > {PAYLOAD_LIMIT_BYTES} AS over_limit FROM t",
        "payload_batches": by_file.rstrip()
        + f", {sized[0]} AS ({sized[1]}), t AS (SELECT *, coalesce(sum(csv_bytes) OVER (PARTITION BY source_file "
        "ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized) "
        "SELECT source_file, row_index, csv_bytes, CAST(before AS BIGINT) AS byte_offset, "
        f"CAST(floor(before / {PAYLOAD_LIMIT_BYTES}) AS BIGINT) AS batch_id FROM t",
        "lead_envelope": by_file.rstrip()
        + f", {sized[0]} AS ({sized[1]}), t AS (SELECT *, coalesce(sum(csv_bytes) OVER (PARTITION BY source_file "
        "ORDER BY row_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized), "
        f"lines AS (SELECT t.source_file, t.row_index, csv_bytes, CAST(floor(before / {PAYLOAD_LIMIT_BYTES}) AS BIGINT) AS batch_id, "
        f"{_LINE} AS line, concat_ws('|', {TARGET_LIST}) AS lead FROM t JOIN full_rows f ON f.source_file = t.source_file AND f.row_index = t.row_index), "
        + _report_ctes()
        + "SELECT l.source_file, batch_id, count(*) AS row_count, CAST(sum(csv_bytes) AS BIGINT) AS csv_bytes, "
        f"md5('{','.join(TARGET)}' || chr(10) || string_agg(line || chr(10), '' ORDER BY row_index)) AS csv_md5, "
        "md5(string_agg(lead, chr(10) ORDER BY row_index)) AS leads_md5, 'success' AS status, true AS same_count, "
        "any_value(mapping) AS mapped, any_value(unmapped) AS unmapped, any_value(output_rows) AS output_rows, "
        "any_value(drop_counts) AS drop_counts, 'run-7' AS correlation_id "
        "FROM lines l JOIN reports r ON r.source_file = l.source_file GROUP BY l.source_file, batch_id",
        "csv_preview": base
        + f"SELECT substr('{','.join(TARGET)}' || chr(10) || string_agg(({_LINE}) || chr(10), '' ORDER BY row_index), 1, 500) "
        "|| '...' AS csv_preview FROM full_rows",
        "sample_rows": _with(leads(source_file=True))
        + f"SELECT source_file, row_index, {', '.join(RAW_COLUMNS)} FROM raw_leads "
        "QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY row_index) <= 25",
        "input_info": _with(leads((), True))
        + "SELECT source_file, count(*) AS rows, 'csv' AS file_type FROM raw_leads GROUP BY source_file",
        # header mapping
        "mapping_parse": mapping + "SELECT source_file, pos, input_header, target FROM proposals",
        "mapping_rejects": mapping + "SELECT source_file, reason FROM replies WHERE reason IS NOT NULL",
        "mapping_validate": mapping + "SELECT * FROM validated",
        "mapping_split": mapping + "SELECT * FROM marks",
        "mapping_unmapped": mapping + _UNMAPPED,
        "apply_mapping": _with(leads()) + f"SELECT row_index, {raw} FROM raw_leads",
        "apply_split_mapping": _with(leads())
        + f"SELECT row_index, {split_first('full_name')} AS first_name, {split_last('full_name')} AS last_name, "
        + ", ".join(f"{cells_in[t]} AS {t}" for t in TARGET[2:])
        + " FROM raw_leads",
        "apply_feed_mapping": _with(*_mapping_ctes(), *_feed_rows())
        + f"SELECT source_file, row_index, {TARGET_LIST} FROM mapped",
        "clean_feeds": _with(
            *_mapping_ctes(), *_feed_rows(),
            *_normalized("mapped", {t: t for t in TARGET}, "source_file, row_index"),
            *_scored("source_file, "),
        )
        + f"SELECT source_file, row_index, {TARGET_LIST} FROM ranked WHERE rk = 1",
        "column_profile": _with(*_profile_ctes()) + "SELECT * FROM profile",
        "propose_mapping": _propose_sql(),
        # scalar functions
        "strip_blank": one("title", strip, "title"),
        "normalize_name": one("fname", name, "first_name"),
        "split_full_names": _with(*chain()) + "SELECT row_index, first_name, last_name FROM norm",
        "normalize_company": one("company", strip, "company_name"),
        "normalize_email": one("email", email, "email"),
        "normalize_phone": one("phone", phone, "phone_number"),
        "normalize_job_title": one("title", collapse, "job_title"),
        "normalize_linkedin": one("linkedin", linkedin, "linkedin_url"),
        "normalize_website": one("site", website, "website"),
        "website_pages": f"SELECT page_id, {website('url')} AS website FROM pages",
        "normalize_summary": one("about", summary, "company_summary"),
        "summary_documents": f"SELECT doc_id, {summary('text')} AS company_summary FROM documents",
        "normalize_sources": one("src", sources, "sources"),
        "split_names": _with(leads(("full_name",)))
        + f"SELECT row_index, {split_first('full_name')} AS first_name, {split_last('full_name')} AS last_name FROM raw_leads",
        "clean_name_part": one("full_name", name_part, "name_part"),
        "source_label": base + label + "FROM full_rows",
        "company_from_email": base
        + "SELECT row_index, CASE WHEN company_name = '' AND email <> '' AND split_part(email, '@', -1) "
        f"NOT IN ({_quoted(FREE_MAIL_DOMAINS)}) THEN {initcap(_FIRST_LABEL)} "
        "ELSE company_name END AS company_name FROM norm",
        "extract_contacts": "SELECT DISTINCT doc_id, kind, value FROM ("
        "SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS value FROM documents "
        "UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '\\+[0-9][0-9 ().-]{6,18}[0-9]')) FROM documents)",
        # filters
        "non_empty_rows": base + clean,
        "drops_empty": with_drops + "SELECT * FROM drops WHERE reason = 'empty_row'",
        "no_company_rows": base + f"SELECT row_index, {TARGET_LIST} FROM scored WHERE company_key = ''",
        # one contact per company
        "company_key": base + "SELECT row_index, company_key FROM scored",
        "priority_score": base + "SELECT row_index, priority_score FROM scored",
        "best_contact_per_company": base
        + f"SELECT row_index, {TARGET_LIST}, company_key, priority_score FROM ranked WHERE rk = 1",
        "best_contact_agg": base
        + "SELECT company_key, arg_max(row_index, priority_score * 1000000000 - row_index) AS kept_row_index, "
        "max(priority_score) AS priority_score FROM scored WHERE company_key <> '' GROUP BY company_key",
        "company_groups": base
        + "SELECT company_key, count(*) AS contacts, min(row_index) AS first_row_index, max(row_index) AS last_row_index "
        "FROM scored WHERE company_key <> '' GROUP BY company_key",
        "company_members": base + "SELECT company_key, row_index FROM scored WHERE company_key <> ''",
        "drops_duplicate": with_drops + "SELECT * FROM drops WHERE reason = 'duplicate_contact'",
        # order and set operations
        "clean_leads_ordered": base + dedup,
        "concat_leads": base + dedup,
        "drops": with_drops + "SELECT * FROM drops",
        # statistics and whole runs
        "stats": with_drops + _stats(),
        "drop_counts": with_drops + "SELECT reason, count(*) AS dropped_rows FROM drops GROUP BY reason",
        "parse_summary": with_drops
        + "SELECT total_rows AS input_rows, output_rows, dropped_rows, valid_email_ratio AS valid_emails, "
        f"linkedin_ratio AS linkedin_profiles, phone_ratio AS phones, company_ratio AS companies FROM ({_stats()})",
        "report": by_file.rstrip() + ", " + _report_ctes() + "SELECT * FROM reports",
        "run_ledger": _run_sql() + "SELECT source_file AS file, row_index, reason, details FROM file_drops",
        # The files of this run are written as text, so their names do not end with .csv.
        "run_report": _run_sql().rstrip() + ", "
        + _report_ctes("all_rows", tuple(c for c in RUN_CELLS if c != "src"), "", "run-7", drops=False, file_type="unsupported")
        + "SELECT * FROM reports",
        "run_metrics": _run_sql()
        + "SELECT 'normalize' AS phase, count(*) AS rows FROM norm UNION ALL "
        "SELECT 'write', count(*) FROM ranked WHERE rk = 1",
        "clean_leads": base + clean,
        "clean_leads_split": _with(*chain(split=True)) + clean,
        "clean_leads_dedup": base + dedup,
        "clean_leads_labelled": base + label + "FROM ranked WHERE rk = 1",
        # run ledger
        "job_state": jobs + "SELECT * FROM jobs",
        "job_lookup": jobs + "SELECT * FROM jobs WHERE job_id = 7",
        "job_list": jobs + "SELECT * FROM jobs",
        "job_totals": jobs + "SELECT status, count(*) AS jobs FROM jobs GROUP BY status",
        "job_retention": jobs
        + "SELECT * FROM jobs WHERE NOT (status IN ('completed', 'failed') AND "
        "updated_at < (SELECT max(ts) FROM events) - INTERVAL 24 HOURS)",
        "job_notices": jobs
        + "SELECT job_id, CAST(job_id AS VARCHAR) AS notice_job_id, status, CAST(job_id AS VARCHAR) AS correlation_id, "
        "CASE WHEN has_result THEN 'ok' END AS result_status, error FROM jobs WHERE status IN ('completed', 'failed')",
        # streams: the same tables as in batch
        "stream_clean": base + clean,
        "stream_best_contact": base + dedup,
        "stream_job_state": jobs + "SELECT * FROM jobs",
        "stream_feeds": _with(
            leads(ODD_CELLS, True),
            (
                "mapped",
                "SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY row_index) - 1 AS row_index, "
                + ", ".join(f"{_cell(c)} AS {t}" for c, t in zip(ODD_CELLS, ODD_TARGETS))
                + f" FROM (SELECT *, {NOTE_SQL} AS note FROM raw_leads)",
            ),
            *_normalized("mapped", {t: t if t in ODD_TARGETS else "''" for t in TARGET}, "source_file, row_index"),
        )
        + f"SELECT source_file AS file, row_index, {TARGET_LIST} FROM norm WHERE {_ANY}",
        "stream_drops": with_drops + "SELECT * FROM drops",
        "stream_drops_duplicate": with_drops + "SELECT * FROM drops WHERE reason = 'duplicate_contact'",
        "stream_job_retention": jobs
        + "SELECT * FROM jobs WHERE NOT (status IN ('completed', 'failed') AND "
        "updated_at < (SELECT max(ts) FROM events) - INTERVAL 24 HOURS)",
    }
