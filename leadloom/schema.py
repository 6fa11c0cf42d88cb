"""Column names, fixed values and small schemas shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Results depend on these being exactly what they are.
# --------------------------------------------------------------------------

#: The clean table, in output order.
TARGET = (
    "first_name",
    "last_name",
    "company_name",
    "email",
    "phone_number",
    "job_title",
    "linkedin_url",
    "website",
    "company_summary",
    "sources",
)

#: Cell texts that mean "missing" when a file is scanned.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

#: Job-title words that raise a contact's priority (matched as substrings).
SENIOR_KEYWORDS = (
    "ceo", "cto", "cfo", "president", "director", "vp", "vice president",
    "head", "chief", "founder",
)

#: Titles removed from the front of a name part.
NAME_TITLES = ("mr.", "mrs.", "ms.", "dr.", "prof.", "sir", "madam")

#: Punctuation removed from both ends of a name part.
NAME_PUNCTUATION = ".,;:()"

#: Query keys removed from website addresses.
TRACKING_KEYS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
    "gclid", "fbclid",
)

#: An address is kept when it matches this pattern (text is lower-cased first).
EMAIL_PATTERN = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"

#: Addresses beyond the pattern: what mail standards allow in a local part (dot-separated
#: atoms, letters of any script) and in a host name (labels that end in a letter, no special use).
EMAIL_LOCAL_CHARACTERS = r"a-z0-9!#$%&'*+/=?^_`{|}~\-"
EMAIL_LOCAL_LENGTH, EMAIL_LABEL_LENGTH, EMAIL_LENGTH = 64, 63, 254
EMAIL_SPECIAL_DOMAINS = ("arpa", "invalid", "local", "localhost", "onion", "test")

SUMMARY_LENGTH = 2000
PREVIEW_LENGTH = 500
SAMPLE_ROWS = 25
PAYLOAD_LIMIT_BYTES = 5 * 1024 * 1024
RETENTION_HOURS = 24

SCORE_EMAIL = 100
SCORE_PROFILE = 50
SCORE_SENIOR = 30

REASON_EMPTY = "empty_row"
DETAILS_EMPTY = "All target fields are empty"
REASON_DUPLICATE = "duplicate_contact"
DETAILS_DUPLICATE = "Duplicate contact for company: "
REASON_UNMAPPED = "no_mapping"
DETAILS_UNMAPPED = "No usable header mapping for the file"

#: Characters that count as white space at the ends of, or inside, a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: URL schemes whose address may carry a host part / path parameters (the
#: registry of Python's ``urllib.parse``, which the expected URLs follow).
HOST_SCHEMES = (
    "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
    "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync",
    "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
)
PARAM_SCHEMES = (
    "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp",
    "rtsps", "rtspu", "sip", "sips", "mms", "sftp", "tel",
)

# --------------------------------------------------------------------------
# Our own design values
# --------------------------------------------------------------------------

#: Normalised header (lower case, letters and digits only) -> target.
HEADER_ALIASES = {
    "first_name": ("firstname", "fname", "givenname"),
    "last_name": ("lastname", "lname", "surname", "familyname"),
    "company_name": ("company", "companyname", "organization", "organisation"),
    "email": ("email", "emailaddress", "mail"),
    "phone_number": ("phone", "phonenumber", "mobile", "tel"),
    "job_title": ("title", "jobtitle", "position", "role"),
    "linkedin_url": ("linkedin", "linkedinurl", "linkedinprofile"),
    "website": ("website", "site", "url", "homepage"),
    "company_summary": ("about", "summary", "description", "companysummary"),
    "sources": ("source", "sources", "src"),
}

#: Normalised headers that hold a whole name to be split.
SPLIT_HEADERS = (
    "fullname", "name", "contact", "primarycontact", "owner", "representative",
)

#: Profile test -> target it speaks for.
PROFILE_TARGETS = {
    "email": "email",
    "phone": "phone_number",
    "linkedin": "linkedin_url",
    "url": "website",
    "long_text": "company_summary",
}

#: Mail providers whose domain says nothing about the employer.
FREE_MAIL_DOMAINS = (
    "gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com",
    "live.com", "msn.com", "aol.com", "icloud.com", "me.com", "gmx.com",
    "gmx.de", "web.de", "proton.me", "protonmail.com", "mail.com",
)

ROW_INDEX = "row_index"
SOURCE_FILE = "source_file"

DROP_COLUMNS = ("row_index", "reason", "details")

#: Shape of a header-mapping reply.
REPLY_SCHEMA = T.StructType(
    [
        T.StructField("mapping", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "split_fields",
            # Only the keys are read; a value may be any JSON.
            T.MapType(T.StringType(), T.StringType()),
        ),
        T.StructField("unmapped", T.ArrayType(T.StringType())),
    ]
)


def identity_columns(columns) -> list[str]:
    """The columns among ``columns`` that identify a row."""
    return [c for c in (SOURCE_FILE, ROW_INDEX) if c in columns]
