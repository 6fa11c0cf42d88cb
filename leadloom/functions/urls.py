"""Web addresses, cut the way RFC 3986 parsers do, without a UDF.

Each step rewrites the text it gets and mentions it once.  Expressions are
trees: a value used in several places would be repeated in the generated code,
and a method beyond 8,000 bytes of code is never compiled by the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions.text import strip
from leadloom.schema import HOST_SCHEMES, PARAM_SCHEMES, TRACKING_KEYS, WHITESPACE


def _any_of(words) -> str:
    return "(?i:" + "|".join(w.replace("+", r"\+") for w in words) + ")"


_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_NO_SCHEME = rf"^(?!{_SCHEME})(?=.)"
_UPPER_SCHEME = (
    rf"^[{WHITESPACE}]*[\x00-\x20]*(?:[a-z][a-z0-9+.\-\t\r\n]*)?[A-Z][A-Za-z0-9+.\-\t\r\n]*:"
)
_CONTROLS = "".join(chr(i) for i in range(33))

#: Addresses that are in normal form already, the bulk of clean columns.
_PLAIN = r"^https?://[A-Za-z0-9.\-]+(?::[0-9]+)?(?:/[^?#;\x00-\x20]*)?$"

#: A host with one kind of bracket only cannot be parsed.
_ONE_BRACKET = r"(?:[^/?#\]]*\[[^/?#\]]*|[^/?#\[]*\][^/?#\[]*)(?:[/?#]|$)"
_BROKEN_SITE = rf"^[\x00-\x20]*(?:{_SCHEME}//|(?!{_SCHEME})(?://)?){_ONE_BRACKET}"
_NO_ADDRESS_START = rf"^(?![\x00-\x20]*(?:{_SCHEME}|//))"
_PROFILE = rf"(?i)(?:{_SCHEME})?//(?!{_ONE_BRACKET})[^/?#]*linkedin\.com"

#: ``;`` that ends the last path segment and carries nothing.
_EMPTY_PARAMS = (
    rf"^({_any_of(PARAM_SCHEMES)}:(?://[^/?]*/(?:[^?]*/)?|(?!//)(?:[^?]*/)?)[^/;?]*);(?=\?|$)"
)
#: Schemes with a host show ``//`` before a path that starts with ``/``.
_MISSING_SLASHES = rf"^({_any_of(HOST_SCHEMES)}:)(?=/(?!/)|\?|$)"
#: Other schemes do not, where there is no host.
_NEEDLESS_SLASHES = rf"^((?!{_any_of(HOST_SCHEMES)}:){_SCHEME})//(?=/(?!/)|\?|$)"

#: The query, one kept part per match.  Parts without ``=`` and tracking keys
#: are passed over.
_QUERY_PART = (
    r"(?:^([^?]*\?)|\G(?!^))"
    rf"(?:(?:[^&=]*|(?:{'|'.join(TRACKING_KEYS)})=[^&]*)(?:&|$))*+([^&]+(?:&|$))?"
)
#: What is left over then: a ``?`` without a query, ``&`` after its last part.
_QUERY_END = r"(?s)^([^?]*)(?:\?|(\?.*)&)$"


def _parser_text(c: Column) -> Column:
    """What a parser reads: stripped text without leading control characters
    and line breaks, its scheme in lower case."""
    lowered = F.when(
        c.rlike(_UPPER_SCHEME),
        F.concat(F.lower(F.substring_index(c, ":", 1)), F.substr(c, F.instr(c, F.lit(":")))),
    ).otherwise(c)
    return F.ltrim(F.translate(strip(lowered), "\t\r\n", ""), F.lit(_CONTROLS))


def is_profile_url(c: Column) -> Column:
    """Whether a raw cell is an address on the host ``linkedin.com``."""
    return F.contains(F.lower(c), F.lit("linkedin.com")) & F.translate(c, "\t\r\n", "").rlike(
        rf"^[{WHITESPACE}\x00-\x20]*{_PROFILE}"
    )


def normalize_linkedin_url(c: Column, allow_schemeless: bool = False) -> Column:
    """Profile address without query and fragment, or the empty text.

    The host has to contain ``linkedin.com``.  An address without a scheme has
    no host (``linkedin.com/in/x``) and is emptied, unless ``allow_schemeless``
    reads it as if it began with ``https://``.
    """
    if allow_schemeless:
        c = F.regexp_replace(strip(c), _NO_ADDRESS_START + "(?=.)", "https://")
    url = F.regexp_replace(_parser_text(c), "^//", "https://")
    base = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    return F.when(is_profile_url(c), F.regexp_replace(base, _EMPTY_PARAMS, "$1")).otherwise("")


def normalize_website(c: Column) -> Column:
    """Address with a scheme, without fragment and tracking keys.

    Query parts without ``=`` go as well.  Text that cannot be parsed (a host
    with one bracket only) is returned as it stands.
    """
    text = strip(c)
    url = F.regexp_replace(_parser_text(c), _NO_SCHEME, "https://")
    url = F.substring_index(url, "#", 1)
    for pattern, replacement in (
        (_QUERY_PART, "$1$2"),
        (_QUERY_END, "$1$2"),
        (_EMPTY_PARAMS, "$1"),
        (_MISSING_SLASHES, "$1//"),
        (_NEEDLESS_SLASHES, "$1"),
    ):
        url = F.regexp_replace(url, pattern, replacement)
    return (
        F.when(text.rlike(_PLAIN), text)
        .when(text.rlike(_BROKEN_SITE), F.regexp_replace(text, _NO_ADDRESS_START, "https://"))
        .otherwise(url)
    )
