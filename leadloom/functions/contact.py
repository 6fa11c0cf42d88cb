"""E-mail addresses and phone numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from leadloom.functions.text import strip
from leadloom.schema import (
    EMAIL_LABEL_LENGTH,
    EMAIL_LENGTH,
    EMAIL_LOCAL_CHARACTERS,
    EMAIL_LOCAL_LENGTH,
    EMAIL_PATTERN,
    EMAIL_SPECIAL_DOMAINS,
    FREE_MAIL_DOMAINS,
)


_WIDE = r"[\p{L}\p{N}\p{P}\p{S}&&[^\x00-\x7F]]"
_ATOM = rf"(?:[{EMAIL_LOCAL_CHARACTERS}]|{_WIDE}\p{{M}}*+)++"
_LETTER = r"[a-z0-9\p{L}\p{N}&&[^A-Z]]"
# A label neither begins nor ends with a hyphen, nor has two of them in its third place.
_LABEL = rf"(?!(?!xn)..--)(?=[^.]{{1,{EMAIL_LABEL_LENGTH}}}(?:\.|$)){_LETTER}(?:[{_LETTER}\p{{M}}\-]*[{_LETTER}\p{{M}}])?"
_SYNTAX = (
    rf"^(?=[^@]{{1,{EMAIL_LOCAL_LENGTH}}}@){_ATOM}(?:\.{_ATOM})*@"
    rf"(?!(?:.*\.)?(?:{'|'.join(EMAIL_SPECIAL_DOMAINS)})$)(?:{_LABEL}\.)+(?=[^.]{{2,}}$){_LABEL}(?<=[\p{{L}}\p{{M}}])$"
)


def normalize_email(c: Column) -> Column:
    """Lower-cased address, or the empty text where it is not an address.

    An address fits the plain pattern, or the syntax of mail standards (``o'neil@x.com``,
    ``josé@x.com``).  Neither needs a network, so the answer is the same on every run.
    """
    address = F.lower(strip(c))
    beyond = (
        F.contains(address, F.lit("@"))
        & (F.length(address) <= EMAIL_LENGTH)
        & address.rlike(_SYNTAX)
    )
    return F.when(address.rlike(EMAIL_PATTERN) | beyond, address).otherwise("")


def normalize_phone(c: Column) -> Column:
    """Digits with a leading ``+``; ten digits are read as a US number."""
    digits = F.coalesce(F.regexp_replace(c, r"[^\p{Nd}+]", ""), F.lit(""))
    us_number = F.regexp_replace(digits, "^(?=[^+].{9}$)", "+1")
    return F.regexp_replace(us_number, "^(?=[^+])", "+")


def company_from_email(company: Column, email: Column) -> Column:
    """The company, or the first label of the mail domain where it is missing.

    Domains of free mail providers say nothing and are skipped.
    """
    domain = F.substring_index(email, "@", -1)
    clue = F.initcap(F.substring_index(domain, ".", 1))
    usable = (company == "") & (email != "") & ~domain.isin(*FREE_MAIL_DOMAINS)
    return F.when(usable, clue).otherwise(company)
