"""Column expressions; every function takes and returns a ``Column``."""

from leadloom.functions.contact import normalize_email, normalize_phone, company_from_email
from leadloom.functions.names import clean_name_part, normalize_name, split_full_names, split_names
from leadloom.functions.score import (
    company_key, has_data, priority_score, priority_to_be, will_be_filled, will_have_data,
)
from leadloom.functions.text import (
    collapse,
    drop_null_tokens,
    normalize_company,
    normalize_job_title,
    normalize_sources,
    normalize_summary,
    source_label,
    strip,
)
from leadloom.functions.urls import normalize_linkedin_url, normalize_website

__all__ = [
    "clean_name_part", "collapse", "company_from_email", "company_key",
    "drop_null_tokens", "has_data", "normalize_company", "normalize_email",
    "normalize_job_title", "normalize_linkedin_url", "normalize_name",
    "normalize_phone", "normalize_sources", "normalize_summary",
    "normalize_website", "priority_score", "priority_to_be", "source_label", "split_full_names",
    "split_names", "strip", "will_be_filled", "will_have_data",
]
