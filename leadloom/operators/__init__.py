"""DataFrame operators: mapping, cleaning, de-duplication, reports, run ledger."""
