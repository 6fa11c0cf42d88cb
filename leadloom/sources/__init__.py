"""Reading delimited feeds, writing clean tables, reports and payloads."""
