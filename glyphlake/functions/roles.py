"""Roles of page regions, and the content kind and zone of each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Content kind and zone by role.
KIND_BY_ROLE = {
    "unknown": "any",
    "merchant_name": "arabic_text",
    "invoice_number": "number",
    "invoice_date": "date",
    "city": "arabic_text",
    "column_header": "arabic_text",
    "line_number": "number",
    "product_name": "arabic_text",
    "quantity": "number",
    "unit_price": "number",
    "line_total": "number",
    "notes": "arabic_text",
    "total_amount": "number",
    "total_in_words": "arabic_text",
    "total_in_figures": "number",
    "label": "arabic_text",
}
ZONE_BY_ROLE = {
    "merchant_name": "header",
    "invoice_number": "header",
    "invoice_date": "header",
    "city": "header",
    "column_header": "table",
    "line_number": "table",
    "product_name": "table",
    "quantity": "table",
    "unit_price": "table",
    "line_total": "table",
    "notes": "table",
    "total_amount": "footer",
    "total_in_words": "footer",
    "total_in_figures": "footer",
}


def _lookup(values: dict[str, str], role: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, role), F.lit(default))


def content_kind(role: Column) -> Column:
    return _lookup(KIND_BY_ROLE, role, "any")


def zone(role: Column) -> Column:
    return _lookup(ZONE_BY_ROLE, role, "unknown")
