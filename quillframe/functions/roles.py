"""Which column plays which business role, judged from names and types alone."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .columns import is_numeric

# Fixed values, in order of preference: exact column names for each role.
ROLE_ALIASES = {
    "revenue": ["revenue", "sales_amount", "net_sales", "sales", "order_value", "total_amount", "amount"],
    "profit": ["profit", "gross_profit", "net_profit", "profit_amount"],
    "quantity": ["quantity", "units", "units_sold", "qty"],
    "orders": ["order_id", "transaction_id", "invoice_id", "purchase_id"],
    "customers": ["customer_id", "client_id", "buyer_id", "user_id"],
    "date": ["order_date", "transaction_date", "purchase_date", "sale_date", "date", "datetime", "timestamp"],
    "product": ["product", "product_name", "item", "item_name", "sku"],
    "category": ["category", "product_category", "segment", "sub_category"],
    "region": ["region", "country", "state", "city", "territory", "store"],
    "discount": ["discount", "discount_pct", "discount_rate", "discount_amount"],
}

# Name parts (split at underscores) that hint at a role when no alias matches.
ROLE_HINTS = {
    "revenue": {"revenue", "sales", "salesamount"},
    "profit": {"profit", "margin"},
    "quantity": {"quantity", "units", "qty"},
    "orders": {"order", "transaction", "invoice", "purchase"},
    "customers": {"customer", "client", "buyer", "user"},
    "date": {"date", "datetime", "timestamp"},
    "product": {"product", "item", "sku"},
    "category": {"category", "subcategory", "segment"},
    "region": {"region", "country", "state", "city", "territory", "store"},
    "discount": {"discount"},
}

MEASURE_ROLES = {"revenue", "profit", "quantity", "discount"}
IDENTIFIER_ROLES = {"orders", "customers"}

# Identifier names, and phrases in a column description that mark it as recorded too late.
IDENTIFIER_NAMES = {"id", "customer_id", "client_id", "row_id", "index"}
LATE_PHRASES = ("leakage", "after the outcome", "post-outcome")


def detect_roles(df: DataFrame, overrides: dict[str, str | None] | None = None) -> dict[str, str | None]:
    """Role -> column name (or None).  ``overrides`` states roles the caller already knows."""
    fields = {field.name.lower(): field for field in df.schema.fields}

    def fits(role: str, name: str) -> bool:
        return role not in MEASURE_ROLES or is_numeric(fields[name])

    def hinted(role: str, name: str) -> bool:
        parts = set(name.split("_"))
        return bool(parts & ROLE_HINTS[role]) and (role not in IDENTIFIER_ROLES or "id" in parts)

    roles: dict[str, str | None] = {}
    for role, aliases in ROLE_ALIASES.items():
        candidates = [a for a in aliases if a in fields] + [n for n in fields if hinted(role, n)]
        roles[role] = next((fields[n].name for n in candidates if fits(role, n)), None)
    for role, name in (overrides or {}).items():
        if role not in ROLE_ALIASES:
            raise ValueError(f"Unknown role: {role}")
        if name is not None and name not in df.columns:
            raise ValueError(f"Unknown column(s): {name}")
        roles[role] = name
    return roles


def leakage_columns(columns: list[str], descriptions: dict[str, str] | None) -> list[str]:
    """Columns whose description says they leak the outcome."""
    return [c for c, text in (descriptions or {}).items() if c in columns and "leakage" in str(text).lower()]


def excluded_driver_fields(
    columns: list[str], target: str, descriptions: dict[str, str] | None = None
) -> dict[str, str]:
    """Columns that may not explain ``target``, each with the reason."""
    reasons = {target: "outcome being measured"}
    for name in columns:
        if name == target:
            continue
        text = str((descriptions or {}).get(name, "")).lower()
        if any(phrase in text for phrase in LATE_PHRASES):
            reasons[name] = "recorded during or after the outcome"
        elif name.lower() in IDENTIFIER_NAMES or name.lower().endswith("_id"):
            reasons[name] = "identifier"
    return reasons
