"""Contract ids `CON.F.US.<product>.<month code><year>`, ticks, sides and labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .market_time import col

#: Month codes from January to December.
MONTH_CODES = "FGHJKMNQUVXZ"


def expiry_code(contract: Column | str) -> Column:
    """Month code and two-digit year after the last dot, NULL if there is none."""
    code = F.regexp_extract(col(contract), rf"(?:^|\.)([{MONTH_CODES}][0-9]{{2}})$", 1)
    return F.when(code != "", code)


def expiry_month(contract: Column | str) -> Column:
    return F.position(F.substring(expiry_code(contract), 1, 1), F.lit(MONTH_CODES))


def expiry_year(contract: Column | str) -> Column:
    return F.lit(2000) + F.substring(expiry_code(contract), 2, 2).cast("int")


def expiry_rank(contract: Column | str) -> Column:
    """year * 12 + month: later expiries rank higher; NULL when the id cannot be read."""
    return expiry_year(contract) * 12 + expiry_month(contract)


def has_product(contract: Column | str, product: Column | str) -> Column:
    """The second to last dot segment is the product code."""
    parts = F.split(col(contract), r"\.")
    return F.coalesce((F.size(parts) >= 2) & (F.element_at(parts, -2) == col(product)), F.lit(False))


def ticks_between(start: Column, end: Column, tick: Column) -> Column:
    return (end - start) / tick


def round_to_tick(price: Column, tick: Column) -> Column:
    """Nearest tick, halves away from zero."""
    ticks = price / tick
    return F.signum(ticks) * F.floor(F.abs(ticks) + 0.5) * tick


def typical_price(high: Column | str = "high", low: Column | str = "low", close: Column | str = "close") -> Column:
    return (col(high) + col(low) + col(close)) / 3


def order_side(code: Column | str) -> Column:
    """Bid buys and ask sells; anything else is unknown."""
    return F.when(col(code) == "bid", "buy").when(col(code) == "ask", "sell").otherwise("unknown")


def account_stage(name: Column | str) -> Column:
    """Practice, evaluation, funded or unknown, from the first segment of an account's name or its older forms."""
    label = F.upper(F.trim(col(name)))
    head = F.element_at(F.split(label, "-"), 1)
    return (
        F.when((head == "PRAC") | label.rlike("^PRACTICE[A-Z]{3}[0-9]+$"), "practice")
        .when((head == "EXPRESS") | label.rlike("^EXPRESS[A-Z]{3}[0-9]+$"), "funded")
        .when(head.rlike("^[0-9]+KTC$") | label.rlike("^S[0-9][A-Z]{3}[0-9]+$"), "evaluation")
        .otherwise("unknown")
    )


def order_status(code: Column | str) -> Column:
    known = ("open", "filled", "cancelled", "expired", "rejected", "pending")
    return F.when(col(code).isin(*known), col(code)).otherwise("unknown")
