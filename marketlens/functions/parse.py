"""Text parsers for sales and delivery text (FE-01..FE-05).

Built-in regex expressions only: they run inside whole-stage codegen, no
Python per row. Regexes use bracket classes (``[0-9]``, ``[.]``, ``[+]``) so
the same text works in Spark (Java regex) and in the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sales pattern "<number>[k]+" and the delivery pattern
# "$<number> delivery" used by the reference's parsers.
SALES_PATTERN = r"([0-9]+(?:[.][0-9]+)?)\s*([kK]?)[+]"
DELIVERY_FEE_PATTERN = r"[$]([0-9]+(?:[.][0-9]+)?)\s*delivery"
NO_DELIVERY_TEXT = "no delivery information"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _extract(text: Column, pattern: str, group: int) -> Column:
    """regexp_extract with NULL (not '') when there is no match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def sales_number_truncated(c) -> Column:
    """FE-01 (cleaning variant): lower-case, first match, x1000 on k, truncate; no match -> 0."""
    text = F.lower(_c(c).cast("string"))
    num = _extract(text, SALES_PATTERN, 1).cast("double")
    mult = F.when(F.regexp_extract(text, SALES_PATTERN, 2) == "k", 1000).otherwise(1)
    return F.coalesce((num * mult).cast("bigint"), F.lit(0).cast("bigint"))


def sales_number_rounded(c) -> Column:
    """FE-02 (loader variant): k or K, round half-even; no match -> NULL."""
    text = _c(c).cast("string")
    num = _extract(text, SALES_PATTERN, 1).cast("double")
    is_k = F.lower(F.regexp_extract(text, SALES_PATTERN, 2)) == "k"
    return F.bround(num * F.when(is_k, 1000).otherwise(1), 0).cast("bigint")


def delivery_fee_lenient(c) -> Column:
    """FE-03: ``$x delivery`` case-insensitive; default 0.0."""
    fee = _extract(_c(c).cast("string"), "(?i)" + DELIVERY_FEE_PATTERN, 1).cast("double")
    return F.coalesce(fee, F.lit(0.0))


def delivery_fee_strict(c) -> Column:
    """FE-04: ``$x delivery`` case-sensitive; default NULL."""
    return _extract(_c(c).cast("string"), DELIVERY_FEE_PATTERN, 1).cast("double")


# Delivery text sections (date after "delivery", country after
# "Ships to", stock note starting "Only N left"), case-insensitive. The
# reference stops the lazy group with a look-ahead; "(?:stop.*)?$" is the same
# language and also runs on engines without look-around.
DATE_PATTERN = r"(?i)delivery\s+(.*?)(?:\s*Ships to.*)?$"
SHIP_PATTERN = r"(?i)Ships to\s+(.*?)(?:\s*Only\s+[0-9]+\s+left.*)?$"
STOCK_PATTERN = r"(?i)(Only\s+[0-9]+\s+left.*)$"


def delivery_details(c) -> Column:
    """FE-05: struct(fee, date_text, ship_to, stock_note) from delivery text.

    A missing text or "No delivery information" gives (0.0, NULL, NULL, NULL).
    A space is inserted between a digit and a following letter first.
    """
    raw = _c(c).cast("string")
    s = F.trim(raw)
    norm = F.regexp_replace(s, "([0-9])([A-Za-z])", "$1 $2")
    none = raw.isNull() | (F.lower(raw) == NO_DELIVERY_TEXT)
    fee = F.coalesce(_extract(s, "(?i)" + DELIVERY_FEE_PATTERN, 1).cast("double"), F.lit(0.0))

    def part(p: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(norm, p, 1)), F.lit(""))

    return F.when(none, F.struct(F.lit(0.0).alias("fee"),
                                 F.lit(None).cast("string").alias("date_text"),
                                 F.lit(None).cast("string").alias("ship_to"),
                                 F.lit(None).cast("string").alias("stock_note"))) \
        .otherwise(F.struct(fee.alias("fee"), part(DATE_PATTERN).alias("date_text"),
                            part(SHIP_PATTERN).alias("ship_to"), part(STOCK_PATTERN).alias("stock_note")))
