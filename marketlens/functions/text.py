"""Flag, missing-value and small text expressions (CLN-07/08, FE-20, FE-26..29)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as true by the loader; the boolean domain check
# knows only the two words themselves.
TRUE_TEXT = ["true", "1", "yes", "y"]
# Placeholder strings that mean "missing" (exact match, no trim).
PLACEHOLDERS = ["[]", "{}", "", "missing value", "N/A", "nan"]
EXPLORATION_PLACEHOLDERS = ["[]", "{}", ""]
# Listing-quality "missing" spellings after trim+lower; the
# zero spellings count only for non-quantitative columns.
MISSING_TEXT = ["", "nan", "none", "[]", "{}", "false"]
ZERO_TEXT = ["0", "0.0"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_to_bool(c) -> Column:
    """CLN-07: trim+lower in {true,1,yes,y}; anything else (NULL too) -> false."""
    return F.coalesce(F.lower(F.trim(_c(c).cast("string"))).isin(*TRUE_TEXT), F.lit(False))


def bool_domain(c) -> Column:
    """CLN-05: "true" or "false" in any case -> boolean, anything else -> NULL."""
    t = F.lower(F.trim(_c(c).cast("string")))
    return F.when(t == "true", True).when(t == "false", False)


def flag_to_int(c) -> Column:
    """CLN-08: true-text -> 1, else try_cast(int), default 0."""
    t = F.lower(F.trim(_c(c).cast("string")))
    return F.when(t.isin(*TRUE_TEXT), 1).otherwise(
        F.coalesce(t.try_cast("int"), F.lit(0)))


def placeholder_to_null(c, placeholders: Sequence[str] = PLACEHOLDERS) -> Column:
    """CLN-01: exact placeholder text -> NULL (no trimming)."""
    x = _c(c)
    return F.when(~x.isin(*placeholders) | x.isNull(), x)


def is_missing(c, quantitative: bool) -> Column:
    """FE-20: NULL, or trimmed lower text in the missing vocabulary (+ zeros for
    non-quantitative columns)."""
    x = _c(c)
    vocab = list(MISSING_TEXT) + ([] if quantitative else list(ZERO_TEXT))
    return x.isNull() | F.lower(F.trim(x.cast("string"))).isin(*vocab)


def slug(c, max_len: int = 64, default: str = "all") -> Column:
    """FE-26: lower, non-alphanumerics -> '-', trim dashes, cut to 64, default 'all'."""
    s = F.regexp_replace(F.lower(_c(c).cast("string")), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, max_len), F.lit("")), F.lit(default))


def truncate_label(c, n: int) -> Column:
    """FE-28: cut to n characters and append '...' when longer."""
    x = _c(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def _one_decimal(v: Column, unit: float) -> Column:
    """v/unit with one decimal, half rounded up, as text (exact for integer input)."""
    tenths = F.floor(v / (unit / 10) + 0.5).cast("bigint")
    return F.concat((tenths / 10).cast("bigint").cast("string"), F.lit("."),
                    (tenths % 10).cast("string"))


def compact_number(c) -> Column:
    """FE-29: 1500 -> '1.5K', 2500000 -> '2.5M', else the number as text."""
    v = _c(c).cast("double")
    return (F.when(v >= 1e6, F.concat(_one_decimal(v, 1e6), F.lit("M")))
            .when(v >= 1e3, F.concat(_one_decimal(v, 1e3), F.lit("K")))
            .otherwise(_c(c).cast("string")))
