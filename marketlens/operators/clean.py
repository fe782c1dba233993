"""Validation and cleaning transforms (CLN-01..CLN-22).

Every function is DataFrame -> DataFrame and lazy; the counting variants
return one-row frames produced by a single aggregate (one scan, whatever the
number of columns).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions import parse
from marketlens.functions.text import (PLACEHOLDERS, bool_domain, flag_to_int,
                                       placeholder_to_null, text_to_bool)
from marketlens.operators.ranking import first_per_key

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """CLN-17: column names by type class: 'numeric', 'string' or 'boolean'."""
    kinds = {"numeric": NUMERIC_TYPES, "string": (T.StringType,), "boolean": (T.BooleanType,)}
    want = kinds[kind]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, want)]


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """CLN-17 as a projection."""
    return df.select(*columns_of_kind(df, kind))


def replace_placeholders(df: DataFrame, cols: Sequence[str] | None = None,
                         placeholders: Sequence[str] = PLACEHOLDERS) -> DataFrame:
    """CLN-01: exact placeholder strings -> NULL on string columns."""
    cols = [c for c in (cols or string_columns(df)) if c in df.columns]
    return df.withColumns({c: placeholder_to_null(c, placeholders) for c in cols})


def to_number(c: str, df: DataFrame) -> Column:
    """CLN-02 expression: try_cast(double) and NaN -> NULL; numbers pass through."""
    dt = df.schema[c].dataType
    if isinstance(dt, NUMERIC_TYPES):
        return F.col(c)
    x = F.col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(x), x)


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN-02: numeric coercion, invalid -> NULL."""
    return df.withColumns({c: to_number(c, df) for c in cols if c in df.columns})


def coercion_losses(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN-03: per column, values that become NULL under CLN-02 (one aggregate)."""
    aggs = [F.count_if(F.col(c).isNotNull() & to_number(c, df).isNull()).alias(c)
            for c in cols if c in df.columns]
    return df.agg(*aggs)


# The model path's range rules (NULL out when violated).
RANGE_RULES = {
    "price": lambda c: c < 0,
    "reviews": lambda c: c < 0,
    "rating": lambda c: (c < 1) | (c > 5),
}


def range_violations(df: DataFrame, rules: Mapping = RANGE_RULES) -> DataFrame:
    """CLN-04 counts: rows breaking each rule (one aggregate)."""
    return df.agg(*[F.count_if(rule(F.col(c))).alias(c) for c, rule in rules.items()
                    if c in df.columns])


def apply_range_rules(df: DataFrame, rules: Mapping = RANGE_RULES) -> DataFrame:
    """CLN-04: NULL out values breaking a range rule."""
    return df.withColumns({c: F.when(~rule(F.col(c)) | F.col(c).isNull(), F.col(c))
                           for c, rule in rules.items() if c in df.columns})


BOOL_FLAGS = ["is_amazon_choice", "is_prime", "has_variations", "is_climate_friendly"]


# The model path's 31 columns without predictive use.
UNNECESSARY_FEATURES = [
    "link", "image_url", "main_image_url", "additional_image_urls", "aplus_images",
    "brand_url", "brand_urls", "video_thumbnail", "product_videos", "user_videos", "slug",
    "title", "currency",
    "current_price", "is_bestseller", "is_best_seller", "parent_asin", "landing_asin",
    "main_category",
    "category_hierarchy", "variation_dimensions", "variants", "all_variants",
    "frequently_bought_together", "top_reviews", "top_reviews_global", "detailed_rating",
    "technical_details", "product_details", "key_features", "full_description",
]


def bool_domain_violations(df: DataFrame, cols: Sequence[str] = BOOL_FLAGS) -> DataFrame:
    """CLN-05 counts: non-null values outside the boolean vocabulary."""
    return df.agg(*[F.count_if(F.col(c).isNotNull() & bool_domain(c).isNull()).alias(c)
                    for c in cols if c in df.columns])


def enforce_bool_domain(df: DataFrame, cols: Sequence[str] = BOOL_FLAGS) -> DataFrame:
    """CLN-05: text flags -> boolean; anything outside true/false -> NULL."""
    return df.withColumns({c: bool_domain(c) for c in cols if c in df.columns})


def bools_to_int(df: DataFrame, cols: Sequence[str] = BOOL_FLAGS) -> DataFrame:
    """CLN-06: boolean -> 0/1 (NULL stays NULL)."""
    return df.withColumns({c: F.col(c).cast("int") for c in cols if c in df.columns})


def text_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN-07: text -> boolean with the loader's vocabulary; absent column -> false."""
    return df.withColumns({c: text_to_bool(c) if c in df.columns else F.lit(False)
                           for c in cols})


def int_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN-08: mixed flag -> 0/1 with default 0; absent column -> 0."""
    return df.withColumns({c: flag_to_int(c) if c in df.columns else F.lit(0) for c in cols})


def fill_missing(df: DataFrame, from_columns: Mapping[str, str] | None = None,
                 constants: Mapping[str, object] | None = None) -> DataFrame:
    """CLN-09: fill a column from another (``original <- price``) and from constants."""
    out = {}
    for tgt, src in (from_columns or {}).items():
        out[tgt] = F.coalesce(F.col(tgt), F.col(src)) if tgt in df.columns else F.col(src)
    for tgt, val in (constants or {}).items():
        out[tgt] = F.coalesce(F.col(tgt), F.lit(val)) if tgt in df.columns else F.lit(val)
    return df.withColumns(out)


def drop_incomplete(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """CLN-10: drop rows with NULL in any of ``subset``."""
    return df.na.drop(subset=list(subset))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """CLN-11: drop the listed columns; absent names are ignored."""
    return df.drop(*cols)


def clip(c, lower=None, upper=None) -> Column:
    """CLN-13: clip keeping NULL (greatest/least would skip it)."""
    x = F.col(c) if isinstance(c, str) else c
    y = x
    if lower is not None:
        y = F.greatest(y, F.lit(lower))
    if upper is not None:
        y = F.least(y, F.lit(upper))
    return F.when(x.isNotNull(), y)


# Column synonyms of the served preprocessor (source -> canonical).
SYNONYMS = {
    "review_count": "reviews",
    "offer_count": "number_of_offers",
    "category": "crawl_category",
    "is_choice": "is_amazon_choice",
    "is_climate": "is_climate_friendly",
    "has_variation": "has_variations",
}


def apply_synonyms(df: DataFrame, synonyms: Mapping[str, str] = SYNONYMS) -> DataFrame:
    """CLN-14: copy a synonym column into the canonical name when that is absent."""
    add = {tgt: F.col(src) for src, tgt in synonyms.items()
           if tgt not in df.columns and src in df.columns}
    return df.withColumns(add) if add else df


def conform(df: DataFrame, spec: Mapping[str, tuple[str, object]],
            keep_rest: bool = True) -> DataFrame:
    """CLN-15: one projection to a declared schema ``{name: (type, default)}``.

    Absent columns get the default; present ones are try_cast, then filled.
    Columns outside the spec are kept after the declared ones.
    """
    cols = []
    for name, (typ, default) in spec.items():
        if name in df.columns:
            src = F.col(name)
            if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
                src = F.when(~F.isnan(src), src)
            # booleans by the loader's vocabulary (CLN-07); a missing value takes the default
            v = F.when(src.isNotNull(), text_to_bool(name)) if typ == "boolean" else src.try_cast(typ)
            if typ in ("double", "float"):
                v = F.when(~F.isnan(v), v)
        else:
            v = F.lit(None).cast(typ)
        if default is not None:
            v = F.coalesce(v, F.lit(default).cast(typ))
        cols.append(v.alias(name))
    rest = [c for c in df.columns if c not in spec] if keep_rest else []
    return df.select(*cols, *rest)


def order_columns(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """CLN-16: preferred columns first (when present), the rest after in their order."""
    first = [c for c in preferred if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def add_date(df: DataFrame, value: str, name: str = "date") -> DataFrame:
    """CLN-18: constant date column."""
    return df.withColumn(name, F.lit(value).cast("date"))


# Nested payload fields and their empty defaults.
NESTED_OBJECT_FIELDS = ["main_category", "variants", "all_variants", "detailed_rating"]
NESTED_LIST_FIELDS = ["category_hierarchy", "variation_dimensions", "top_reviews"]


def normalize_nested(df: DataFrame, object_fields: Sequence[str] = NESTED_OBJECT_FIELDS,
                     list_fields: Sequence[str] = NESTED_LIST_FIELDS) -> DataFrame:
    """CLN-19: JSON text of the wrong shape -> empty map / empty array.

    Objects parse as map<string,string>, lists as array<string>; anything that
    does not parse as that shape (or is NULL) becomes {} / [].
    """
    out = {}
    for c in object_fields:
        if c in df.columns:
            parsed = F.from_json(F.col(c).cast("string"), "map<string,string>")
            out[c] = F.coalesce(parsed, F.create_map().cast("map<string,string>"))
    for c in list_fields:
        if c in df.columns:
            parsed = F.from_json(F.col(c).cast("string"), "array<string>")
            out[c] = F.coalesce(parsed, F.array().cast("array<string>"))
    return df.withColumns(out)


# ---------------------------------------------------------------------------
# Composite cleans
# ---------------------------------------------------------------------------

# Fill texts and the snapshot date of the dashboard clean.
NO_SALES_TEXT = "0 bought in past month"
NO_DELIVERY_TEXT = "No delivery information"
SNAPSHOT_DATE = "2026-03-24"
ROW_ORDER = ["row_k1", "row_k2", "row_k3"]


def dashboard_clean(raw: DataFrame, key: str = "asin",
                    order: Sequence[str] = ROW_ORDER, deduplicated: bool = False) -> DataFrame:
    """CLN-21: placeholders -> coercion -> boolean domain -> first per key ->
    fills -> drop rows without price/rating -> date -> features.

    Works on the fixture's cent/tenth columns (``price_cents``,
    ``original_price_cents``, ``rating_x10``); money stays integer cents.

    The first-per-key step only looks at the key and the row order, which the
    row-wise cleaning steps never change, so it runs first: every later
    expression is evaluated once per product instead of once per raw row.
    """
    df = raw if deduplicated else first_per_key(raw, key, order)
    df = replace_placeholders(df)
    df = coerce_numeric(df, ["price_cents", "rating_x10", "reviews"])
    df = enforce_bool_domain(df)
    df = fill_missing(df, {"original_price_cents": "price_cents"},
                      {"sales_volume": NO_SALES_TEXT, "delivery_info": NO_DELIVERY_TEXT})
    df = drop_incomplete(df, ["price_cents", "rating_x10"])
    df = add_date(df, SNAPSHOT_DATE)
    disc = F.col("original_price_cents") - F.col("price_cents")   # before the price clip
    delivery = parse.delivery_details("delivery_info")
    return df.withColumns({
        "discount_cents": disc,
        "price_cents": clip("price_cents", lower=0),
        "discount_rate": F.when(F.col("original_price_cents") > 0,
                                disc / F.col("original_price_cents")).otherwise(F.lit(0.0)),
        "rating": F.col("rating_x10") / 10,
        "sales_volume_num": parse.sales_number_truncated("sales_volume"),
        "delivery": delivery,
    }).withColumns({
        "delivery_fee": F.col("delivery.fee"),
        "delivery_date_text": F.col("delivery.date_text"),
        "delivery_ship_to": F.col("delivery.ship_to"),
        "delivery_stock_note": F.col("delivery.stock_note"),
    }).drop("delivery")


# Numeric inputs of the served preprocessor (cents/tenths forms
# of the money and rating columns in this library's tables).
PREPROCESS_NUMERIC = ["price_cents", "original_price_cents", "rating_x10", "reviews",
                      "number_of_offers", "lowest_offer_price", "delivery_fee", "sales_volume_num"]


def preprocess(df: DataFrame) -> DataFrame:
    """CLN-20: the served preprocessor as one DataFrame -> DataFrame step:
    placeholders -> synonyms -> numeric columns present and coerced ->
    original price falls back to price -> flags as 0/1 (default 0) ->
    category present -> sales 0 if no row has any."""
    out = replace_placeholders(df)
    out = apply_synonyms(out)
    out = out.withColumns({c: F.lit(None).cast("double") for c in PREPROCESS_NUMERIC
                           if c not in out.columns})
    out = coerce_numeric(out, PREPROCESS_NUMERIC)
    out = fill_missing(out, {"original_price_cents": "price_cents"})
    out = int_flags(out, BOOL_FLAGS)
    if "crawl_category" not in out.columns:
        out = out.withColumn("crawl_category", F.lit(None).cast("string"))
    known = out.agg(F.count("sales_volume_num").alias("n")).select("n").scalar()
    return out.withColumn("sales_volume_num", F.when(known == 0, F.lit(0.0)).otherwise(F.col("sales_volume_num")))


def dashboard_table(raw: DataFrame, deduplicated: bool = False) -> DataFrame:
    """The dashboard's loaded table: CLN-21 plus the loader's coercions
    (missing best-seller flag -> false, choice flag via CLN-07)."""
    df = dashboard_clean(raw, deduplicated=deduplicated)
    if "is_best_seller" not in df.columns:
        df = df.withColumn("is_best_seller", F.lit(False))
    return df.withColumns({
        "is_best_seller": F.coalesce(F.col("is_best_seller").cast("boolean"), F.lit(False)),
        "is_amazon_choice": F.coalesce(F.col("is_amazon_choice"), F.lit(False)),
    })
