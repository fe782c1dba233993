"""Model-path questions (CLN-20, CLN-22, ML-01..ML-22).

Estimator questions with exact arithmetic have oracles; model training is
checked by rows (and by tests on thresholds), as parity with other model
libraries is not a goal. Training questions search the whole reference grids
(48/72/144 points) once for each input and share what the store holds.
"""

from __future__ import annotations

import json
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marketlens.ml import modeling as MD
from marketlens.ml.estimators import QuantileClipper, impute_constants
from marketlens.ml.store import NAMES, Store, load_model
from marketlens.operators import clean as C
from marketlens.plans import oracle as O
from marketlens.plans.catalog import register
from marketlens.plans.frames import input_stamp, products
from marketlens.session import ensure_checkpoint_dir

MODEL_SQL = f"""
model_base as (
  select asin, price_cents / 100 as price, original_price_cents / 100 as original_price,
         case when rating_x10 / 10 < 1 or rating_x10 / 10 > 5 then null else rating_x10 / 10 end as rating,
         reviews, number_of_offers, crawl_category
  from products
)"""


_HASH = "cast('0x' || substr(md5(asin || ':42'), 1, 8) as bigint) % 100"
_SKEWED = ["price", "original_price", "reviews", "number_of_offers", "delivery_fee", "discount", "lowest_offer_price"]
_STABLE = ["rating", "discount_rate"]
_FLAGS = ["is_prime", "is_amazon_choice", "is_climate_friendly", "has_variations"]

MODEL_ROWS = f"""
model_base as (
  select asin, price_cents / 100 as price, case when reviews < 0 then null else reviews end as reviews, number_of_offers, {O.ph('crawl_category')} as crawl_category,
         case when rating_x10 / 10 < 1 or rating_x10 / 10 > 5 then null else rating_x10 / 10 end as rating,
         coalesce(original_price_cents / 100, price_cents / 100) as original_price,
         {O.sales_trunc("coalesce(" + O.ph('sales_volume') + ", '0 bought in past month')")} as sales_volume_num,
         {O.fee_lenient("coalesce(" + O.ph('delivery_info') + ", 'No delivery information')")} as delivery_fee,
         cast({O.booldom('is_amazon_choice')} as int) as is_amazon_choice, cast({O.booldom('has_variations')} as int) as has_variations
  from products
),
model_rows as (
  select asin, case when {_HASH} < 70 then 'train' when {_HASH} < 85 then 'val' else 'test' end as split,
         ln(1 + sales_volume_num) as target_log, sales_volume_num, price, original_price, rating, reviews, number_of_offers, delivery_fee,
         original_price - price as discount, case when original_price > 0 then (original_price - price) / original_price else 0.0 end as discount_rate,
         crawl_category, is_amazon_choice, has_variations
  from model_base where price is not null and rating is not null
),
model_x as (
  select asin, split, coalesce(crawl_category, 'missing') as crawl_category, 0.0::double as lowest_offer_price, 0.0::double as is_prime, 0.0::double as is_climate_friendly,
         {", ".join(f"coalesce({c}::double, 0.0) as {c}" for c in _SKEWED[:-1] + _STABLE + ["is_amazon_choice", "has_variations"])}
  from model_rows
),
model_log as (
  select asin, split, {", ".join(f"ln(1 + greatest({c}, 0.0)) as {c}" for c in _SKEWED)} from model_x
),
model_q as (
  select {", ".join(f"quantile_cont({c}, 0.01) as {c}_lo, quantile_cont({c}, 0.99) as {c}_hi" for c in _SKEWED)} from model_log where split = 'train'
),
model_clip as (
  select x.asin, x.split, x.crawl_category, {", ".join(f"least(greatest(l.{c}, {c}_lo), {c}_hi) as {c}" for c in _SKEWED)}, {", ".join("x." + c for c in _STABLE + _FLAGS)}
  from model_x x join model_log l on l.asin = x.asin, model_q
),
model_s as (
  select {", ".join(f"avg({c}) as {c}_m, case when stddev_pop({c}) > 0 then stddev_pop({c}) else 1 end as {c}_s" for c in _SKEWED + _STABLE)},
         list_sort(list(distinct crawl_category)) as cats
  from model_clip where split = 'train'
),
model_features as (
  select asin, split, list_concat(list_concat([{", ".join(f"({c} - {c}_m) / {c}_s" for c in _SKEWED + _STABLE)}],
         list_transform(cats, lambda c: case when c = crawl_category then 1.0::double else 0.0::double end)), [{", ".join(_FLAGS)}]) as features
  from model_clip, model_s
)"""


def _table(spark, d):
    return MD.model_table(products(spark, d))


# is_prime and is_climate_friendly hold no true or false in the fixture: they are dropped as sparse
@register("cln_22", O.with_base("select * from model_rows", MODEL_ROWS))
def cln_22(spark, d):
    return _table(spark, d)


@register("cln_20", O.with_base(f"""
select asin, coalesce(reviews, 0) as reviews, coalesce(number_of_offers, 0) as number_of_offers,
  crawl_category,
  case when lower(trim(is_prime)) in ('true', '1', 'yes', 'y') then 1
       else coalesce(try_cast(lower(trim(is_prime)) as int), 0) end as is_prime,
  case when lower(trim(is_amazon_choice)) in ('true', '1', 'yes', 'y') then 1
       else coalesce(try_cast(lower(trim(is_amazon_choice)) as int), 0) end as is_amazon_choice,
  coalesce(original_price_cents, price_cents) as original_price_cents, cast(0 as double) as sales_volume_num
from (select asin, reviews as review_count, number_of_offers as offer_count, crawl_category as category,
             {O.ph('is_prime')} as is_prime, {O.ph('is_amazon_choice')} as is_amazon_choice,
             original_price_cents, price_cents, reviews, number_of_offers, crawl_category
      from products) p"""))
def cln_20(spark, d):
    from marketlens.operators.clean import preprocess
    p = products(spark, d)
    out = preprocess(p.withColumnRenamed("reviews", "review_count")
                     .withColumnRenamed("number_of_offers", "offer_count")
                     .withColumnRenamed("crawl_category", "category"))
    return out.select("asin", F.coalesce("reviews", F.lit(0)).alias("reviews"),
                      F.coalesce("number_of_offers", F.lit(0)).alias("number_of_offers"),
                      "crawl_category", "is_prime", "is_amazon_choice", "original_price_cents", "sales_volume_num")


@register("ml_01", O.with_base("""
with q as (select quantile_cont(price, 0.01) as plo, quantile_cont(price, 0.99) as phi,
                  quantile_cont(reviews, 0.01) as rlo, quantile_cont(reviews, 0.99) as rhi from model_base)
select asin, case when price is not null then least(greatest(price, plo), phi) end as price,
       case when reviews is not null then least(greatest(cast(reviews as double), rlo), rhi) end as reviews
from model_base, q""", MODEL_SQL))
def ml_01(spark, d):
    p = products(spark, d).select(
        "asin", (F.col("price_cents") / 100).alias("price"), F.col("reviews").cast("double").alias("reviews"))
    m = QuantileClipper(inputCols=["price", "reviews"]).fit(p)
    return m.transform(p)


@register("ml_02", O.with_base("""
with l as (select asin, ln(1 + price) as p, ln(1 + coalesce(reviews, 0)) as r from model_rows),
     q as (select quantile_cont(p, 0.01) as plo, quantile_cont(p, 0.99) as phi, quantile_cont(r, 0.01) as rlo, quantile_cont(r, 0.99) as rhi from l)
select asin, least(greatest(p, plo), phi) as price_log_clipped, least(greatest(r, rlo), rhi) as reviews_log_clipped,
       0.0::double as lowest_offer_price_log_clipped
from l, q""", MODEL_ROWS))
def ml_02(spark, d):
    t = _table(spark, d)
    m = QuantileClipper(inputCols=["price", "reviews", "lowest_offer_price"], logFirst=True,
                        outputSuffix="_log_clipped").fit(t)
    return m.transform(t).select("asin", "price_log_clipped", "reviews_log_clipped",
                                 "lowest_offer_price_log_clipped")


@register("ml_03", O.with_base("""
with s as (select avg(rating) as rm, stddev_pop(rating) as rs, avg(discount_rate) as dm, stddev_pop(discount_rate) as ds from model_rows)
select asin, (rating - rm) / rs as rating_scaled, (discount_rate - dm) / ds as discount_rate_scaled from model_rows, s""", MODEL_ROWS))
def ml_03(spark, d):
    from marketlens.ml.estimators import PopulationScaler
    t = _table(spark, d)
    m = PopulationScaler(inputCols=["rating", "discount_rate"], outputSuffix="_scaled").fit(t)
    return m.transform(t).select("asin", "rating_scaled", "discount_rate_scaled")


@register("ml_04", O.with_base("""
select asin, crawl_category, list_transform(cats, lambda c: case when c = crawl_category then 1.0::double else 0.0::double end) as one_hot
from model_x, model_s""", MODEL_ROWS))
def ml_04(spark, d):
    t = MD.prepare_features(_table(spark, d))
    fm = MD.fit_features(t.where("split = 'train'"))
    return fm.transform(t).select("asin", "crawl_category",
                                  vector_to_array("crawl_category_ohe").alias("one_hot"))


@register("ml_05", O.with_base("""
select asin, coalesce(cast(reviews as double), 0.0) as reviews,
       coalesce(cast(original_price as double), 0.0) as original_price,
       0.0 as lowest_offer_price, coalesce(crawl_category, 'missing') as crawl_category
from model_base""", MODEL_SQL))
def ml_05(spark, d):
    p = products(spark, d).select(
        "asin", "reviews", (F.col("original_price_cents") / 100).alias("original_price"),
        "crawl_category")
    return impute_constants(p, ["reviews", "original_price", "lowest_offer_price"],
                            ["crawl_category"]).select(
        "asin", "reviews", "original_price", "lowest_offer_price", "crawl_category")


def _features(spark, d):
    t = MD.prepare_features(_table(spark, d))
    fm = MD.fit_features(t.where("split = 'train'"))
    return t, fm


@register("ml_06", O.with_base("select asin, split, len(features)::int as width, features from model_features", MODEL_ROWS))
def ml_06(spark, d):
    t, fm = _features(spark, d)
    return fm.transform(t).select("asin", "split", F.size(vector_to_array("features")).alias("width"),
                                  vector_to_array("features").alias("features"))


@register("ml_07", O.with_base("select split, count(*) as rows, min(features[1]) as first_feature_min, max(features[1]) as first_feature_max from model_features group by split", MODEL_ROWS))
def ml_07(spark, d):
    t, fm = _features(spark, d)
    out = fm.transform(t)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("rows"),
                                    F.min(vector_to_array("features")[0]).alias("first_feature_min"),
                                    F.max(vector_to_array("features")[0]).alias("first_feature_max"))


@register("ml_08", O.with_base("select asin, features from model_features", MODEL_ROWS))
def ml_08(spark, d):
    t = MD.prepare_features(_table(spark, d))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/features-{uuid.uuid4().hex}"
    MD.ensure_pipeline(path, t.where("split = 'train'"))  # builds and saves
    loaded = MD.ensure_pipeline(path, t.limit(0))  # loads
    return loaded.transform(t).select("asin", vector_to_array("features").alias("features"))


_NAMES_SQL = f"list_concat(list_concat({_SKEWED + _STABLE}, list_transform(cats, lambda c: 'crawl_category_' || c)), {_FLAGS})"


@register("ml_09", O.with_base(f"""
select (row_number() over () - 1)::int as idx, feature from (select unnest({_NAMES_SQL}) as feature from model_s)""", MODEL_ROWS))
def ml_09(spark, d):
    t, fm = _features(spark, d)
    return MD.feature_name_frame(spark, fm.transform(t))


def _store(spark, d, names=NAMES):
    return Store(spark, lambda: _table(spark, d), [input_stamp(spark, d), "first listing of each product"], names=names)


def _searched(spark, d, name):
    """Every point of a model's grid, best first, the chosen one with its metrics on test."""
    store = _store(spark, d, [name])
    points = store.points(name)
    rows = [(k + 1, json.dumps(p["settings"], sort_keys=True), p["mse"], p["folds"]) for k, p in enumerate(points)]
    grid = spark.createDataFrame(rows, "rank int, settings string, cv_mse double, folds int")
    best = store.comparison([name]).withColumn("_rank", F.lit(1))
    return grid.join(F.broadcast(best), F.col("rank") == F.col("_rank"), "left").drop("_rank").withColumn("model", F.lit(name))


@register("ml_10")
def ml_10(spark, d):
    return _store(spark, d).comparison(["linear"])


@register("ml_11")
def ml_11(spark, d):
    return _searched(spark, d, "random_forest")


@register("ml_12")
def ml_12(spark, d):
    return _searched(spark, d, "gradient_boosting")


@register("ml_13")
def ml_13(spark, d):
    return _searched(spark, d, "regularised_boosting")


@register("ml_14")
def ml_14(spark, d):
    return MD.metrics(_store(spark, d).predicted("linear", "test"))


@register("ml_15")
def ml_15(spark, d):
    return _store(spark, d).comparison().orderBy(F.col("r2").desc(), "model")


@register("ml_16")
def ml_16(spark, d):
    store = _store(spark, d)
    names = store.features()["names"]
    return MD.each_model({k: MD.importances(store.model(k), names, spark, 10) for k in NAMES})


@register("ml_17")
def ml_17(spark, d):
    store = _store(spark, d)
    rows = [(k, *r) for k in NAMES for r in store.scores(k)["curve"]]
    df = spark.createDataFrame(rows, "model string, train_fraction double, rows long, train_mse double, cv_mse double")
    return df.groupBy("model", "train_fraction").agg(F.avg("rows").alias("train_rows"), F.avg("train_mse").alias("train_mse"),
                                                     F.avg("cv_mse").alias("cv_mse"), F.count(F.lit(1)).alias("folds"))


@register("ml_18")
def ml_18(spark, d):
    store = _store(spark, d)
    df = spark.createDataFrame([(k, float(r2)) for k in NAMES for r2 in store.scores(k)["stability"]], "model string, r2 double")
    return df.groupBy("model").agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"), F.count(F.lit(1)).alias("folds"))


@register("ml_19")
def ml_19(spark, d):
    from marketlens.operators.aggregates.profile import histogram
    store, out = _store(spark, d), {}
    for k in NAMES:
        r = MD.residuals(store.predicted(k, "test"))
        mean = r.agg(F.avg("residual").alias("residual_mean"))
        out[k] = histogram(r, "residual", 40, eager_bounds=True).crossJoin(F.broadcast(mean))
    return MD.each_model(out)


@register("ml_20")
def ml_20(spark, d):
    """Pairs of actual and predicted of every test listing, with the axis limits of their chart."""
    store, out = _store(spark, d), {}
    for k in NAMES:
        p = store.predicted(k, "test")
        out[k] = p.select("asin", F.col(MD.LABEL).alias("actual"), "prediction").crossJoin(F.broadcast(MD.axis_limits(p)))
    return MD.each_model(out)


@register("ml_21")
def ml_21(spark, d):
    store = _store(spark, d)
    model = load_model(spark, store.catalog().where("is_default").first()["path"])
    return MD.score(store.pipeline(), model, store.table()).select("asin", "prediction", "predicted_units", "potential")


@register("ml_22")
def ml_22(spark, d):
    return _store(spark, d).catalog()
