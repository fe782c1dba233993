"""Model table, feature pipeline, evaluation and scoring (CLN-22, ML-04..ML-22).

Features are Spark ML: a ``Pipeline`` of our estimators, ``StringIndexer`` +
``OneHotEncoder`` and ``VectorAssembler``. The linear model is solved from
sums (``gram``), forests and boosted trees are grown on binned rows
(``trees``), and ``store`` keeps what is fitted. Metrics are plain aggregates
over the prediction frame. Parity of model numbers with other libraries is
not a goal; the operators around the models are exact.
"""

from __future__ import annotations

import functools

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import parse
from marketlens.ml.estimators import PopulationScaler, QuantileClipper, SparseColumnDropper, impute_constants
from marketlens.ml.scoring import back_transform
from marketlens.functions.bins import potential_badge
from marketlens.operators import clean as C
from marketlens.operators.ranking import hash_split

# The model's feature groups.
SKEWED = ["price", "original_price", "reviews", "number_of_offers", "delivery_fee", "discount",
          "lowest_offer_price"]
STABLE = ["rating", "discount_rate"]
CATEGORICAL = ["crawl_category"]
FLAGS = ["is_prime", "is_amazon_choice", "is_climate_friendly", "has_variations"]
LABEL = "target_log"


def model_table(products: DataFrame, seed: int = 42) -> DataFrame:
    """CLN-22: the model path's clean, from first-row products (W-01 done).

    listed columns dropped -> placeholders -> numeric coercion -> range rules ->
    boolean domain -> sparse columns dropped (learnt from the rows) -> fills -> drop rows without price/rating -> discount features -> sales and
    delivery parsing -> log1p target -> 70/15/15 hash split.
    """
    df = C.replace_placeholders(C.drop_columns(products, C.UNNECESSARY_FEATURES))
    df = C.coerce_numeric(df, ["price_cents", "original_price_cents", "rating_x10", "reviews",
                               "number_of_offers"])
    df = df.withColumns({"price": F.col("price_cents") / 100,
                         "original_price": F.col("original_price_cents") / 100,
                         "rating": F.col("rating_x10") / 10})
    df = C.apply_range_rules(df)
    df = C.enforce_bool_domain(df)
    df = SparseColumnDropper(protected=["asin", "price", "original_price", "rating", "sales_volume", "delivery_info"]).fit(df).transform(df)
    df = C.fill_missing(df, {"original_price": "price"},
                        {"sales_volume": C.NO_SALES_TEXT, "delivery_info": C.NO_DELIVERY_TEXT})
    df = C.drop_incomplete(df, ["price", "rating"])
    disc = F.col("original_price") - F.col("price")
    df = df.withColumns({
        "discount": disc,
        "price": C.clip("price", lower=0),
        "discount_rate": F.when(F.col("original_price") > 0, disc / F.col("original_price"))
        .otherwise(F.lit(0.0)),
        "sales_volume_num": parse.sales_number_truncated("sales_volume"),
        "delivery_fee": parse.delivery_fee_lenient("delivery_info"),
    })
    df = C.bools_to_int(df)
    df = df.withColumn(LABEL, F.log1p("sales_volume_num"))
    df = hash_split(df, "asin", seed)
    keep = ["asin", "split", LABEL, "sales_volume_num", "price", "original_price", "rating",
            "reviews", "number_of_offers", "delivery_fee", "discount", "discount_rate",
            "crawl_category", *FLAGS]
    return df.select(*[c for c in keep if c in df.columns])


def feature_pipeline() -> Pipeline:
    """ML-06: skewed -> log1p, quantile clip, population scale; stable -> scale;
    category -> one-hot (sorted, unseen -> all zeros); flags pass through."""
    log_clip = QuantileClipper(inputCols=SKEWED, lowerQuantile=0.01, upperQuantile=0.99,
                               logFirst=True, outputSuffix="_lc")
    scale_skewed = PopulationScaler(inputCols=[c + "_lc" for c in SKEWED], outputSuffix="_s")
    scale_stable = PopulationScaler(inputCols=STABLE, outputSuffix="_s")
    idx = StringIndexer(inputCol="crawl_category", outputCol="crawl_category_idx",
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCol="crawl_category_idx", outputCol="crawl_category_ohe",
                        dropLast=True, handleInvalid="error")
    assemble = VectorAssembler(
        inputCols=[c + "_lc_s" for c in SKEWED] + [c + "_s" for c in STABLE]
        + ["crawl_category_ohe"] + FLAGS, outputCol="features")
    return Pipeline(stages=[log_clip, scale_skewed, scale_stable, idx, ohe, assemble])


def prepare_features(df: DataFrame) -> DataFrame:
    """ML-05: impute 0.0 / 'missing' so the assembler never sees NULL."""
    return impute_constants(df, SKEWED + STABLE + FLAGS, CATEGORICAL)


def fit_features(train: DataFrame) -> PipelineModel:
    """ML-07: fit the feature pipeline on the training split only."""
    return feature_pipeline().fit(prepare_features(train))


def feature_names(transformed: DataFrame, col: str = "features") -> list[str]:
    """ML-09: names of the assembled vector's slots from its ML attribute metadata."""
    meta = transformed.schema[col].metadata.get("ml_attr", {})
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs.extend(group)
    names = [None] * meta.get("num_attrs", len(attrs))
    scaled = {c + "_lc_s" for c in SKEWED} | {c + "_s" for c in STABLE}
    for a in attrs:
        n = a.get("name", f"f{a['idx']}")
        if n.startswith("crawl_category_ohe_"):
            n = "crawl_category_" + n.removeprefix("crawl_category_ohe_")
        elif n in scaled or n.rsplit("_", 1)[0] in scaled:  # some slots carry a number at the end
            n = n.removesuffix("_s").removesuffix("_lc")
        names[a["idx"]] = n.replace("[", "").replace("]", "").replace("<", "")
    return [n or f"f{i}" for i, n in enumerate(names)]


def feature_name_frame(spark: SparkSession, transformed: DataFrame) -> DataFrame:
    names = feature_names(transformed)
    return spark.createDataFrame(list(enumerate(names)), "idx int, feature string")


def save_pipeline(model: PipelineModel, path: str) -> None:
    """ML-08: persist a fitted pipeline (overwrite)."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def ensure_pipeline(path: str, sample: DataFrame) -> PipelineModel:
    """ML-08: load if present, else fit on ``sample`` and save."""
    spark = sample.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return load_pipeline(path)
    m = fit_features(sample)
    save_pipeline(m, path)
    return m


# ---------------------------------------------------------------------------
# Evaluation (the models are in trees, gram and store)
# ---------------------------------------------------------------------------

def metrics(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """ML-14: RMSE, MAE, R^2 as one aggregate (R^2 from the label's own mean)."""
    y, p = F.col(label), F.col(prediction)
    n = F.count(F.lit(1))
    sst = F.var_pop(y) * n
    return pred.agg(F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
                    F.avg(F.abs(y - p)).alias("mae"),
                    (F.lit(1.0) - F.sum((y - p) * (y - p)) / sst).alias("r2"),
                    n.alias("rows"))


def each_model(frames: dict) -> DataFrame:
    """One frame per model, stacked, with the model's name as a column."""
    named = [df.withColumn("model", F.lit(name)) for name, df in frames.items()]
    return functools.reduce(DataFrame.unionByName, named)


def importances(model, names: list[str], spark: SparkSession, k: int = 10) -> DataFrame:
    """ML-16: top-k |coefficient| (linear) or shares of gain (trees)."""
    values = [float(v) for v in model.importances()]
    df = spark.createDataFrame(list(zip(names, values)), "feature string, importance double")
    return df.orderBy(F.col("importance").desc(), "feature").limit(k)


def residuals(pred: DataFrame) -> DataFrame:
    """ML-19: residual per row (label - prediction)."""
    return pred.withColumn("residual", F.col(LABEL) - F.col("prediction"))


def axis_limits(pred: DataFrame) -> DataFrame:
    """ML-20: common axis limits of predicted-vs-actual."""
    return pred.agg(F.least(F.min(LABEL), F.min("prediction")).alias("low"),
                    F.greatest(F.max(LABEL), F.max("prediction")).alias("high"))


def score(features_model: PipelineModel, model, rows: DataFrame) -> DataFrame:
    """ML-21: batch scoring: features -> prediction -> units -> potential badge."""
    p = model.transform(features_model.transform(prepare_features(rows)))
    units = back_transform("prediction")
    return p.withColumn("predicted_units", units) \
        .withColumn("potential", potential_badge(F.col("predicted_units")))
