"""Feature estimators with fitted state kept as Params (ML-01..ML-03, ML-05).

Each fit is ONE aggregate over all input columns (exact ``percentile`` /
``avg`` / ``stddev_pop``); transform is a single projection of built-in
expressions. Saving and loading inside a ``PipelineModel`` works through
``DefaultParamsWritable`` / ``DefaultParamsReadable`` (the classes live in an
importable module).
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _ClipParams(HasInputCols):
    lowerQuantile = Param(Params._dummy(), "lowerQuantile", "lower quantile",
                          typeConverter=TypeConverters.toFloat)
    upperQuantile = Param(Params._dummy(), "upperQuantile", "upper quantile",
                          typeConverter=TypeConverters.toFloat)
    logFirst = Param(Params._dummy(), "logFirst", "null->0 then log1p before clipping",
                     typeConverter=TypeConverters.toBoolean)
    outputSuffix = Param(Params._dummy(), "outputSuffix", "suffix of output columns ('' = in place)",
                         typeConverter=TypeConverters.toString)

    def _prepared(self, df: DataFrame, c: str):
        if c not in df.columns:                         # absent column -> 0 (ML-02)
            x = F.lit(0.0)
        else:
            x = F.col(c).cast("double")
        if self.getOrDefault(self.logFirst):
            # negative values would make log1p undefined below -1: floor at 0
            x = F.log1p(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
        return x


class QuantileClipper(Estimator, _ClipParams, DefaultParamsReadable, DefaultParamsWritable):
    """ML-01 (``logFirst=False``) / ML-02 (``logFirst=True``, suffix ``_log_clipped``):
    learn per-column lower/upper quantiles, clip to them."""

    @keyword_only
    def __init__(self, *, inputCols=None, lowerQuantile=0.01, upperQuantile=0.99,
                 logFirst=False, outputSuffix=""):
        super().__init__()
        self._setDefault(lowerQuantile=0.01, upperQuantile=0.99, logFirst=False, outputSuffix="")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "QuantileClipperModel":
        cols = self.getInputCols()
        lo, hi = self.getOrDefault(self.lowerQuantile), self.getOrDefault(self.upperQuantile)
        aggs = [F.percentile(self._prepared(df, c), F.array(F.lit(lo), F.lit(hi))).alias(f"q{i}")
                for i, c in enumerate(cols)]
        row = df.agg(*aggs).collect()[0]          # one row: 2 numbers per column
        lows = [float(row[f"q{i}"][0]) if row[f"q{i}"] is not None else 0.0 for i in range(len(cols))]
        highs = [float(row[f"q{i}"][1]) if row[f"q{i}"] is not None else 0.0 for i in range(len(cols))]
        m = QuantileClipperModel(inputCols=cols, lows=lows, highs=highs,
                                 logFirst=self.getOrDefault(self.logFirst),
                                 outputSuffix=self.getOrDefault(self.outputSuffix))
        return self._copyValues(m)


class QuantileClipperModel(Model, _ClipParams, DefaultParamsReadable, DefaultParamsWritable):
    lows = Param(Params._dummy(), "lows", "fitted lower bounds", typeConverter=TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "fitted upper bounds", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, lows=None, highs=None, logFirst=False, outputSuffix="",
                 lowerQuantile=0.01, upperQuantile=0.99):
        super().__init__()
        self._setDefault(logFirst=False, outputSuffix="", lowerQuantile=0.01, upperQuantile=0.99)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        lows, highs = self.getOrDefault(self.lows), self.getOrDefault(self.highs)
        suffix = self.getOrDefault(self.outputSuffix)
        out = {}
        for c, lo, hi in zip(cols, lows, highs):
            x = self._prepared(df, c)
            out[c + suffix] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
        return df.withColumns(out)


class _ScaleParams(HasInputCols):
    outputSuffix = Param(Params._dummy(), "outputSuffix", "suffix of output columns",
                         typeConverter=TypeConverters.toString)


class PopulationScaler(Estimator, _ScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    """ML-03: (x - mean) / population std; a zero-variance column divides by 1."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputSuffix=""):
        super().__init__()
        self._setDefault(outputSuffix="")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PopulationScalerModel":
        cols = self.getInputCols()
        aggs = []
        for i, c in enumerate(cols):
            aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
        row = df.agg(*aggs).collect()[0]
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(cols))]
        stds = [float(row[f"s{i}"] or 0.0) for i in range(len(cols))]
        stds = [s if s > 0 else 1.0 for s in stds]
        return self._copyValues(PopulationScalerModel(inputCols=cols, means=means, stds=stds,
                                                      outputSuffix=self.getOrDefault(self.outputSuffix)))


class PopulationScalerModel(Model, _ScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "fitted means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "fitted population stds", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, means=None, stds=None, outputSuffix=""):
        super().__init__()
        self._setDefault(outputSuffix="")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        suffix = self.getOrDefault(self.outputSuffix)
        return df.withColumns({
            c + suffix: (F.col(c) - F.lit(m)) / F.lit(s)
            for c, m, s in zip(self.getInputCols(), self.getOrDefault(self.means),
                               self.getOrDefault(self.stds))})


class _SparseParams(Params):
    threshold = Param(Params._dummy(), "threshold", "percent of missing values from which a column goes", typeConverter=TypeConverters.toFloat)
    protected = Param(Params._dummy(), "protected", "columns that stay whatever they miss", typeConverter=TypeConverters.toListString)


class SparseColumnDropper(Estimator, _SparseParams, DefaultParamsReadable, DefaultParamsWritable):
    """CLN-12: learn which columns miss at least ``threshold`` percent of their values (one aggregate
    over all columns), and drop them; the model drops the same columns from any later table."""

    @keyword_only
    def __init__(self, *, threshold=85.0, protected=None):
        super().__init__()
        self._setDefault(threshold=85.0, protected=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> "SparseColumnDropperModel":
        cols = [c for c in df.columns if c not in self.getOrDefault(self.protected)]
        row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        sparse = [c for i, c in enumerate(cols) if row["n"] and row[f"m{i}"] * 100.0 / row["n"] >= self.getOrDefault(self.threshold)]
        return self._copyValues(SparseColumnDropperModel(dropped=sparse))


class SparseColumnDropperModel(Model, _SparseParams, DefaultParamsReadable, DefaultParamsWritable):
    dropped = Param(Params._dummy(), "dropped", "columns to drop", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, dropped=None, threshold=85.0, protected=None):
        super().__init__()
        self._setDefault(threshold=85.0, protected=[], dropped=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getOrDefault(self.dropped))


def impute_constants(df: DataFrame, numeric_cols, category_cols, category_value: str = "missing"):
    """ML-05: 0.0 for numeric columns, a constant label for categories (absent -> added)."""
    out = {}
    for c in numeric_cols:
        out[c] = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
    for c in category_cols:
        out[c] = F.coalesce(F.col(c), F.lit(category_value)) if c in df.columns else F.lit(category_value)
    return df.withColumns(out)
