"""Preprocessing of the model pipelines as saveable ``pyspark.ml`` stages.

Each stage keeps what it has fitted in parameters (one number or two a column), so it is saved and loaded with
its pipeline. Nothing here gathers a column: medians come from the distributed quantile operator, moments from
partial aggregates.
"""

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.operators.quantiles import multi_quantile_columns


class _Columns(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns read", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "columns written", TypeConverters.toListString)

    def _pairs(self) -> list[tuple[str, str]]:
        return list(zip(self.getOrDefault(self.inputCols), self.getOrDefault(self.outputCols), strict=True))


class _Persisted(DefaultParamsReadable, DefaultParamsWritable):
    pass


def _present(c: str) -> Column:
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


class MedianImputerModel(Model, _Columns, _Persisted):
    """Writes each column with NULL and NaN replaced by its median."""

    medians = Param(Params._dummy(), "medians", "median of each column", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        filled = zip(self._pairs(), self.getOrDefault(self.medians))
        return dataset.withColumns({o: F.coalesce(_present(c), F.lit(m)) for (c, o), m in filled})


class MedianImputer(Estimator, _Columns, _Persisted):
    """The median of the present values of each column (mean of the middle two); 0 where a column has none (G1)."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        cols = self.getOrDefault(self.inputCols)
        row = multi_quantile_columns(dataset, [], {c: (c, 0.5) for c in cols}).first()
        return MedianImputerModel()._set(inputCols=cols, outputCols=self.getOrDefault(self.outputCols),
                                         medians=[0.0 if row is None or row[c] is None else row[c] for c in cols])


class PopulationScalerModel(Model, _Columns, _Persisted):
    means = Param(Params._dummy(), "means", "mean of each column", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population deviation of each column, 1 for 0", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        moments = zip(self._pairs(), self.getOrDefault(self.means), self.getOrDefault(self.stds))
        return dataset.withColumns({o: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for (c, o), m, s in moments})


class PopulationScaler(Estimator, _Columns, _Persisted):
    """``(x - mean) / population deviation``, the deviation 0 counted as 1 (G12). NULL and NaN aren't counted."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> PopulationScalerModel:
        cols = self.getOrDefault(self.inputCols)
        row = dataset.agg(*[F.avg(_present(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                          *[F.stddev_pop(_present(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        return PopulationScalerModel()._set(
            inputCols=cols, outputCols=self.getOrDefault(self.outputCols),
            means=[row[f"m{i}"] or 0.0 for i in range(len(cols))], stds=[row[f"s{i}"] or 1.0 for i in range(len(cols))])


class LogTargetInverse(Transformer, _Persisted):
    """The last stage of a model of the log target: ``max(expm1(p * std + mean), 0)`` in place of its prediction."""

    mean = Param(Params._dummy(), "mean", "mean of log1p(target)", TypeConverters.toFloat)
    std = Param(Params._dummy(), "std", "population deviation of log1p(target)", TypeConverters.toFloat)
    predictionCol = Param(Params._dummy(), "predictionCol", "column rewritten", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, mean=None, std=None, predictionCol="prediction"):
        super().__init__()
        self._setDefault(predictionCol="prediction")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        p = self.getOrDefault(self.predictionCol)
        z = F.col(p) * F.lit(self.getOrDefault(self.std)) + F.lit(self.getOrDefault(self.mean))
        return dataset.withColumn(p, F.greatest(F.expm1(z), F.lit(0.0)))
