"""Pipeline stages: random kernel features and a macro-F1 evaluator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.operators.models.ensembles import score


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random cosine features of a vector column; their products approximate a radial kernel."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    count = Param(Params._dummy(), "count", "number of cosines", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "input features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the draw", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="vector", outputCol="kernel", gamma=0.01, count=128, width=1, seed=42):
        super().__init__()
        self._setDefault(gamma=0.01, count=128, width=1, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, count, width = (self.getOrDefault(p) for p in (self.gamma, self.count, self.width))
        draw = np.random.default_rng(self.getOrDefault(self.seed))
        weights = draw.normal(scale=np.sqrt(2 * gamma), size=(width, count))
        shifts = draw.uniform(0, 2 * np.pi, size=count)

        @F.pandas_udf("array<double>")
        def cosines(values: pd.Series) -> pd.Series:
            rows = np.array(values.tolist(), dtype=np.float64)
            return pd.Series(list(np.sqrt(2 / count) * np.cos(rows @ weights + shifts)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(cosines(vector_to_array(self.getInputCol()))))


class MacroF1(Evaluator, HasLabelCol, HasPredictionCol):
    """Unweighted mean of the F1 of all labels (MLlib's own ``f1`` is weighted)."""

    @keyword_only
    def __init__(self, *, labelCol="label", predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        return score(dataset, self.getLabelCol(), self.getPredictionCol())[1]

    def isLargerBetter(self) -> bool:
        return True
