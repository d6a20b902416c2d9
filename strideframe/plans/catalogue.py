"""All registered queries."""

from strideframe.plans import budget_queries, cleaning_queries, comparison_queries, feature_queries, measure_queries, model_queries, series_queries, study_queries  # noqa: F401
from strideframe.plans.registry import ORACLES, QUERIES  # noqa: F401
