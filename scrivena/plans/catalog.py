"""All registered queries of the library."""

from scrivena.plans import cleaning_queries, feature_queries, model_queries, reporting_queries, split_queries, stream_queries  # noqa: F401
from scrivena.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
