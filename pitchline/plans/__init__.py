"""All registered queries."""

from pitchline.plans import (  # noqa: F401
    aggregate_queries, join_queries, model_queries, prior_queries, report_queries, source_queries, stream_queries,
    text_queries,
)
from pitchline.plans.registry import ORACLES, QUERIES  # noqa: F401
