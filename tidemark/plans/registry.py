"""All registered queries; importing this module loads every plan."""

from tidemark.plans.base import ORACLES, QUERIES
from tidemark.plans import q_features, q_labels_splits, q_eval, q_detector, q_models, q_streaming, q_chunked  # noqa: F401  isort: skip

__all__ = ["ORACLES", "QUERIES"]
