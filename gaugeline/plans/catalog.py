"""All registered queries (importing the modules fills the registry)."""

from gaugeline.plans import q_checked, q_decision, q_fusion, q_history, q_learn, q_models, q_profile, q_tables, q_uncertainty  # noqa: F401
from gaugeline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
