"""Every registered query, by importing the modules that register them."""

from . import contract_plans, evidence_plans, graph_plans, history_plans, memory_plans, reader_plans, retrieval_plans, rules_plans, streaming_plans, upkeep_plans  # noqa: F401
from .registry import CATALOGUE

__all__ = ["CATALOGUE"]
