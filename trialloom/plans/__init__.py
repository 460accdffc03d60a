"""Registered queries by family."""

from importlib import import_module

FAMILIES = [
    "record_queries", "design_queries", "retrieval_queries", "contract_queries", "metric_queries", "signal_queries", "probe_queries",
    "source_queries",
]


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"trialloom.plans.{family}")
