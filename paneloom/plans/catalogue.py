"""All registered queries."""

from importlib import import_module

from paneloom.plans.bindings import QUERIES, SQL

for _module in (
    "panel_queries",
    "evidence_queries",
    "label_queries",
    "metric_queries",
    "feature_queries",
    "model_queries",
    "robustness_queries",
    "report_queries",
):
    import_module(f"paneloom.plans.{_module}")

__all__ = ["QUERIES", "SQL"]
