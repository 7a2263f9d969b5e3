"""Whole reports: the set of tables, publishing them, and one-row documents."""

from custvalue.plans.reports import (
    Inputs,
    Reports,
    load_reports,
    publish,
    report_tables,
    scored_clv,
)

__all__ = ["Inputs", "Reports", "load_reports", "publish", "report_tables", "scored_clv"]
