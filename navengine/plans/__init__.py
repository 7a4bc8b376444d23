from . import audit_queries, queries, report_queries, run_queries, selection_queries, store_queries

__all__ = ["audit_queries", "queries", "report_queries", "run_queries", "selection_queries", "store_queries"]
