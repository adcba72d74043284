"""Cohort and event-time analytics as Spark DataFrame operations."""

from tidemark.session import apply_settings, build_session, cut_lineage

__all__ = ["apply_settings", "build_session", "cut_lineage"]
