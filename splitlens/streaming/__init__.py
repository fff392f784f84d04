"""Incremental audits on streams."""
