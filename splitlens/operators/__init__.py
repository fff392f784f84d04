"""Audit operators on canonical records."""
