"""Readers that give canonical records."""
