"""Whole audits."""
