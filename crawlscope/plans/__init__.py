"""Whole audits and the reports on them."""
