"""Inputs, derived tables and sinks."""
