"""Derived tables, pipelines and the registered queries."""
