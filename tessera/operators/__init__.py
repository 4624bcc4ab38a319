"""Predicates, ordering, budgets, rendering and sinks over a relation of files."""
