"""Compositions of operators and their bindings to the driver tables."""
