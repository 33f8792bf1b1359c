"""Operators on DataFrames: each takes and returns plans, none runs a job unless its docstring says so."""
