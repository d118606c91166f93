"""Operators over data frames; none of them runs a job unless its docstring says so."""
