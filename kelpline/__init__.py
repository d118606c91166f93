"""Bitemporal change-data-capture analytics on PySpark."""
