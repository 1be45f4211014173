"""Bibliographic record analytics on PySpark."""
