"""Operators for preparing training text. Nothing else in the library imports
this package; its queries are in `queries.py`."""
