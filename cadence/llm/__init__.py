"""Operators for preparing language-model training data.

Nothing else in the library imports this package; the registered queries are in
``queries`` and the DuckDB statements in ``oracle``.
"""
