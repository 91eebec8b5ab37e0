"""Operators for preparing language-model training data at corpus scale.

Nothing outside this subpackage imports it; `queries.py` holds the thin
queries that the entry module registers when the subpackage is present.
"""
