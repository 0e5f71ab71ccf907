"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. ``queries.py`` registers one query per
operator; each operator module keeps its own general interface.
"""
