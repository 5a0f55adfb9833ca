"""Operators for preparing training text: duplicates, secrets, language, packing, scoring, search, tokens.

Every operator takes and returns DataFrames. Nothing else in the library imports this subpackage.
"""
