"""Operators for preparing training text: filtering, deduplication, extraction, tokenizing.

Nothing else in the library imports this subpackage.
"""
