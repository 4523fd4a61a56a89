"""Operators for preparing training data: language, duplicates, secrets, mixing, packing, archives.

Nothing else in the library imports this subpackage.
"""
