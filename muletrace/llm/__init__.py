"""Operators for text training data: formatting, screening, deduplication, decontamination and encoding.

Nothing else in the package imports this one.
"""
