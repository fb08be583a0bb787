"""Operators for large training-data pipelines, one module each.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
thin driver queries; the modules hold the operators with their own interfaces.
"""
