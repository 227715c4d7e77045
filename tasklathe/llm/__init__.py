"""Operators for large training-data pipelines, one module each.

Nothing outside this subpackage imports it.  ``registry`` lists the driver
queries; the operators themselves have general interfaces of their own.
"""
