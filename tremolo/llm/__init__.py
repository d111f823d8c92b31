"""Operators of a large-scale training-data pipeline, one module each.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
