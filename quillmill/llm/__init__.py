"""Operators for preparing training data: one module per operator.

Nothing outside this subpackage imports it; the entry module registers its
queries only when it can be imported.
"""
