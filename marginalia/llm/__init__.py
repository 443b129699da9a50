"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; it can be deleted whole.
"""
