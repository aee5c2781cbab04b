"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it; ``queries`` holds the thin queries
that apply every operator to the driver's tables.
"""
