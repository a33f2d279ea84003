"""Operators that prepare text and vectors for training collections.

Nothing outside this package imports it; the driver entry adds its queries when it is present.
"""
