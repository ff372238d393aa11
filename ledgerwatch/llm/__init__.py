"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it; remove the folder and the rest of
the library still works.
"""
