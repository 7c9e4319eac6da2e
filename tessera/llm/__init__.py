"""Operators for large training collections. Nothing outside this subpackage imports it."""
