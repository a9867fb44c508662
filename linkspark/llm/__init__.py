"""Operators on names, addresses and texts. Nothing outside this subpackage imports it."""
