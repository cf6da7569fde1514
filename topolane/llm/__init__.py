"""Operators for text that becomes training data; nothing outside this subpackage imports it."""
