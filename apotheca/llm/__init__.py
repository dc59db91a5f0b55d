"""Operators that prepare text, pages and vectors for training; nothing outside this subpackage imports it."""
