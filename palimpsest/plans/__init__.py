"""Registered queries over the library's operators."""
