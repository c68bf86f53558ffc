"""Operators of the sports analytics library."""
