"""Streaming of the sports analytics library."""
