"""Sources of the sports analytics library."""
