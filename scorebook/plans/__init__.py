"""Plans of the sports analytics library."""
