"""Functions of the sports analytics library."""
