"""Queries composed from the operators, and the registry that names them."""
