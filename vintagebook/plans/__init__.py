"""User-facing queries composed from the operators, and their binding to test tables."""
