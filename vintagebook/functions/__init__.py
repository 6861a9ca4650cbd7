"""Column expressions: text cleaning, names, numbers, identifiers, labels."""
